"""Classification of a table of any length on the executors.

Batches are numbered and their costs summed by ranges. A round admits every batch
that the budget would carry even if each had to be asked about twice, asks about
them on the executors, and takes what was really spent off the budget; so rounds
spend what a loop over the batches would spend, and there are about as many as the
budget has binary digits in batches. Replies are written before they are read: a
later step that fails asks nobody again (a task that fails does). The driver sees
batch numbers and sums, no items.
"""

import json
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.replies import parsed_entry, reply_entries
from ..session import materialize
from .classify import FALLBACK, FIELDS, ProviderError, batch_cost, item_length
from .relational import clean_secondaries, row_numbers, running_sums

LABEL = ["topic", "secondary_topics", "score", "rationale"]
REPLY = "batch long, called boolean, reply string"


def batch_queue(pending: DataFrame, order: list[str], size: int, prompt: str) -> DataFrame:
    """(batch, items, cost, spent) of ``pending`` (id, title, source, summary, url and
    the columns of ``order``): batches of ``size`` items from 0, an array of items each,
    the estimate of a call, and the estimates up to and with it."""
    numbered = row_numbers(pending, [F.col(c) for c in order], "k")
    item = F.struct("k", *FIELDS, item_length({f: F.col(f) for f in FIELDS}).cast("long").alias("letters"))
    lists = numbered.withColumn("batch", F.floor((F.col("k") - 1) / size)).groupBy("batch").agg(F.sort_array(F.collect_list(item)).alias("items"))
    priced = lists.withColumn("cost", batch_cost(prompt, _letters("items")))
    return materialize(running_sums(priced, [F.col("batch")], "cost", "spent"), "batches")


def _letters(items: str):
    return F.aggregate(items, F.lit(0).cast("long"), lambda total, i: total + i["letters"])


def _asked(batches: DataFrame, provider, prompt: str, temperature: float, max_failures: int, tasks: int, name: str) -> DataFrame:
    """A reply per batch (null: the call failed), one call after another in a task.
    After ``max_failures`` failures in a row a task makes no further call."""

    def reply(items):
        if hasattr(provider, "ask"):
            return provider.ask(prompt, items, temperature)
        return json.dumps([{"id": k, **v} for k, v in provider.classify(prompt, items, temperature).items()], ensure_ascii=False)

    def visit(frames):
        failures = 0
        for frame in frames:
            rows = []
            for batch, items in zip(frame["batch"], frame["items"]):
                called, text = failures < max_failures, None
                if called:
                    try:
                        text, failures = reply([{f: i[f] for f in FIELDS} for i in items]), 0
                    except ProviderError:
                        failures += 1
                rows.append((batch, called, text))
            yield pd.DataFrame(rows, columns=["batch", "called", "reply"])

    dealt = batches.select("batch", "items").repartitionByRange(tasks, "batch").sortWithinPartitions("batch")
    return materialize(dealt.mapInPandas(visit, REPLY), name)


def _labels(asked: DataFrame, members: DataFrame, topics: list[str]) -> DataFrame:
    """(batch, id, label) of members whose first valid entry has a known topic."""
    entries = asked.select("batch", F.posexplode(reply_entries(F.col("reply"))).alias("pos", "v"))
    rows = entries.select("batch", "pos", parsed_entry(F.col("v")).alias("e")).filter("e IS NOT NULL").select("batch", "pos", F.col("e.id").alias("id"), "e")
    first = F.row_number().over(Window.partitionBy("batch", "id").orderBy("pos"))
    mine = rows.join(members.select("batch", "id"), ["batch", "id"], "left_semi").withColumn("_k", first).filter("_k = 1")
    known = mine.filter(F.col("e.topic").isin(topics))
    return known.select("batch", "id", F.struct("e.topic", clean_secondaries(F.col("e.secondary_topics"), F.col("e.topic"), topics).alias("secondary_topics"), "e.score", "e.rationale").alias("label"))


def _round(chosen: DataFrame, provider, prompt, topics, temperature, fallback_topic, max_failures, tasks, second_budget):
    """(outcome of every item of ``chosen``, tokens spent, whether a task gave up)."""
    members = chosen.select("batch", F.explode("items").alias("i")).select("batch", "i.*")
    first = _asked(chosen, provider, prompt, temperature, max_failures, tasks, "replies")
    found = materialize(_labels(first, members, topics), "labels")
    open_ = members.join(first.filter("called").select("batch"), "batch", "left_semi").join(found, ["batch", "id"], "left_anti")
    rest = open_.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("k", *FIELDS, "letters"))).alias("items")).withColumn("cost", batch_cost(prompt, _letters("items")))
    if second_budget is not None:
        rest = rest.filter(F.col("cost") <= second_budget)
    rest = materialize(rest, "second-batches")
    second = _asked(rest, provider, prompt, 0.0, max_failures, tasks, "second-replies")
    labels = found.unionByName(_labels(second, rest.select("batch", F.explode("items").alias("i")).select("batch", "i.id"), topics))
    heard = first.unionByName(second).filter(reply_entries(F.col("reply")).isNotNull()).select("batch").distinct().withColumn("heard", F.lit(True))
    default = F.struct(F.lit(fallback_topic).alias("topic"), F.array().cast("array<string>").alias("secondary_topics"), F.lit(FALLBACK["score"]).alias("score"), F.lit(FALLBACK["rationale"]).alias("rationale"))
    known = members.join(labels, ["batch", "id"], "left").join(heard, "batch", "left")
    outcome = F.when(F.col("label").isNotNull(), "classified").when(F.col("heard"), "fallback").otherwise("skipped")
    label = F.coalesce("label", F.when(F.col("heard"), default))
    out = materialize(known.select("id", outcome.alias("outcome"), label.alias("label")).select("id", "outcome", "label.*"), "outcomes")
    spent = lambda asked, of: asked.filter("called").join(of, "batch").agg(F.coalesce(F.sum("cost"), F.lit(0))).first()[0]
    gave_up = not first.filter("NOT called").isEmpty()
    return out, spent(first, chosen.select("batch", "cost")) + spent(second, rest.select("batch", "cost")), gave_up


def classify_table(pending: DataFrame, provider, prompt: str, topics, order=("ingested_at", "canonical_hash"), batch_size: int = 10, temperature: float = 0.2,
                   token_budget: int | None = None, fallback_topic: str = "other", max_failures: int = 3, tasks: int = 8) -> DataFrame:
    """(canonical_hash, outcome, topic, secondary_topics, score, rationale) of every row
    of ``pending`` (canonical_hash unique, title, source_name, summary, url, ``order``).

    ``outcome`` is classified, fallback (the provider answered, but gave no valid
    label) or skipped (nothing else is set), as in ``classify_items``: a batch is one
    call, its items without a label are asked about once more at temperature 0, the
    first batch runs whatever it costs, and the first that the budget does not carry
    ends the run. At most ``tasks`` calls run at a time. A task gives up after
    ``max_failures`` failed calls in a row, and no round follows; other tasks' batches
    keep what they got. An empty table gives an empty one.
    """
    topics = sorted(topics)
    columns = [F.col("canonical_hash").alias("id"), "title", F.col("source_name").alias("source"), "summary", "url", *[F.col(c).alias(f"_{k}") for k, c in enumerate(order)]]
    queue = batch_queue(pending.select(*columns), [f"_{k}" for k in range(len(order))], batch_size, prompt)
    done, before, left, out = -1, 0, token_budget, []
    while True:
        ahead, second = queue.filter(F.col("batch") > done), None
        if left is not None:
            ahead = ahead.filter(2 * (F.col("spent") - before) <= left)
        top = ahead.agg(F.max("batch").alias("batch"), F.max("spent").alias("spent")).first()
        if top["batch"] is None:  # nothing that is sure to fit: the next one alone, or the end
            ahead = queue.filter(F.col("batch") == done + 1)
            top = ahead.select("batch", "spent", "cost").first()
            if top is None or (top["cost"] > left and done >= 0):
                break
            second = max(0, left - top["cost"])
        rows, cost, gave_up = _round(ahead, provider, prompt, topics, temperature, fallback_topic, max_failures, tasks, second)
        out.append(rows)
        done, before = top["batch"], top["spent"]
        left = None if left is None else max(0, left - cost)
        if gave_up:
            break
    unread = queue.filter(F.col("batch") > done).select(F.explode("items").alias("i")).select("i.id", F.lit("skipped").alias("outcome"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*out, unread]).select(
        F.col("id").alias("canonical_hash"), "outcome", *[(F.col(c) if out else F.lit(None).cast(t)).alias(c) for c, t in zip(LABEL, ["string", "array<string>", "int", "string"])])
