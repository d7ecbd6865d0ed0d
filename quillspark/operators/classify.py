"""Budgeted batch classification: prompts, replies, and the loop over a short list.

A provider is any object with ``model_id`` and ``classify(prompt, items,
temperature) -> {id: entry}``; one with ``ask(prompt, items, temperature) -> reply``
leaves the reading of replies to Spark. :mod:`.admission` classifies a table of any
length on the executors, with the same outcomes.
"""

import hashlib
import json
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.replies import parsed_entry, reply_entries
from .relational import align_replies

FALLBACK = {"score": 3, "rationale": "classifier produced no valid label; default applied", "secondary_topics": []}
RESULT = "canonical_hash string, topic string, secondary_topics array<string>, score int, rationale string"


#: What a provider is told of an item.
FIELDS = ("id", "title", "source", "summary", "url")


class ProviderError(Exception):
    """A call failed, or its reply could not be read at all."""


class Provider(Protocol):
    model_id: str

    def classify(self, prompt: str, items: list[dict], temperature: float) -> dict[str, dict]: ...


def items_message(items: list[dict]) -> str:
    """The batch as JSON; escaping keeps a feed's text from posing as structure."""
    return json.dumps([{k: i.get(k) for k in FIELDS} for i in items], ensure_ascii=False)


def token_estimate(prompt: str, items: list[dict]) -> int:
    return (len(prompt) + len(items_message(items))) // 4 + 16


def _json_length(c: Column) -> Column:
    """Letters of a string, or null, written as JSON."""
    escaped = F.length(c) - F.length(F.translate(c, '"\\\n\r\t\b\f', ""))
    coded = F.length(c) - F.length(F.regexp_replace(c, r"[\x00-\x07\x0b\x0e-\x1f]", ""))
    return F.when(c.isNull(), 4).otherwise(F.length(c) + 2 + escaped + 5 * coded)


def item_length(item: dict[str, Column]) -> Column:
    """Letters that an item (a column per key of FIELDS) adds to the message, with the
    two that part it from the next."""
    frame = len(json.dumps(dict.fromkeys(FIELDS, ""))) - 2 * len(FIELDS) + 2
    return sum((_json_length(item[k]) for k in FIELDS), F.lit(frame))


def batch_cost(prompt: str, letters: Column) -> Column:
    """:func:`token_estimate` of a batch from the sum of its :func:`item_length`."""
    return (F.floor((F.lit(len(prompt)) + letters) / 4) + 16).cast("long")


def classifier_version(prompt: str, model: str) -> str:
    return "cls-" + hashlib.sha256(f"{prompt}\0{model}".encode()).hexdigest()[:12]


def version_of(prompt: Column, model: Column) -> Column:
    """:func:`classifier_version` of columns."""
    return F.concat(F.lit("cls-"), F.left(F.sha2(F.concat(prompt, F.lit("\0"), model), 256), F.lit(12)))


def parse_replies(replies: DataFrame, known: DataFrame) -> DataFrame:
    """(id, topic, score, rationale, secondary_topics) of replies (reply_id, reply)
    aligned to the ids in ``known``: per id the first valid entry."""
    entries = replies.select("reply_id", F.posexplode(reply_entries(F.col("reply"))).alias("pos", "v"))
    rows = entries.withColumn("e", parsed_entry(F.col("v"))).filter("e IS NOT NULL").select("reply_id", F.struct("reply_id", "pos").alias("pos"), "e.*")
    return align_replies(rows, known).drop("pos")


def parse_reply(spark: SparkSession, text: str, ids: list[str]) -> dict[str, dict]:
    """One reply, for providers. Raises ProviderError if it holds no list."""
    df = spark.createDataFrame([(0, text)], "reply_id int, reply string")
    if df.select(reply_entries(F.col("reply")).isNull().alias("bad")).first()["bad"]:
        raise ProviderError("the reply holds no list of objects")
    known = spark.createDataFrame([(i,) for i in ids], "id string").distinct()
    return {r["id"]: r.asDict() for r in parse_replies(df, known).drop("reply_id").collect()}


@dataclass
class Outcome:
    results: dict[str, dict] = field(default_factory=dict)
    fallbacks: set[str] = field(default_factory=set)
    skipped: list[str] = field(default_factory=list)


class _Budget:
    def __init__(self, tokens):
        self.left, self.used = tokens, False

    def allows(self, cost: int, always: bool = False) -> bool:
        if self.left is None:
            return True
        if cost <= self.left:
            self.left -= cost
            return True
        if always:  # the first batch runs whatever it costs, and then nothing is left
            self.left = 0
        return always


def classify_items(items: list[dict], provider: Provider, prompt: str, topics: set[str], batch_size: int = 10, temperature: float = 0.2,
                   token_budget: int | None = None, estimate=token_estimate, fallback_topic: str = "other", max_failures: int = 3) -> Outcome:
    """Labels for ``items`` (dicts with id, title, source, summary, url).

    Each batch is one call; its items without a label inside ``topics`` are asked
    once more at temperature 0. If the provider answered at all, what is still
    without a label gets the fallback; if every call failed, it is skipped for a
    later run. ``max_failures`` failed calls in a row, or a spent budget, skip the rest.
    """
    out, budget, failures = Outcome(), _Budget(token_budget), 0
    groups = [items[k : k + batch_size] for k in range(0, len(items), batch_size)]

    def call(batch, heat):
        nonlocal failures
        try:
            found = provider.classify(prompt, batch, heat)
        except ProviderError:
            failures += 1
            return None
        failures = 0
        return found

    def settle(batch, found):
        rest = []
        for item in batch:
            label = (found or {}).get(item["id"])
            if label is None or label["topic"] not in topics:
                rest.append(item)
                continue
            second = dict.fromkeys(s for s in label.get("secondary_topics") or [] if s in topics and s != label["topic"])
            out.results[item["id"]] = {**label, "secondary_topics": list(second)}
        return rest

    for k, batch in enumerate(groups):
        if failures >= max_failures or not budget.allows(estimate(prompt, batch), always=k == 0):
            out.skipped += [i["id"] for g in groups[k:] for i in g]
            break
        first = call(batch, temperature)
        rest, answered = settle(batch, first), first is not None
        if rest and budget.allows(estimate(prompt, rest)):
            again = call(rest, 0.0)
            rest, answered = settle(rest, again), answered or again is not None
        for item in rest:
            if answered:
                out.results[item["id"]] = {"topic": fallback_topic, **FALLBACK}
                out.fallbacks.add(item["id"])
            else:
                out.skipped.append(item["id"])
    return out


def classify_pending(pending: DataFrame, provider: Provider, prompt: str, topics: set[str], **options) -> tuple[DataFrame, Outcome]:
    """Classify the rows of ``pending`` (canonical_hash, title, source_name, summary,
    url; already limited and ordered). Returns rows to store and the outcome."""
    spark = pending.sparkSession
    items = [{"id": r["canonical_hash"], "title": r["title"], "source": r["source_name"], "summary": r["summary"], "url": r["url"]} for r in pending.collect()]
    outcome = classify_items(items, provider, prompt, topics, **options)
    rows = [(k, v["topic"], v["secondary_topics"], v["score"], v["rationale"]) for k, v in outcome.results.items()]
    return spark.createDataFrame(rows, RESULT), outcome


class KeywordProvider:
    """A deterministic offline provider: the topic whose keywords match most often."""

    def __init__(self, keywords: dict[str, list[str]], default: str = "other"):
        self.keywords, self.default, self.model_id = keywords, default, "offline:keywords"

    def classify(self, prompt, items, temperature):
        out = {}
        for item in items:
            text = f"{item['title']} {item.get('summary') or ''}".lower()
            hits = {t: sum(text.count(w) for w in words) for t, words in self.keywords.items()}
            best = max(sorted(hits), key=lambda t: hits[t], default=self.default)
            topic = best if hits.get(best) else self.default
            second = [t for t in sorted(hits) if hits[t] and t != topic]
            out[item["id"]] = {"topic": topic, "score": min(10, 3 + 2 * hits.get(best, 0)), "rationale": f"{hits.get(best, 0)} keyword(s)", "secondary_topics": second}
        return out
