"""The relational operators over items, classifications, sources and runs."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import age_days
from ..session import materialize

#: Rows of an entity that are paired with as many others at once.
CELL = 512


def row_numbers(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds ``name``: 1, 2, ... over the whole table in ``order``.

    Rows are dealt by range and numbered inside each range; a range starts after
    the counts of those before it, so no task sees the whole table.
    """
    dealt = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    starts = dealt.groupBy("_range").agg(F.count("*").alias("_rows")).withColumn("_start", F.sum("_rows").over(before) - F.col("_rows"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn(name, inside).join(starts, "_range").withColumn(name, F.col(name) + F.col("_start")).drop("_range", "_rows", "_start")


def running_sums(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` (not null) up to and with each row in ``order``,
    which must leave no ties. A range starts after the sums of those before it."""
    dealt = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    starts = dealt.groupBy("_range").agg(F.sum(value).alias("_sum")).withColumn("_start", F.sum("_sum").over(before) - F.col("_sum"))
    inside = F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn(name, inside).join(starts, "_range").withColumn(name, F.col(name) + F.col("_start")).drop("_range", "_sum", "_start")


# ---------------------------------------------------------------- selections


def unclassified(items: DataFrame, active: DataFrame, superseded: DataFrame, limit: int | None = None) -> DataFrame:
    """Items without an active classification that nothing supersedes, oldest first."""
    left = items.join(active, "canonical_hash", "left_anti").join(superseded, "canonical_hash", "left_anti").orderBy("ingested_at", "canonical_hash")
    return left.limit(limit) if limit is not None else left


def ingested_between(items: DataFrame, superseded: DataFrame, start: Column, end: Column | None = None) -> DataFrame:
    inside = F.col("ingested_at") >= start
    if end is not None:
        inside = inside & (F.col("ingested_at") < end)
    return items.filter(inside).join(superseded, "canonical_hash", "left_anti").orderBy("ingested_at", "canonical_hash")


def by_score_and_topic(classified: DataFrame, floor: int, topic: str | None = None) -> DataFrame:
    hit = F.col("score") >= floor
    if topic is not None:
        hit = hit & ((F.col("topic") == topic) | F.array_contains("secondary_topics", topic))
    return classified.filter(hit).orderBy(F.desc("score"), "canonical_hash")


def classified_between(classified: DataFrame, start: Column, end: Column, min_score: int | None = None) -> DataFrame:
    """Classified items that were ingested in [start, end), of a score at least."""
    inside = (F.col("ingested_at") >= start) & (F.col("ingested_at") < end)
    return classified.filter(inside if min_score is None else inside & (F.col("score") >= min_score))


def named(rows: DataFrame, column: str, only) -> DataFrame:
    """The rows of the sources asked for; of all, if none is named."""
    return rows.filter(F.col(column).isin(*only)) if only else rows


def open_followups(rows: DataFrame, done: DataFrame, open_only: bool = True) -> DataFrame:
    """Followups with ``completed``, by the ids in ``done``; the open ones alone if asked."""
    marked = rows.join(done.select("id").distinct().withColumn("completed", F.lit(True)), "id", "left").withColumn("completed", F.coalesce("completed", F.lit(False)))
    return marked.filter(~F.col("completed")) if open_only else marked


def followup_order() -> list:
    return [F.col("action"), F.col("item_title_snapshot"), F.col("id")]


def lookup(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_semi")


# ---------------------------------------------------------------- joins


def with_active(items: DataFrame, classifications: DataFrame) -> DataFrame:
    return items.join(classifications, items["current_classification_id"] == classifications["id"])


def first_source(sources: DataFrame) -> DataFrame:
    """(canonical_hash, source_name) of the earliest sighting; ties by name."""
    return sources.groupBy("canonical_hash").agg(F.min(F.struct("first_seen_at", "source_name"))["source_name"].alias("source_name"))


def with_first_source(items: DataFrame, sources: DataFrame) -> DataFrame:
    return items.join(first_source(sources), "canonical_hash", "left")


def dedupe_candidates(items: DataFrame, scores: DataFrame, entities: DataFrame) -> DataFrame:
    """Items with score (0 if unclassified) and their set of (kind, value)."""
    sets = entities.groupBy("canonical_hash").agg(F.array_sort(F.collect_set(F.struct("kind", "value"))).alias("entities"))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    return items.join(scores, "canonical_hash", "left").join(sets, "canonical_hash", "left").withColumns(
        {"score": F.coalesce("score", F.lit(0)), "entities": F.coalesce("entities", none)})


def strong_overlap(a: Column, b: Column, kinds=("cve",)) -> Column:
    strong = lambda c: F.filter(c, lambda e: e["kind"].isin(*kinds))
    return F.arrays_overlap(strong(a), strong(b))


def pairs_within(rows: DataFrame, group: str, ident: str, cell: int = CELL) -> DataFrame:
    """(group, l, r): every two rows of a group once, as structs; ``ident`` is unique in it.

    The rows of a group are cut into runs of about ``cell``, every two runs meet in a
    cell of their own, and a task makes the pairs of its cells one after the other: it
    holds a few runs, however large a group is. ``rows`` should be stored.
    """
    counts = materialize(rows.groupBy(group).agg(F.count("*").alias("n")).filter("n > 1"), "pair-groups")
    tasks = min(counts.agg(F.ceil(F.sum(F.col("n").cast("double") ** 2) / (8 * cell * cell))).first()[0] or 1, 10_000)
    frequent = counts.filter(F.col("n") > cell).select(group, F.ceil(F.col("n") / cell).cast("int").alias("_runs"))
    dealt = rows.join(F.broadcast(frequent), group, "left").withColumn("_runs", F.coalesce("_runs", F.lit(1))).withColumn("_run", F.pmod(F.xxhash64(ident), "_runs").cast("int"))
    row = F.struct(*[c for c in rows.columns if c != group])
    left = dealt.select(group, F.col("_run").alias("i"), F.explode(F.sequence(F.col("_run"), F.col("_runs") - 1)).alias("j"), row.alias("l"))
    right = dealt.select(group, F.explode(F.sequence(F.lit(0), F.col("_run"))).alias("i"), F.col("_run").alias("j"), row.alias("r"))
    met = left.repartition(tasks, group, "i", "j").join(right.repartition(tasks, group, "i", "j"), [group, "i", "j"])
    return met.filter((F.col("i") < F.col("j")) | (F.col(f"l.{ident}") < F.col(f"r.{ident}"))).select(group, "l", "r")


def entity_pairs(entities: DataFrame, key: str, kinds=("cve",), cell: int = CELL) -> DataFrame:
    """(a, b), a < b, of all ``key`` that share an entity of a strong kind, each once:
    a pair is made at the least entity that both have, so pairs are not gathered."""
    strong = entities.filter(F.col("kind").isin(*kinds)).select(F.col(key).alias("k"), F.struct("kind", "value").alias("e"))
    sets = strong.filter("k IS NOT NULL AND e.value IS NOT NULL").groupBy("k").agg(F.collect_set("e").alias("es"))
    rows = materialize(sets.select("k", F.explode("es").alias("e"), F.when(F.size("es") > 1, F.col("es")).alias("es")), "strong-entities")
    once = F.col("l.es").isNull() | F.col("r.es").isNull() | (F.col("e") == F.array_min(F.array_intersect("l.es", "r.es")))
    return pairs_within(rows, "e", "k", cell).filter(once).select(F.least("l.k", "r.k").alias("a"), F.greatest("l.k", "r.k").alias("b"))


def with_sources(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Items with the sorted names of all their sources (none: an empty array)."""
    names = sources.groupBy("canonical_hash").agg(F.sort_array(F.collect_set("source_name")).alias("sources"))
    return items.join(names, "canonical_hash", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


def latest(log: DataFrame, keys: list[str], columns: list[str], seq: str) -> DataFrame:
    """The last entry of every key of a log."""
    return log.groupBy(*keys).agg(F.max_by(F.struct(*columns), seq).alias("_r")).select(*keys, "_r.*")


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct ``key`` of ``left`` that ``right`` has not: sources that never ran."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def all_sources(configured: DataFrame, runs: DataFrame) -> DataFrame:
    """Configured sources and those seen in the log, each once; ``_run`` marks the latter."""
    return configured.select("source_name").distinct().join(runs.withColumn("_run", F.lit(True)), "source_name", "full_outer")


def inherit_sources(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """Source rows of losers, rewritten to their roots; rows the root has stay as they are."""
    mine = sources.join(pairs, sources["canonical_hash"] == pairs["loser"]).select(
        F.col("root").alias("canonical_hash"), "source_name", "source_type", "external_id", "first_seen_at")
    once = mine.groupBy("canonical_hash", "source_name").agg(F.min(F.struct("first_seen_at", "external_id", "source_type")).alias("s")).select(
        "canonical_hash", "source_name", "s.source_type", "s.external_id", "s.first_seen_at")
    return once.join(sources.select("canonical_hash", "source_name"), ["canonical_hash", "source_name"], "left_anti")


def align_replies(entries: DataFrame, known: DataFrame) -> DataFrame:
    """First valid entry (pos) of each known id; an invalid one claims nothing."""
    w = Window.partitionBy("id").orderBy("pos")
    return entries.join(known, "id", "left_semi").withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


# ---------------------------------------------------------------- health


def streaks(runs: DataFrame, source: str, seq: str, failed: Column, empty: Column, ts: str) -> DataFrame:
    """Per source: consecutive errors and consecutive empty runs at the end of its
    log, and the time of the last success. Errors count neither way for emptiness."""
    log = runs.select(F.col(source).alias("source_name"), F.col(seq).alias("_s"), failed.alias("_f"), empty.alias("_e"), F.col(ts).alias("_t"))
    last = log.groupBy("source_name").agg(
        F.max(F.when(~F.col("_f"), F.col("_s"))).alias("ok"), F.max(F.when(~F.col("_f") & ~F.col("_e"), F.col("_s"))).alias("full"),
        F.max(F.when(~F.col("_f"), F.struct("_s", "_t")))["_t"].alias("last_success_at"), F.max(F.struct("_s", "_t"))["_t"].alias("last_run_at"))
    none = F.lit(-(1 << 62))
    return log.join(last, "source_name").groupBy("source_name").agg(
        F.count_if(F.col("_f") & (F.col("_s") > F.coalesce("ok", none))).alias("consecutive_error_runs"),
        F.count_if(~F.col("_f") & F.col("_e") & (F.col("_s") > F.coalesce("full", none))).alias("consecutive_empty_runs"),
        F.first("last_success_at").alias("last_success_at"), F.first("last_run_at").alias("last_run_at"))


def carried_success(runs: DataFrame, source: str, seq: str, failed: Column, ts: str) -> DataFrame:
    """Every run with the time of the last success so far."""
    w = Window.partitionBy(source).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("last_success_at", F.last(F.when(~failed, F.col(ts)), ignorenulls=True).over(w))


def health_label(errors: Column, last_success: Column, now: Column, stale_days: int) -> Column:
    age = age_days(last_success, now)
    return (F.when(errors > 0, "FAILING").when(last_success.isNull(), "no success yet").when(age > stale_days, "STALE").otherwise("ok"))


def failing(runs: DataFrame, after: int) -> DataFrame:
    """Sources with at least ``after`` errors in a row; none if ``after`` is 0."""
    return runs.filter((F.col("consecutive_error_runs") >= after) & F.lit(after > 0))


# ---------------------------------------------------------------- aggregations


def run_totals(runs: DataFrame, failed: Column, empty: Column) -> DataFrame:
    return runs.agg(F.count("*").alias("runs"), F.count_if(failed).alias("errors"), F.count_if(empty).alias("empties"), F.coalesce(F.bool_or(failed), F.lit(False)).alias("any_error"))


def outcomes_per_source(rows: DataFrame, **outcomes: Column) -> DataFrame:
    """Per source how many rows there are of each outcome."""
    return rows.groupBy("source_name").agg(*[F.count_if(c).alias(name) for name, c in outcomes.items()])


def outcomes(rows: DataFrame, classified: Column, fallback: Column) -> DataFrame:
    """How many rows were classified, got the fallback, or were skipped (neither)."""
    label = F.when(classified, "classified").when(fallback, "fallback").otherwise("skipped")
    return rows.groupBy(label.alias("outcome")).agg(F.count("*").alias("n"))


def store_counts(items: DataFrame, active: DataFrame) -> DataFrame:
    """(items, unclassified) of the items that nothing supersedes."""
    marked = items.join(active.select("canonical_hash").distinct().withColumn("_c", F.lit(True)), "canonical_hash", "left")
    return marked.agg(F.count("*").alias("items"), F.count_if(F.col("_c").isNull()).alias("unclassified"))


def entity_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("kind").agg(F.count("*").alias("n"))


def usage(calls: DataFrame, key: str, tokens: Column) -> DataFrame:
    """Tokens and turns per conversation."""
    return calls.groupBy(key).agg(F.sum(tokens).alias("tokens"), F.count("*").alias("turns"))


def spent(batches: DataFrame, budget: int) -> DataFrame:
    """Running cost over (batch, cost), and whether it is within ``budget``."""
    summed = running_sums(batches.select("batch", "cost"), [F.col("batch")], "cost", "spent")
    return summed.select("batch", "spent", (F.col("spent") <= budget).alias("affordable"))


def accuracy(golden: DataFrame, expected: Column, predicted: Column) -> DataFrame:
    """(accuracy, n): the share of rows whose prediction is what was expected; a
    missing one is a miss. Of no rows it is 0."""
    hit = F.coalesce(expected == predicted, F.lit(False))
    return golden.agg(F.coalesce(F.avg(F.when(hit, 1.0).otherwise(0.0)), F.lit(0.0)).alias("accuracy"), F.count("*").alias("n"))


def entry_order() -> list:
    return [F.desc("score"), F.desc_nulls_last("published_at"), F.col("canonical_hash")]


def topic_groups(entries: DataFrame) -> DataFrame:
    """Every entry with its topic's ``n``, ``best`` and ``topic_place`` (topics by best
    score, then name) and its own ``place`` in the topic, in report order.

    Entries are numbered by ranges over the whole table and a topic starts after
    those before it, so no topic is gathered however many entries it has.
    """
    sizes = materialize(entries.groupBy("topic").agg(F.count("*").alias("n"), F.max("score").alias("best")), "topics")
    order = Window.partitionBy().orderBy(F.desc("best"), "topic")  # one row per topic of the taxonomy
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    topics = sizes.withColumns({"topic_place": F.row_number().over(order).cast("long"), "_before": before})
    numbered = row_numbers(entries.join(topics, "topic"), [F.col("topic_place"), *entry_order()], "place")
    return numbered.withColumn("place", (F.col("place") - F.col("_before")).cast("long")).drop("_before")


def weekly_entities(entities: DataFrame, week: Column) -> DataFrame:
    """Roll-up of (canonical_hash, ingested_at, kind, value, context) per ``week``, kind
    and value: sorted distinct items and the context of the first that has one, else
    the value. ``week`` may be one week or an expression of the rows."""
    has = F.col("context").isNotNull() & (F.col("context") != "")
    return entities.withColumn("week_starting", week).groupBy("week_starting", "kind", "value").agg(
        F.sort_array(F.collect_set("canonical_hash")).alias("related_item_hashes"),
        F.min(F.when(has, F.struct("ingested_at", "canonical_hash", "context")))["context"].alias("_c"),
    ).select("week_starting", "kind", "value", F.coalesce("_c", "value").alias("context"), "related_item_hashes").orderBy("week_starting", "kind", "value")


def watermark(rows: DataFrame, ts: str, ident: str) -> DataFrame:
    """(wm, seen): the largest timestamp and the sorted ids that stand on it."""
    top = rows.agg(F.max(ts).alias("wm"))
    return rows.join(top, rows[ts] == top["wm"]).groupBy("wm").agg(F.array_sort(F.collect_set(ident)).alias("seen"))


def after_watermark(rows: DataFrame, ts: str, ident: str, wm: int, seen: list) -> DataFrame:
    """Rows beyond the watermark, undated ones, and those on it that are unseen."""
    on = (F.col(ts) == wm) & ~F.col(ident).isin(seen) if seen else F.col(ts) == wm
    return rows.filter(F.col(ts).isNull() | (F.col(ts) > wm) | on)


def clean_secondaries(secondary: Column, primary: Column, valid: list[str]) -> Column:
    return F.array_distinct(F.filter(secondary, lambda s: s.isin(valid) & (s != primary)))
