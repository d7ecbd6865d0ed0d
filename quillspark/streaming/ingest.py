"""Incremental collection as streams."""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.store import Store
from ..plans.pipeline import ingest
from ..session import scratch_path


def stream_sources(spark: SparkSession, config_json: str, polls: str | None = None, **options) -> DataFrame:
    """All configured sources as one stream. ``polls`` is the folder in which polls are
    logged; a stream that is to resume keeps it beside its checkpoint."""
    from ..sources.datasource import register

    register(spark)
    return spark.readStream.format("quill_feed").options(config=config_json, polls=polls or scratch_path(spark, "polls"), **options).load()


def once(raw: DataFrame, kept: str = "7 days") -> DataFrame:
    """A stream of raw rows without those fetched before within ``kept``: feeds that
    are replayed pass on what is new or changed. The state holds a digest per row and
    is dropped by time of fetching, so no row is lost for the date it bears."""
    if "fetched_at" not in raw.columns:
        raw = raw.withColumn("fetched_at", F.current_timestamp())
    version = F.sha2(F.to_json(F.struct("source_name", "external_id", "payload")), 256)
    return raw.withColumn("_version", version).withWatermark("fetched_at", kept).dropDuplicatesWithinWatermark(["_version"]).drop("_version")


def entity_pairs(left: DataFrame, right: DataFrame, kind: str = "cve", hours: int = 48, lateness: str = "2 days") -> DataFrame:
    """(a, b, value) of items of two streams (canonical_hash, published_at, kind, value)
    that share an entity within ``hours``, the smaller hash first. State is kept for
    the window and ``lateness``; items without a date are in no pair."""
    def side(df, name):
        return df.filter((F.col("kind") == kind) & F.col("published_at").isNotNull()).select(F.col("canonical_hash").alias(name), F.col("published_at").alias(f"{name}_at"), F.col("value").alias(f"{name}_value")).withWatermark(f"{name}_at", lateness)

    reach = F.expr(f"INTERVAL {int(hours)} HOURS")
    near = (F.col("b_at") >= F.col("a_at") - reach) & (F.col("b_at") <= F.col("a_at") + reach)
    met = side(left, "a").join(side(right, "b"), (F.col("a_value") == F.col("b_value")) & near & (F.col("a") < F.col("b")))
    return met.select("a", "b", F.col("a_value").alias("value"))


def start_ingest(raw: DataFrame, store: Store, clock, checkpoint: str | None = None, kept: str = "7 days", **window):
    """Store every micro-batch. Rows fetched before within ``kept`` do not get that far;
    a batch that runs twice stores nothing twice: inserts ignore known keys, so
    at-least-once delivery ends exactly once."""
    raw = once(raw, kept)

    def land(batch: DataFrame, epoch: int):
        now = clock()
        ingest(store, batch.withColumn("fetched_at", F.lit(now)), now, **window)

    return raw.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint or scratch_path(store.spark, "stream")).start()


HEALTH = "source_name string, consecutive_error_runs long, consecutive_empty_runs long, last_success_at timestamp"


def stream_health(runs: DataFrame) -> DataFrame:
    """Running counters per source over a stream of (source_name, seq, failed, empty, ts)."""
    def update(key, batches, state: GroupState):
        errors, empties, success = state.get if state.exists else (0, 0, None)
        for pdf in batches:
            for r in pdf.sort_values("seq").itertuples():
                errors = errors + 1 if r.failed else 0
                if not r.failed:
                    empties = empties + 1 if r.empty else 0
                    success = int(r.ts.value // 1000)
        state.update((errors, empties, success))
        at = pd.NaT if success is None else pd.Timestamp(success * 1000)
        yield pd.DataFrame({"source_name": [key[0]], "consecutive_error_runs": [errors], "consecutive_empty_runs": [empties], "last_success_at": [at]})

    return runs.groupBy("source_name").applyInPandasWithState(update, HEALTH, "errors long, empties long, success long", "update", GroupStateTimeout.NoTimeout)


def daily_counts(events: DataFrame, ts: str, key: str, lateness: str = "30 days") -> DataFrame:
    """Tumbling day windows per key."""
    return events.withWatermark(ts, lateness).groupBy(F.window(ts, "1 day").alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), key, "n")


def weekly_counts(events: DataFrame, ts: str, key: str, lateness: str = "30 days") -> DataFrame:
    """Tumbling ISO weeks per key: (week, label, key, n), a week starting on Monday UTC."""
    monday = F.window(ts, "7 days", "7 days", "4 days")  # the epoch was a Thursday
    counted = events.withWatermark(ts, lateness).groupBy(monday.alias("w"), key).agg(F.count("*").alias("n"))
    thursday = F.col("w.start") + F.expr("INTERVAL 3 DAYS")
    return counted.select(F.col("w.start").alias("week"), F.concat(F.year(thursday).cast("string"), F.lit("-W"), F.lpad(F.weekofyear("w.start").cast("string"), 2, "0")).alias("label"), key, "n")
