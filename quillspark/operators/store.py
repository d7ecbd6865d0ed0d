"""The item store: append-only Parquet tables, read as views.

Nothing is updated in place. What the model mutates (the active classification
of an item, what superseded it, a source's state, a followup's completion) is a
log with a sequence number, and a view takes the latest entry per key. Writes are
batches that become visible as a whole (:mod:`.commits`), over all tables they touch.
"""

import uuid
from contextlib import contextmanager
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, shared_dir
from .commits import Batch, CommitLog, migrate
from .relational import latest, open_followups, row_numbers

SCHEMAS = {
    "items": "canonical_hash string, url string, title string, summary string, published_at timestamp, ingested_at timestamp, metadata string, canonicalization_version int",
    "item_bodies": "canonical_hash string, body string, fetched_from_url string, fetched_at timestamp, seq long",
    "item_sources": "canonical_hash string, source_name string, source_type string, external_id string, first_seen_at timestamp",
    "item_entities": "canonical_hash string, kind string, value string, context string",
    "classifications": "id long, canonical_hash string, topic string, secondary_topics array<string>, score int, rationale string, classifier_version string, classifier_model string, classified_at timestamp",
    "activations": "canonical_hash string, classification_id long, seq long",
    "supersessions": "loser string, winner string, seq long",
    "deletions": "canonical_hash string",
    "source_runs": "source_name string, cursor string, last_run_at timestamp, last_success_at timestamp, last_error string, consecutive_empty_runs int, consecutive_error_runs int, seq long",
    "followups": "id long, created_at timestamp, item_hash string, item_title_snapshot string, item_url_snapshot string, action string, note string",
    "followups_done": "id long",
    "weekly_entities": "week_starting timestamp, kind string, value string, context string, related_item_hashes array<string>, seq long",
}
KEYS = {"items": ["canonical_hash"], "item_sources": ["canonical_hash", "source_name"], "item_entities": ["canonical_hash", "kind", "value"]}
#: Logs of which a view reads the latest entry per key.
LOGS = {"item_bodies": ["canonical_hash"], "activations": ["canonical_hash"], "supersessions": ["loser"], "source_runs": ["source_name"]}
#: Rows that are looked up by a plain join, however many of them have one key.
MANY = 1_000_000
#: Rows of a supersession log that a worker holds at once.
SPAN = 1 << 18
#: Rows that are broadcast.
FEW = 1 << 17
ACTIONS = ["read-deep", "implement", "audit", "track"]


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; ``order`` breaks ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def insert_new(batch: DataFrame, existing: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows to append under insert-or-ignore: first per key in the batch, not yet stored."""
    return first_per_key(batch, keys, order).join(existing.select(*keys), keys, "left_anti")


def upsert(existing: DataFrame, batch: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Union in which the row with the largest ``seq`` of a key wins."""
    rest = [c for c in existing.columns if c not in keys]
    both = existing.unionByName(batch.select(*existing.columns))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_row")).select(*keys, "_row.*")


def admit(batch: DataFrame, parents: DataFrame, key: str, parent_key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows whose parent exists, rows whose parent does not)."""
    p = parents.select(F.col(parent_key or key).alias(key)).distinct()
    return batch.join(p, key, "left_semi"), batch.join(p, key, "left_anti")


def cascade(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return children.join(deleted.select(key), key, "left_anti")


def _looked_up(rows: DataFrame, key: str, answers: DataFrame, n: int, many: int) -> DataFrame:
    """``n`` stored rows with the answer (_key and more) to their ``key``, if there is one.

    Of more than ``many`` rows a sample tells the keys that many have: their answers go
    to the rows, so that no task gets all rows of a key. The rows are the same either way.
    """
    match = F.col(key) == F.col("_key")
    if n <= many:
        return rows.join(answers, match, "left")
    drawn = rows.sample(min(1.0, 200_000 / n), seed=7).groupBy(key).agg(F.count("*").alias("_n"))
    often = materialize(drawn.filter("_n >= 50").select(F.col(key).alias("_often")), "frequent-keys")
    known = materialize(answers.join(F.broadcast(often), F.col("_key") == F.col("_often"), "left_semi"), "frequent-answers")
    frequent = often.join(F.broadcast(known), F.col("_often") == F.col("_key"), "left")
    direct = rows.join(F.broadcast(frequent), F.col(key) == F.col("_often")).drop("_often")
    return direct.unionByName(rows.join(F.broadcast(often), F.col(key) == F.col("_often"), "left_anti").join(answers, match, "left"))


def _followed_nearby(links: DataFrame, span: int) -> DataFrame:
    """Links (loser, root), one per loser, followed as far as they stay among ``span``
    neighbours in the order of losers. ``done`` rows have come to a cycle's least member;
    the others stand at a row of other neighbours, or at the end: ``low`` is the least that
    their path has met on the way there, if anything.
    """
    kind = links.select(F.coalesce("root", "loser").alias("k")).schema["k"].dataType

    def parts(batches):
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, span - n))
                n, batch = n + held[-1].num_rows, batch.slice(held[-1].num_rows)
                if n == span:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def follow(batches):
        for part in parts(batches):
            loser, root = (part[c].combine_chunks() for c in ("loser", "root"))
            n = len(part)
            to = pc.fill_null(pc.index_in(root, value_set=loser), -1).to_numpy(zero_copy_only=False)
            out = to < 0
            at, met = np.where(out, np.arange(n), to), np.where(out, n, to)
            for _ in range(n.bit_length()):
                met, at = np.minimum(met, met[at]), at[at]
            ring = ~out[at]
            end = np.where(ring, n + met[at], at)
            yield from pa.table({
                "loser": loser, "root": pa.concat_arrays([root, loser]).take(pa.array(end)),
                "low": loser.take(pa.array(met, mask=met == n)), "done": pa.array(ring)}).to_batches()

    near = links.select(F.col("loser").cast(kind), F.col("root").cast(kind)).repartitionByRange("loser").sortWithinPartitions("loser")
    fields = T.StructType([T.StructField(c, kind) for c in ("loser", "root", "low")]).add("done", "boolean")
    return near.mapInArrow(follow, fields)


def _doubled(near: DataFrame, many: int) -> DataFrame:
    """(loser, root) of rows (loser, root, least, done, maybe low) by pointer doubling.

    Rows whose root is final are set aside and only looked up. ``least`` is the least
    row that the path behind a row has met so far: where that is the row itself, it has
    gone all around a cycle, and every path that met it ends at the cycle's least member.
    That is the row itself, or its ``low`` where paths have been followed past rows that
    are not among these.
    """
    marks = [c for c in ("least", "low") if c in near.columns]
    final = near.filter("done").select("loser", "root")
    now = near.filter("NOT done").select("loser", "root", *marks)
    left, kind = now.count(), now.schema["root"].dataType
    while left:
        nxt = now.select(F.col("loser").alias("_key"), F.col("root").alias("_r"), *[F.col(c).alias(f"_{c}") for c in marks])
        nxt = nxt.unionByName(final.select(F.col("loser").alias("_key"), F.col("root").alias("_r"), *[F.lit(None).cast(kind).alias(f"_{c}") for c in marks]))
        jumped = materialize(_looked_up(now, "root", nxt, left, many).select(
            "loser", F.coalesce("_r", "root").alias("root"), *[F.least(c, f"_{c}").alias(c) for c in marks], F.col("_least").isNull().alias("done")), "roots")
        left, around = jumped.agg(F.count_if(~F.col("done")), F.count_if(~F.col("done") & (F.col("loser") == F.col("least")))).first()
        parts = [jumped.filter("done")]
        if around:
            going = jumped.filter("NOT done").drop("done")
            ends = going.filter("loser = least").select(F.col("loser").alias("_key"), F.col(marks[-1]).alias("_r"))
            jumped = materialize(_looked_up(going, "least", ends, left, many).select(
                "loser", F.coalesce("_r", "root").alias("root"), *marks, F.col("_key").isNotNull().alias("done")), "roots")
            left = jumped.filter("NOT done").count()
            parts.append(jumped.filter("done"))
        now = jumped.filter("NOT done").drop("done")
        for part in parts:
            final = final.unionByName(part.select("loser", "root"))
    return final


def resolve_roots(edges: DataFrame, many: int = MANY, span: int = SPAN) -> DataFrame:
    """(loser, root) of a supersession log (loser, winner, seq): latest entry per
    loser, chains followed to their ends. A cycle, and whatever leads into it, ends at
    its least member.

    Rows are dealt by ranges of losers, and each task follows the paths that stay among
    neighbours. The rows that paths go on to elsewhere are then solved by pointer doubling
    and looked up; where those are most of all rows, as with random keys, all are doubled.
    """
    latest = edges.groupBy("loser").agg(F.max_by("winner", "seq").alias("root")).filter("loser <> root")
    near = materialize(_followed_nearby(latest, span), "roots")
    going = near.filter("NOT done")
    n, left, exits = near.agg(F.count("*"), F.count_if(~F.col("done")), F.approx_count_distinct(F.when(~F.col("done"), F.col("root")))).first()
    if 4 * exits > n:
        return _doubled(near.select("loser", "root", F.least("root", "low").alias("least"), "done"), many).filter("loser <> root")
    roots = near.filter("done").select("loser", "root")
    if left:
        small = F.broadcast if exits <= FEW else lambda df: df
        entered = going.select(F.col("root").alias("_key")).distinct()
        met = near.select("loser", "root", F.col("root").alias("least"), F.least("root", "low").alias("low"), "done")
        between = materialize(met.join(small(entered), F.col("loser") == F.col("_key"), "left_semi"), "roots")
        ends = _doubled(between, many).select(F.col("loser").alias("_key"), F.col("root").alias("_r"))
        found = going.join(F.broadcast(ends), F.col("root") == F.col("_key"), "left") if exits <= FEW else _looked_up(going, "root", ends, left, many)
        roots = roots.unionByName(found.select("loser", F.coalesce("_r", "root").alias("root")))
    return roots.filter("loser <> root")


def repointed(current: DataFrame) -> DataFrame:
    """(loser, root) of every loser whose winner (loser, winner) has itself lost."""
    roots = resolve_roots(current.select("loser", "winner", F.lit(1).alias("seq")))
    return roots.join(current, "loser").filter("root <> winner").select("loser", "root")


def body_state(items: DataFrame, bodies: DataFrame, known: DataFrame) -> DataFrame:
    """Items with ``cached`` (has a body) and ``known`` (a body of it may be kept)."""
    mark = lambda df, name: df.select("canonical_hash").distinct().withColumn(name, F.lit(True))
    both = items.join(mark(bodies, "cached"), "canonical_hash", "left").join(mark(known, "known"), "canonical_hash", "left")
    return both.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("cached", "known")})


class Store:
    """Tables below one folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        shared_dir(spark)
        self.log, self._batch = CommitLog(spark, self.path), None
        migrate(self)

    @staticmethod
    def tables() -> list[str]:
        return list(SCHEMAS)

    def _schema(self, name: str) -> T.StructType:
        return T.StructType.fromDDL(SCHEMAS[name])

    @contextmanager
    def transaction(self):
        """All that is written inside becomes visible at its end, or nothing of it.

        Inside, reads see the store as it was at the beginning and the batch's own
        rows. If another writer has since committed to a table that was read or
        written here, the batch is given up with :class:`.commits.Conflict`. A
        transaction inside another is part of it.
        """
        if self._batch is not None:
            yield self._batch
            return
        batch = self._batch = Batch(uuid.uuid4().hex, self.log.last())
        try:
            yield batch
            if batch.tables or batch.version:
                self.log.commit(batch)
        finally:
            self._batch = None

    def read(self, name: str, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
        """The committed rows of a table. With ``since`` or ``until`` batches ingested
        wholly outside are not read; rows of the others are not filtered."""
        if self._batch is not None:
            self._batch.touched.add(name)
        micros = lambda t: int(t.timestamp() * 1_000_000)
        within = [b for b, t in self.log.visible(name, self._batch).items()
                  if t["rows"] and (since is None or t["most"] is None or t["most"] >= micros(since)) and (until is None or t["least"] is None or t["least"] < micros(until))]
        if not within:
            return self.spark.createDataFrame([], self._schema(name))
        rows = self.spark.read.schema(self._schema(name).add("_batch", "string")).parquet(f"{self.path}/data/{name}")
        return rows.filter(F.col("_batch").isin(within)).drop("_batch")

    def append(self, name: str, df: DataFrame) -> int:
        """Adds rows to a table; returns how many."""
        fields = self._schema(name)
        with self.transaction() as batch:
            folder = f"{self.path}/data/{name}/_batch={batch.id}"
            before = batch.tables.get(name, {"rows": 0})["rows"]
            df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]).write.mode("append").parquet(folder)
            times = F.unix_micros("ingested_at") if "ingested_at" in fields.names else F.lit(None).cast("long")
            r = self.spark.read.schema(fields).parquet(folder).agg(F.count("*"), F.min(times), F.max(times)).first()
            batch.tables[name] = {"rows": r[0], "least": r[1], "most": r[2]}
            batch.touched.add(name)
            return r[0] - before

    def insert_or_ignore(self, name: str, batch: DataFrame, order: list | None = None) -> int:
        """Append rows with unseen keys; returns how many were new."""
        keys = KEYS[name]
        order = order or [F.col(c) for c in batch.columns if c not in keys][:1] or [F.lit(1)]
        with self.transaction():
            return self.append(name, insert_new(batch, self.read(name), keys, order))

    def next_seq(self, name: str, column: str = "seq") -> int:
        return (self.read(name).agg(F.max(column)).first()[0] or 0) + 1

    def rewrite(self, name: str, rows: DataFrame) -> None:
        """Puts ``rows`` in the place of all that a table holds."""
        with self.transaction() as batch:
            old = list(self.log.visible(name, batch))
            self.append(name, materialize(rows, name))
            batch.replaces[name] = old

    def compact(self, name: str) -> None:
        """One batch in the place of many: of a log the latest entry per key, which is
        all that its view reads; of another table all rows, by time of ingestion."""
        rows = self.read(name)
        if name in LOGS:
            keys = LOGS[name]
            rest = [c for c in rows.columns if c not in keys]
            rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("_row")).select(*keys, "_row.*")
        elif "ingested_at" in rows.columns:
            rows = rows.repartitionByRange("ingested_at").sortWithinPartitions("ingested_at")
        self.rewrite(name, rows)

    def vacuum(self) -> int:
        """Deletes the folders of batches that no reader sees: given up or replaced.
        Not to be run while others write or read older states."""
        gone = 0
        for name in self.log.names("data"):
            seen = set(self.log.visible(name))
            for folder in self.log.names(f"data/{name}"):
                if folder.startswith("_batch=") and folder.removeprefix("_batch=") not in seen:
                    self.log.drop(f"data/{name}/{folder}")
                    gone += 1
        return gone

    # ---- views

    def supersessions(self) -> DataFrame:
        return self.read("supersessions").groupBy("loser").agg(F.max_by("winner", "seq").alias("superseded_by"))

    def active(self) -> DataFrame:
        """(canonical_hash, classification_id): the latest activation."""
        return latest(self.read("activations"), ["canonical_hash"], ["classification_id"], "seq").withColumnRenamed("classification_id", "current_classification_id")

    def items(self, with_superseded: bool = False, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
        """Items with what superseded them, or those that nothing did. ``since`` and
        ``until`` bound the time of ingestion and keep older batches from being read."""
        items = self.read("items", since, until)
        if since is not None:
            items = items.filter(F.col("ingested_at") >= F.lit(since))
        if until is not None:
            items = items.filter(F.col("ingested_at") < F.lit(until))
        items = cascade(items, self.read("deletions"), "canonical_hash")
        lost = self.supersessions().withColumnRenamed("loser", "canonical_hash")
        items = items.join(lost, "canonical_hash", "left") if with_superseded else items.join(lost, "canonical_hash", "left_anti")
        return items.join(self.active(), "canonical_hash", "left")

    def children(self, name: str) -> DataFrame:
        return cascade(self.read(name), self.read("deletions"), "canonical_hash")

    def bodies(self) -> DataFrame:
        return latest(self.children("item_bodies"), ["canonical_hash"], ["body", "fetched_from_url", "fetched_at"], "seq")

    def source_runs(self) -> DataFrame:
        cols = [c for c in self._schema("source_runs").names if c not in ("source_name", "seq")]
        return latest(self.read("source_runs"), ["source_name"], cols, "seq")

    def classified(self, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
        """Items with their active classification; bounds as of :meth:`items`."""
        cls = self.children("classifications").drop("canonical_hash")
        return self.items(since=since, until=until).join(cls, F.col("current_classification_id") == F.col("id")).drop("id")

    def followups(self, open_only: bool = False) -> DataFrame:
        f = open_followups(self.read("followups"), self.read("followups_done"), open_only)
        gone = self.read("deletions").withColumnRenamed("canonical_hash", "item_hash").withColumn("_gone", F.lit(True))
        return f.join(gone, "item_hash", "left").withColumn("item_hash", F.when(F.col("_gone").isNull(), F.col("item_hash"))).drop("_gone")

    # ---- writes with rules

    def set_bodies(self, batch: DataFrame) -> int:
        """Bodies of known items; the latest wins. Returns rows turned away."""
        with self.transaction():
            marked = body_state(batch, self.bodies(), self.items(True))
            known, unknown = marked.filter("known"), marked.filter("NOT known")
            self.append("item_bodies", known.withColumn("seq", F.lit(self.next_seq("item_bodies"))))
            return unknown.count()

    def classify(self, batch: DataFrame) -> int:
        """Append classifications of known items and make them active. Returns rows turned away."""
        with self.transaction():
            known, unknown = admit(batch, self.items(True), "canonical_hash")
            start = self.next_seq("classifications", "id") - 1
            seq = self.next_seq("activations")
            rows = materialize(row_numbers(known.filter(F.col("score").between(0, 10)), [F.col("canonical_hash"), F.col("classified_at")], "id").withColumn("id", F.lit(start) + F.col("id")), "classified")
            self.append("classifications", rows)
            self.append("activations", rows.groupBy("canonical_hash").agg(F.max("id").alias("classification_id")).withColumn("seq", F.lit(seq)))
            return unknown.count()

    def supersede(self, pairs: DataFrame) -> None:
        """Record (loser, winner), then repoint older losers of a new loser to its root."""
        with self.transaction():
            self.append("supersessions", pairs.select("loser", "winner").withColumn("seq", F.lit(self.next_seq("supersessions"))))
            current = self.supersessions()
            moved = materialize(repointed(current.withColumnRenamed("superseded_by", "winner")).select("loser", F.col("root").alias("winner")), "repointed")
            if not moved.isEmpty():
                self.append("supersessions", moved.withColumn("seq", F.lit(self.next_seq("supersessions"))))

    def delete_items(self, hashes: DataFrame) -> None:
        self.append("deletions", hashes.select("canonical_hash").distinct())

    def add_followups(self, rows: DataFrame) -> None:
        with self.transaction():
            bad = rows.filter(~F.col("action").isin(ACTIONS))
            if not bad.isEmpty():
                raise ValueError(f"action must be one of {ACTIONS}")
            start = self.next_seq("followups", "id") - 1
            numbered = row_numbers(rows, [F.col("created_at"), F.col("item_hash"), F.col("action")], "id")
            self.append("followups", numbered.withColumn("id", F.lit(start) + F.col("id")))

    def complete_followup(self, followup_id: int) -> None:
        self.append("followups_done", self.spark.createDataFrame([(followup_id,)], "id long"))

    def add_weekly_entities(self, rows: DataFrame, mode: str = "replace_week") -> None:
        """``replace_week``: a later write of a week hides the earlier one.
        ``append``: rows add up, whatever was there."""
        with self.transaction():
            self.append("weekly_entities", rows.withColumn("seq", F.lit(self.next_seq("weekly_entities") if mode == "replace_week" else 0)))

    def weekly_entities(self) -> DataFrame:
        w = self.read("weekly_entities")
        latest = w.groupBy("week_starting").agg(F.max("seq").alias("seq"))
        return w.join(latest, ["week_starting", "seq"], "left_semi").unionByName(w.filter("seq = 0").join(latest.filter("seq > 0"), "week_starting", "left_semi")).drop("seq")

    def audit_keys(self) -> dict[str, int]:
        """Duplicate keys per table (all must be 0)."""
        return {t: self.read(t).groupBy(*k).count().filter("count > 1").count() for t, k in KEYS.items()}
