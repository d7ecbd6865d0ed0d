"""Mixing sources to target weights by systematic sampling.

A document's expected copies are its source's target divided by the source's
size. Within a source the documents stand in order of size; the running sum of
expected copies, moved by one random offset, crosses an integer boundary once
for every copy that the document gets. Because equal sizes stand together, the
sample is spread evenly over short and long texts, so the words taken differ
from the target by little more than one document.

The running sum is made of counts per cell (source, size, salt) and of ranks
inside a cell, so a source with a third of all rows is dealt over many tasks.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import small, table, text_or_empty, word_count

#: Most rows ranked by one task on average: fuller cells are salted by a digest of the id.
CELL_ROWS = 20_000
SEED = "mix-1"


def offset(source: Column, seed: str = SEED) -> Column:
    """The source's random offset in [0, 1), from a digest of seed and name."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def targets(sources: DataFrame, weights=(1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Adds ``target`` to (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn and share the sum
    of all sizes; a target stops at ``cap`` times its source's size and what is
    over is shared again by weight. That fixed point is min(cap x size, level x
    weight) for one level, found in order of cap x size / weight: the level is
    what is left of the total when every source with a smaller ratio has its
    cap. One row per source: the table is small however many documents there are.
    """
    everyone = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(everyone.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)
    s = sources.withColumn("w", weight)
    s = s.withColumn("top", F.lit(float(cap)) * F.col("source_size")).withColumn("ratio", F.col("top") / F.col("w"))
    order = everyone.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "left_words": F.sum(F.col("source_size").cast("double")).over(everyone) - F.coalesce(F.sum("top").over(before), F.lit(0.0)),
        "left_weight": F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
    }).withColumn("level", F.col("left_words") / F.col("left_weight"))
    # the first source whose cap is above the level at its turn: from there on all take level x weight
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(everyone)["level"])
    return s.select("source", "source_size", F.least("top", F.coalesce(F.col("level") * F.col("w"), F.col("top"))).alias("target"))


def _sized(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): rows of ``docs`` (text, keys) with their sizes, equal ones counted.
    Written once: the words of a text are counted once."""
    sized = docs.select(*[k for k in keys if k != "size"], word_count(text_or_empty("text")).alias("size"))
    return materialize(sized.groupBy(*keys).agg(F.count("*").alias("n")), "mix-sizes")


def _sampled(sized: DataFrame, more: list[str], weights, cap: float, seed: str, cell_rows: int) -> DataFrame:
    """``sized`` (doc_id, source, size, ``more``, n) with source_size, target, and
    what the sample is read off: ``u``, ``rate`` and ``start``, the rows before."""
    cells = materialize(sized.groupBy("source", "size").agg(F.sum("n").alias("rows")), "mix-cells")
    per_source = targets(cells.groupBy("source").agg(F.sum(F.col("rows") * F.col("size")).cast("long").alias("source_size")), weights, cap)
    # fuller cells are dealt over salts; how many is a function of the cell's rows alone
    fuller = cells.filter(F.col("rows") > cell_rows).select(F.col("source").alias("s2"), F.col("size").alias("z2"), F.ceil(F.col("rows") / F.lit(float(cell_rows))).cast("long").alias("salts"))
    salt = F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), *[F.col(m).cast("string") for m in more], F.lit(""))), 1, 8), 16, 10).cast("long"), F.coalesce("salts", F.lit(1)))
    spread = sized.join(small(fuller, 60), F.col("source").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("z2")), "left").withColumn("salt", salt).drop("s2", "z2", "salts")
    starts = spread.groupBy("source", "size", "salt").agg(F.sum("n").alias("rows")).withColumn(
        "first", F.sum("rows").over(Window.partitionBy("source").orderBy("size", "salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows"))
    inside = Window.partitionBy("source", "size", "salt").orderBy("doc_id", *more).rowsBetween(Window.unboundedPreceding, 0)
    ranked = spread.withColumn("last", F.sum("n").over(inside))
    a, b, c = ranked.alias("a"), starts.alias("b"), per_source.alias("c")
    joined = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size")) & (F.col("a.salt") == F.col("b.salt"))).join(
        c, F.col("a.source").eqNullSafe(F.col("c.source")))
    return joined.select(
        "a.doc_id", "a.source", "a.size", *[f"a.{m}" for m in more], "a.n", "c.source_size", "c.target", offset(F.col("a.source"), seed).alias("u"),
        F.when(F.col("c.source_size") > 0, F.col("c.target") / F.col("c.source_size")).otherwise(0.0).alias("rate"), (F.col("b.first") + F.col("a.last") - F.col("a.n")).alias("start"))


def _crossed(upto: Column, since: Column) -> Column:
    """Integer boundaries that the running sum crosses between two places."""
    return (F.floor(F.col("u") + F.col("rate") * upto) - F.floor(F.col("u") + F.col("rate") * since)).cast("long")


def mix(docs: DataFrame, weights=(1, 2, 3), cap: float = 3.0, seed: str = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every row of ``docs``.

    ``docs`` needs doc_id, text and source; other columns are ignored. Null text
    has size 0. A null source is a source of its own, after all others. Rows of a
    source of size 0 get 0 copies. Rows without an id, and repeated rows (same id
    and size), stand side by side and are counted as one entry until the end: which
    of them gets a copy does not show. An empty table gives no rows. At most
    ceil(cap) copies of a row are taken. Reruns agree.
    """
    sampled = _sampled(_sized(docs, ["doc_id", "source", "size"]), [], weights, cap, seed, cell_rows)
    each = sampled.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return each.select("doc_id", "source", "size", "source_size", "target", _crossed(F.col("start") + F.col("k"), F.col("start") + F.col("k") - 1).alias("copies"))


def mixed_documents(docs: DataFrame, weights=(1, 2, 3), cap: float = 3.0, seed: str = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Rows are told apart by 128 hash bits of all their columns, whatever their names;
    ids may be null or repeat. Rows equal in every column are one entry of the mix
    with all their copies. Nulls, sizes, sources and empty tables: see :func:`mix`.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.col("doc_id"), F.col("source"), F.col("text"), F.xxhash64(row).alias("h1"), F.xxhash64(F.lit(1), row).alias("h2"))
    sized = _sized(keyed, ["doc_id", "source", "size", "h1", "h2"])
    sampled = _sampled(sized, ["h1", "h2"], weights, cap, seed, cell_rows)
    taken = materialize(sampled.select(F.col("h1").alias("t1"), F.col("h2").alias("t2"), "n", _crossed(F.col("start") + F.col("n"), F.col("start")).alias("copies")).filter("copies > 0"), "mix-taken")
    found = keyed.join(small(taken, 40), (F.col("h1") == F.col("t1")) & (F.col("h2") == F.col("t2")))
    # of equal rows one stands for all
    once = found.filter("n > 1").groupBy("h1", "h2").agg(F.first("row").alias("row"), F.first("copies").alias("copies"))
    out = found.filter("n = 1").select("row", "copies").unionByName(once.select("row", "copies"))
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op4_mix(spark, sf_dir: str) -> DataFrame:
    """The mix of every row of ``documents``; see :func:`mix` for nulls and repeats."""
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


OP4_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (
  SELECT *, (1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3)::DOUBLE AS w,
         3.0::DOUBLE * source_size AS top FROM src),
o AS (
  SELECT *, top / w AS ratio,
         (sum(source_size::DOUBLE) OVER () - coalesce(sum(top) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level_at
  FROM w WINDOW before AS (ORDER BY top / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (
  SELECT level_at AS level FROM o WHERE level_at <= ratio ORDER BY ratio, source ASC NULLS LAST LIMIT 1),
tgt AS (
  SELECT source, source_size, least(top, coalesce((SELECT level FROM lev) * w, top)) AS target FROM o),
cells AS (SELECT source, size, ceil(count(*) / {float(CELL_ROWS)})::BIGINT AS salts FROM sized GROUP BY source, size),
salted AS (
  SELECT s.*, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % salts AS salt FROM sized s JOIN cells c ON s.source IS NOT DISTINCT FROM c.source AND s.size = c.size),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, salt, doc_id) AS last,
         ('0x' || substr(md5('{SEED}:' || coalesce('s' || source, 'n')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM salted),
joined AS (
  SELECT doc_id, size, t.source_size, target, u, last, CASE WHEN t.source_size > 0 THEN target / t.source_size ELSE 0 END AS rate
  FROM ranked r JOIN tgt t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((floor(u + rate * last) - floor(u + rate * (last - 1))) * size)::BIGINT AS taken,
       (floor(u + rate * last) - floor(u + rate * (last - 1)))::BIGINT AS copies
FROM joined
"""
