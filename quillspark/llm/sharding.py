"""Sharding by extendible hashing.

A directory maps hash-prefix bits to shards. A bucket is split on one more bit
only while it is over the byte limit; all others keep their depth. The bytes
of every prefix come from one pre-aggregation over the documents, the splits
from that histogram, so no document moves until its shard is known.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import hash_bits, table, text_or_empty

BITS = 60
#: Bits below the expected depth that the first histogram has, and that each further one adds.
SPARE_BITS, MORE_BITS = 5, 8
#: Bytes of text that a shard may hold (production; see :func:`op5_shards` for its use).
SHARD_BYTES = 4 << 20


def prefix(h: Column, depth) -> Column:
    return F.shiftright(h, BITS - depth) if isinstance(depth, int) else F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def _leaves(cells: DataFrame, bits: int, floor_depth: int, limit: int) -> DataFrame:
    """For every cell (prefix of ``bits`` bits) the depth at which its bucket fits,
    null if it is too large at ``bits`` too."""
    depths = F.sequence(F.lit(floor_depth), F.lit(bits))
    sums = cells.select(F.explode(depths).alias("depth"), "cell", "bytes").withColumn(
        "at", F.call_function("shiftright", F.col("cell"), (F.lit(bits) - F.col("depth")).cast("int"))
    )
    fits = sums.groupBy("depth", "at").agg(F.sum("bytes").alias("shard_bytes")).filter(F.col("shard_bytes") <= limit)
    found = sums.join(fits, ["depth", "at"]).groupBy("cell").agg(F.min(F.struct("depth", "shard_bytes")).alias("leaf"))
    return cells.select("cell", "bytes").join(found, "cell", "left").select("cell", "bytes", "leaf.depth", "leaf.shard_bytes")


def directory(hashed: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """[(bits, leaves)]: histograms of more and more bits, each after the first
    over those cells alone that the one before could not settle.

    ``hashed`` has ``h`` and ``bytes``. A bucket whose rows all have one hash
    cannot be split; it stays over the limit at the full depth.
    """
    total = hashed.agg(F.sum("bytes")).first()[0] or 0
    bits, done = min(BITS, max(1, math.ceil(math.log2(max(1.0, total / limit)))) + SPARE_BITS), []
    floor_depth, rest = 0, hashed
    while True:
        cells = rest.groupBy(prefix(F.col("h"), bits).alias("cell")).agg(F.sum("bytes").alias("bytes"))
        leaves = _leaves(cells, bits, floor_depth, limit).checkpoint()
        done.append((bits, leaves))
        if bits == BITS or leaves.filter("depth IS NULL").isEmpty():
            return done
        floor_depth = bits + 1
        rest = rest.join(leaves.filter("depth IS NULL").select(F.col("cell").alias("_c")), prefix(F.col("h"), bits) == F.col("_c"), "left_semi")
        bits = min(BITS, bits + MORE_BITS)


def shard(docs: DataFrame, limit: int = SHARD_BYTES, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with ``shard`` (the hash-prefix bits as text), ``depth``,
    ``bytes`` (of the text in UTF-8) and ``shard_bytes``.

    No shard holds more than ``limit`` bytes, unless rows with one key alone do
    (a text beyond the limit, or repeats of a key): such a key gets a shard of
    its own at the full depth, and ``shard_bytes`` shows it. A row without a key hashes
    by its text, so such rows spread like others; null text has 0 bytes; an empty table gives no rows.
    Columns of ``docs`` with the names added here are replaced, all others are
    kept, whatever their names. Repeated rows share a shard.
    """
    shared_dir(docs.sparkSession)
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "depth", "bytes", "shard_bytes")]
    size = F.octet_length(text_or_empty("text")).cast("long")
    h = hash_bits(F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null "), F.md5(text_or_empty("text")))))
    rows = docs.select(F.struct(*kept).alias("row"), h.alias("h"), size.alias("bytes"))
    levels = directory(docs.select(h.alias("h"), size.alias("bytes")), limit)
    for k, (bits, leaves) in enumerate(levels):
        lone = bits == BITS
        leaf = leaves.filter("depth IS NOT NULL") if not lone else leaves.withColumns(
            {"shard_bytes": F.coalesce("shard_bytes", "bytes"), "depth": F.coalesce("depth", F.lit(BITS))})
        leaf = leaf.select(F.col("cell").alias(f"c{k}"), F.col("depth").alias(f"d{k}"), F.col("shard_bytes").alias(f"b{k}"))
        rows = rows.join(leaf, prefix(F.col("h"), bits) == F.col(f"c{k}"), "left")
    ks = range(len(levels))
    rows = rows.withColumns({"depth": F.coalesce(*[F.col(f"d{k}") for k in ks]).cast("int"), "shard_bytes": F.coalesce(*[F.col(f"b{k}") for k in ks])})
    name = F.substring(F.lpad(F.conv(F.col("h").cast("string"), 10, 2), BITS, "0"), F.lit(1), F.col("depth"))
    return rows.select("row.*", name.alias("shard"), "depth", "bytes", "shard_bytes")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder of Parquet per shard; rows of a shard are gathered first."""
    sharded.repartition("shard").write.partitionBy("shard").mode("overwrite").parquet(path)


def op5_shards(spark, sf_dir: str) -> DataFrame:
    """The shard of every row of ``documents``; see :func:`shard` for nulls, ties
    and keys beyond the limit."""
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES).select("doc_id", "shard", "depth", "bytes", "shard_bytes")


OP5_SQL = rf"""
WITH hashed AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null ' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS h FROM documents),
sums AS (
  SELECT d AS depth, h >> ({BITS} - d) AS pre, sum(bytes)::BIGINT AS shard_bytes
  FROM hashed, range(0, {BITS} + 1) t(d) GROUP BY 1, 2),
leaf AS (
  SELECT h, min(depth) FILTER (WHERE shard_bytes <= {SHARD_BYTES} OR depth = {BITS}) AS depth
  FROM (SELECT DISTINCT h FROM hashed) x, range(0, {BITS} + 1) t(d) JOIN sums ON depth = d AND pre = h >> ({BITS} - d) GROUP BY h)
SELECT doc_id, substr(lpad(bin(h), {BITS}, '0'), 1, leaf.depth::INT) AS shard, leaf.depth::INT AS depth, bytes, shard_bytes
FROM hashed JOIN leaf USING (h) JOIN sums ON sums.depth = leaf.depth AND pre = h >> ({BITS} - leaf.depth)
"""
