"""Exact deduplication by an extendible-hash index on shared files.

Every text has a key, the hash of what is left of it without white space. Small
entries (key, lengths, digest) are written first; a directory of key prefixes is
made from them, in which only buckets over their limit are split on further bits.
The texts themselves move once, combined by key and bytes on the map side, so a
text that a third of all rows share leaves a task once: equal keys chain up, bytes
decide. The chains are written by bucket, every task owning whole key ranges.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import small, table, text_or_empty
from .sharding import BITS, directory, prefix

#: Bytes of distinct text that a bucket of the index stands for.
BUCKET_BYTES = 4 << 20
#: A class with more than this share of all rows is joined by broadcast: there are at most as many.
HEAVY_SHARE = 20_000
#: Characters that do not count when texts are compared.
IGNORED = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null is empty."""
    out = text_or_empty(text)
    for ch in IGNORED:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def hash_key(norm: Column, bits: int = BITS) -> Column:
    """The first ``bits`` of 60 hash bits, in their place (the rest are 0)."""
    return F.xxhash64(norm).bitwiseAND((1 << BITS) - (1 << (BITS - bits)))


def entry_table(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One small stored row (row, doc_id, n_chars, norm_bytes, key, text_sha256) for every document."""
    norm = normalised(F.col("text"))
    return materialize(docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.length(text_or_empty("text")).cast("long").alias("n_chars"),
        F.octet_length(norm).cast("long").alias("norm_bytes"), hash_key(norm, bits).alias("key"), F.sha2(norm, 256).alias("text_sha256")), "entries")


def build_index(docs: DataFrame, entries: DataFrame, bits: int = BITS, limit: int = BUCKET_BYTES) -> DataFrame:
    """The stored index: one row (bucket, depth, key, chain, norm_bytes, text_sha256,
    group_size, keep_id, keep_row) for every distinct normalised text.

    ``bucket`` is the key's prefix of ``depth`` bits in the directory; ``chain`` counts
    from 0 the different texts of one key, by digest. Files follow key ranges. Entries
    find their chain by key, digest and length; should two texts agree in all three
    and differ in bytes, that is an error, not a silent merge.
    """
    norm = normalised(F.col("text"))
    chains = docs.select(hash_key(norm, bits).alias("key"), norm.alias("norm")).groupBy("key", "norm").agg(F.count("*").alias("group_size"))
    chains = materialize(chains.select("key", "group_size", F.octet_length("norm").cast("long").alias("norm_bytes"), F.sha2("norm", 256).alias("text_sha256")), "chains")
    levels = directory(chains.select(F.col("key").alias("h"), F.greatest("norm_bytes", F.lit(1)).alias("bytes")), limit)
    placed = chains
    for k, (width, leaves) in enumerate(levels):
        depth = F.coalesce("depth", F.lit(BITS)) if width == BITS else F.col("depth")
        leaf = leaves.select(F.col("cell").alias(f"_c{k}"), depth.cast("int").alias(f"_d{k}"))
        placed = placed.join(small(leaf, 12), prefix(F.col("key"), width) == F.col(f"_c{k}"), "left")
    placed = placed.withColumn("depth", F.coalesce(*[F.col(f"_d{k}") for k in range(len(levels))]))
    placed = placed.withColumn("bucket", F.substring(F.lpad(F.conv(F.col("key").cast("string"), 10, 2), BITS, "0"), F.lit(1), F.col("depth")))
    chain_of = ["key", "text_sha256", "norm_bytes"]
    rank = F.struct("n_chars", F.col("doc_id").isNotNull().alias("has"), F.bitwise_not("doc_id").alias("id"), F.bitwise_not("row").alias("at"))
    best = entries.groupBy(*chain_of).agg(F.max(rank).alias("best"))
    best = best.select(*chain_of, F.bitwise_not("best.id").alias("keep_id"), F.bitwise_not("best.at").alias("keep_row"))
    found = placed.join(best, chain_of).select("bucket", "depth", *chain_of, "group_size", "keep_id", "keep_row")
    owned = found.repartitionByRange("bucket", "key")
    place = Window.partitionBy("bucket", "key").orderBy("text_sha256", "norm_bytes")
    twin = F.lag("norm_bytes").over(place) == F.col("norm_bytes")
    alike = (F.lag("text_sha256").over(place) == F.col("text_sha256")) & twin
    chain = F.when(alike, F.raise_error("different texts with equal SHA-256")).otherwise(F.row_number().over(place) - 1)
    return materialize(owned.withColumn("chain", chain.cast("int")), "index")


def exact_duplicates(docs: DataFrame, bits: int = BITS, limit: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, bucket, chain) for every row of ``docs``.

    Rows are equal when their texts are after white space is deleted; null counts as
    empty, and so do texts of white space alone, which are all equal. Of equal rows
    the one with the most code points stays, then the one with the smallest doc_id
    (null after all others), then any one of those equal in both. ``kept`` is true
    for exactly one row of a group, also where a doc_id repeats. Other columns play
    no part; an empty table gives no rows.
    """
    entries = entry_table(docs, bits)
    index = build_index(docs, entries, bits, limit)
    chain_of = ["key", "text_sha256", "norm_bytes"]
    group = index.select(*chain_of, "group_size", "keep_id", "keep_row", "bucket", "chain")
    # groups of more than one row in HEAVY_SHARE of all: fewer than HEAVY_SHARE, so they are broadcast
    least = entries.count() / HEAVY_SHARE
    heavy = F.broadcast(group.filter(F.col("group_size") > least))
    dealt = entries.join(F.broadcast(group.filter(F.col("group_size") > least).select(*chain_of)), chain_of, "left_anti").join(group.filter(F.col("group_size") <= least), chain_of)
    rows = entries.join(heavy, chain_of).unionByName(dealt)
    return rows.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "bucket", "chain")


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Groups of equal texts in ``documents``; see :func:`exact_duplicates`."""
    rows = exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm)::BIGINT AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST)
"""
