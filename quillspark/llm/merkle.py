"""A Merkle manifest of a dataset, its leaves ranked by radix and not by a global sort.

Histograms of ever longer prefixes of the sort key (source, then digits of the
doc_id) give every cell of rows the rank at which it starts; only cells over a limit
are cut by a further digit. Ranks written in base 3 are addresses in the source's
tree: a block of leaves with one address prefix is reduced to its node by one task,
blocks of nodes likewise, up to the source's subroot; subroots ordered by source
make the last tree. On the way down every block hands its members the siblings above
it, so no proof is shuffled with a leaf.
"""

import hashlib
from itertools import chain, islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import row_numbers
from ..session import materialize
from .common import small, table

FANOUT = 3
#: Levels of a tree that one task reduces: a block has at most FANOUT ** BLOCK_LEVELS nodes.
BLOCK_LEVELS = 6
BLOCK = FANOUT**BLOCK_LEVELS
#: Rows of a cell that are numbered by one task.
CELL_ROWS = 4096
#: The fields that a leaf covers, in order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_digest(fields: list[Column]) -> Column:
    """Hex SHA-256 of all fields: ``-`` for null, else the bytes' number, ``:``, value."""
    shown = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in shown]), 256)


def leaf_table(docs: DataFrame) -> DataFrame:
    """Stored rows (row, doc_id, src, key, leaf, tampered); texts are read once, here.

    ``src`` orders sources by bytes, null first. ``key`` orders the leaves of a source:
    hex digits of the doc_id (null first), of the leaf, of the row. ``tampered`` is the
    leaf of the text without line ends, null for rows that are not tampered with.
    """
    text, doc = F.col("text"), F.col("doc_id").cast("long")
    leaf = leaf_digest([F.col(c) for c in FIELDS])
    changed = leaf_digest([*[F.col(c) for c in FIELDS[:-1]], F.replace(text, F.lit("\n"), F.lit(""))])
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return materialize(
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-")).alias("src"),
                    leaf.alias("leaf"), F.when(hit, changed).alias("tampered"),
                    F.when(doc.isNull(), F.lit("0" * 18)).otherwise(F.concat(F.lit("01"), F.lpad(F.hex(doc.bitwiseXOR(-(1 << 63))), 16, "0"))).alias("id_key"))
        .select("row", "doc_id", "src", F.concat("id_key", F.substring("leaf", 1, 8), F.lower(F.lpad(F.hex("row"), 16, "0"))).alias("key"), "leaf", "tampered"), "leaves")


def ranked(rows: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``rows`` (src, key, ...) with ``rank``, from 0 within src by key.

    Cells are prefixes of the key, two hex digits a step. Each histogram covers only
    rows whose cell was too full; a cell's start is its parent's plus the counts of
    the (at most 256) siblings before it. Within a cell rows are numbered by one task.
    """
    ends = rows.agg(F.min("key"), F.max("key")).first()
    if ends[0] is None:
        return rows.withColumn("rank", F.lit(0).cast("long"))
    same = next((i for i, (a, b) in enumerate(zip(*ends)) if a != b), len(ends[0]) - 2)
    width, rest, parents, settled = same // 2 * 2 + 2, rows, None, []
    while True:
        cells = rest.groupBy("src", F.substring("key", 1, width).alias("cell")).agg(F.count("*").alias("n"))
        up = Window.partitionBy("src", F.substring("cell", 1, width - 2)).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("start", F.coalesce(F.sum("n").over(up), F.lit(0)))
        if parents is not None:
            above = parents.select(F.col("src").alias("_s"), F.col("cell").alias("_c"), F.col("start").alias("_b"))
            cells = cells.join(above, (F.col("src") == F.col("_s")) & (F.substring("cell", 1, width - 2) == F.col("_c"))).withColumn("start", F.col("start") + F.col("_b")).drop("_s", "_c", "_b")
        cells = materialize(cells, "cells")
        fits = F.lit(True) if width >= len(ends[0]) else F.col("n") <= cell_rows
        settled.append((width, cells.filter(fits)))
        parents = cells.filter(~fits)
        if parents.isEmpty():
            break
        full = parents.select(F.col("src").alias("_s"), F.col("cell").alias("_c"))
        rest = rest.join(small(full, 120), (F.col("src") == F.col("_s")) & (F.substring("key", 1, width) == F.col("_c")), "left_semi")
        width += 2
    placed = rows
    for k, (width, cells) in enumerate(settled):
        at = cells.select(F.col("src").alias(f"_s{k}"), F.col("cell").alias(f"_c{k}"), F.col("start").alias(f"_b{k}"))
        placed = placed.join(small(at, 120), (F.col("src") == F.col(f"_s{k}")) & (F.substring("key", 1, width) == F.col(f"_c{k}")), "left")
    ks = range(len(settled))
    placed = placed.withColumn("_cell", F.coalesce(*[F.col(f"_c{k}") for k in ks])).withColumn("_from", F.coalesce(*[F.col(f"_b{k}") for k in ks]))
    inside = F.row_number().over(Window.partitionBy("src", "_cell").orderBy("key")) - 1
    return placed.withColumn("rank", F.col("_from") + inside).select(*rows.columns, "rank")


# ---------------------------------------------------------------- trie blocks


def node_digest(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def depth_of(n: int) -> int:
    """Levels until ``n`` nodes are one."""
    depth = 0
    while n > 1:
        n, depth = -(-n // FANOUT), depth + 1
    return depth


def reduce_block(digests: list[str], n: int) -> list[list[str]]:
    """The levels of a block, leaves first; ``n`` nodes stand beside each other in
    the whole tree at the block's lowest level."""
    levels = [digests]
    for _ in range(min(BLOCK_LEVELS, depth_of(n))):
        row = levels[-1]
        levels.append([node_digest(row[i : i + FANOUT]) for i in range(0, len(row), FANOUT)])
    return levels


def steps_of(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """(siblings to the left, to the right), level by level, of node ``at`` of a block."""
    out = []
    for row in levels[:-1]:
        first = at // FANOUT * FANOUT
        out.append(("".join(row[first:at]), "".join(row[at + 1 : first + FANOUT])))
        at //= FANOUT
    return out


def fold(digest: str, steps) -> str:
    for left, right in steps:
        digest = node_digest((left, digest, right))
    return digest


def _encode(steps) -> str:
    return "/".join(f"{a}:{b}" for a, b in steps)


def _decode(path: str) -> list[tuple[str, str]]:
    return [tuple(step.split(":")) for step in path.split("/")] if path else []


def blocks(batches):
    """Frames of one block (src, block) each, from rows that arrive sorted by it; a
    block that a batch breaks off is finished with the next one."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        change = (batch["src"].ne(batch["src"].shift()) | batch["block"].ne(batch["block"].shift())).to_numpy().nonzero()[0]
        for a, b in zip(change, change[1:]):
            yield batch.iloc[a:b]
        held = batch.iloc[change[-1] :]
    if held is not None:
        yield held


def frames(rows, columns: list[str], at_once: int = 4096):
    """Data frames of up to ``at_once`` of the rows that an iterator gives."""
    while part := list(islice(rows, at_once)):
        yield pd.DataFrame(part, columns=columns)


def _by_block(nodes: DataFrame, *order: str) -> DataFrame:
    return nodes.repartition("src", "block").sortWithinPartitions("src", "block", *order)


def _nodes(leaves: DataFrame) -> DataFrame:
    """(src, idx, n, digest) one block level up from the same columns."""

    def reduced(batches):
        for b in blocks(batches):
            n = int(b["n"].iloc[0])
            yield b["src"].iloc[0], int(b["block"].iloc[0]), -(-n // BLOCK), reduce_block(b["digest"].tolist(), n)[-1][0]

    def run(batches):
        return frames(reduced(batches), ["src", "idx", "n", "digest"])

    dealt = _by_block(leaves.select("src", (F.floor(F.col("idx") / BLOCK)).alias("block"), "idx", "n", "digest"), "idx")
    return dealt.mapInPandas(run, "src string, idx long, n long, digest string")


def build(leaves: DataFrame) -> list[DataFrame]:
    """Stored node tables (src, idx, n, digest) from ``leaves`` up, the last with one
    node per src."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    tables = [leaves]
    while True:
        tables.append(materialize(_nodes(tables[-1]), "nodes"))
        most = -(-most // BLOCK)
        if most <= 1:
            return tables


def _handed_down(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """(src, block, idx, n, digest, path, ...) sorted by block, each block led by the
    row of ``above`` (src, idx, path) for its node."""
    led = above.select("src", F.col("idx").alias("block"), F.lit(-1).cast("long").alias("idx"), "path")
    own = nodes.withColumn("block", F.floor(F.col("idx") / BLOCK)).withColumn("path", F.lit(None).cast("string"))
    return _by_block(own.unionByName(led, allowMissingColumns=True), "idx")


def paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """(src, idx, path) of ``nodes``: the siblings of every level above each of them."""

    def handed(batches):
        for b in blocks(batches):
            upper, own = b["path"].iloc[0], b.iloc[1:]
            levels = reduce_block(own["digest"].tolist(), int(own["n"].iloc[0]))
            for i, (src, idx) in enumerate(zip(own["src"], own["idx"])):
                yield src, idx, "/".join(filter(None, (_encode(steps_of(levels, i)), upper)))

    def run(batches):
        return frames(handed(batches), ["src", "idx", "path"])

    return _handed_down(nodes, above).mapInPandas(run, "src string, idx long, path string")


def manifest(docs: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, src, leaf_rank, leaf, subroot, root, proof_sha256, folded_root,
    verified) for every row of ``docs``.

    Leaves of a source ascend by doc_id, null first; rows that share a doc_id follow
    by digest, and rows equal in every column have equal leaves, so their order does
    not matter to any node. A null source is one of its own and the first. A null
    doc_id is never tampered with, nor is a null text changed. A source of one
    document has its leaf as subroot, one source its subroot as root; a proof without
    siblings is the digest of nothing. An empty table gives no rows. Columns other
    than the five that a leaf covers play no part.
    """
    leaves = materialize(ranked(leaf_table(docs), cell_rows), "ranked")
    counts = materialize(leaves.groupBy("src").agg(F.count("*").alias("n")), "sources")
    leaves = leaves.join(small(counts, 100), "src").withColumnRenamed("rank", "idx").withColumn("digest", F.col("leaf"))
    trees = build(leaves.select("src", "idx", "n", "digest"))
    sources = counts.count()
    order = materialize(row_numbers(trees[-1].select(F.col("src").alias("name"), "digest"), [F.col("name")], "place"), "subroots")
    top = build(order.select(F.lit("").alias("src"), (F.col("place") - 1).alias("idx"), F.lit(sources).cast("long").alias("n"), "digest"))
    root = top[-1].first()["digest"] if sources else ""

    # down again: the root has nothing above it
    path = top[-1].select("src", "idx", F.lit("").alias("path"))
    for nodes in reversed(top[:-1]):
        path = materialize(paths(nodes, path), "paths")
    at = order.withColumn("idx", F.col("place") - 1).join(path.select("idx", "path"), "idx")
    path = materialize(at.select(F.col("name").alias("src"), F.lit(0).cast("long").alias("idx"), "path"), "paths")
    for nodes in reversed(trees[1:-1]):
        path = materialize(paths(nodes, path), "paths")

    def proved(batches):
        for b in blocks(batches):
            upper, own = _decode(b["path"].iloc[0]), b.iloc[1:]
            levels = reduce_block(own["digest"].tolist(), int(own["n"].iloc[0]))
            above = "".join(chain.from_iterable(upper))
            for i, (src, doc, rank, leaf, tampered, subroot) in enumerate(zip(own["src"], own["doc"], own["idx"], own["digest"], own["tampered"], own["subroot"])):
                steps = steps_of(levels, i)
                folded = fold(fold(tampered or leaf, steps), upper)
                yield doc, src, rank, leaf, subroot, root, node_digest((*chain.from_iterable(steps), above)), folded, folded == root

    def run(batches):
        return frames(proved(batches), ["doc_id", "src", "leaf_rank", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    subroots = materialize(trees[-1].select("src", F.col("digest").alias("subroot")), "subroots")
    own = leaves.join(small(subroots, 150), "src").select("src", "idx", "n", "digest", "tampered", "subroot", F.col("doc_id").cast("string").alias("doc"))
    kind = leaves.schema["doc_id"].dataType.simpleString()
    made = _handed_down(own, path).mapInPandas(run, "doc_id string, src string, leaf_rank long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return made.withColumn("doc_id", F.col("doc_id").cast(kind))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Leaf, proof and check of every row of ``documents``; see :func:`manifest`."""
    made = manifest(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: The reflected CRC-32 polynomial (a fixed value).
CRC_POLYNOMIAL = 0xEDB88320


def _leaf_sql(text: str) -> str:
    shown = [*(f"{c}::VARCHAR" for c in FIELDS[:-1]), text]
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in shown) + "))"


OP12_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || source, '-') AS src, {_leaf_sql("text")} AS leaf, {_leaf_sql("replace(text, chr(10), '')")} AS changed,
         list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * {CRC_POLYNOMIAL}))) AS crc
  FROM documents),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rk, count(*) OVER (PARTITION BY src) AS n FROM d),
lv AS (
  SELECT src, 0 AS level, rk AS idx, leaf AS h, n FROM ranked
  UNION ALL
  SELECT src, level + 1, idx // {FANOUT}, sha256(string_agg(h, '' ORDER BY idx)), (n + {FANOUT} - 1) // {FANOUT} FROM lv WHERE n > 1 GROUP BY src, level, idx // {FANOUT}, n),
sub AS (SELECT src, h AS subroot, row_number() OVER (ORDER BY src) - 1 AS sk, count(*) OVER () AS n FROM lv WHERE n = 1),
tv AS (
  SELECT 0 AS level, sk AS idx, subroot AS h, n FROM sub
  UNION ALL
  SELECT level + 1, idx // {FANOUT}, sha256(string_agg(h, '' ORDER BY idx)), (n + {FANOUT} - 1) // {FANOUT} FROM tv WHERE n > 1 GROUP BY level, idx // {FANOUT}, n),
near AS (
  SELECT rid, level, rk // ({FANOUT} ** level)::BIGINT AS me, idx, h FROM ranked JOIN lv USING (src)
  WHERE lv.n > 1 AND idx // {FANOUT} = rk // ({FANOUT} ** (level + 1))::BIGINT
  UNION ALL
  SELECT rid, 1000 + level, sk // ({FANOUT} ** level)::BIGINT, idx, h FROM ranked JOIN sub USING (src), tv
  WHERE tv.n > 1 AND idx // {FANOUT} = sk // ({FANOUT} ** (level + 1))::BIGINT),
steps AS (
  SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY level) AS step, coalesce(string_agg(h, '' ORDER BY idx) FILTER (idx < me), '') AS l, coalesce(string_agg(h, '' ORDER BY idx) FILTER (idx > me), '') AS r
  FROM near GROUP BY rid, level),
proofs AS (SELECT rid, string_agg(l || r, '' ORDER BY step) AS siblings, max(step) AS last FROM steps GROUP BY rid),
folds AS (
  SELECT rid, 0 AS step, CASE WHEN crc & 1 = 1 AND doc_id IS NOT NULL THEN changed ELSE leaf END AS h FROM d
  UNION ALL
  SELECT f.rid, f.step + 1, sha256(s.l || f.h || s.r) FROM folds f JOIN steps s ON s.rid = f.rid AND s.step = f.step + 1)
SELECT doc_id, leaf, subroot, tv.h AS root, sha256(coalesce(siblings, '')) AS proof_sha256, f.h AS folded_root, f.h = tv.h AS verified
FROM ranked JOIN sub USING (src) LEFT JOIN proofs USING (rid) JOIN folds f ON f.rid = ranked.rid AND f.step = coalesce(last, 0) JOIN tv ON tv.n = 1
"""
