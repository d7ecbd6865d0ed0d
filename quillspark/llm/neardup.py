"""N-gram Jaccard join with a token-group matrix.

Exact components of the graph in which two texts are linked when the Jaccard
likeness of their shingle sets reaches a threshold.

1. Texts with equal sets form a class with a number of its own; one of its rows
   goes on. Numbers become doc_ids only when all links are known.
2. Frequencies of all shingles over all classes, counted batch by batch: a batch
   of documents asks once for each of its distinct shingles, so a shingle that a
   third of all texts share costs one entry per batch.
3. A set with too many shingles of its own can have no partner (if u of n
   shingles occur nowhere else, no likeness exceeds (n - u) / n). The others keep
   their rarest shingles (the prefix that any partner must meet).
4. Similar sets are partitioned into clusters: min-hash bands propose one hub per
   band value, exact likeness decides, links join sets into clusters.
5. Clusters are cut into groups of equal size; the matrix holds each group's token
   union. A set whose prefix meets a group of another cluster is bounded by its
   overlap with the group's union, and only qualifying groups are opened, where
   members are compared exactly. No pair inside a cluster is enumerated.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shared_dir
from .common import chunks, mix64, shingle_sets, table, text_or_empty
from ..operators.components import components

#: Characters of text in a batch of documents, shingles counted by one task,
#: and members of a group, on average.
BATCH_CHARS, COUNT_TOKENS, GROUP_MEMBERS = 1_500_000, 750_000, 32
BANDS, BAND_ROWS = 8, 3


def _set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of hashes."""
    with np.errstate(over="ignore"):
        a, b = mix64(s).sum(dtype=np.uint64), mix64(s ^ np.uint64(0x94D049BB133111EB)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _bands(s: np.ndarray) -> list[int]:
    """Keys of the min-hash bands of a set."""
    seeds = mix64(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64))
    with np.errstate(over="ignore"):
        least = np.array([mix64(s ^ seed).min() for seed in seeds]).reshape(BANDS, BAND_ROWS)
        key = np.arange(BANDS, dtype=np.uint64)
        for j in range(BAND_ROWS):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + least[:, j])
    return key.astype(np.int64).tolist()


def _need(n: int, percent: int) -> int:
    """Shingles that a set of n must share with a partner."""
    return -(-percent * n // 100)


def _slots(s: np.ndarray, parts: int) -> np.ndarray:
    """(counting task << 32 | 32 bits) of every hash."""
    part = ((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return (part << np.uint64(32)) | (s & np.uint64(0xFFFFFFFF))


def _occupied(slots: np.ndarray) -> list[tuple[int, int, int]]:
    """(counting task, begin, end) of every task that has some of the sorted slots;
    tasks without any cost nothing."""
    part = slots >> np.uint64(32)
    begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    return list(zip(part[begin].tolist(), begin.tolist(), np.append(begin[1:], len(slots)).tolist()))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets reach the threshold exactly."""
    left = sets.select(F.col("rep").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("set").alias("sb"))

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["sa"], batch["sb"]):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[keep, ["a", "b"]]

    return pairs.join(left, "a").join(right, "b").mapInPandas(compare, "a long, b long")


def _possible(n1: Column, s1: Column, n2: Column, s2: Column, percent: int) -> Column:
    """Can sets of sizes n with s shingles that occur elsewhere reach the threshold?"""
    s = F.least(s1, s2)
    return 100 * s >= percent * (n1 + n2 - s)


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, batch_chars: int = BATCH_CHARS, count_tokens: int = COUNT_TOKENS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    The set of a text is its distinct ``k``-word shingles (with fewer words the
    whole sequence is one). Two documents are linked when 100 * intersection >=
    ``percent`` * union; component_id is the smallest doc_id reachable. Null,
    empty and wordless texts have no shingle and no links. Equal texts are
    linked. Rows that share a doc_id are one document and linked; a null doc_id
    takes part in links but never names a component (a component of null ids
    alone has a null id). Other columns of ``docs`` are ignored; an empty table
    gives no rows. No limit on partners, groups or candidates.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    # a row is found again by its id (or, without one, the text's hash) and the text's hash
    source = docs.select("doc_id", text_or_empty("text").alias("text")).withColumn("th", F.xxhash64("text")).select(
        F.col("doc_id").isNull().alias("lone"), F.coalesce("doc_id", "th").alias("key"), "th", "text")

    def profile(batches):
        for batch in batches:
            texts, named = batch["text"].tolist(), []
            for lo, hi in chunks([len(t) for t in texts]):  # no more sets at once than a piece of the batch has
                named += [(len(s), *_set_key(s)) for s in shingle_sets(texts[lo:hi], k)]
            n, k1, k2 = zip(*named) if named else ((), (), ())
            yield pd.DataFrame({"lone": batch["lone"], "key": batch["key"], "th": batch["th"], "chars": [len(t) for t in texts], "n": n, "k1": k1, "k2": k2})

    prof = materialize(source.mapInPandas(profile, "lone boolean, key long, th long, chars long, n long, k1 long, k2 long"), "neardup-profile")
    prof = prof.withColumn("doc_id", F.when(~F.col("lone"), F.col("key")))
    class_of = ["n", "k1", "k2"]
    # written, so that the final join deals its classes anew and a hot class can be split there
    classes = materialize(prof.filter("n > 0").groupBy(*class_of).agg(
        F.min("doc_id").alias("least"), F.min(F.struct("lone", "key", "th")).alias("r")
    ).select(*class_of, "least", "r.key", "r.th", F.monotonically_increasing_id().alias("rep")), "neardup-classes")
    totals = prof.agg(F.sum("chars").alias("c"), F.sum("n").alias("n")).first()
    # a pair of different sets needs at least so many shingles on the larger side
    smallest = next(m for m in range(1, 202) if 100 * m >= percent * (m + 1)) if percent < 100 else 1 << 62
    batches_n = max(1, -(-int(totals["c"] or 0) // batch_chars))
    parts = max(1, -(-int(totals["n"] or 0) // count_tokens))

    batch_of = lambda c: F.pmod(F.xxhash64(c), F.lit(batches_n)).cast("long")
    # copies without an id are folded before they meet in a batch
    texts = source.filter("NOT lone").unionByName(source.filter("lone").distinct()).drop("lone").withColumn("b", batch_of("key"))
    reps = classes.filter(F.col("n") >= smallest).select("rep", "n", "k1", "k2", "key", "th").withColumn("b", batch_of("key"))

    def pick(docs_pd, wanted):
        """(class, set) of the batch's rows that stand for a class."""
        left = {(n, a, b): rep for n, a, b, rep in zip(*(wanted[c].tolist() for c in ("n", "k1", "k2", "rep")))}
        mine = docs_pd[docs_pd["key"].isin(wanted["key"]) & docs_pd["th"].isin(wanted["th"])].drop_duplicates(["key", "th"])
        named = [((len(s), *_set_key(s)), s) for s in shingle_sets(mine["text"].tolist(), k)]
        return [(left.pop(name), s) for name, s in named if name in left]

    def ask(docs_pd, wanted):
        """A batch's distinct shingles with their counts, for each counting task."""
        picked = pick(docs_pd, wanted)
        if not picked:
            return pd.DataFrame({"p": [], "b": [], "tokens": [], "counts": []})
        slots, counts = np.unique(_slots(np.concatenate([s for _, s in picked]), parts), return_counts=True)
        rows = [(p, int(docs_pd["b"].iloc[0]), (slots[lo:hi] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), np.minimum(counts[lo:hi], 65535).astype(np.uint16).tobytes())
                for p, lo, hi in _occupied(slots)]
        return pd.DataFrame(rows, columns=["p", "b", "tokens", "counts"])

    def answer(asked):
        """To every batch: those of its shingles that other sets have too, and their frequency."""
        tokens = [np.frombuffer(t, dtype=np.uint32) for t in asked["tokens"]]
        counts = np.concatenate([np.frombuffer(c, dtype=np.uint16) for c in asked["counts"]])
        flat = np.concatenate(tokens)
        order = np.argsort(flat, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(flat[order]) != 0)))
        sums = np.minimum(np.add.reduceat(counts[order], starts, dtype=np.int64), 2**31 - 1).astype(np.int32)
        df = np.empty(len(flat), dtype=np.int32)
        df[order] = np.repeat(sums, np.diff(np.append(starts, len(flat))))
        del flat, order, counts
        rows, at = [], 0
        for b, t in zip(asked["b"], tokens):
            mine = df[at : at + len(t)]
            at += len(t)
            keep = mine > 1
            if keep.any():
                rows.append((int(b), int(asked["p"].iloc[0]), t[keep].tobytes(), mine[keep].tobytes()))
        return pd.DataFrame(rows, columns=["b", "p", "tokens", "df"])

    asked = texts.groupBy("b").cogroup(reps.groupBy("b")).applyInPandas(ask, "p long, b long, tokens binary, counts binary")
    answered = asked.groupBy("p").applyInPandas(answer, "b long, p long, tokens binary, df binary")
    # no nulls among the numbers: they would come as floats
    replies = answered.withColumns({c: F.lit(-1).cast("long") for c in ("rep", "n", "k1", "k2", "key", "th")}).unionByName(
        reps.select("b", F.lit(-1).cast("long").alias("p"), F.lit(None).cast("binary").alias("tokens"), F.lit(None).cast("binary").alias("df"), "rep", "n", "k1", "k2", "key", "th")
    )

    def sketch(docs_pd, told):
        """Sets that may have a partner: size, shared shingles, prefix, bands."""
        wanted, got = told[told["rep"] >= 0], told[told["p"] >= 0]
        rows = []
        if len(got) and len(wanted) and len(docs_pd):
            slots = np.concatenate([np.frombuffer(t, dtype=np.uint32).astype(np.uint64) | np.uint64(int(p) << 32) for p, t in zip(got["p"], got["tokens"])])
            df = np.concatenate([np.frombuffer(d, dtype=np.int32) for d in got["df"]])
            order = np.argsort(slots)
            slots, df = slots[order], df[order]
            for rep, s in pick(docs_pd, wanted):
                mine = _slots(s, parts)
                at = np.minimum(np.searchsorted(slots, mine), len(slots) - 1)
                freq = np.where(slots[at] == mine, df[at], 1)
                n, shared = len(s), int((freq > 1).sum())
                reach = n - _need(n, percent) + 1 - (n - shared)
                if reach > 0:
                    prefix = s[np.lexsort((s, freq))][n - shared :][:reach]
                    rows.append((rep, n, shared, prefix.astype(np.int64).tolist(), _bands(s), s.tobytes()))
        return pd.DataFrame(rows, columns=["rep", "n", "shared", "prefix", "bands", "set"])

    linkable = materialize(
        texts.groupBy("b").cogroup(replies.groupBy("b")).applyInPandas(sketch, "rep long, n long, shared long, prefix array<long>, bands array<long>, set binary"), "neardup-sets")
    sets = linkable.select("rep", "set")

    # clusters: every band value proposes its most central set as a hub
    banded = linkable.select("rep", "n", "shared", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(
        F.min(F.struct((-F.col("shared") / F.col("n")).alias("own"), F.col("rep").alias("hub"), F.col("n").alias("hn"), F.col("shared").alias("hs"))).alias("h"), F.count("*").alias("size")
    ).filter("size > 1").select("band", "h.hub", "h.hn", "h.hs")
    proposed = banded.join(hubs, "band").filter(
        (F.col("rep") != F.col("hub")) & _possible(F.col("n"), F.col("shared"), F.col("hn"), F.col("hs"), percent)
    ).select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    near = _verify(proposed, sets, percent).checkpoint()
    cluster = components(near)
    placed = linkable.select("rep", "n", "shared", "prefix").join(cluster, F.col("rep") == F.col("node"), "left").withColumn("cluster", F.coalesce("root", "rep")).drop("node", "root")
    sizes = placed.groupBy("cluster").agg(F.ceil(F.count("*") / F.lit(GROUP_MEMBERS)).alias("salts"))
    own = F.floor(F.lit(40) * (F.col("n") - F.col("shared")) / F.col("n"))
    placed = materialize(
        placed.join(sizes, "cluster").withColumn("part", F.xxhash64("n", own, F.pmod(F.xxhash64("rep"), "salts"))).drop("salts"), "neardup-groups")

    # the matrix restricted to prefixes: tokens that meet more than one cluster. A
    # token's position counts the set's own shingles too, which come first in order
    postings = placed.select("rep", "n", "shared", "cluster", "part", F.posexplode("prefix").alias("k", "token")).withColumn("pos", F.col("n") - F.col("shared") + F.col("k"))
    meeting = postings.groupBy("token").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi")).filter("lo < hi").select("token")
    postings = postings.join(meeting, "token")
    matrix = postings.groupBy("token", F.col("cluster").alias("gc"), F.col("part").alias("gp")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("shared").alias("gs"), F.min("pos").alias("gpos"))
    # sets of sizes n and m need so many shingles in common, hence one among the first n - need + 1
    need = F.ceil(percent * (F.col("q.n") + F.col("g.lo")) / F.lit(100 + percent) - 1e-9)
    met = postings.alias("q").join(matrix.alias("g"), (F.col("q.token") == F.col("g.token")) & (F.col("q.cluster") < F.col("g.gc"))
        & (100 * F.col("q.n") >= percent * F.col("g.lo")) & (100 * F.col("g.hi") >= percent * F.col("q.n"))
        & (F.col("q.pos") + need <= F.col("q.n")) & (F.col("g.gpos") + need <= F.col("g.hi"))
        & _possible(F.col("q.n"), F.col("q.shared"), F.col("g.lo"), F.col("g.gs"), percent))
    candidates = met.select("rep", "q.n", "q.shared", "gc", "gp").distinct().checkpoint()
    members = placed.select(F.col("rep").alias("m"), F.col("n").alias("mn"), F.col("shared").alias("ms"), F.col("cluster").alias("gc"), F.col("part").alias("gp"))
    wanted = members.join(candidates.select("gc", "gp").distinct(), ["gc", "gp"], "left_semi").join(sets.withColumnRenamed("rep", "m"), "m").select("gc", "gp", "set")

    def unite(rows):
        union = np.unique(np.concatenate([np.frombuffer(s, dtype=np.uint64) for s in rows["set"]]))
        return pd.DataFrame({"gc": rows["gc"].iloc[:1], "gp": rows["gp"].iloc[:1], "tokens": [union.tobytes()]})

    unions = wanted.groupBy("gc", "gp").applyInPandas(unite, "gc long, gp long, tokens binary")

    def bound(batches):
        for batch in batches:
            keep = [len(np.intersect1d(np.frombuffer(s, dtype=np.uint64), np.frombuffer(t, dtype=np.uint64), assume_unique=True)) >= _need(n, percent)
                    for n, s, t in zip(batch["n"], batch["set"], batch["tokens"])]
            yield batch.loc[keep, ["rep", "n", "shared", "gc", "gp"]]

    qualifying = candidates.join(sets, "rep").join(unions, ["gc", "gp"]).mapInPandas(bound, "rep long, n long, shared long, gc long, gp long")
    opened = qualifying.join(members, ["gc", "gp"]).filter(_possible(F.col("n"), F.col("shared"), F.col("mn"), F.col("ms"), percent)).select(F.col("rep").alias("a"), F.col("m").alias("b"))
    across = _verify(opened, sets, percent)
    joined = components(near.unionByName(across))

    # one doc_id with several texts: its classes are one document
    labelled = prof.select("doc_id", "n", "k1", "k2").join(classes.select(*class_of, "least", "rep"), class_of, "left").select("doc_id", F.col("n").alias("n_shingles"), "least", "rep")
    clashing = labelled.filter("doc_id IS NOT NULL AND rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("doc_id", "a")
    if not clashing.isEmpty():
        several = labelled.filter("rep IS NOT NULL").select("doc_id", F.col("rep").alias("b")).join(clashing, "doc_id").select("a", "b")
        joined = components(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(several))
    # classes of a component take its least doc_id
    joined = joined.checkpoint()
    least = joined.join(classes.select("rep", "least"), F.col("node") == F.col("rep")).groupBy("root").agg(F.min("least").alias("found"))
    named = joined.join(least, "root").select("node", "found")
    return labelled.join(named, F.col("rep") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("found", "least", "doc_id").alias("component_id"))


def op2_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)
