"""Document fingerprints by locally consistent parsing.

Each level parses a sequence of names into phrases: runs of one name collapse,
deterministic coin tossing gives every name a label of a few bits that depends
on its left neighbours only, and a phrase starts where a label is a local
maximum. Phrases get names (hashes of their content) and are parsed again. The
cuts depend on a bounded neighbourhood, so equal substrings are cut alike
inside, at whatever offset they stand. A fingerprint keeps, for three levels,
the least name in each of 64 bins.
"""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix64, span_hashes, table, text_or_empty

BINS, LEVELS, TOSSES = 64, 3, 4
#: Phrases of a level, in both texts, with which it counts half.
ENOUGH = 24
EMPTY = 0xFFFF
#: Rows that one range of ids holds on average, and the most ranges there are: their
#: cuts stand on the driver. A range is walked as a stream, so its size costs no memory.
RANGE_ROWS, MAX_RANGES = 2_000, 20_000
_LOW = np.array([(i & -i).bit_length() - 1 if i else 0 for i in range(256)], dtype=np.uint8)


def _toss(names, first):
    """Labels in 0..5 such that neighbours (of one text) differ."""
    prev = np.empty_like(names)
    prev[1:] = names[:-1]
    prev[first] = names[first] ^ np.uint64(1)
    x = names ^ prev
    low = np.log2((x & (~x + np.uint64(1))).astype(np.float64)).astype(np.uint8)
    label = (2 * low + ((names >> low.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).astype(np.uint8)
    for _ in range(TOSSES - 1):
        prev = np.empty_like(label)
        prev[1:] = label[:-1]
        prev[first] = label[first] ^ 1
        low = _LOW[label ^ prev]
        label = 2 * low + ((label >> low) & 1)
    return label


def parse_level(names, owner):
    """One level: (names, owners) of the phrases of ``names``."""
    n = len(names)
    if n == 0:
        return names, owner
    new = np.empty(n, dtype=bool)
    new[0] = True
    np.not_equal(owner[1:], owner[:-1], out=new[1:])
    starts = np.flatnonzero(new | np.concatenate(([True], names[1:] != names[:-1])))
    length = np.diff(np.append(starts, n)).astype(np.uint64)
    with np.errstate(over="ignore"):
        names = np.where(length > 1, mix64(names[starts] + length * np.uint64(0x9E3779B97F4A7C15)), names[starts])
    owner = owner[starts]
    n = len(names)
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    # two runs of one name and length cannot be neighbours, so labels differ
    label = _toss(names, first).astype(np.int16)
    cut = np.zeros(n, dtype=bool)
    if n > 2:
        cut[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
        cut[1:-1] &= (owner[1:-1] == owner[:-2]) & (owner[1:-1] == owner[2:])
    cut[first] = True
    begin = np.flatnonzero(cut)
    return span_hashes(names, begin, np.append(begin[1:], n)), owner[begin]


class Sketches:
    """Fingerprints of several texts, as arrays."""

    def __init__(self, texts: list[bytes]):
        k = len(texts)
        self.count = np.zeros((LEVELS, k), dtype=np.int64)
        self.bins = np.full((LEVELS, k, BINS), EMPTY, dtype=np.uint16)
        self.root = [hashlib.sha256(t).hexdigest()[:16] for t in texts]
        for lo, hi in chunks([len(t) + 1 for t in texts]):
            part = texts[lo:hi]
            data = np.frombuffer(b"".join(part), dtype=np.uint8)
            owner = np.repeat(np.arange(hi - lo), [len(t) for t in part])
            names = data.astype(np.uint64)
            for level in range(LEVELS):
                names, owner = parse_level(names, owner)
                least = np.full((hi - lo) * BINS, 1 << 58, dtype=np.uint64)
                name = mix64(names ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                slot = owner * BINS + (name >> np.uint64(58)).astype(np.int64)
                np.minimum.at(least, slot, name & np.uint64((1 << 58) - 1))
                kept = np.where(least == 1 << 58, EMPTY, mix64(least) % np.uint64(EMPTY)).astype(np.uint16)
                self.bins[level, lo:hi] = kept.reshape(-1, BINS)
                self.count[level, lo:hi] = np.bincount(owner, minlength=hi - lo)

    def strings(self) -> list[str]:
        """``count.count.count.root:`` and the bins of each level as hex."""
        out = []
        for i, root in enumerate(self.root):
            head = ".".join(str(int(c)) for c in self.count[:, i])
            out.append(f"{head}.{root}:" + self.bins[:, i].astype(">u2").tobytes().hex())
        return out


def _likeness(ca, ba, cb, bb) -> float:
    """Agreement of the bins, mostly on the highest level that both texts fill: a
    level counts by how many phrases it has, what it leaves goes to the one below."""
    total, left = 0.0, 1.0
    for level in reversed(range(LEVELS)):
        x, y = ba[level], bb[level]
        either = (x != EMPTY) | (y != EMPTY)
        phrases = float(min(ca[level], cb[level])) ** 2
        share = left * phrases / (phrases + ENOUGH**2) if level else left
        total += share * float(((x == y) & either).sum() / max(1, either.sum()))
        left -= share
    return total


def likeness(a: str, b: str) -> float:
    """Estimated share of phrases in common (0 to 1) of two fingerprint strings,
    mostly on the highest level that both texts fill; equal fingerprints: 1."""
    if a == b:
        return 1.0
    parts = []
    for f in (a, b):
        head, _, hexed = f.partition(":")
        parts += [[int(x) for x in head.split(".")[:LEVELS]], np.frombuffer(bytes.fromhex(hexed), dtype=">u2").reshape(LEVELS, BINS)]
    return _likeness(*parts)


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``fingerprint`` to ``docs``; a column of that name is replaced. Null
    text counts as empty. Equal texts have equal fingerprints."""
    @F.pandas_udf("string")
    def fp(t: pd.Series) -> pd.Series:
        return pd.Series(Sketches([x.encode("utf-8", "surrogatepass") for x in t]).strings())

    return docs.withColumn("fingerprint", fp(text_or_empty(F.col(text))))


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the start of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


PAIRS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(rows: list) -> pd.DataFrame:
    """Results for all but the last of consecutive rows (doc_id, text)."""
    texts = [r[1] for r in rows]
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    enc = [t.encode("utf-8", "surrogatepass") for t in texts]
    cenc = [t.encode("utf-8", "surrogatepass") for t in changed]
    s, e = Sketches(enc), Sketches(cenc)
    fs, fe = s.strings(), e.strings()
    k = len(rows) - 1
    like = lambda i, t, j, same: 1.0 if same else _likeness(s.count[:, i], s.bins[:, i], t.count[:, j], t.bins[:, j])
    return pd.DataFrame({
        "doc_id": pd.array([r[0] for r in rows[:k]], dtype="Int64"),
        "n_chars": [len(t) for t in texts[:k]],
        "edited_sha256": [hashlib.sha256(c).hexdigest() for c in cenc],
        "fingerprint": fs[:k],
        "edited_fingerprint": fe,
        "near_edited": [like(i, e, i, fs[i] == fe[i]) for i in range(k)],
        "near_next": [like(i, s, i + 1, fs[i] == fs[i + 1]) for i in range(k)],
    })


def compare_neighbours(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    ``docs`` has an integer doc_id and text; other columns are ignored. The next
    document is the one with the next smaller doc_id (after the last: the
    first); rows of one id stand in order of text, null ids after all others;
    null text is empty. A lone row is its own next.

    Ids are cut into ranges at approximate quantiles; the first row of each range
    is also sent, as a mark, to the end of the range before it, so each range is
    walked alone and the whole order never meets in one task.
    """
    low = -(1 << 63)
    keyed = docs.select("doc_id", text_or_empty("text").alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("_k"))
    ids = keyed.select("_k")
    n = ids.count()
    if n == 0:
        return docs.sparkSession.createDataFrame([], PAIRS)
    ranges = min(MAX_RANGES, max(1, -(-n // range_rows)))
    cuts = np.unique(np.array(ids.approxQuantile("_k", [i / ranges for i in range(1, ranges)], 0.2 / ranges), dtype=np.float64)).astype(np.int64) if ranges > 1 else np.array([], dtype=np.int64)

    # range 0 has the largest ids
    def range_of(k):
        return len(cuts) - np.searchsorted(cuts, k, side="left")

    @F.pandas_udf("long")
    def bucket(k: pd.Series) -> pd.Series:
        return pd.Series(range_of(k.to_numpy()))

    heads = {r["b"]: r["k"] for r in ids.groupBy(bucket("_k").alias("b")).agg(F.max("_k").alias("k")).collect()}
    order = sorted(heads)
    before = {heads[b]: order[i - 1] for i, b in enumerate(order)}  # the first head closes the last range

    @F.pandas_udf("array<struct<b:long,mark:boolean>>")
    def places(k: pd.Series) -> pd.Series:
        return pd.Series([[{"b": int(b), "mark": False}] + ([{"b": before[x], "mark": True}] if x in before else []) for x, b in zip(k.tolist(), range_of(k.to_numpy()))])

    def walk(batches):
        pending, size, at = [], 0, None
        for batch in batches:
            for doc_id, text, b, mark in zip(batch["doc_id"].astype("Int64"), batch["text"], batch["b"], batch["mark"]):
                if b != at:
                    pending, size, at = [], 0, b
                if pending is None:
                    continue  # further rows of the next range's first id
                pending.append((None if doc_id is pd.NA else int(doc_id), text))
                size += len(text)
                if mark or size > 1 << 20:
                    if len(pending) > 1:
                        yield _compare(pending)
                        pending, size = pending[-1:], len(text)
                if mark:
                    pending = None

    spread = keyed.withColumn("p", F.explode(places("_k"))).select("doc_id", "text", "_k", "p.b", "p.mark")
    dealt = spread.repartition(len(order), "b").sortWithinPartitions("b", "mark", F.desc("_k"), "text")
    return dealt.select("doc_id", "text", "b", "mark").mapInPandas(walk, PAIRS)


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` against its edited text and the next document; see
    :func:`compare_neighbours` for nulls, ties and lone rows."""
    return compare_neighbours(table(spark, sf_dir, "documents"))
