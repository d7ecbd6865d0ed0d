"""Shared helpers: table access, null handling and vectorised text hashing."""

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

#: The word pattern of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes up to which a written table may be broadcast (beyond, it is joined by key).
BROADCAST_BYTES = 16 << 20
#: Bytes of text that a vectorised step holds at once (a longer text is one step).
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(c) -> Column:
    return F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))


def small(written: DataFrame, row_bytes: int) -> DataFrame:
    """``written`` with a broadcast hint if its rows of about ``row_bytes`` fit
    BROADCAST_BYTES; else as it is, for a join by key. The rows joined are the
    same either way."""
    return F.broadcast(written) if written.count() * row_bytes <= BROADCAST_BYTES else written


def identified(docs: DataFrame) -> DataFrame:
    """(row, id, made) of every row of ``docs``; ``row`` holds its columns.

    ``id`` is the doc_id where no other row has it. A null or repeated doc_id gives
    way to hash bits of all columns, from 2^62 up (``made``): rows of one doc_id
    with different texts are told apart, rows equal in every column are not.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    shared = materialize(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("shared")), "shared-ids")
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("key")).join(small(shared, 20), F.col("key") == F.col("shared"), "left")
    made = F.col("key").isNull() | F.col("shared").isNotNull()
    own = F.xxhash64("row").bitwiseAND((1 << 62) - 1) + F.lit(1 << 62)
    return rows.select("row", F.when(made, own).otherwise(F.col("key")).alias("id"), made.alias("made"))


def word_count(text: Column) -> Column:
    """Number of ``WORD`` runs, by the JVM: every run becomes one letter, then
    what is left of the white space is taken off."""
    marked = F.regexp_replace(text, WORD, "x")
    return F.length(F.regexp_replace(marked, r"[\x20\x09-\x0D]+", "")).cast("long")


def hash_bits(key: Column) -> Column:
    """60 hash bits of a key as a non-negative long (leading md5 digits)."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def chunks(sizes, limit: int = CHUNK_BYTES):
    """Slices of consecutive rows whose sizes sum to about ``limit``."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


# ---------------------------------------------------------------- hashing

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict = {}


def _powers(n: int):
    """Powers of the base and of its inverse, grown on demand."""
    have = _POWERS.get("n", 0)
    if have < n:
        size = max(n, 2 * have, 1 << 16)
        with np.errstate(over="ignore"):
            for key, base in (("up", _BASE), ("down", _INV)):
                p = np.full(size, base, dtype=np.uint64)
                p[0] = 1
                _POWERS[key] = np.multiply.accumulate(p)
        _POWERS["n"] = size
    return _POWERS["up"][:n], _POWERS["down"]


def mix64(x):
    """Finaliser that spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values, starts, ends):
    """64-bit hashes of ``values[s:e]`` (unsigned integers) for every span."""
    up, down = _powers(len(values) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        return mix64(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


#: Byte classes: ASCII white space; what separates licence and matching words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def hashed_words(texts: list[bytes], separator=SPACE):
    """Words of several texts: (hash of each word, index of its text).

    A-Z is folded; a word is a run of bytes outside ``separator``. A separator
    byte stands between texts, so no word spans two of them.
    """
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    inside = ~separator[buf]
    edge = np.diff(np.concatenate(([False], inside)).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.cumsum([len(t) + 1 for t in texts])
    return span_hashes(FOLD[buf], starts, ends), np.searchsorted(offsets, starts, side="right")


def shingles(words, owner, k: int):
    """Hashes of all runs of ``k`` words inside one text: (hash, index of text)."""
    m = len(words) - k + 1
    if m <= 0:
        return words[:0], owner[:0]
    with np.errstate(over="ignore"):
        h = words[:m].copy()
        for j in range(1, k):
            h = h * np.uint64(0xD1342543DE82EF95) + words[j : j + m]
    keep = owner[:m] == owner[k - 1 :]
    return mix64(h[keep]), owner[:m][keep]


def shingle_sets(texts: list[str], k: int, separator=SPACE) -> list:
    """The sorted distinct shingle hashes of every text, in order.

    A text with fewer than ``k`` words has its whole sequence as the only
    shingle, one without words the empty set.
    """
    out = []
    for lo, hi in chunks([len(t or "") + 1 for t in texts]):
        words, owner = hashed_words([(t or "").encode("utf-8", "surrogatepass") for t in texts[lo:hi]], separator)
        h, of = shingles(words, owner, k)
        at = np.searchsorted(of, np.arange(hi - lo + 1))
        wat = np.searchsorted(owner, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            if at[i + 1] > at[i]:
                out.append(np.unique(h[at[i] : at[i + 1]]))
            elif wat[i + 1] > wat[i]:
                w = words[wat[i] : wat[i + 1]]
                out.append(span_hashes(w, np.array([0]), np.array([len(w)])))
            else:
                out.append(h[:0])
    return out
