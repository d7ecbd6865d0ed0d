"""Benchmark decontamination by a BM25 index of test items.

The inverted index holds the test items; every passage of every training text
is a query against it. Retrieval is block-max WAND, evaluated for a batch of
passages at once: only terms that an item needs to reach its threshold open
posting lists (the pivot terms), sums of block maxima discard whole blocks of
items, and the survivors are scored exactly. A retrieved pair counts as a leak
if question and answer both overlap with the passage, word order included.
"""

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import chunks, hashed_words, shingles, span_hashes, table, text_or_empty

K1, B = 1.2, 0.75
#: Share of an item's own score that retrieves a passage; share of a part's
#: n-grams that the passage must hold; words of an n-gram; words from which an item
#: is retrieved by score (a shorter one is matched word for word).
RETRIEVE, OVERLAP, NGRAM, MIN_ITEM_WORDS = 0.6, 0.6, 2, 4
#: Share of an item's own score that may lie with terms that open no posting list:
#: the more it is, the fewer terms are pivots and the looser are the bounds.
UNOPENED = 0.35
BLOCK_ITEMS = 16
#: Bytes of item texts in one shard, on average: its index is broadcast.
SHARD_BYTES = 8 << 20
#: Shards that one scan of the documents searches, one after the other.
SCAN_SHARDS = 64
#: Bytes of text whose words a task holds while it goes through several shards.
HELD_BYTES = 16 << 20
#: Least words from one passage to the next.
STRIDE = 64
#: Words are runs of letters and digits, so punctuation does not hide a leak.
MARKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
#: Punctuation and spaces outside ASCII cut words too.
_CUTS = frozenset(chr(c) for c in range(0x80, 0x20000) if c == 0x200B or unicodedata.category(chr(c))[0] in "PZ")
#: Scripts written without spaces (Thai to Tibetan, Burmese, Khmer, Tai, kana, Han): every code point is a word.
_ALONE = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19ff\u1a20-\u1aad\ua9e0-\ua9fe\uaa60-\uaadf\u2e80-\u2fdf\u3005-\u3007\u3021-\u3029\u3031-\u3035\u303b\u303c"
                    "\u3040-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff]")


def plain(text: str) -> str:
    """The text with its words set apart by ASCII marks in every script."""
    if text.isascii():
        return text
    text = text.replace("\uff1f", "?").replace("\u061f", "?").replace("\uff1a", ":")
    for mark in _CUTS.intersection(text):  # few of them stand in any one text
        text = text.replace(mark, " ")
    return _ALONE.sub(r" \g<0> ", text) if max(text) >= "\u0e00" else text


def _encoded(text: str) -> bytes:
    return plain(text).encode("utf-8", "surrogatepass")


def _grams(words, k: int = NGRAM):
    """Distinct n-grams; of fewer words: the whole sequence."""
    if len(words) >= k:
        return np.unique(shingles(words, np.zeros(len(words), dtype=np.int64), k)[0])
    return span_hashes(words, np.array([0]), np.array([len(words)])) if len(words) else words


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: cut after the last question mark that leaves an
    answer, or at an ``Answer:`` line, else two thirds into the words."""
    low = text.lower()
    at = low.rfind("answer:")
    if at > 0 and text[at + 7 :].strip():
        return text[:at], text[at + 7 :]
    at = text.rfind("?")
    if at > 0 and text[at + 1 :].strip():
        return text[: at + 1], text[at + 1 :]
    words = text.split()
    cut = max(1, (2 * len(words)) // 3)
    return " ".join(words[:cut]), " ".join(words[cut:])


def _width(n: int) -> int:
    """Words of the window in which an item of ``n`` words is confirmed."""
    return max(STRIDE + 1, 2 * n)


def indexes(items: list[tuple[int, str]], stats=None) -> list["Index"]:
    """Items by the power of two that their window needs as a stride, so that a
    long item lengthens no other item's passages; weights are those of all items."""
    classes, words_of = {}, []
    for item, text in items:
        words, _ = hashed_words([_encoded(text)], MARKS)
        if len(words) >= MIN_ITEM_WORDS:
            words_of.append(words)
            classes.setdefault((_width(len(words)) - 2).bit_length(), []).append((item, text))
    stats = stats or statistics(words_of)
    return [Index(mine, stats) for _, mine in sorted(classes.items())]


def statistics(words_of: list):
    """(items, mean words, sorted terms, items that have each term)."""
    distinct = [np.unique(w) for w in words_of]
    terms, df = np.unique(np.concatenate(distinct), return_counts=True) if distinct else (np.array([], dtype=np.uint64), np.array([]))
    return len(words_of), sum(map(len, words_of)) / max(1, len(words_of)), terms, df


class Index:
    """BM25 postings of test items, with maxima per block of items. ``stats`` are
    the :func:`statistics` of all items; without them those of ``items``."""

    def __init__(self, items: list[tuple[int, str]], stats=None):
        self.ids, self.terms, self.weights, self.parts = [], [], [], []
        words_of = []
        for item, text in sorted(items):
            words, _ = hashed_words([_encoded(text)], MARKS)
            if len(words) < MIN_ITEM_WORDS:
                continue
            question, answer = (hashed_words([_encoded(p)], MARKS)[0] for p in split_item(plain(text)))
            self.ids.append(item)
            self.parts.append((_grams(question), _grams(answer)))
            words_of.append(words)
        n = len(self.ids)
        self.widths = [_width(len(w)) for w in words_of]
        # a window of any item lies whole in some passage of two strides
        self.stride = max([STRIDE, *(w - 1 for w in self.widths)])
        distinct = [np.unique(w, return_counts=True) for w in words_of]
        total, mean, vocabulary, df = stats or statistics(words_of)
        idf = np.log1p((total - df + 0.5) / (df + 0.5))
        self.threshold, self.rest = np.zeros(n), np.zeros(n)
        postings = []
        for i, (t, tf) in enumerate(distinct):
            w = idf[np.searchsorted(vocabulary, t)] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words_of[i]) / mean))
            self.terms.append(t)
            self.weights.append(w)
            self.threshold[i] = RETRIEVE * w.sum()
            order = np.argsort(w, kind="stable")
            low = np.cumsum(w[order]) <= min(UNOPENED, RETRIEVE * 0.999) * w.sum()  # together still too little: not pivots
            self.rest[i] = w[order][low].sum()
            postings += [(term, i, weight) for term, weight in zip(t[order][~low], w[order][~low])]
        self.pivots = np.unique(np.array([p[0] for p in postings], dtype=np.uint64))
        term = np.searchsorted(self.pivots, np.array([p[0] for p in postings], dtype=np.uint64))
        item = np.array([p[1] for p in postings], dtype=np.int64)
        weight = np.array([p[2] for p in postings], dtype=np.float64)
        self.item_lists = self._csr(term, item, weight, len(self.pivots))
        blocks = -(-n // BLOCK_ITEMS)
        key, at = np.unique(term * max(1, blocks) + item // BLOCK_ITEMS, return_inverse=True)
        top = np.zeros(len(key))
        np.maximum.at(top, at, weight)
        self.block_lists = self._csr(key // max(1, blocks), key % max(1, blocks), top, len(self.pivots))
        # a block can qualify if its maxima reach the easiest gap of its items
        gap = self.threshold - self.rest
        self.block_gap = np.array([gap[k * BLOCK_ITEMS : (k + 1) * BLOCK_ITEMS].min() for k in range(blocks)])
        self.item_gap = gap

    @staticmethod
    def _csr(term, target, weight, n):
        order = np.argsort(term, kind="stable")
        return np.searchsorted(term[order], np.arange(n + 1)), target[order], weight[order]

    @staticmethod
    def _expand(lists, query, term):
        """(row of ``query``, target, weight) of all postings of ``term``."""
        begin, target, weight = lists
        count = begin[term + 1] - begin[term]
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[term], count)
        return np.repeat(query, count), target[at], weight[at]

    @staticmethod
    def _sums(query, target, weight, width):
        key, at = np.unique(query * width + target, return_inverse=True)
        return key // width, key % width, np.bincount(at, weights=weight)

    def search(self, texts, hashed=None):
        """(text, item, score, question overlap, answer overlap, first word of the
        window) of every leak; the best window of each pair. Where ``hashed``, the
        texts' words, are given, of ``texts`` only the number counts."""
        best = {}
        if not self.ids:
            return best
        words, owner = hashed or hashed_words(texts, MARKS)
        if not len(words):
            return best
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
        base = np.concatenate(([0], np.cumsum(np.diff(first) // self.stride + 1)))
        at = np.minimum(np.searchsorted(self.pivots, words), len(self.pivots) - 1)
        hit = np.flatnonzero(self.pivots[at] == words)
        place = (hit - first[owner[hit]]) // self.stride
        # passage w holds the words from w * stride up to (w + 2) * stride
        w, t = base[owner[hit]] + place, at[hit]
        inner = place > 0
        w, t = np.concatenate((w, w[inner] - 1)), np.concatenate((t, t[inner]))
        pair = np.unique(w * len(self.pivots) + t)
        w, t = pair // len(self.pivots), pair % len(self.pivots)
        bw, block, upper = self._sums(*self._expand(self.block_lists, w, t), len(self.block_gap))
        keep = upper >= self.block_gap[block] * 0.999
        open_ = np.unique(bw[keep] * len(self.block_gap) + block[keep])
        if not len(open_):
            return best
        live = np.isin(w, open_ // len(self.block_gap))
        iw, item, weight = self._expand(self.item_lists, w[live], t[live])
        inside = np.isin(iw * len(self.block_gap) + item // BLOCK_ITEMS, open_)
        iw, item, upper = self._sums(iw[inside], item[inside], weight[inside], len(self.ids))
        keep = upper >= self.item_gap[item] * 0.999
        grams, last = None, -1
        for window, i in zip(iw[keep].tolist(), item[keep].tolist()):
            if window != last:
                text = int(np.searchsorted(base, window, side="right") - 1)
                start = (window - base[text]) * self.stride
                passage = words[first[text] + start : min(first[text + 1], first[text] + start + 2 * self.stride)]
                held, grams, last = np.unique(passage), None, window
            score = float(self.weights[i][np.isin(self.terms[i], held, assume_unique=True)].sum())
            if score < self.threshold[i] * (1 - 1e-9):
                continue
            shares = []
            for part in self.parts[i]:
                if not len(part):
                    shares.append(1.0)
                    continue
                if grams is None:
                    grams = {k: _grams_all(passage, k) for k in range(1, NGRAM + 1)}
                shares.append(max(float(np.isin(part, grams[k]).mean()) for k in (range(1, NGRAM + 1) if len(part) == 1 else [NGRAM])))
            if min(shares) >= OVERLAP and (window_ := self._window(passage, i, grams)):
                found = (*window_[:3], int(start + window_[3]))
                best[(text, i)] = max(best.get((text, i), found), found)
        return best

    def _window(self, passage, i: int, grams):
        """(score, question overlap, answer overlap, first word) of the passage's
        best window for item ``i`` that reaches all three bounds, or None."""
        size, width = len(passage), self.widths[i]
        at = np.minimum(np.searchsorted(self.terms[i], passage), len(self.terms[i]) - 1)
        hit = np.flatnonzero(self.terms[i][at] == passage)
        score = _sliding(hit, at[hit], self.weights[i][at[hit]], width - 1, size)
        shares = []
        for part in self.parts[i]:
            share = np.zeros(size) if len(part) else np.ones(size)
            for k in (range(1, NGRAM + 1) if len(part) == 1 else [NGRAM]) if len(part) else ():
                run = grams[k]
                j = np.minimum(np.searchsorted(part, run), len(part) - 1)
                on = np.flatnonzero(part[j] == run)
                place = on % max(1, len(run) // 2)  # grams of either name, position by position
                share = np.maximum(share, _sliding(place, j[on], np.ones(len(on)), width - k, size) / len(part))
            shares.append(share)
        ok = np.flatnonzero((score >= self.threshold[i] * (1 - 1e-9)) & (np.minimum(*shares) >= OVERLAP - 1e-9))
        if not len(ok):
            return None
        s = int(ok[np.lexsort((ok, -shares[1][ok].round(9), -shares[0][ok].round(9), -score[ok].round(9)))[0]])
        held = np.isin(self.terms[i], passage[s : s + width])
        return float(self.weights[i][held].sum()), float(shares[0][s].round(12)), float(shares[1][s].round(12)), s


def _sliding(place, key, value, reach: int, size: int):
    """For every start s below ``size``: the sum of ``value`` over the distinct
    keys that have a place in s .. s + reach."""
    order = np.lexsort((place, key))
    place, key, value = place[order], key[order], value[order]
    before = np.full(len(place), -1)
    same = np.flatnonzero(key[1:] == key[:-1]) + 1
    before[same] = place[same - 1]
    # a key counts by its first place in the window
    begin = np.maximum(np.maximum(before + 1, place - reach), 0)
    change = np.bincount(begin, weights=value, minlength=size + 1) - np.bincount(place + 1, weights=value, minlength=size + 1)
    return np.cumsum(change)[:size]


class ShortItems:
    """Items of fewer than MIN_ITEM_WORDS words, found where all their words stand
    in a row; ``bm25`` of such a match is the number of words."""

    def __init__(self, items: list[tuple[int, str]]):
        self.lists = {}
        for item, text in sorted(items):
            words, _ = hashed_words([_encoded(text)], MARKS)
            if 0 < len(words) < MIN_ITEM_WORDS:
                self.lists.setdefault(len(words), []).append((int(shingles(words, np.zeros(len(words), dtype=np.int64), len(words))[0][0]), item))
        self.lists = {k: (np.array([h for h, _ in sorted(v)], dtype=np.uint64), [i for _, i in sorted(v)]) for k, v in self.lists.items()}

    def search(self, texts, hashed=None):
        """(text, item id) -> (words, 1, 1, first word of the first match)."""
        found = {}
        if not self.lists:
            return found
        words, owner = hashed or hashed_words(texts, MARKS)
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
        for k, (hashes, ids) in self.lists.items():
            runs, _ = shingles(words, owner, k)
            at = np.flatnonzero(owner[: max(0, len(words) - k + 1)] == owner[k - 1 :])
            lo, hi = np.searchsorted(hashes, runs), np.searchsorted(hashes, runs, side="right")
            for r in np.flatnonzero(hi > lo).tolist():
                text = int(owner[at[r]])
                for i in range(lo[r], hi[r]):
                    found.setdefault((text, ids[i]), (float(k), 1.0, 1.0, int(at[r] - first[text])))
        return found


def _grams_all(words, k: int):
    """All runs of k words, named as :func:`_grams` names them (and as whole sequences)."""
    if len(words) < k:
        return words[:0]
    start = np.arange(len(words) - k + 1)
    whole = span_hashes(words, start, start + k)
    return np.concatenate((whole, shingles(words, np.zeros(len(words), dtype=np.int64), k)[0]))


def _item_terms(batches):
    """Words and distinct terms of the items that are retrieved by score."""
    for batch in batches:
        words_of = [hashed_words([_encoded(t)], MARKS)[0] for t in batch["text"]]
        rows = [(s, len(w), np.unique(w).view(np.int64).tolist()) for s, w in zip(batch["shard"], words_of) if len(w) >= MIN_ITEM_WORDS]
        yield pd.DataFrame(rows, columns=["shard", "n_words", "terms"])


LEAKS = "doc_id long, item_id long, bm25 double, question_overlap double, answer_overlap double, first_word long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, shard_items: int | None = None, short_items: bool = False, shard_bytes: int = SHARD_BYTES, scan_shards: int = SCAN_SHARDS) -> DataFrame:
    """(doc_id, item_id, bm25, question_overlap, answer_overlap, first_word) of
    every document that leaks a test item; one row per row of ``docs`` and item.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns
    are ignored. All passages of all texts are searched, whatever their length.
    Null and empty texts leak nothing, null and wordless items match nothing;
    repeated items count once, repeated documents are each searched; without
    documents or items there is no row. With ``short_items``, as in the query and the
    pipeline, items of fewer than MIN_ITEM_WORDS words leak where all their words
    stand in a row; without it they match nothing.

    An index holds items of at most ``shard_bytes`` of text (or ``shard_items``
    items) on average. A larger benchmark has several, built by a task each with the
    term frequencies and mean length of all items and written to the shared folder:
    the rows are the same. One scan of ``docs`` hashes its words once and visits the
    broadcast indexes in turn, one in memory at a time; beyond ``scan_shards`` of
    them there are further scans, as every executor keeps a scan's indexes on disk. An
    item is confirmed in a window of twice its own words, or of STRIDE + 1 where that
    is more.
    """
    context = docs.sparkSession.sparkContext
    items = benchmark.filter("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text").distinct()
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(1, -(-size // shard_bytes), -(-n // shard_items) if shard_items else 1)
    texts = docs.select("doc_id", text_or_empty("text").alias("text"))
    if shards == 1:
        return _search(texts, [context.broadcast(_index([(r["item_id"], r["text"]) for r in items.collect()], short_items))])
    built, out = _built(items, shards, short_items), None
    for first in range(0, shards, scan_shards):
        mine = built.filter(F.col("shard").between(first, first + scan_shards - 1))
        indexes_ = [context.broadcast(cloudpickle.loads(r["index"])) for r in mine.toLocalIterator()]
        found = _search(texts, indexes_)
        if shards > scan_shards:
            found = materialize(found, "leaks")
            for index in indexes_:
                index.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _index(items: list, short_items: bool, stats=None):
    return indexes(items, stats), ShortItems(items if short_items else [])


def _built(items: DataFrame, shards: int, short_items: bool) -> DataFrame:
    """(shard, index) of ``items`` dealt over ``shards``; every index weighs by all items."""
    items = materialize(items.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards))), "leak-items")
    counted = materialize(items.mapInPandas(_item_terms, "shard long, n_words long, terms array<long>"), "leak-terms")
    total, mean = counted.agg(F.count("*"), F.avg("n_words")).first()
    terms = counted.select("shard", F.explode("terms").alias("term"))
    frequency = terms.groupBy("term").agg(F.count("*").alias("df"))
    known = terms.distinct().join(frequency, "term")

    def build(key, mine, known):
        term = known["term"].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.argsort(term)
        stats = total, mean or 0.0, term[order], known["df"].to_numpy(dtype=np.int64)[order]
        index = _index(list(zip(mine["item_id"].tolist(), mine["text"])), short_items, stats)
        return pd.DataFrame({"shard": [int(key[0])], "index": [cloudpickle.dumps(index)]})

    return materialize(items.groupBy("shard").cogroup(known.groupBy("shard")).applyInPandas(build, "shard long, index binary"), "leak-indexes")


def _held(batches, limit: int):
    """Lists of (ids, number of texts, their hashed words) of about ``limit`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        ids, texts = batch["doc_id"].astype("Int64").tolist(), batch["text"].tolist()
        for lo, hi in chunks([len(t) + 1 for t in texts]):
            raw = [_encoded(t) for t in texts[lo:hi]]
            held.append((ids[lo:hi], range(hi - lo), hashed_words(raw, MARKS)))
            size += sum(map(len, raw))
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def _search(docs: DataFrame, shards: list) -> DataFrame:
    """Leaks of the items in the broadcast indexes."""

    def search(batches):
        for held in _held(batches, HELD_BYTES if len(shards) > 1 else 1):
            for shard in shards:
                scored, short = shard.value
                for ids, texts, hashed in held:
                    rows = [(ids[t], one.ids[i], *v) for one in scored for (t, i), v in one.search(texts, hashed).items()]
                    rows += [(ids[t], item, *v) for (t, item), v in short.search(texts, hashed).items()]
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in LEAKS.split(", ")])
                if len(shards) > 1:  # the worker reads it from its disk again
                    del scored, short
                    vars(shard).pop("_value", None)

    return docs.mapInPandas(search, LEAKS)


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every leak of every row of ``documents``, short items included; see
    :func:`find_leaks` for nulls, empty texts and repeats."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_items=True)
