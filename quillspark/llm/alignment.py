"""Alignment of two tokenizers by elementary intervals.

A text is cut where neither tokenizer can have a token across: before a space that
follows another character than white space. Each distinct piece of a batch of texts
is tokenized once by both. The ends of both tokenizers' tokens cut the bytes into
elementary intervals, each of which lies in one token of either and so is one link;
ends that both share close a group. Link counts of id pairs are summed over the whole
corpus, asked for once per batch and distinct pair, and given back to the batch.
"""

import hashlib
import json
import os
import re
from collections import defaultdict
from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from ..session import materialize
from .common import small, table

#: Folder of the tokenizer files on every machine, and the two files.
TOKENIZERS = "/opt/tokenizers"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in a batch (a longer text is a batch of its own), pieces tokenized at once.
BATCH_BYTES = 4 << 20
PIECES_AT_ONCE = 1 << 15
#: Where texts are cut: both \S of Python's and the space are plain for every tokenizer.
CUT = re.compile(r"(?<=[^\s▁])(?= )")
#: How the byte-level tokenizer parts a text before its merges (a fixed value).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A piece of the second tokenizer is encoded behind this letter, which is one token.
LEAD = "a"


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable
    Latin-1 stands for itself, the other bytes follow from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers and the bytes of all their ids.

    The merges of the byte-level vocabulary are in the order of its ids, so its file
    serves as a table of ranks; the tests hold the ids against the file's own library.
    """

    def __init__(self, folder: str = TOKENIZERS):
        import sentencepiece
        import tiktoken

        with open(os.path.join(folder, BYTE_LEVEL), encoding="utf-8") as f:
            read = json.load(f)
        special, symbols = {t["content"] for t in read["added_tokens"]}, byte_of_symbol()
        vocab = {i: t.encode() if t in special else bytes(symbols[c] for c in t) for t, i in read["model"]["vocab"].items()}
        self.a_bytes = [vocab[i] for i in range(len(vocab))]
        ranks = {v: i for i, v in vocab.items() if v.decode("latin-1") not in special}
        self.a = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, PIECES))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if len(self.b.encode(LEAD)) != 1 or any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces reach across spaces, texts cannot be cut there")
        self.a_size, self.b_size = (np.array([len(v) for v in table]) for table in (self.a_bytes, self.b_bytes))
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.shown = np.array([[f"{i}{mark}" for i in range(most)] for mark in ",|;"], dtype=object)

    def encode_a(self, pieces: list[str]):
        """Ids of pieces one after the other. Those that end in a plain character are
        encoded in one go, as texts are cut behind such characters."""
        out, run = [], []
        for p in pieces:
            run.append(p)
            if p[-1].isspace():
                out.append(self.a.encode_to_numpy("".join(run), disallowed_special=()))
                run = []
        if run:
            out.append(self.a.encode_to_numpy("".join(run), disallowed_special=()))
        return np.concatenate(out).astype(np.int64)

    def encode_b(self, pieces: list[str]):
        """(ids of pieces one after the other, how many each has)."""
        ids = self.b.encode([LEAD + p for p in pieces], num_threads=1)
        count = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) - 1
        flat = np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=int(count.sum()) + len(ids))
        return np.delete(flat, np.cumsum(count + 1) - count - 1), count

    def encode_text(self, text: str):
        """(A ids, B ids) of a whole text, uncut."""
        return self.a.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64), np.array(self.b.encode(text, num_threads=1), dtype=np.int64)


_LOADED: dict = {}


def load(folder: str) -> Tokenizers:
    """The tokenizers of a worker, read once."""
    if folder not in _LOADED:
        _LOADED[folder] = Tokenizers(folder)
    return _LOADED[folder]


def union(a, b):
    """What np.union1d gives for two ascending arrays, by merging them."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return both[np.append(both[1:] != both[:-1], True)] if len(both) else both


class Aligned:
    """Alignments of pieces (bytes): per piece the token, group and link numbers,
    whether both tokenizers give its bytes back (else it has no tokens), its groups as
    text, and its links as numbers a * B ids + b, from ``starts[i]`` to ``starts[i + 1]``.
    """

    def __init__(self, tok: Tokenizers, pieces: list[bytes], a, b, b_count):
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        stops, whole = np.cumsum(size), b"".join(pieces)
        ends_a, ends_b = np.cumsum(tok.a_size[a]), np.cumsum(tok.b_size[b])
        if b"".join(map(tok.a_bytes.__getitem__, a.tolist())) != whole:
            raise ValueError("a byte-level tokenizer gives every text back")
        of_b = np.repeat(np.arange(len(pieces)), b_count)
        self.good = np.bincount(of_b, weights=tok.b_size[b], minlength=len(pieces)).astype(np.int64) == size
        if not self.good.all() or b"".join(map(tok.b_bytes.__getitem__, b.tolist())) != whole:
            at = np.concatenate(([0], np.cumsum(b_count)))
            self.good = np.array([b"".join(tok.b_bytes[i] for i in b[lo:hi]) == p for p, lo, hi in zip(pieces, at, at[1:])], dtype=bool)
            keep_a, keep_b = self.good[np.searchsorted(stops, ends_a)], self.good[of_b]
            a, b, of_b = a[keep_a], b[keep_b], of_b[keep_b]
            ends_a, ends_b, stops = np.cumsum(tok.a_size[a]), np.cumsum(tok.b_size[b]), np.cumsum(np.where(self.good, size, 0))
        self.n_a = np.diff(np.concatenate(([0], np.searchsorted(ends_a, stops, side="right"))))
        self.n_b = np.bincount(of_b, minlength=len(pieces))
        # every interval between two neighbouring ends has one owner on either side
        ends = union(ends_a, ends_b)
        own_a, own_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        self.pairs = a[own_a] * len(tok.b_bytes) + b[own_b]
        self.n_links = np.diff(np.concatenate(([0], np.searchsorted(ends, stops, side="right"))))
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        groups = np.searchsorted(shared, stops, side="right")
        self.n_groups = np.diff(np.concatenate(([0], groups)))
        self.text = _group_texts(tok, a, b, np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b), groups)


def _group_texts(tok: Tokenizers, a, b, group_a, group_b, last_groups) -> list[str]:
    """``a1,a2|b1;a3|b2`` of every piece; ``last_groups`` counts the groups up to each."""
    if not len(a):
        return [""] * len(last_groups)
    # tokens keep their order within a side of a group
    order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
    place = np.concatenate((2 * group_a, 2 * group_b + 1))[order]
    follows = np.append(place[1:] == place[:-1], False)
    mark = np.where(follows, 0, 1 + place % 2)
    shown = tok.shown[mark, np.concatenate((a, b))[order]].tolist()
    cuts = np.searchsorted(place, 2 * last_groups).tolist()
    return ["".join(shown[lo:hi])[:-1] for lo, hi in zip([0, *cuts], cuts)]


def align_batch(tok: Tokenizers, texts: list):
    """Alignments of whole texts: (frame with a row per text, pairs and starts per piece).

    The frame has n_a, n_b, n_groups, n_links, groups_sha256 and ``pieces``, the
    numbers of a text's pieces as int32. A text one of whose pieces does not give its
    bytes back is tokenized whole; if that does not either, it has no tokens.
    """
    known: defaultdict = defaultdict(count().__next__)
    of_text = [list(map(known.__getitem__, CUT.split(" " + t))) if t else [] for t in texts]
    names = list(known)
    parts = []
    for at in range(0, len(names), PIECES_AT_ONCE):
        some = names[at : at + PIECES_AT_ONCE]
        parts.append(Aligned(tok, [p.encode() for p in some], tok.encode_a(some), *tok.encode_b(some)))
    good = np.concatenate([p.good for p in parts]) if parts else np.zeros(0, dtype=bool)
    bad = set(np.flatnonzero(~good).tolist())
    made = len(names)
    for i, pieces in enumerate(of_text if bad else []):
        if not bad.isdisjoint(pieces):
            a, b = tok.encode_text(texts[i])
            whole = Aligned(tok, [(" " + texts[i]).encode()], a, b, np.array([len(b)]))
            of_text[i] = [made] if whole.good[0] else []
            parts.append(whole)
            made += 1
    figures = [np.concatenate([getattr(p, k) for p in parts]) if parts else np.zeros(0, dtype=np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")]
    shown = [t for p in parts for t in p.text]
    rows = []
    for pieces in of_text:
        at = np.array(pieces, dtype=np.int32)
        digest = hashlib.sha256(";".join([shown[p] for p in pieces]).encode()).hexdigest() if pieces else ""
        rows.append((*(int(f[at].sum()) for f in figures), digest, at.tobytes()))
    pairs = np.concatenate([p.pairs for p in parts]) if parts else np.zeros(0, dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(figures[3])))
    return pd.DataFrame(rows, columns=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pieces"]), pairs, starts


def batch_rows(tok: Tokenizers, ids: list, texts: list, batch: int) -> pd.DataFrame:
    """Rows of a batch, led by one with its distinct pairs, how often each is linked,
    and the pieces' links as numbers of these pairs."""
    frame, pairs, starts = align_batch(tok, texts)
    distinct, number = np.unique(pairs, return_inverse=True)
    uses = np.bincount(np.concatenate([np.frombuffer(p, dtype=np.int32) for p in frame["pieces"]]), minlength=len(starts) - 1)
    links = np.bincount(number, weights=np.repeat(uses, np.diff(starts)), minlength=len(distinct)).astype(np.int64)
    used = links > 0
    rank = np.cumsum(used) - 1  # pieces of texts that were tokenized anew have no use
    frame.insert(0, "doc_id", ids)
    head = {"pairs": distinct[used], "links": links[used], "starts": starts.astype(np.int64).tobytes(), "numbers": rank[number].astype(np.int32).tobytes()}
    whole = {c: [None, *frame[c]] for c in frame.columns} | {c: [v] + [None] * len(frame) for c, v in head.items()}
    return pd.DataFrame(whole, dtype=object).assign(batch=batch)


COLUMNS = {"batch": "long", "doc_id": "string", "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string", "pieces": "binary",
           "pairs": "array<long>", "links": "array<long>", "starts": "binary", "numbers": "binary"}


def aligned_texts(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """Stored rows of :func:`batch_rows`, one batch after the other."""

    def run(batches):
        tok, made, part = load(folder), 0, TaskContext.get().partitionId()
        ids, texts, held = [], [], 0

        def flush():
            nonlocal ids, texts, held, made
            frame = batch_rows(tok, ids, texts, (part << 32) + made)
            ids, texts, held, made = [], [], 0, made + 1
            return frame[list(COLUMNS)]

        for batch in batches:
            for doc, text in zip(batch["doc"], batch["text"]):
                size = len(text or "")
                if ids and held + size > BATCH_BYTES:
                    yield flush()
                ids.append(doc)
                texts.append(text)
                held += size
        if ids:
            yield flush()

    schema = ", ".join(f"{k} {v}" for k, v in COLUMNS.items())
    return materialize(docs.select(F.col("doc_id").cast("string").alias("doc"), F.col("text").cast("string").alias("text")).mapInPandas(run, schema), "aligned")


def link_counts(aligned: DataFrame, b_ids: int) -> DataFrame:
    """Stored (pair, count, best): links of every id pair in the whole corpus, and
    whether no pair with its B id has more."""
    asked = aligned.filter(F.col("pairs").isNotNull()).select(F.explode(F.arrays_zip("pairs", "links")).alias("p"))
    counts = materialize(asked.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.links").alias("count")), "counts")
    most = counts.groupBy((F.col("pair") % b_ids).alias("b")).agg(F.max("count").alias("most"))
    return materialize(counts.join(small(materialize(most, "most"), 16), F.col("pair") % b_ids == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "counts")


def align(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every
    row of ``docs``.

    Null and empty texts, and texts that a tokenizer does not give back byte for byte,
    have zeros and an empty ``groups_sha256``, and add nothing to the counts. Repeated
    rows count as often as they stand there, ids may repeat or be null. Whole texts
    are tokenized whatever their length; other columns play no part; an empty table
    gives no rows.
    """
    aligned = aligned_texts(docs, folder)
    counts = link_counts(aligned, len(load(folder).b_bytes))
    asked = aligned.filter(F.col("pairs").isNotNull()).select("batch", F.explode("pairs").alias("pair"))
    told = asked.join(small(counts, 24), "pair").select(F.col("batch").alias("of"), "pair", "count", "best")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def answer(replies: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        head = rows["pairs"].notna().to_numpy()
        lead, docs = rows[head].iloc[0], rows[~head]
        order = np.argsort(replies["pair"].to_numpy())
        starts, numbers = np.frombuffer(lead["starts"], dtype=np.int64), np.frombuffer(lead["numbers"], dtype=np.int32)
        best = count = np.zeros(len(starts) - 1, dtype=np.int64)
        if len(order):
            sums = [np.concatenate(([0], np.cumsum(replies[c].to_numpy()[order].astype(np.int64)[numbers]))) for c in ("best", "count")]
            best, count = (s[starts[1:]] - s[starts[:-1]] for s in sums)
        at = [np.frombuffer(p, dtype=np.int32) for p in docs["pieces"]]
        return docs.assign(n_best=[int(best[p].sum()) for p in at], count_sum=[int(count[p].sum()) for p in at])[names]

    made = told.groupBy("of").cogroup(aligned.groupBy("batch")).applyInPandas(answer, "doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return made.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    """Alignment of both tokenizers over every text of ``documents``; see :func:`align`."""
    return align(table(spark, sf_dir, "documents").select("doc_id", "text"))
