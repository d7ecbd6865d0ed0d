"""Alignment of two tokenizers against byte-by-byte brute force over whole texts."""

import hashlib
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm import alignment

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string"
pytestmark = pytest.mark.skipif(not os.path.isdir(alignment.TOKENIZERS), reason="no tokenizers")


@pytest.fixture(scope="module")
def tok():
    return alignment.load(alignment.TOKENIZERS)


def plain(tok, rows):
    """Owners of every byte on both sides; counts over all rows."""
    made, counts = [], Counter()
    for doc, text in rows:
        links, groups, a, b = [], [], [], []
        if text:
            a, b = (ids.tolist() for ids in tok.encode_text(text))
            whole = (" " + text).encode()
            if b"".join(tok.a_bytes[i] for i in a) != whole or b"".join(tok.b_bytes[i] for i in b) != whole:
                a, b = [], []
            own_a = [k for k, i in enumerate(a) for _ in tok.a_bytes[i]]
            own_b = [k for k, i in enumerate(b) for _ in tok.b_bytes[i]]
            seen = sorted(set(zip(own_a, own_b)))
            links = [(a[x], b[y]) for x, y in seen]
            start = 0
            for p in range(1, len(own_a) + 1):
                if p == len(own_a) or own_a[p] != own_a[p - 1] and own_b[p] != own_b[p - 1]:
                    groups.append(tuple(",".join(str(ids[k]) for k in sorted(set(own[start:p]))) for ids, own in ((a, own_a), (b, own_b))))
                    start = p
        counts.update(links)
        shown = ";".join("|".join(g) for g in groups)
        made.append([doc, len(a), len(b), len(groups), len(links), links, hashlib.sha256(shown.encode()).hexdigest() if groups else ""])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return sorted([(d, na, nb, g, n, sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), h) for d, na, nb, g, n, ls, h in made], key=str)


def mine(df):
    return sorted([(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()], key=str)


ODD = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\n b", "a \n", "tab\tand  two   spaces ", "it's <|endoftext|> x", "</s> <s> <unk> <0x0A>", "▁", "a▁b", "a▁ b", "nbsp x 　y", "日本語 のテキスト。", "é é ﬁ Å", "\x00 \x1c x\x1c y", "🙂🙂 👩‍👩‍👧", "x" * 5000, "   " * 300, "​ ﻿", "1234567 89", "a" * 3 + " " * 50 + "b"]


def test_pieces_are_tokenized_as_in_the_whole(tok):
    rnd = random.Random(5)
    marks = list("ab  \n\t.,'s1é日▁  \x1c🙂") + ["  ", " the", "'ll ", "ing ", "<s>"]
    for _ in range(1500):
        text = "".join(rnd.choice(marks) for _ in range(rnd.randrange(1, 40)))
        pieces = alignment.CUT.split(" " + text)
        a, (b, count) = tok.encode_a(pieces), tok.encode_b(pieces)
        whole = tok.encode_text(text)
        assert a.tolist() == whole[0].tolist() and count.sum() == len(b)
        assert "▁" in text or b.tolist() == whole[1].tolist()


def test_ids_are_those_of_the_file(tok):
    """Every code point between letters, digits and marks, and every token's own text."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(os.path.join(alignment.TOKENIZERS, alignment.BYTE_LEVEL))
    own.encode_special_tokens = True
    texts = [f" a{c}b1{c}2.{c},{c} {c}" for c in (chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)]
    texts += [t for t in (v.decode("utf-8", "ignore") for v in tok.a_bytes) if t] + [t for t in ODD if t]
    for at in range(0, len(texts), 50_000):
        some = texts[at : at + 50_000]
        assert [e.ids for e in own.encode_batch(some, add_special_tokens=False)] == [tok.a.encode_ordinary(t) for t in some]


def test_whole_tables(spark, tok):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert mine(alignment.op13_alignment(spark, SF)) == plain(tok, [(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("size", [4 << 20, 1])
def test_edges(spark, tok, size, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH_BYTES", size)
    rows = [(i if i % 7 else None, t) for i, t in enumerate(ODD + ODD[3:9])]
    df = spark.createDataFrame(rows, DDL).withColumns({c: F.lit("own") for c in ("batch", "pair", "pairs", "count", "best", "doc", "n_a")}).repartition(3)
    assert mine(alignment.align(df)) == plain(tok, rows)


def test_nothing_to_align(spark):
    assert alignment.align(spark.createDataFrame([], DDL)).count() == 0
    assert [r[1:] for r in mine(alignment.align(spark.createDataFrame([(1, None), (2, "▁")], DDL)))] == [(0, 0, 0, 0, 0, 0, "")] * 2
