"""The Merkle manifest against a plain tree, over cells and blocks of several levels."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillspark.llm import merkle

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    doc, _, lang, source, n = row
    return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text))


def tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha(levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([m[2] for m in sorted(by[s], key=lambda m: m[:3])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(by[s], key=lambda m: m[:3])):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            h, siblings = leaf(r, r[1].replace("\n", "")) if hit else own, ""
            for levels, k in ((trees[s], i), (top, at)):
                for level in levels[:-1]:
                    run = level[k // 3 * 3 : k // 3 * 3 + 3]
                    siblings += "".join(run[: k % 3] + run[k % 3 + 1 :])
                    h = sha([*run[: k % 3], h, *run[k % 3 + 1 :]])
                    k //= 3
            out.append((r[0], own, trees[s][-1][0], top[-1][0], sha([siblings]), h, h == top[-1][0]))
    return sorted(out, key=str)


def mine(df):
    return sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()], key=str)


ODD = [
    (1, "a\nb", "en", None, 3), (2, None, None, None, None), (3, "", "en", "", 0), (4, "\n", "en", "", 1), (None, "no\nid", "en", "b", 5), (None, "no id", "en", "b", 5), (7, "x", "en", "b", 1), (7, "x", "en", "b", 1),
    (7, "another\ntext", "en", "b", 1), (-5, "negative\n", "en", "b", 1), (-(1 << 63), "least", "en", "b", 1), ((1 << 63) - 1, "most\n", "en", "b", 1), (8, "é\n" * 50_000, "fr", "é", 1), (9, "日本\n", "ja", "\U0001f600", 1), (10, "z", "en", "￮", 1),
]


@pytest.mark.parametrize("cell_rows", [4096, 2])
def test_manifest(spark, cell_rows):
    rows = ODD + [(100 + 3 * i, f"line {i}\nend", "en", "hot", i) for i in range(900)] + [(5000 + i * i * 1_000_003, "t\n", "en", f"s{i}", 1) for i in range(40)]
    clash = {c: F.lit("own") for c in ("row", "src", "key", "leaf", "idx", "n", "block", "path", "rank", "digest")}
    for mixed in (rows, rows[::-1]):
        df = spark.createDataFrame(mixed, DDL).withColumns(clash).repartition(7)
        assert mine(merkle.manifest(df, cell_rows)) == plain(rows)


@pytest.mark.parametrize("n", [1, 4, 10])
def test_small_trees(spark, n):
    rows = [(i, f"text\n{i}", "en", "a" if i < 7 else f"b{i}", 1) for i in range(n)]
    assert mine(merkle.manifest(spark.createDataFrame(rows, DDL))) == plain(rows)


def test_blocks_of_one_level(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 3)
    cloudpickle.register_pickle_by_value(merkle)
    try:
        rows = [(i, f"text\n{i}", "en", "ab"[i % 2] if i < 50 else f"c{i}", 1) for i in range(64)]
        assert mine(merkle.manifest(spark.createDataFrame(rows, DDL))) == plain(rows)
    finally:
        cloudpickle.unregister_pickle_by_value(merkle)


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], DDL)).count() == 0


def test_repeated_rows_are_split(spark):
    df = spark.createDataFrame([(1, "same\n", "en", "a", 1)] * 300 + [(2, "x", "en", "a", 1)], DDL).repartition(3)
    ranks = merkle.ranked(merkle.leaf_table(df), 16)
    assert sorted(r["rank"] for r in ranks.collect()) == list(range(301))
