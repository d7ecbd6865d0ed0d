"""Every operator and stage on nulls, empty and repeated rows, ties, empty tables
and columns whose names clash."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quillspark.llm import alignment, decontaminate, exactdedup, extract, lcp, licenses, merkle, mixing, neardup, quality, sharding, urlfilter, warc

GOOD = "The quick brown fox jumps over the lazy dog and then it sleeps near the river bank. "
OTHER = "Rivers of the north run cold in early spring while farmers plough their heavy fields. "
LEAK = "Which river crosses the old town of Ulm in the south? The Danube crosses it."
ROWS = [
    (1, GOOD * 3, "en", "a", 9), (2, GOOD * 3, "en", "a", 9), (3, OTHER * 2, "en", None, 9), (3, OTHER * 2, "en", None, 9), (4, "", "en", "b", 9), (5, None, None, "b", 9),
    (6, " \n\t", "en", "b", None), (None, GOOD * 3, "en", "c", 9), (None, "no id here, and no copy of it either", "en", "c", 9), (None, LEAK, "en", "c", 9), (7, "two texts share this id, this is one", "en", "a", 9),
    (7, "and that is quite another text of them", "en", "a", 9), (8, "x" * 200_000, "en", "a", 9), (9, LEAK, "en", "a", 9), (None, None, None, None, None),
]
DDL = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "row h h1 h2 id made n bytes copies score labels words hits base host path html key k rate start u last salt size _w _c0 _h _host depth c0 d0 b0 t1 component_id b fingerprint".split()


def table(spark, rows=ROWS, clash=False):
    df = spark.createDataFrame(rows, DDL)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES}) if clash else df


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables that the stages read beside their documents."""
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, 1, 0) for i in range(1, 4)] + [(None, 1, 0), (4, 0, 0), (4, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, LEAK), (1, LEAK), (2, None), (None, "x"), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def plain(df):
    return Counter(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in df.collect())


OPERATORS = {
    "fingerprint": lambda df, f: lcp.fingerprint(df), "compare": lambda df, f: lcp.compare_neighbours(df), "components": lambda df, f: neardup.jaccard_components(df),
    "leaks": lambda df, f: decontaminate.find_leaks(df, df.sparkSession.read.parquet(f"{f}/benchmark.parquet"), short_items=True), "mix": lambda df, f: mixing.mix(df), "mixed": lambda df, f: mixing.mixed_documents(df),
    "shard": lambda df, f: sharding.shard(df, 1000), "extract": lambda df, f: extract.extract(df.withColumn("n_chars", F.lit(0)), url="lang", html="text").drop("n_chars"),
    "urls": lambda df, f: urlfilter.filter_urls(df, urlfilter.rule_table(df.sparkSession, urlfilter.CONTRACT_RULES), "text", "doc_id"),
    "quality": lambda df, f: quality.score_quality(df, quality.fit(df, df.sparkSession.read.parquet(f"{f}/labels.parquet"))), "licenses": lambda df, f: licenses.scan_licenses(df),
    "exact": lambda df, f: exactdedup.exact_duplicates(df), "manifest": lambda df, f: merkle.manifest(df), "align": lambda df, f: alignment.align(df),
}
#: Operators that give one row per row.
WHOLE = set(OPERATORS) - {"leaks", "mixed"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operator(spark, folder, name):
    run = OPERATORS[name]
    got = run(table(spark), folder)
    rows = plain(got)
    assert rows == plain(run(table(spark, ROWS[::-1]), folder))  # the order of rows does not matter
    if name in WHOLE:
        assert sum(rows.values()) == len(ROWS)
    clashed = run(table(spark, clash=True), folder)
    assert plain(clashed.select(*[f"`{c}`" for c in got.columns])) == rows or name in ("mixed", "extract")
    kept = [c for c in clashed.columns if c in CLASHES and c not in got.columns]
    assert all(set(r) == {f"own {c}" for c in kept} for r in clashed.select(*kept).distinct().collect())
    assert sum(plain(clashed).values()) == sum(rows.values())
    assert run(table(spark, []), folder).count() == 0 and run(table(spark, [], True), folder).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stage(spark, folder, name):
    run = dict(cp.STAGES)[name]
    for clash in (False, True):
        df = table(spark, clash=clash)
        got = run(spark, df, folder)
        assert got.columns[: len(df.columns)] == df.columns or clash and name == "shards"
        own = [c for c in got.columns if c in CLASHES and c not in ("bytes", "depth")]
        assert not clash or all(set(r) == {f"own {c}" for c in own} for r in got.select(*own).distinct().collect())
        assert plain(got) == plain(run(spark, table(spark, ROWS[::-1], clash), folder)) or name == "quality"
        assert run(spark, table(spark, [], clash), folder).count() == 0


def test_near_duplicates_and_leaks_without_ids(spark, folder):
    kept = [(r["doc_id"], (r["text"] or "")[:9]) for r in cp.near_duplicates(spark, table(spark), folder).collect()]
    want = [(1, GOOD[:9]), (3, OTHER[:9]), (4, ""), (5, ""), (6, " \n\t"), (None, "no id her"), (7, "two texts"), (7, "and that "), (8, "x" * 9), (9, LEAK[:9]), (None, "")]
    assert Counter(kept) == Counter(want)
    clean = [(r["doc_id"], r["text"]) for r in cp.decontaminate(spark, table(spark), folder).collect()]
    assert Counter(clean) == Counter((r[0], r[1]) for r in ROWS if r[1] != LEAK)


def test_archive(spark, tmp_path):
    rows = [(1, "http://e.com/", "small"), (2, None, "é" * 3_000_000), (3, "http://e.com/ x", None), (None, "u", "small"), (1, "http://e.com/", "small")] + [(10 + i, "u", f"page {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("payload", "uri", "kind", "value")})
    warc.write_archive(df, f"file://{tmp_path}/a", date="2024-01-01T00:00:00Z")
    warc.deduplicate_archive(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/b")
    first, second = (warc.read_archive(spark, f"file://{tmp_path}/{d}").collect() for d in "ab")
    assert len(first) == len(second) == len(rows) and not {r["record_id"] for r in first} & {r["record_id"] for r in second}
    assert {r["date"] for r in second} == {"2024-01-01T00:00:00Z"} and {r["refers_to_date"] for r in second if r["record_type"] == "revisit"} == {"2024-01-01T00:00:00Z"}
    once = Counter((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.resolve_revisits(spark, f"file://{tmp_path}/b").collect())
    assert sum(k[3] == "revisit" for k in once.elements()) == 2
    # an archive that has revisits already resolves to the same
    warc.deduplicate_archive(spark, f"file://{tmp_path}/b", f"file://{tmp_path}/c")
    assert once == Counter((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.resolve_revisits(spark, f"file://{tmp_path}/c").collect())
