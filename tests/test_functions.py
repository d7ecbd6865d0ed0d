"""Scalar functions, table-driven."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import dates, entities, replies, similarity, text, url
from quillspark.operators.classify import parse_replies


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


URLS = {
    "HTTPS://User:pw@Example.COM:443/A/b/?utm_source=x&b=1&a=2#Top": "https://example.com/A/b?b=1&a=2#Top",
    "http://e.com": "http://e.com/",
    "http://e.com:8080/x/": "http://e.com:8080/x",
    "https://e.com:80/": "https://e.com:80/",
    "https://e.com//": "https://e.com",
    "https://e.com/?a": "https://e.com/?a=",
    "https://e.com/?q=a%20b+c": "https://e.com/?q=a+b+c",
    "https://e.com/?q=%zz&r=;": "https://e.com/?q=%25zz&r=%3B",
    "https://e.com/?a=*~-._": "https://e.com/?a=%2A~-._",
    "https://e.com/?&&x=1&": "https://e.com/?x=1",
    "https://e.com/p#": "https://e.com/p",
    "https://e.com/p?x#a?b": "https://e.com/p?x=#a?b",
    "https://e.com/?FBCLID=1&Mc_cid=2&keep=3": "https://e.com/?keep=3",
    "https://bücher.example/ä": "https://xn--bcher-kva.example/ä",
    "https://arxiv.org/pdf/2305.12345v2.pdf": "https://arxiv.org/abs/2305.12345",
    "http://export.arxiv.org/abs/cs.CR/0501001v1": "https://arxiv.org/abs/cs.CR/0501001",
    "https://arxiv.org/list/cs": "https://arxiv.org/list/cs",
    "https://e.com:99999/": None,
    "  https://e.com/x\n": "https://e.com/x",
}


def test_canonical_url(spark):
    assert column(spark, list(URLS), url.canonical_url) == list(URLS.values())


def test_canonical_url_is_idempotent(spark):
    once = [v for v in URLS.values() if v and v != "https://e.com"]
    assert column(spark, once, url.canonical_url) == once


def test_extra_tracking(spark):
    assert column(spark, ["https://e.com/?SID=1&b=2"], lambda c: url.canonical_url(c, ["sid"])) == ["https://e.com/?b=2"]


ENTITIES = {
    "see cve-2024-12345, CVE-2024-1": [("cve", "CVE-2024-12345")],
    "https://github.com/Foo/Bar.git and github.com/sponsors/x": [("repo", "foo/bar")],
    "use Owner/Name, and/or n/a; src/main.py 1/2 a/b/c": [("repo", "owner/name")],
    "npm:@Scope/pkg-1 PyPI:Lib.x.": [("package", "npm:@scope/pkg-1"), ("package", "pypi:lib.x")],
    "": [],
}


def test_entities(spark):
    got = column(spark, list(ENTITIES), entities.extract_entities)
    assert [[tuple(e) for e in row] for row in got] == list(ENTITIES.values())


def test_entity_limit_cuts_repositories_first(spark):
    noisy = " ".join(f"o{i}/r{i}" for i in range(100)) + " CVE-2024-0001 npm:z"
    kinds = [e["kind"] for e in column(spark, [noisy], entities.extract_entities)[0]]
    assert len(kinds) == 64 and kinds[:2] == ["cve", "package"]


@pytest.mark.parametrize("a,b,want", [("", "", 1.0), ("abc", "abc", 1.0), ("mcp server leaks secrets", "mcp server leaks secrets via env", 48 / 56), ("abc", "", 0.0)])
def test_indel(a, b, want):
    assert similarity.indel(a, b) == pytest.approx(want)
    assert similarity.lcs_bound(a, b) >= similarity.lcs_length(a, b)


def test_text(spark):
    assert column(spark, ["\t a \n"], text.strip) == ["a"]
    assert column(spark, ["<p>a&amp;b</p><script>x</script> c&eacute;"], text.html_to_text) == ["a&b cé"]
    assert column(spark, ["```json\n[1]\n```", "[2]"], text.unfence) == ["[1]", "[2]"]
    assert column(spark, ["a\x00b \n\t c" + "x" * 400], text.clean_rationale)[0].startswith("ab cxxx")
    assert column(spark, ["a|b\nc "], text.markdown_cell) == ["a\\|b c"]


def test_dates(spark):
    assert column(spark, ["2026-05-20T00:00:00Z", "2026-05-20T02:00:00+02:00", "2026-05-20T00:00:00", "nope", None], dates.iso_to_epoch) == [1779235200] * 3 + [None] * 2
    label = lambda c: dates.iso_week_label(c.cast("timestamp"))
    assert column(spark, ["2027-01-01", "2026-05-18"], label) == ["W2026-W53", "W2026-W21"]
    got = column(spark, [1e18, -1e18, 0.0], lambda c: F.unix_seconds(dates.epoch_to_timestamp(c)), "double")
    assert got == [None, None, 0]


SCORES = {"7": 7, '"7"': 7, "7.0": 7, '"7.0"': 7, '" 7 "': 7, "true": 1, "7.5": None, "null": None, "11": None, "-1": None, '"x"': None, "[7]": None}


def test_scores(spark):
    got = column(spark, [f'{{"score":{k}}}' for k in SCORES], lambda c: replies.lax_score(F.parse_json(c)))
    assert got == list(SCORES.values())


def test_replies(spark):
    good = '{"id":"a","topic":"t","score":"8","rationale":"why","secondary_topics":["x"]}'
    later = '{"id":"a","topic":"u","score":1}'
    bad = ['{"id":"a","topic":"t","score":7.5}', '{"id":"a","topic":null,"score":1}', '{"id":"a","score":1,"rationale":null}', '{"id":"a","score":1,"secondary_topics":[1]}', '"text"', '{"id":5,"score":1}']
    known = spark.createDataFrame([("a",)], "id string")

    def parse(reply):
        df = spark.createDataFrame([(1, reply)], "reply_id int, reply string")
        return [(r["topic"], r["score"], r["secondary_topics"]) for r in parse_replies(df, known).collect()]

    assert parse(f"[{good},{later}]") == [("t", 8, ["x"])]
    assert parse(f"[{','.join(bad)},{good}]") == [("t", 8, ["x"])]
    assert parse('{"results":[' + later + "]}") == [("u", 1, [])]
    assert parse('{"whatever":[{"id":"a","score":2}]}') == [("", 2, [])]
    assert parse('[{"id":"zzz","score":2}]') == []
    assert parse('{"p":[],"q":[]}') == parse("not json") == []
