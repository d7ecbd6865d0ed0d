"""Landed replies against the adapters that read one reply."""

import json

from pyspark.sql import functions as F

from quillspark.operators import landed
from quillspark.sources import adapters

HITS = [
    {"hits": [{"objectID": "1", "title": "", "story_title": "S", "url": "https://e.com", "created_at_i": 50, "points": 3, "num_comments": 0, "author": "a"},
              {"objectID": 2, "title": "T", "created_at_i": 70.0, "story_text": "x \"y\""}, {"objectID": "", "title": "gone"}, {"title": "gone"}, "no object", None, {"objectID": "3", "created_at_i": True}]},
    {"hits": []}, {"hits": None}, {"other": 1}, [1], "text",
]
RELEASES = [
    [{"id": 7, "tag_name": "v1", "name": "N", "body": "b", "html_url": "https://g/7", "draft": False, "author": {"login": "me"}, "published_at": "2024-01-02T03:04:05Z"},
     {"id": 0, "html_url": "https://g/0", "name": "only name", "author": None, "published_at": "soon"}, {"id": 8, "draft": True}, {"draft": False}, 5, {"id": "x", "tag_name": "", "name": ""}],
    {"message": "rate limited"}, [],
]


def loaded(rows):
    return sorted((r[0], *sorted(json.loads(r[1]).items(), key=str)) for r in rows)


def test_search_hits(spark):
    df = spark.createDataFrame([(k, json.dumps(b)) for k, b in enumerate(HITS)] + [(9, "{broken"), (10, None)], "reply int, body string")
    got = landed.search_hits(df)
    want = [r for b in HITS for r in adapters.hit_rows(b, 0)[0]]
    assert loaded(got.select("external_id", "payload").collect()) == loaded((k, p) for k, p in want if k != "3") + loaded([("3", json.dumps({"link": adapters.HN_ITEM.format(3), "hn_url": adapters.HN_ITEM.format(3)}))])
    assert landed.advanced(got, 10).first()[0] == 70 and landed.advanced(got, 99).first()[0] == 99 and landed.advanced(got.limit(0), 5).first()[0] == 5


def test_releases(spark):
    df = spark.createDataFrame([("o/n", json.dumps(b)) for b in RELEASES] + [("o/n", "x"), ("o/n", None)], "repo string, body string")
    got = landed.releases(df).select("external_id", "payload").collect()
    assert loaded(got) == loaded(r for b in RELEASES for r in adapters.release_rows("o/n", b))


def test_keys_and_error_entries(spark):
    rows = [("i", "l", "t", "p"), ("", "l", "t", "p"), (None, None, "é", None), (None, "", None, "2024"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "i string, l string, t string, p string")
    assert [r[0] for r in df.select(landed.entry_key(*map(F.col, "iltp"))).collect()] == [adapters.external_id(*r) for r in rows]
    bad = spark.createDataFrame([("http://arxiv.org/api/errors#x", None), ("a", "http://arxiv.org/api/errors"), ("a", "b"), (None, None)], "i string, l string")
    assert [r[0] for r in bad.select(landed.tells_of_an_error(F.col("i"), F.col("l"))).collect()] == [True, True, False, False]
