"""The sink of many reports against the report of one day."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.plans.report_sink import collection_reports, write_reports
from quillspark.plans.reports import collection_report

ENTRY = "day string, canonical_hash string, title string, url string, score int, topic string, secondary_topics array<string>, rationale string, published_at timestamp, sources array<string>"


def entries(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(f"2024-01-{1 + i % 3:02d}", f"h{i}", f"T{i} é", f"https://e.com/{i}", i % 4, ["a", "b", "null"][i % 7 % 3], ["b"] if i % 2 else [], "why", t0 + timedelta(days=i) if i % 5 else None, ["s2", "s1", "s2"][: i % 4])
            for i in range(60)]
    return spark.createDataFrame(rows, ENTRY).repartition(5)


def test_each_day_is_its_report(spark, tmp_path):
    df = entries(spark)
    (tmp_path / "2024-01-02.md").write_text("old")
    for root in (str(tmp_path), f"file://{tmp_path}/deeper/still"):
        write_reports(collection_reports(df), root)
    for k in (1, 2, 3):
        want = collection_report(df.filter(F.col("day") == f"2024-01-0{k}"), date(2024, 1, k)).encode()
        assert (tmp_path / f"2024-01-0{k}.md").read_bytes() == want == (tmp_path / "deeper/still" / f"2024-01-0{k}.md").read_bytes()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["2024-01-01.md", "2024-01-02.md", "2024-01-03.md", "deeper"]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    (tmp_path / "a").write_text("old")
    bad = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("b", 2, None), ("c", 1, "z")], "path string, place long, text string")
    with pytest.raises(Exception, match="NoneType|encode"):
        write_reports(bad, str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == ["a"] and (tmp_path / "a").read_text() == "old"


def test_nothing_to_write(spark, tmp_path):
    write_reports(collection_reports(entries(spark).limit(0)), str(tmp_path))
    assert not list(tmp_path.iterdir())
