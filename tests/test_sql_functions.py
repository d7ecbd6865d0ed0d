"""SQL names against the Column functions."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.functions import dates, entities, similarity, text, url
from quillspark.functions.sql import register_functions

TEXTS = [None, "", "  a |b\n c ", "cve-2024-12345 and CVE-2024-1, npm:@Scope/Left-pad, PyPI:Lib.x", "https://github.com/Org/Repo.git and github.com/sponsors/x, and/or a/b.py o-w/na_me 1/2",
         " ".join(f"npm:p{i} o{i}/r{i}" for i in range(50)), "é/ü x/y", "it's 'quoted' \\ back"]
URLS = [None, "", "HTTP://User@E.com:80/a//?b=1&utm_source=x&B=%zz+c~*&d#f", "https://e.com", "https://e.com:443/x/", "https://e.com:99999/", "https://e.com:8443/?fbclid=1", "https://[::1]:8080/x?q=a=b", "mailto:a@b",
        " https://arxiv.org/pdf/2301.00001v2.PDF ", "https://export.arxiv.org/abs/cs.CR/0001234", "//e.com/x", "rel/path?mc_id=1&x", "https://e.com/a\tb\n", "https://münchen.de/ä?ö=ü"]


@pytest.fixture(scope="module")
def sql(spark):
    assert "quill_entities" in register_functions(spark)
    register_functions(spark)
    spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").createOrReplaceTempView("quill_texts")
    spark.createDataFrame(list(enumerate(URLS)), "id int, url string").createOrReplaceTempView("quill_urls")
    return spark


def same(sql, table, pairs):
    df = sql.table(table)
    got = sql.sql(f"SELECT id, {', '.join(f'{q} AS c{k}' for k, (q, _) in enumerate(pairs))} FROM {table} ORDER BY id").collect()
    assert got == df.select("id", *[c.alias(f"c{k}") for k, (_, c) in enumerate(pairs)]).orderBy("id").collect()


def test_texts(sql):
    t = F.col("text")
    same(sql, "quill_texts", [("quill_strip(text)", text.strip(t)), ("quill_collapse(text)", text.collapse(t)), ("quill_markdown_cell(text)", text.markdown_cell(t)), ("quill_safe_source(text)", text.safe_source_name(t)),
                              ("quill_cves(text)", entities.cves(t)), ("quill_packages(text)", entities.packages(t)), ("quill_entity_list(text)", entities.extract_entities(t)),
                              ("quill_title_similarity(text, 'a b c')", similarity.indel_ratio(t, F.lit("a b c")))])


def test_urls(sql):
    u = F.col("url")
    same(sql, "quill_urls", [("quill_canonical_url(url)", url.canonical_url(u, idn=False)), ("quill_arxiv_id(url)", url.arxiv_id(u)), ("quill_is_tracking(url)", url.is_tracking(u))])
    assert sql.sql("SELECT quill_is_tracking('UTM_x'), quill_is_tracking('reference')").first()[:] == (True, False)


def test_lateral_entities_without_a_shuffle(sql):
    df = sql.sql("SELECT id, e.kind, e.value FROM quill_texts, LATERAL quill_entities(text) e")
    want = sql.table("quill_texts").select("id", F.explode(entities.extract_entities(F.col("text"))).alias("e")).select("id", "e.kind", "e.value")
    assert sorted(df.collect()) == sorted(want.collect()) and want.count() > 64
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan


def test_dates(sql):
    a, b = datetime(2024, 12, 30), datetime(2025, 1, 1, 23)
    df = sql.createDataFrame([(0, a, b), (1, None, b)], "id int, a timestamp, b timestamp")
    df.createOrReplaceTempView("quill_dates")
    same(sql, "quill_dates", [("quill_week(a)", dates.iso_week_label(F.col("a"))), ("quill_age_days(a, b)", dates.age_days(F.col("a"), F.col("b"))), ("quill_close_in_time(a, b, 48)", dates.close_in_time(F.col("a"), F.col("b"), 48))])
