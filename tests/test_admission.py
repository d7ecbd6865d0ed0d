"""Classification on executors against the loop."""

import json
import sys
from datetime import datetime, timedelta

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillspark.operators.admission import batch_queue, classify_table
from quillspark.operators.classify import ProviderError, classifier_version, classify_items, token_estimate, version_of
from quillspark.operators.relational import running_sums

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # providers of this file go to the workers
T0 = datetime(2024, 1, 1)
TOPICS = {"x", "y", "other"}
ODD = ['plain', 'quo"te', 'back\\slash', "line\nbreak\ttab", "bell\x07", "é漢🦜", "", None]


def rows(n):
    return [(f"h{i:03d}", ODD[i % 8], f"s{i % 3}" if i % 5 else None, ODD[(i + 3) % 8], f"https://e.com/{i}", T0 + timedelta(hours=i)) for i in range(n)]


def table(spark, n):
    ddl = "canonical_hash string, title string, source_name string, summary string, url string, ingested_at timestamp"
    return spark.createDataFrame(rows(n), ddl).orderBy(F.rand(1))


class Fixed:
    """Depends on the items alone: every fifth has a bad topic at first, every tenth always."""

    model_id = "fixed"

    def __init__(self, down_from=None, garbage=False):
        self.down_from, self.garbage = down_from, garbage

    def _entries(self, items, temperature):
        if self.down_from is not None and int(items[0]["id"][1:]) >= self.down_from:
            raise ProviderError("down")
        out = {}
        for i in items:
            n = int(i["id"][1:])
            bad = n % 10 == 3 or (n % 5 == 3 and temperature > 0)
            out[i["id"]] = {"topic": "bogus" if bad else "xy"[n % 2], "score": n % 11, "rationale": "r", "secondary_topics": ["x", "x", "y", "z"]}
        return out

    def classify(self, prompt, items, temperature):
        if self.garbage:
            raise ProviderError("no list")
        return self._entries(items, temperature)

    def ask(self, prompt, items, temperature):
        return "nothing" if self.garbage else json.dumps([{"id": "h999", "topic": "x", "score": 1}, *[{"id": k, **v} for k, v in self._entries(items, temperature).items()]])


def by_loop(n, provider, **options):
    items = [{"id": k, "title": t, "source": s, "summary": m, "url": u} for k, t, s, m, u, _ in rows(n)]
    out = classify_items(items, provider, "prompt", TOPICS, batch_size=4, **options)
    kinds = {k: "fallback" if k in out.fallbacks else "classified" for k in out.results} | dict.fromkeys(out.skipped, "skipped")
    return {k: (kind, *(out.results[k][c] for c in ("topic", "secondary_topics", "score", "rationale"))) if k in out.results else (kind, None, None, None, None) for k, kind in kinds.items()}


def by_table(spark, n, provider, **options):
    got = classify_table(table(spark, n), provider, "prompt", TOPICS, batch_size=4, tasks=3, **options).collect()
    assert len(got) == n
    return {r[0]: tuple(r[1:]) for r in got}


@pytest.mark.parametrize("budget", [None, 1, 400, 1200, 2500])
def test_same_outcomes_as_the_loop(spark, budget):
    assert by_table(spark, 46, Fixed(), token_budget=budget) == by_loop(46, Fixed(), token_budget=budget)


def test_outage_skips_what_the_loop_skips(spark):
    for provider in (Fixed(down_from=0), Fixed(down_from=24), Fixed(garbage=True)):
        assert by_table(spark, 46, provider) == by_loop(46, provider)


def test_a_task_gives_up_after_failures_in_a_row(spark, tmp_path):
    class Counting(Fixed):
        def ask(self, prompt, items, temperature):
            (tmp_path / f"{temperature}-{items[0]['id']}").touch()
            raise ProviderError("down")

    got = classify_table(table(spark, 80), Counting(), "prompt", TOPICS, batch_size=2, tasks=1).collect()
    assert {r["outcome"] for r in got} == {"skipped"} and len(got) == 80
    assert len(list(tmp_path.iterdir())) == 6  # three first calls, and the same batches once more


def test_empty_table(spark):
    for budget in (None, 10):
        assert classify_table(table(spark, 4).limit(0), Fixed(), "p", TOPICS, token_budget=budget).count() == 0


def test_costs_are_those_of_the_message(spark):
    pending = table(spark, 30).withColumnsRenamed({"canonical_hash": "id", "source_name": "source"})
    got = {r["batch"]: r for r in batch_queue(pending, ["ingested_at", "id"], 7, "prompt").collect()}
    total = 0
    for k in range(5):
        items = [dict(zip(("id", "title", "source", "summary", "url"), r)) for r in rows(30)[7 * k : 7 * k + 7]]
        total += token_estimate("prompt", items)
        assert got[k]["cost"] == token_estimate("prompt", items) and got[k]["spent"] == total


def test_running_sums_and_versions(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7).repartition(5)
    got = {r["id"]: r["s"] for r in running_sums(df, [F.col("id")], "v", "s").collect()}
    assert got == {i: sum(k % 7 for k in range(i + 1)) for i in range(1000)}
    assert spark.range(1).select(version_of(F.lit("p é"), F.lit("m"))).first()[0] == classifier_version("p é", "m")
