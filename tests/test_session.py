"""Scratch blocks: what is written inside goes, what is kept stays."""

import os

import pytest

from quillspark.operators.components import components
from quillspark.session import materialize, scratch, scratch_path


def folders(spark):
    base = os.path.dirname(scratch_path(spark, "probe")).removeprefix("file://").removeprefix("file:")
    return set(os.listdir(base)) if os.path.isdir(base) else set()


def test_tables_of_a_block_go_and_kept_ones_stay(spark):
    df = spark.range(5)
    before = folders(spark)
    with scratch(spark) as keep:
        inner = materialize(df, "inner")
        kept = keep(inner.selectExpr("id + 1 AS id"), "kept")
        assert len(folders(spark) - before) == 2
    assert [f.split("-")[0] for f in folders(spark) - before] == ["kept"]
    assert sorted(r["id"] for r in kept.collect()) == [1, 2, 3, 4, 5]


def test_blocks_nest(spark):
    before = folders(spark)
    with scratch(spark):
        with scratch(spark) as keep:
            materialize(spark.range(2), "a")
            b = keep(spark.range(3), "b")
        assert b.count() == 3 and [f.split("-")[0] for f in folders(spark) - before] == ["b"]
    assert folders(spark) == before


def test_a_block_that_fails_leaves_nothing(spark):
    before = folders(spark)
    with pytest.raises(ValueError), scratch(spark):
        materialize(spark.range(2), "a")
        raise ValueError
    assert folders(spark) == before
    materialize(spark.range(2), "outside")
    assert len(folders(spark) - before) == 1


def test_components_leave_one_table(spark):
    before = folders(spark)
    links = spark.range(50).selectExpr("id AS a", "id + 1 AS b")
    roots = components(links, local_links=0)
    assert len(folders(spark) - before) == 1
    assert roots.filter("root <> 0").isEmpty() and roots.count() == 51
