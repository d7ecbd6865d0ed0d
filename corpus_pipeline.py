"""The training-corpus pipeline: five stages over ``documents``.

Every stage works on all that its predecessor kept and returns the columns of
``documents`` (the last adds the shard), whatever other columns there are. An empty
table passes through all of them. Each is written as Parquet and read
again before the next one starts, so a lost executor costs one stage at most.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import WORD, identified, small, table
from quillspark.llm.decontaminate import find_leaks
from quillspark.llm.mixing import mixed_documents
from quillspark.llm.neardup import jaccard_components
from quillspark.llm.quality import fit, score_quality
from quillspark.llm.sharding import SHARD_BYTES, shard
from quillspark.session import materialize, scratch

#: Score from which a document passes the quality classifier.
QUALITY = 0.5


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the positive-unlabelled classifier accepts.

    Null texts are judged as empty ones; rows that repeat are judged alike; an id
    plays no part but for choosing rows with labels. No label, or no row: all stay
    (every score is then 0.5).
    """
    model = fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return score_quality(rows, model, "row.text").filter(F.col("score") >= QUALITY).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles,
    Jaccard likeness of at least 0.8): the one with the smallest doc_id.

    Rows that share a doc_id or have none are documents of their own: each is
    linked by its text, and one with a doc_id of its own is preferred to stay. Rows
    equal in every column are exact copies. Texts without words are like nothing
    and all stay, rows without text as well.
    """
    rows = identified(docs)
    groups = jaccard_components(rows.select(F.col("id").alias("doc_id"), "row.text"), k=5, percent=80)
    gone = materialize(groups.filter("n_shingles > 0 AND doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct(), "copies")
    kept = rows.join(small(gone, 16), "id", "left_anti")
    copied = F.col("made") & F.coalesce(F.col("row.text").rlike(WORD), F.lit(False))
    once = kept.filter(copied).groupBy("id").agg(F.first("row").alias("row"))
    return kept.filter(~copied).select("row.*").unionByName(once.select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a test item go, whatever their ids: a null or repeated
    doc_id takes no other row along. Null and empty texts leak nothing and stay."""
    rows = identified(docs)
    leaks = find_leaks(rows.select(F.col("id").alias("doc_id"), "row.text"), table(spark, sf_dir, "benchmark"), short_items=True)
    gone = materialize(leaks.select(F.col("doc_id").alias("id")).distinct(), "leaks")
    return rows.join(small(gone, 16), "id", "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as systematic sampling takes it. Null texts have no
    words, a null source is one of its own, rows are told apart by all their
    columns; see :func:`quillspark.llm.mixing.mixed_documents`."""
    return mixed_documents(docs)


def make_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard, depth, bytes and shard_bytes to every row by extendible hashing of
    the doc_id; copies of a document share a shard, rows without an id are dealt by
    their text, null texts have 0 bytes."""
    return shard(docs, SHARD_BYTES)


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix_sources),
    ("shards", make_shards),
]

#: SQL cannot express the classifier nor the retrieval; the tests hold each stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again. A stage's own tables
    are removed once its rows are written, the stages' rows once the last is."""
    with scratch(spark) as keep:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES[:-1]:
            docs = _written(spark, stage, docs, sf_dir, name)
        name, stage = STAGES[-1]
        return keep(stage(spark, docs, sf_dir), f"pipeline-{name}")


def _written(spark: SparkSession, stage, docs: DataFrame, sf_dir: str, name: str) -> DataFrame:
    with scratch(spark) as keep:
        return keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
