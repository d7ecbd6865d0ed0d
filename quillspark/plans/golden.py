"""Accuracy of a classifier on a labelled JSONL file."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational
from ..operators.classify import Provider, classify_pending

GATE = 0.85
ROW = "title string, summary string, source string, url string, topic string, score int, note string"


def load_golden(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(ROW).json(path).filter("title IS NOT NULL")
    numbered = relational.row_numbers(rows, [F.col("url"), F.col("title")], "canonical_hash")
    return numbered.withColumn("canonical_hash", F.col("canonical_hash").cast("string")).withColumnRenamed("source", "source_name")


def accuracy(golden: DataFrame, provider: Provider, prompt: str, **options) -> tuple[float, DataFrame]:
    """(share of rows with the expected topic, the rows that missed)."""
    topics = {r["topic"] for r in golden.select("topic").distinct().collect()}
    found, _ = classify_pending(golden.orderBy("canonical_hash"), provider, prompt, topics, **options)
    both = golden.join(found.select("canonical_hash", F.col("topic").alias("predicted")), "canonical_hash", "left")
    hit = F.coalesce(F.col("topic") == F.col("predicted"), F.lit(False))
    share = relational.accuracy(both, F.col("topic"), F.col("predicted")).first()["accuracy"]
    return share, both.filter(~hit).select("title", "topic", "predicted")
