"""Raw source rows to items: one projection for all source types."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import published_at
from ..functions.entities import extract_entities
from ..functions.text import blank_to_null, strip_tags
from ..functions.url import VERSION, canonical_url

MAX_SUMMARY, MAX_EXTRACTION = 4_000, 20_000
#: Per source type: payload field of the summary, of the extra text for entity
#: extraction, and the payload fields kept as metadata.
SHAPES = {
    "rss": ("summary", "content", ["authors", "tags"]),
    "arxiv": ("summary", "summary", ["authors", "tags"]),
    "hn_search": ("story_text", "story_text", ["hn_url", "author", "points", "num_comments"]),
    "github_releases": ("summary", "summary", ["repo", "tag", "author"]),
    "github_topic": ("summary", "summary", ["repo", "stars"]),
}


def _text(payload: Column, key: str) -> Column:
    """A payload field if it is a JSON string."""
    kind = F.schema_of_variant(F.try_variant_get(payload, f"$.{key}", "variant"))
    return F.when(kind == "STRING", F.try_variant_get(payload, f"$.{key}", "string"))


def _epoch(payload: Column, key: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(payload, f"$.{key}", "variant"))
    return F.when(~kind.isin("STRING", "BOOLEAN"), F.try_variant_get(payload, f"$.{key}", "double"))


def by_type(source_type: Column, choose) -> Column:
    """``choose(shape)`` of the row's source type; null for an unknown one."""
    out = None
    for name, shape in SHAPES.items():
        out = F.when(source_type == name, choose(shape)) if out is None else out.when(source_type == name, choose(shape))
    return out


def metadata(payload: Column, source_type: Column, original: Column) -> Column:
    """Compact JSON of the kept fields; null and empty ones are left out."""
    def pick(shape):
        # fields go in as text: lists as JSON, numbers and strings by value
        got = [F.struct(F.lit(k).alias("k"), F.to_json(F.try_variant_get(payload, f"$.{k}", "variant")).alias("v")) for k in sorted(shape[2])]
        got.append(F.struct(F.lit("original_url").alias("k"), json_string(original).alias("v")))
        kept = F.filter(F.array(*got), lambda e: e["v"].isNotNull() & ~e["v"].isin("null", "[]", '""'))
        return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(kept), lambda e: F.concat(F.lit('"'), e["k"], F.lit('":'), e["v"])), ","), F.lit("}"))

    return by_type(source_type, pick)


def json_string(c: Column) -> Column:
    """A JSON string literal."""
    return F.when(c.isNotNull(), F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1))


def normalize(raw: DataFrame, now: Column, extra_tracking=(), idn: bool = True) -> DataFrame:
    """Rows of items from raw rows (source_name, source_type, external_id, payload
    variant, fetched_at).

    ``error`` says why a row is no item (unknown type, no usable URL, bad URL);
    such rows stay, so that they can be counted. ``entities`` come from title,
    summary and the type's extra text, cut before markup is stripped.
    """
    p, kind = F.col("payload"), F.col("source_type")
    staged = raw.select(
        "source_name", "source_type", "external_id", "fetched_at", "payload",
        blank_to_null(_text(p, "link")).alias("link"),
        _text(p, "link").alias("_link"),
        F.coalesce(blank_to_null(_text(p, "title")), F.lit("(untitled)")).alias("title"),
        F.left(blank_to_null(by_type(kind, lambda s: _text(p, s[0]))), F.lit(MAX_SUMMARY)).alias("summary"),
        F.nullif(by_type(kind, lambda s: _text(p, s[1])), F.lit("")).alias("_extra"),
        published_at(_epoch(p, "published_timestamp"), _epoch(p, "updated_timestamp")).alias("published_at"),
    ).withColumn("url", canonical_url("link", extra_tracking, idn))
    error = (
        F.when(~kind.isin(*SHAPES) | kind.isNull(), F.concat(F.lit("no normalizer for source_type "), F.coalesce(kind, F.lit("null"))))
        .when(F.col("link").isNull(), "no usable url")
        .when(F.col("url").isNull() | ~F.col("url").rlike(r"^https?://"), "url is not http(s)")
    )
    text = strip_tags(F.left(F.concat_ws("\n", "title", "summary", "_extra"), F.lit(MAX_EXTRACTION)))
    return staged.select(
        F.sha2("url", 256).alias("canonical_hash"), "url", "title", "summary", "published_at", now.alias("ingested_at"),
        metadata(F.col("payload"), kind, F.when(F.col("_link") != F.col("url"), F.col("_link"))).alias("metadata"),
        F.lit(VERSION).alias("canonicalization_version"), "source_name", "source_type", "external_id",
        F.coalesce("fetched_at", now).alias("first_seen_at"), extract_entities(text).alias("entities"), error.alias("error"),
    )


def validate(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): malformed rows are set aside and counted, never fatal."""
    return items.filter("error IS NULL").drop("error"), items.filter("error IS NOT NULL")
