"""Rows of landed API replies: the mappings of the sources as projections.

Where replies were written down as they came (one row each, ``body`` as text), these
turn them into raw rows for :func:`normalize` without fetching again: all replies of
all sources at once, in the JVM. Other columns of a reply go along with its rows. What
is not JSON, or has another shape, gives no rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import iso_to_epoch
from ..sources.adapters import ARXIV_ERRORS, HN_ITEM


def entry_key(ident: Column, link: Column, title: Column, published: Column) -> Column:
    """An entry's id, else its link, else a digest of title and time."""
    told = F.concat(F.coalesce(title, F.lit("")), F.lit("|"), F.coalesce(published, F.lit("")))
    return F.coalesce(F.nullif(ident, F.lit("")), F.nullif(link, F.lit("")), F.sha2(told, 256))


def tells_of_an_error(ident: Column, link: Column) -> Column:
    """Whether an entry of a paper search is the one that tells of an error."""
    return F.coalesce(F.contains(ident, F.lit(ARXIV_ERRORS)), F.lit(False)) | F.coalesce(F.contains(link, F.lit(ARXIV_ERRORS)), F.lit(False))


def _kind(v: Column, key: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")), F.lit("VOID"))


def _string(v: Column, key: str) -> Column:
    """A field that is a string with letters in it."""
    return F.when(_kind(v, key) == "STRING", F.nullif(F.try_variant_get(v, f"$.{key}", "string"), F.lit("")))


def _name(v: Column, key: str) -> Column:
    """A field that names something: a string, or a number other than 0, as text."""
    plain = F.when(~F.startswith(_kind(v, key), F.lit("OBJECT")) & ~F.startswith(_kind(v, key), F.lit("ARRAY")), F.try_variant_get(v, f"$.{key}", "string"))
    return F.when(~plain.isin("", "0", "false"), plain)


def _number(v: Column, key: str) -> Column:
    return F.when(~_kind(v, key).isin("STRING", "BOOLEAN", "VOID"), F.try_variant_get(v, f"$.{key}", "double"))


def _exploded(replies: DataFrame, path: str) -> DataFrame:
    """A row per object of the list at ``path``, as ``_v``."""
    listed = F.try_variant_get(F.try_parse_json("body"), path, "array<variant>")
    rows = replies.withColumn("_v", F.explode(listed)).drop("body")
    return rows.filter(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")))


def search_hits(replies: DataFrame) -> DataFrame:
    """(other columns, external_id, created, payload) of search replies; ``created`` is the
    epoch second, null where there is none."""
    v = F.col("_v")
    rows = _exploded(replies, "$.hits").withColumn("external_id", F.try_variant_get(v, "$.objectID", "string")).filter("external_id <> ''")
    page = F.concat(*[p for k, part in enumerate(HN_ITEM.split("{}")) for p in ([F.col("external_id")] if k else []) + [F.lit(part)]])
    created = _number(v, "created_at_i").cast("long")
    payload = F.struct(
        F.coalesce(_string(v, "title"), _string(v, "story_title")).alias("title"), F.coalesce(_string(v, "url"), page).alias("link"), page.alias("hn_url"), _string(v, "story_text").alias("story_text"),
        _string(v, "author").alias("author"), _number(v, "points").cast("long").alias("points"), _number(v, "num_comments").cast("long").alias("num_comments"), created.alias("published_timestamp"))
    return rows.withColumns({"created": created, "payload": F.to_json(payload)}).drop("_v")


def advanced(hits: DataFrame, mark: int) -> DataFrame:
    """(new_cursor): the latest second of ``hits``, never before ``mark``."""
    return hits.agg(F.greatest(F.lit(mark), F.coalesce(F.max("created"), F.lit(mark))).cast("long").alias("new_cursor"))


def releases(replies: DataFrame) -> DataFrame:
    """(other columns, external_id, payload) of lists of releases (``repo`` and ``body``);
    drafts are left out."""
    v = F.col("_v")
    rows = _exploded(replies, "$").withColumn("external_id", F.coalesce(_name(v, "id"), _name(v, "html_url"))).filter(F.col("external_id").isNotNull() & _name(v, "draft").isNull())
    payload = F.struct(
        _string(v, "html_url").alias("link"), F.trim(F.concat_ws(" ", "repo", F.coalesce(_string(v, "tag_name"), _string(v, "name"), F.lit("")))).alias("title"), _string(v, "body").alias("summary"),
        F.col("repo").alias("repo"), _string(v, "tag_name").alias("tag"), F.when(F.startswith(_kind(v, "author"), F.lit("OBJECT")), F.try_variant_get(v, "$.author.login", "string")).alias("author"),
        iso_to_epoch(_string(v, "published_at")).alias("published_timestamp"))
    return rows.withColumn("payload", F.to_json(payload)).drop("_v")
