"""Reading classifier replies: JSON of any shape in, checked columns out."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_rationale, unfence

MAX_REPLY, MAX_ENTRIES, MAX_TOPIC, MAX_SECONDARIES = 200_000, 2_000, 128, 10
WRAPPERS = ["results", "items", "classifications"]


def reply_entries(reply: Column) -> Column:
    """The array of objects in a reply, as array<variant>; null if there is none.

    It is the array itself, or the first of the known keys that holds one, or
    the only list of the object. Replies beyond the size limit have none.
    """
    value = F.when(F.length(reply) <= MAX_REPLY, F.try_parse_json(unfence(reply)))
    lists = F.filter(F.map_values(F.try_variant_get(value, "$", "map<string,variant>")), lambda v: F.startswith(F.schema_of_variant(v), F.lit("ARRAY")))
    found = F.when(F.startswith(F.schema_of_variant(value), F.lit("ARRAY")), F.try_variant_get(value, "$", "array<variant>"))
    keyed = F.coalesce(*[F.when(F.startswith(F.schema_of_variant(F.try_variant_get(value, f"$.{k}", "variant")), F.lit("ARRAY")), F.try_variant_get(value, f"$.{k}", "array<variant>")) for k in WRAPPERS])
    only = F.when(F.size(lists) == 1, F.try_variant_get(F.get(lists, F.lit(0)), "$", "array<variant>"))
    return F.slice(F.coalesce(found, keyed, only), 1, MAX_ENTRIES)


def _kind(v: Column, key: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))


def lax_score(v: Column) -> Column:
    """0..10 as int: whole numbers, numeric strings and booleans count; else null."""
    kind = _kind(v, "score")
    text = F.when(kind == "STRING", F.regexp_extract(F.try_variant_get(v, "$.score", "string"), r"(?U)^\s*([+-]?\d+(?:\.0*)?)\s*$", 1).try_cast("double"))
    number = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$.score", "boolean").cast("int").cast("double")).when(kind == "STRING", text).otherwise(F.try_variant_get(v, "$.score", "double"))
    return F.when((number == F.floor(number)) & number.between(0, 10), number.cast("int"))


def parsed_entry(v: Column) -> Column:
    """struct(id, topic, score, rationale, secondary_topics) of one object; null if
    it is malformed: no string id, score not 0..10, topic null or too long,
    rationale null, or a secondary topic that is not a string."""
    has = lambda k: _kind(v, k)
    text = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    missing = lambda k: has(k).isNull()
    topic = F.when(missing("topic"), "").when(has("topic") == "STRING", text("topic"))
    rationale = F.when(missing("rationale"), "").when(has("rationale") == "STRING", text("rationale"))
    kind = has("secondary_topics")
    entries = F.try_variant_get(v, "$.secondary_topics", "array<variant>")
    falsy = missing("secondary_topics") | kind.isin("VOID", "ARRAY<VOID>") | (F.size(entries) == 0)
    strings = F.transform(entries, lambda e: F.when(F.schema_of_variant(e) == "STRING", F.try_variant_get(e, "$", "string")))
    bad = ~falsy & (~F.startswith(kind, F.lit("ARRAY")) | F.exists(strings, lambda s: s.isNull()))
    secondary = F.when(falsy, F.array().cast("array<string>")).otherwise(F.slice(F.filter(strings, lambda s: F.length(s) <= MAX_TOPIC), 1, MAX_SECONDARIES))
    ok = (has("id") == "STRING") & lax_score(v).isNotNull() & (F.length(topic) <= MAX_TOPIC) & rationale.isNotNull() & ~F.coalesce(bad, F.lit(False))
    return F.when(ok, F.struct(text("id").alias("id"), topic.alias("topic"), lax_score(v).alias("score"), clean_rationale(rationale).alias("rationale"), secondary.alias("secondary_topics")))
