"""URL filters by host-suffix and path-prefix expressions.

Every URL is expanded into the expressions that a rule could be written as
(host suffix x path prefix); the expressions meet the rules in an equi-join on
a short hash prefix, and a full digest confirms each match. The longest
matching rule decides. All of it is DataFrame expressions.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty

#: The rules of the contract (action, expression).
CONTRACT_RULES = [
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
]
#: Hex digits of the digest that the join uses.
PREFIX_DIGITS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/ ? #``, A-Z lowered; then up
    to ``? #``. Null or no ``://``: both empty."""
    url = text_or_empty(url)
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_table(spark, rules) -> DataFrame:
    """(action, rule, rule_host, rule_path, digest, short) of (action, expression) pairs."""
    df = spark.createDataFrame(list(rules), "action string, rule string")
    cut = F.instr("rule", "/")
    return df.select(
        "action",
        "rule",
        F.translate(F.when(cut > 0, F.substring("rule", F.lit(1), cut - 1)).otherwise(F.col("rule")), UPPER, LOWER).alias("rule_host"),
        F.when(cut > 0, F.substring("rule", cut, F.length("rule"))).otherwise("").alias("rule_path"),
    ).withColumns({"digest": F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256)}).withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))


def filter_urls(urls: DataFrame, rules: DataFrame, url: str, key: str, default: str = "allow") -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``verdict`` for every row of ``urls``.

    ``rules`` is a :func:`rule_table`. Only host suffixes with as many labels,
    and path prefixes with as many characters, as some rule has are expanded, so
    the expansion of a URL is bounded by the rules and not by the URL's length.
    The longest rule wins; of equally long ones ``block``, then the smaller text.
    Null, empty or malformed URLs have an empty host and path, match nothing and
    get ``default``. Repeated rows are each returned; equal URLs are judged once.
    Columns of ``urls`` other than the two named are ignored.
    """
    shape = rules.agg(
        F.sort_array(F.collect_set(F.size(F.split("rule_host", r"\.")))).alias("labels"),
        F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths"),
    ).first()
    host, path = url_parts(F.col(url))
    rows = urls.select(F.col(key).alias("_key"), host.alias("host"), path.alias("path"))
    if not shape or not shape["labels"]:
        return rows.select(F.col("_key").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    parts = F.split("host", r"\.")
    labels = F.array(*[F.lit(n) for n in shape["labels"]])
    lengths = F.array(*[F.lit(n) for n in shape["lengths"]])
    suffixes = F.transform(
        F.filter(labels, lambda n: n <= F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."),
    )
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat_ws("\n", h, p))))
    # equal (host, path) pairs are expanded once; a hot host meets here as one row per path
    digests = (
        rows.select("host", "path").distinct()
        .select("host", "path", F.explode(pairs).alias("expr"))
        .withColumn("digest", F.sha2("expr", 256))
        .withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    )
    hits = digests.alias("u").join(rules.alias("r"), (F.col("u.short") == F.col("r.short")) & (F.col("u.digest") == F.col("r.digest")))
    best = hits.groupBy("host", "path").agg(
        F.min(F.struct((-F.length("rule")).alias("size"), (F.col("action") != "block").alias("mild"), F.col("rule"), F.col("action"))).alias("best")
    )
    return rows.join(best, ["host", "path"], "left").select(
        F.col("_key").alias(key), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"),
    )


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark, CONTRACT_RULES), "url", "page_id")


OP8_SQL = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN position('://' IN coalesce(url, '')) > 0
              THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages),
hp AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
rules(action, rule, rule_host, rule_path) AS (
  VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
         ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
hits AS (
  SELECT page_id, rule, action,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, action = 'block' DESC, rule) AS k
  FROM hp JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT hp.page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM hp LEFT JOIN hits ON hits.page_id = hp.page_id AND k = 1
"""
