"""Registered queries of the core operators and their SQL.

The model's tables are derived from the test tables by the same rule on both
sides: :func:`base` in Spark, ``BASE`` in SQL. Times come out as epoch seconds.
"""

from functools import cached_property

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, entities, replies, text, url
from ..functions.sql import register_functions
from ..operators import dedupe, landed, relational, store
from ..operators.admission import batch_queue, classify_table
from ..operators.classify import KeywordProvider, parse_replies, version_of
from ..operators.normalize import normalize, validate
from ..session import materialize, scratch_path
from .golden import load_golden

QUERIES, SQL = {}, {}
TOPICS = ["agents", "models", "tools", "other"]

BASE = r"""
canon AS (
  SELECT page_id, url AS raw, html,
    lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS sch,
    lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)) AS host,
    regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query,
    regexp_extract(url, '#(.*)$', 1) AS frag FROM pages),
params AS (
  SELECT *, list_filter(string_split(query, '&'), lambda x: x <> '') AS ps FROM canon),
kept AS (
  SELECT *, list_filter(ps, lambda x: NOT (starts_with(lower(split_part(x, '=', 1)), 'utm_') OR starts_with(lower(split_part(x, '=', 1)), 'mc_')
    OR lower(split_part(x, '=', 1)) IN ('ref', 'ref_src', 'ref_url', 'fbclid', 'gclid', 'gclsrc', 'dclid', 'msclkid', 'igshid', 'mkt_tok', '_hsenc', '_hsmi', 'vero_id', 'yclid'))) AS ks FROM params),
urls AS (
  SELECT page_id, raw, html, host, len(ps) AS n_params, len(ks) AS n_kept,
    sch || '://' || host || CASE WHEN path IN ('', '/') THEN '/' ELSE rtrim(path, '/') END
    || CASE WHEN len(ks) = 0 THEN '' ELSE '?' || array_to_string(list_transform(ks, lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&') END
    || CASE WHEN frag = '' THEN '' ELSE '#' || frag END AS url FROM kept),
items AS (
  SELECT page_id, sha256(url) AS canonical_hash, url, raw, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
    CASE WHEN page_id % 7 = 3 THEN NULL ELSE TIMESTAMP '2024-01-01' + (page_id * 5 % 2000) * INTERVAL 1 HOUR END AS published_at,
    TIMESTAMP '2024-01-01' + page_id * INTERVAL 1 HOUR AS ingested_at
  FROM urls QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1),
cls AS (
  SELECT page_id * 2 + v AS id, canonical_hash, ['agents', 'models', 'tools', 'other'][(page_id + v) % 4 + 1] AS topic,
    [['agents', 'models', 'tools', 'other'][(page_id + v + 1) % 4 + 1], 'noise'] AS secondary_topics, (page_id * 3 + v) % 11 AS score
  FROM items, (VALUES (0), (1)) t(v) WHERE page_id % 5 <> 4),
act AS (SELECT canonical_hash, max(id) AS classification_id FROM cls GROUP BY 1),
sup AS (SELECT a.canonical_hash AS loser, b.canonical_hash AS winner FROM items a JOIN items b ON b.page_id = a.page_id - 1 WHERE a.page_id % 10 = 9),
live AS (SELECT * FROM items WHERE canonical_hash NOT IN (SELECT loser FROM sup)),
src AS (
  SELECT canonical_hash, 'feed' || (page_id % 6) AS source_name, ingested_at AS first_seen_at FROM items
  UNION ALL SELECT canonical_hash, 'feed' || ((page_id + 3) % 6), ingested_at + (page_id % 3 - 1) * INTERVAL 1 HOUR FROM items WHERE page_id % 2 = 0),
active AS (SELECT i.*, c.id, c.topic, c.secondary_topics, c.score FROM live i JOIN act a USING (canonical_hash) JOIN cls c ON c.id = a.classification_id),
runs AS (SELECT user_id AS source_name, event_id AS seq, event_type = 'error' AS failed, event_type = 'view' AS empty, ts FROM events),
texts AS (SELECT o_orderkey, 'Patched cve-2024-' || lpad(o_orderkey::VARCHAR, 6, '0') || ' and CVE-2024-' || lpad((o_orderkey % 9)::VARCHAR, 4, '0') || ' see npm:@Scope' || (o_custkey % 50) || '/pkg-' || (o_custkey % 7)
  || ' or PyPI:Lib' || (o_custkey % 11) || '.x at https://github.com/Org' || (o_custkey % 20) || '/Repo_' || (o_orderkey % 13) || '.git and github.com/sponsors/x?a' AS text FROM orders),
followups AS (SELECT o_orderkey AS id, ['read-deep', 'implement', 'audit', 'track'][o_orderkey % 4 + 1] AS action, o_orderkey AS item, o_orderstatus <> 'O' AS completed, o_orderdate AS created_at FROM orders)
"""


def plus(ts, hours):
    return F.timestamp_seconds(F.unix_seconds(ts) + hours * 3600)


class Base:
    """The derived tables by name; each is built when a query first asks for it."""

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf

    def __getitem__(self, name):
        return getattr(self, name)

    def table(self, name):
        return self.spark.read.parquet(f"{self.sf}/{name}.parquet")

    @cached_property
    def urls(self):
        return self.table("pages").select("page_id", F.col("url").alias("raw"), "html", url.canonical_url("url", idn=False).alias("url"))

    @cached_property
    def items(self):
        start, i = F.lit("2024-01-01 00:00:00").cast("timestamp"), F.col("page_id")
        first = self.urls.groupBy("url").agg(F.min(F.struct("page_id", "raw", "html")).alias("p")).select("url", "p.*")
        return first.select(
            "page_id", F.sha2("url", 256).alias("canonical_hash"), "url", "raw", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
            F.when(i % 7 != 3, plus(start, i * 5 % 2000)).alias("published_at"), plus(start, i).alias("ingested_at"))

    @cached_property
    def cls(self):
        i, v = F.col("page_id"), F.col("v")
        topic = lambda n: F.element_at(F.array(*map(F.lit, TOPICS)), (n % 4 + 1).cast("int"))
        return self.items.filter("page_id % 5 <> 4").withColumn("v", F.explode(F.array(F.lit(0), F.lit(1)))).select(
            (i * 2 + v).alias("id"), "canonical_hash", topic(i + v).alias("topic"), F.array(topic(i + v + 1), F.lit("noise")).alias("secondary_topics"), ((i * 3 + v) % 11).alias("score"))

    @cached_property
    def act(self):
        return self.cls.groupBy("canonical_hash").agg(F.max("id").alias("classification_id"))

    @cached_property
    def sup(self):
        losers = self.items.filter("page_id % 10 = 9").select(F.col("canonical_hash").alias("loser"), (F.col("page_id") - 1).alias("_p"))
        return losers.join(self.items.select(F.col("page_id").alias("_p"), F.col("canonical_hash").alias("winner")), "_p").drop("_p")

    @cached_property
    def lost(self):
        return self.sup.select(F.col("loser").alias("canonical_hash"))

    @cached_property
    def live(self):
        return self.items.join(self.lost, "canonical_hash", "left_anti")

    @cached_property
    def src(self):
        i = F.col("page_id")
        feed = lambda n: F.concat(F.lit("feed"), (n % 6).cast("string"))
        also = self.items.filter("page_id % 2 = 0").select("canonical_hash", feed(i + 3).alias("source_name"), plus(F.col("ingested_at"), i % 3 - 1).alias("first_seen_at"))
        return self.items.select("canonical_hash", feed(i).alias("source_name"), F.col("ingested_at").alias("first_seen_at")).unionByName(also)

    @cached_property
    def active(self):
        current = self.live.join(self.act, "canonical_hash").withColumnRenamed("classification_id", "current_classification_id")
        return relational.with_active(current, self.cls.withColumnRenamed("canonical_hash", "_h")).drop("_h", "current_classification_id")

    @cached_property
    def runs(self):
        kind = F.col("event_type")
        return self.table("events").select(F.col("user_id").alias("source_name"), F.col("event_id").alias("seq"), (kind == "error").alias("failed"), (kind == "view").alias("empty"), F.col("ts").cast("timestamp").alias("ts"))

    @cached_property
    def texts(self):
        k, c, s = F.col("o_orderkey"), F.col("o_custkey"), lambda x: x.cast("string")
        return self.table("orders").select("o_orderkey", F.concat(
            F.lit("Patched cve-2024-"), F.lpad(s(k), 6, "0"), F.lit(" and CVE-2024-"), F.lpad(s(k % 9), 4, "0"), F.lit(" see npm:@Scope"), s(c % 50), F.lit("/pkg-"), s(c % 7), F.lit(" or PyPI:Lib"), s(c % 11),
            F.lit(".x at https://github.com/Org"), s(c % 20), F.lit("/Repo_"), s(k % 13), F.lit(".git and github.com/sponsors/x?a")).alias("text"))

    @cached_property
    def followups(self):
        k = F.col("o_orderkey")
        action = F.element_at(F.array(*map(F.lit, store.ACTIONS)), (k % 4 + 1).cast("int"))
        return self.table("orders").select(k.alias("id"), action.alias("action"), k.alias("item"), (F.col("o_orderstatus") != "O").alias("completed"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


def query(name, sql=None, body=False):
    """Register ``f(base)``; ``sql`` is put after the common tables unless ``body``."""
    def add(f):
        QUERIES[name] = lambda spark, sf: f(Base(spark, sf))
        if sql is not None:
            SQL[name] = sql if body else f"WITH {BASE}\n{sql}"
        return f
    return add


def similar_titles(pairs):
    """SQL: ``alike`` (x, y, similarity) of the rows of ``pairs`` (x, y), by the table of
    common subsequences, one letter of x after the other."""
    return f"""lcs AS (
  SELECT x, y, 0 AS i, list_transform(range(len(y) + 1), lambda j: 0) AS below FROM {pairs}
  UNION ALL
  SELECT x, y, i + 1, list_transform(range(1, len(y) + 2), lambda j: list_max(here[1:j])) FROM (
    SELECT x, y, i, list_transform(range(len(y) + 1), lambda j: CASE WHEN j > 0 AND substr(x, i + 1, 1) = substr(y, j, 1) THEN below[j] + 1 ELSE below[j + 1] END) AS here
    FROM lcs WHERE i < len(x)) t),
alike AS (SELECT x, y, CASE WHEN len(x) + len(y) = 0 THEN 1.0::DOUBLE
  ELSE (1 - (len(x) + len(y) - 2 * below[-1])::DOUBLE / (len(x) + len(y))) * 100 / 100.0::DOUBLE END AS similarity FROM lcs WHERE i = len(x))"""


def secs(c):
    return F.unix_seconds(c) if not isinstance(c, str) else F.unix_seconds(F.col(c))


def at(stamp):
    return F.lit(stamp).cast("timestamp")


# ------------------------------------------------------------------ URLs


@query("url_canonical", "SELECT page_id, url AS canonical_url, sha256(url) AS canonical_hash FROM urls")
def _(b):
    found = b["table"]("pages").select("page_id", url.canonical_url("url").alias("canonical_url"))
    return found.withColumn("canonical_hash", F.sha2("canonical_url", 256))


@query("url_host_rollup", "SELECT host, count(*)::BIGINT AS pages, sum(n_params - n_kept)::BIGINT AS stripped FROM urls GROUP BY host")
def _(b):
    u = b["table"]("pages").select("url")
    host = F.lower(F.regexp_extract("url", "^[^:]*://([^/?#]*)", 1))
    parts = F.filter(F.split(F.regexp_extract("url", r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p != "")
    gone = F.size(F.filter(parts, lambda p: url.is_tracking(F.substring_index(p, "=", 1))))
    return u.select(host.alias("host"), gone.alias("g")).groupBy("host").agg(F.count("*").alias("pages"), F.sum("g").cast("long").alias("stripped"))


@query("tracking_params", """SELECT lower(split_part(p, '=', 1)) AS name, count(*)::BIGINT AS n FROM (SELECT unnest(ps) AS p FROM params)
WHERE starts_with(lower(split_part(p, '=', 1)), 'utm_') OR lower(split_part(p, '=', 1)) IN ('ref', 'fbclid', 'gclid') GROUP BY 1""")
def _(b):
    p = b["table"]("pages").select(F.explode(F.split(F.regexp_extract("url", r"^[^?#]*\?([^#]*)", 1), "&")).alias("p"))
    return p.select(F.lower(F.substring_index("p", "=", 1)).alias("name")).filter((F.col("name") != "") & url.is_tracking(F.col("name"))).groupBy("name").agg(F.count("*").alias("n"))


@query("arxiv_ids", r"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN '23' || lpad((page_id % 12 + 1)::VARCHAR, 2, '0') || '.' || lpad((page_id % 99999)::VARCHAR, 5, '0')
 WHEN 1 THEN 'cs.CR/' || lpad((page_id % 9999999)::VARCHAR, 7, '0') ELSE NULL END AS paper FROM pages""", body=True)
def _(b):
    i = F.col("page_id")
    s = lambda n, w: F.lpad(n.cast("string"), w, "0")
    path = F.when(i % 4 == 0, F.concat(F.lit("/pdf/23"), s(i % 12 + 1, 2), F.lit("."), s(i % 99999, 5), F.lit("v2.PDF"))).when(i % 4 == 1, F.concat(F.lit("/abs/cs.CR/"), s(i % 9999999, 7), F.lit("v1"))).otherwise("/list/recent")
    return b["table"]("pages").select("page_id", url.arxiv_id(path).alias("paper"))


# ------------------------------------------------------------------ sources


@query("external_ids", """SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN 'id' || doc_id ELSE '' END, ''), nullif(CASE WHEN doc_id % 3 = 1 THEN 'https://e.com/' || doc_id ELSE '' END, ''),
 sha256(text || '|' || lang)) AS external_id FROM documents""", body=True)
def _(b):
    d = F.col("doc_id")
    a = F.when(d % 3 == 0, F.concat(F.lit("id"), d.cast("string"))).otherwise("")
    l = F.when(d % 3 == 1, F.concat(F.lit("https://e.com/"), d.cast("string"))).otherwise("")  # noqa: E741
    return b["table"]("documents").select("doc_id", landed.entry_key(a, l, F.col("text"), F.col("lang")).alias("external_id"))


@query("cursor_strict", """SELECT event_id, floor(epoch(ts))::BIGINT AS created, (SELECT greatest(1704800000, max(floor(epoch(ts))::BIGINT)) FROM events) AS new_cursor FROM events WHERE floor(epoch(ts))::BIGINT > 1704800000""", body=True)
def _(b):
    """Every reply of the search holds up to a hundred hits later than the mark; the new
    cursor is the latest of all replies."""
    mark = 1704800000
    e = b["table"]("events").select("event_id", secs(F.col("ts").cast("timestamp")).alias("created")).filter(F.col("created") > mark)
    hit = F.struct(F.col("event_id").cast("string").alias("objectID"), F.lit("t").alias("title"), F.col("created").alias("created_at_i"))
    replies = e.groupBy(F.floor(F.col("event_id") / 100).alias("page")).agg(F.to_json(F.struct(F.collect_list(hit).alias("hits"))).alias("body"))
    rows = materialize(landed.search_hits(replies), "hits")
    return rows.select(F.col("external_id").cast("long").alias("event_id"), "created").join(F.broadcast(landed.advanced(rows, mark)))


@query("release_drafts", "SELECT event_id, 'r' || event_id AS external_id FROM events WHERE event_type <> 'signup'", body=True)
def _(b):
    release = F.struct(F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("id"), F.lit("v1").alias("tag_name"), (F.col("event_type") == "signup").alias("draft"))
    replies = b["table"]("events").groupBy(F.floor(F.col("event_id") / 100).alias("page")).agg(F.to_json(F.collect_list(release)).alias("body")).withColumn("repo", F.lit("o/n"))
    return landed.releases(replies).select(F.substring("external_id", 2, 20).cast("long").alias("event_id"), "external_id")


@query("watermark_boundary", """WITH e AS (SELECT event_id, user_id, epoch(date_trunc('day', ts))::BIGINT AS day FROM events)
SELECT event_id, user_id, day FROM e WHERE day > 1706227200 OR (day = 1706227200 AND user_id NOT IN (1, 2, 3))""", body=True)
def _(b):
    e = b["table"]("events").select("event_id", "user_id", secs(F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("day"))
    return relational.after_watermark(e, "day", "user_id", 1706227200, [1, 2, 3])


@query("watermark_advance", """WITH e AS (SELECT user_id, epoch(date_trunc('hour', ts))::BIGINT AS h FROM events)
SELECT h AS wm, array_to_string(list_sort(list_distinct(list(user_id))), ',') AS seen FROM e WHERE h = (SELECT max(h) FROM e) GROUP BY h""", body=True)
def _(b):
    e = b["table"]("events").select("user_id", secs(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("h"))
    return relational.watermark(e, "h", "user_id").select("wm", F.array_join(F.transform("seen", lambda x: x.cast("string")), ",").alias("seen"))


@query("payload_mapping", """SELECT p_partkey, trim(p_brand || ' ' || CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END) AS title,
 CASE WHEN p_size % 3 = 0 THEN 'https://e.com/' || p_partkey ELSE 'https://news.ycombinator.com/item?id=' || p_partkey END AS link FROM part""", body=True)
def _(b):
    """Release titles and story links; every part is a reply of each kind."""
    key, size = F.col("p_partkey"), F.col("p_size")
    part = b["table"]("part").select("p_partkey", F.col("p_brand").alias("repo"), F.to_json(F.array(F.struct(F.concat(F.lit("r"), key.cast("string")).alias("id"), F.when(size % 2 == 0, F.col("p_type")).alias("tag_name")))).alias("body"))
    hit = F.struct(key.cast("string").alias("objectID"), F.when(size % 3 == 0, F.concat(F.lit("https://e.com/"), key.cast("string"))).alias("url"))
    found = b["table"]("part").select("p_partkey", F.to_json(F.struct(F.array(hit).alias("hits"))).alias("body"))
    titles = landed.releases(part).select("p_partkey", F.get_json_object("payload", "$.title").alias("title"))
    return titles.join(landed.search_hits(found).select("p_partkey", F.get_json_object("payload", "$.link").alias("link")), "p_partkey")


@query("iso_epochs", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE epoch(date_trunc('second', o_orderdate))::BIGINT END AS epoch FROM orders""", body=True)
def _(b):
    d = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("o_orderkey") % 4
    return b["table"]("orders").select("o_orderkey", dates.iso_to_epoch(F.when(k == 0, F.concat(d, F.lit("Z"))).when(k == 1, F.concat(d, F.lit("+00:00"))).when(k == 2, d).otherwise("not a date")).alias("epoch"))


@query("arxiv_error_entries", """SELECT page_id FROM pages WHERE page_id % 13 <> 0""", body=True)
def _(b):
    """Entries of a paper search; those that tell of an error go."""
    i = F.col("page_id")
    entry = F.when(i % 13 == 0, F.concat(F.lit("http://arxiv.org/api/errors#x"), i.cast("string"))).otherwise(F.concat(F.lit("http://e.com/"), i.cast("string")))
    return b["table"]("pages").filter(~landed.tells_of_an_error(entry, F.lit(None).cast("string"))).select("page_id")


# ------------------------------------------------------------------ projections


@query("build_item", r"""SELECT page_id, url, coalesce(nullif(trim(title), ''), '(untitled)') AS title, CASE WHEN raw <> url THEN raw END AS original_url, substr(title || ' ' || raw, 1, 4000) AS summary FROM items""")
def _(b):
    return b["items"].select("page_id", "url", F.coalesce(text.blank_to_null("title"), F.lit("(untitled)")).alias("title"), F.when(F.col("raw") != F.col("url"), F.col("raw")).alias("original_url"),
                             F.left(F.concat_ws(" ", "title", "raw"), F.lit(4000)).alias("summary"))


@query("published_at", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN floor(epoch(ts))::BIGINT WHEN 1 THEN floor(epoch(ts))::BIGINT + 60 WHEN 2 THEN floor(epoch(ts))::BIGINT + 60 ELSE NULL END AS published FROM events""", body=True)
def _(b):
    e = secs(F.col("ts").cast("timestamp"))
    k = F.col("event_id") % 4
    first = F.when(k == 0, e.cast("double")).when(k == 1, F.lit(1e18)).otherwise(F.lit(None))
    second = F.when(k < 3, (e + 60).cast("double")).otherwise(F.lit(-1e15))
    return b["table"]("events").select("event_id", secs(dates.published_at(first, second)).alias("published"))


@query("classifier_version", """SELECT n_nationkey, 'cls-' || substr(sha256(n_name || chr(0) || n_regionkey), 1, 12) AS version FROM nation""", body=True)
def _(b):
    return b["table"]("nation").select("n_nationkey", version_of(F.col("n_name"), F.col("n_regionkey").cast("string")).alias("version"))


@query("normalize_items")
def _(b):
    """All five normalizers over synthesized payloads; rejects stay with their error."""
    p = b["table"]("pages")
    kinds = F.array(*[F.lit(k) for k in ["rss", "arxiv", "hn_search", "github_releases", "github_topic", "usenet"]])
    raw = p.select(
        F.lit("s").alias("source_name"), F.element_at(kinds, (F.col("page_id") % 6 + 1).cast("int")).alias("source_type"), F.col("page_id").cast("string").alias("external_id"), at("2024-02-01 00:00:00").alias("fetched_at"),
        F.parse_json(F.to_json(F.struct(F.when(F.col("page_id") % 9 != 0, F.col("url")).alias("link"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.lit("cve-2024-1234 npm:left-pad").alias("summary"),
                                        F.lit("see github.com/A/b").alias("story_text"), (F.lit(1700000000) + F.col("page_id")).alias("published_timestamp"), F.lit("me").alias("author")))).alias("payload"))
    return normalize(raw, at("2024-02-01 00:00:00")).select("external_id", "source_type", "url", "title", "summary", "metadata", secs("published_at").alias("published"), F.to_json("entities").alias("entities"), "error")


NORMALIZED = r"""
, given AS (
  SELECT page_id, ['rss', 'arxiv', 'hn_search', 'github_releases', 'github_topic', 'usenet'][page_id % 6 + 1] AS source_type,
    CASE WHEN page_id % 9 = 0 THEN NULL WHEN page_id % 9 = 1 THEN 'ftp://e.com/' || page_id ELSE raw END AS link,
    CASE WHEN page_id % 9 = 0 THEN NULL WHEN page_id % 9 = 1 THEN 'ftp://e.com/' || page_id ELSE url END AS url,
    CASE WHEN page_id % 11 = 0 THEN '(untitled)' ELSE trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) END AS title,
    'Fixes cve-2024-' || (10000 + page_id) || ' in npm:Left-pad' || page_id % 7 || ', try Acme/Tool-' || page_id % 13 || ' rather and/or maybe a/b.py now' AS summary,
    '<p>uses <b>pypi:Req' || page_id % 5 || '</b></p> at https://github.com/Org' || page_id % 4 || '/App.git' AS content, 'story of github.com/Q' || page_id % 3 || '/r and github.com/sponsors/z' AS story FROM urls),
shaped AS (
  SELECT *, CASE WHEN source_type = 'hn_search' THEN story WHEN source_type <> 'usenet' THEN summary END AS told,
    CASE source_type WHEN 'rss' THEN content WHEN 'hn_search' THEN story WHEN 'usenet' THEN NULL ELSE summary END AS extra FROM given),
said AS (SELECT page_id, regexp_replace(concat_ws(chr(10), title, told, extra), '<[^>]+>', ' ', 'g') AS t FROM shaped),
named AS (
  SELECT page_id, 'cve:' || upper(unnest(regexp_extract_all(t, '(?i)\bCVE-\d{4}-\d{4,}\b'))) AS e FROM said
  UNION SELECT page_id, 'package:' || lower(unnest(regexp_extract_all(t, '(?i)\b(?:npm|pypi):[a-z0-9_]+(?:[.-][a-z0-9_]+)*'))) FROM said
  UNION SELECT page_id, 'repo:' || regexp_replace(lower(substr(hit, 12)), '\.git$', '') FROM (SELECT page_id, unnest(regexp_extract_all(t, '(?i)github\.com/[a-z0-9][a-z0-9-]{0,38}/[a-z0-9_][a-z0-9._-]{0,99}')) AS hit FROM said) h WHERE hit NOT LIKE '%sponsors%'
  UNION SELECT page_id, 'repo:' || v FROM (SELECT page_id, lower(unnest(regexp_extract_all(t, '(?:^|[^\w/.@:-])([A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?/[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*)(?:[^\w/-]|$)', 1))) AS v FROM said) b WHERE v NOT IN ('and/or', 'a/b.py')),
found AS (SELECT page_id, array_to_string(list_sort(list(e)), ',') AS entities FROM named GROUP BY page_id)
SELECT page_id, source_type, s.url, sha256(s.url) AS canonical_hash, title, told AS summary, coalesce(entities, '') AS entities,
  CASE page_id % 3 WHEN 0 THEN 1700000000 + page_id WHEN 1 THEN 1600000000 + page_id END::BIGINT AS published,
  CASE WHEN source_type IN ('rss', 'arxiv') THEN '["me","you"]' END AS authors, CASE WHEN source_type IN ('hn_search', 'github_releases') THEN 'me ' || page_id END AS author,
  CASE WHEN source_type = 'hn_search' THEN (page_id % 40)::VARCHAR END AS points, CASE WHEN source_type = 'hn_search' THEN 'https://n/' || page_id END AS hn_url,
  CASE WHEN source_type IN ('github_releases', 'github_topic') THEN 'o/n"' || page_id END AS repo, CASE WHEN source_type = 'github_topic' THEN page_id::VARCHAR END AS stars,
  CASE WHEN source_type <> 'usenet' AND link <> s.url THEN link END AS original_url,
  CASE WHEN source_type = 'usenet' THEN 'no normalizer for source_type usenet' WHEN link IS NULL THEN 'no usable url' WHEN link LIKE 'ftp%' THEN 'url is not http(s)' END AS error
FROM shaped s LEFT JOIN found USING (page_id)"""


@query("normalized_fields", NORMALIZED)
def _(b):
    """All normalizers over payloads of every page, field by field. Every third page has
    a usable time, every third one only a usable update, and the rest none."""
    i, s = F.col("page_id"), lambda n: n.cast("string")
    epoch = F.when(i % 3 == 0, F.struct((F.lit(1700000000) + i).alias("published_timestamp"))).otherwise(F.struct(F.lit(10**15).alias("published_timestamp")))
    link = F.when(i % 9 == 0, F.lit(None).cast("string")).when(i % 9 == 1, F.concat(F.lit("ftp://e.com/"), s(i))).otherwise(F.col("url"))
    payload = F.struct(
        link.alias("link"), F.when(i % 11 == 0, "  ").otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"),
        F.concat(F.lit("Fixes cve-2024-"), s(i + 10000), F.lit(" in npm:Left-pad"), s(i % 7), F.lit(", try Acme/Tool-"), s(i % 13), F.lit(" rather and/or maybe a/b.py now")).alias("summary"),
        F.concat(F.lit("<p>uses <b>pypi:Req"), s(i % 5), F.lit("</b></p> at https://github.com/Org"), s(i % 4), F.lit("/App.git")).alias("content"),
        F.concat(F.lit("story of github.com/Q"), s(i % 3), F.lit("/r and github.com/sponsors/z")).alias("story_text"), epoch["published_timestamp"].alias("published_timestamp"),
        F.when(i % 3 == 1, F.lit(1600000000) + i).alias("updated_timestamp"), F.array(F.lit("me"), F.lit("you")).alias("authors"), F.array().cast("array<string>").alias("tags"),
        F.concat(F.lit("me "), s(i)).alias("author"), (i % 40).alias("points"), F.concat(F.lit("https://n/"), s(i)).alias("hn_url"), F.concat(F.lit('o/n"'), s(i)).alias("repo"), i.alias("stars"))
    kinds = F.array(*map(F.lit, ["rss", "arxiv", "hn_search", "github_releases", "github_topic", "usenet"]))
    raw = b["table"]("pages").select(F.lit("s").alias("source_name"), F.element_at(kinds, (i % 6 + 1).cast("int")).alias("source_type"), s(i).alias("external_id"), at("2024-02-01 00:00:00").alias("fetched_at"), F.parse_json(F.to_json(payload)).alias("payload"))
    meta = [F.get_json_object("metadata", f"$.{k}").alias(k) for k in ("authors", "author", "points", "hn_url", "repo", "stars", "original_url")]
    named = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["value"])), ",").alias("entities")
    return normalize(raw, at("2024-02-01 00:00:00")).select(F.col("external_id").cast("long").alias("page_id"), "source_type", "url", "canonical_hash", "title", "summary", named, secs("published_at").alias("published"), *meta, "error")


@query("validation_split", """SELECT CASE WHEN page_id % 9 = 0 THEN 'no usable url' ELSE 'ok' END AS outcome, count(*)::BIGINT AS n FROM pages GROUP BY 1""", body=True)
def _(b):
    p = b["table"]("pages").select(F.lit("s").alias("source_name"), F.lit("rss").alias("source_type"), F.col("page_id").cast("string").alias("external_id"), at("2024-02-01 00:00:00").alias("fetched_at"),
                                   F.parse_json(F.to_json(F.struct(F.when(F.col("page_id") % 9 != 0, F.col("url")).alias("link")))).alias("payload"))
    good, bad = validate(normalize(p, at("2024-02-01 00:00:00")))
    return good.select(F.lit("ok").alias("outcome")).unionByName(bad.select(F.col("error").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ selections


@query("publish_window", "SELECT page_id FROM items WHERE published_at IS NULL OR (published_at >= TIMESTAMP '2024-01-03' AND published_at < TIMESTAMP '2024-02-01')")
def _(b):
    return b["items"].filter(dates.in_window(F.col("published_at"), at("2024-01-03 00:00:00"), at("2024-02-01 00:00:00"))).select("page_id")


@query("unclassified", "SELECT page_id FROM live WHERE canonical_hash NOT IN (SELECT canonical_hash FROM act) ORDER BY ingested_at, canonical_hash LIMIT 200")
def _(b):
    return relational.unclassified(b["items"], b["act"], b["lost"], 200).select("page_id")


@query("recent_items", "SELECT page_id, epoch(ingested_at)::BIGINT AS ingested FROM live WHERE ingested_at >= TIMESTAMP '2024-01-05'")
def _(b):
    return relational.ingested_between(b["items"], b["lost"], at("2024-01-05 00:00:00")).select("page_id", secs("ingested_at").alias("ingested"))


@query("ingest_window", "SELECT page_id FROM live WHERE ingested_at >= TIMESTAMP '2024-01-02' AND ingested_at < TIMESTAMP '2024-01-09'")
def _(b):
    return relational.ingested_between(b["items"], b["lost"], at("2024-01-02 00:00:00"), at("2024-01-09 00:00:00")).select("page_id")


@query("query_items", "SELECT page_id, topic, score FROM active WHERE score >= 5 AND (topic = 'tools' OR list_contains(secondary_topics, 'tools'))")
def _(b):
    return relational.by_score_and_topic(b["active"], 5, "tools").select("page_id", "topic", "score")


@query("window_items", "SELECT page_id, score FROM active WHERE ingested_at >= TIMESTAMP '2024-01-02' AND ingested_at < TIMESTAMP '2024-01-09' AND score >= 5")
def _(b):
    return relational.classified_between(b["active"], at("2024-01-02 00:00:00"), at("2024-01-09 00:00:00"), 5).select("page_id", "score")


@query("source_subset", "SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src3')", body=True)
def _(b):
    return relational.named(b["table"]("documents"), "source", ["src1", "src3"]).select("doc_id", "source")


@query("open_followups", "SELECT id, action, epoch(created_at)::BIGINT AS created FROM followups WHERE NOT completed")
def _(b):
    f = b["followups"]
    return relational.open_followups(f.drop("completed"), f.filter("completed")).select("id", "action", secs("created_at").alias("created"))


@query("point_lookup", "SELECT page_id, url FROM items WHERE canonical_hash = (SELECT min(canonical_hash) FROM items)")
def _(b):
    return relational.lookup(b["items"], b["items"].agg(F.min("canonical_hash").alias("canonical_hash")), "canonical_hash").select("page_id", "url")


@query("item_lookups", """SELECT canonical_hash, source_name, row_number() OVER (PARTITION BY canonical_hash ORDER BY first_seen_at, source_name)::BIGINT AS k FROM src""")
def _(b):
    w = Window.partitionBy("canonical_hash").orderBy("first_seen_at", "source_name")
    return b["src"].select("canonical_hash", "source_name", F.row_number().over(w).cast("long").alias("k"))


@query("repo_likeness", """SELECT o_orderkey, o_orderkey % 5 = 4 AS repo FROM orders""", body=True)
def _(b):
    k = F.col("o_orderkey") % 5
    owner = F.when(k == 0, "settings").when(k == 1, "and").when(k == 2, "1").otherwise("Me")
    repo = F.when(k == 1, "or").when(k == 2, "22").when(k == 3, "main.py").otherwise("Tool")
    return b["table"]("orders").select("o_orderkey", entities.looks_like_repo(F.lower(owner), F.lower(repo)).alias("repo"))


@query("day_window", "SELECT page_id FROM active WHERE date_trunc('day', ingested_at) = TIMESTAMP '2024-01-03'")
def _(b):
    return relational.classified_between(b["active"], at("2024-01-03 00:00:00"), at("2024-01-04 00:00:00")).select("page_id")


# ------------------------------------------------------------------ joins


@query("active_classification", "SELECT page_id, topic, score, id FROM active")
def _(b):
    return b["active"].select("page_id", "topic", "score", "id")


@query("first_source", "SELECT page_id, source_name FROM items LEFT JOIN (SELECT canonical_hash, source_name FROM src QUALIFY row_number() OVER (PARTITION BY canonical_hash ORDER BY first_seen_at, source_name) = 1) USING (canonical_hash)")
def _(b):
    return relational.with_first_source(b["items"], b["src"]).select("page_id", "source_name")


ENTS = """ents AS (SELECT canonical_hash, 'cve' AS kind, 'CVE-2024-' || lpad((page_id % 40)::VARCHAR, 4, '0') AS value FROM items WHERE page_id % 3 = 0
  UNION ALL SELECT canonical_hash, 'package', 'npm:p' || (page_id % 9) FROM items WHERE page_id % 2 = 0)"""


def ents(b):
    i = F.col("page_id")
    one = b["items"].filter("page_id % 3 = 0").select("canonical_hash", "ingested_at", F.lit("cve").alias("kind"), F.concat(F.lit("CVE-2024-"), F.lpad((i % 40).cast("string"), 4, "0")).alias("value"))
    two = b["items"].filter("page_id % 2 = 0").select("canonical_hash", "ingested_at", F.lit("package").alias("kind"), F.concat(F.lit("npm:p"), (i % 9).cast("string")).alias("value"))
    return one.unionByName(two)


@query("dedupe_candidates", f", {ENTS}, e AS (SELECT canonical_hash, array_to_string(list_sort(list_distinct(list(kind || ':' || value))), ',') AS entities FROM ents GROUP BY 1) SELECT page_id, coalesce(a.score, 0) AS score, coalesce(entities, '') AS entities FROM live LEFT JOIN (SELECT canonical_hash, score FROM active) a USING (canonical_hash) LEFT JOIN e USING (canonical_hash)")
def _(b):
    c = relational.dedupe_candidates(b["live"], b["active"].select("canonical_hash", "score"), ents(b))
    return c.select("page_id", "score", F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["value"])), ",").alias("entities"))


@query("strong_overlap", f", {ENTS} SELECT DISTINCT a.page_id AS a, b.page_id AS b FROM items a JOIN ents x USING (canonical_hash) JOIN ents y ON x.kind = 'cve' AND y.kind = 'cve' AND x.value = y.value JOIN items b ON b.canonical_hash = y.canonical_hash WHERE a.page_id < b.page_id")
def _(b):
    return relational.entity_pairs(ents(b).join(b["items"].select("canonical_hash", "page_id"), "canonical_hash"), "page_id")


@query("report_entries", "SELECT page_id, topic, score, (SELECT array_to_string(list_sort(list_distinct(list(source_name))), ',') FROM src s WHERE s.canonical_hash = active.canonical_hash) AS sources FROM active")
def _(b):
    return relational.with_sources(b["active"], b["src"]).select("page_id", "topic", "score", F.array_join("sources", ",").alias("sources"))


@query("body_cache", "SELECT page_id, page_id % 3 = 0 AS cached, page_id % 4 <> 0 AS known FROM items")
def _(b):
    i = b["items"].select("page_id", "canonical_hash")
    return store.body_state(i, i.filter("page_id % 3 = 0"), i.filter("page_id % 4 <> 0")).select("page_id", "cached", "known")


@query("never_run", "SELECT c_custkey AS source_name FROM customer WHERE c_custkey NOT IN (SELECT source_name FROM runs)")
def _(b):
    return relational.missing(b["table"]("customer").select(F.col("c_custkey").alias("source_name")), b["runs"], "source_name")


@query("insert_or_ignore", """SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE value > 150) GROUP BY 1, 2""", body=True)
def _(b):
    e = b["table"]("events").select("user_id", "event_type", "event_id", "value")
    return store.insert_new(e.drop("value"), e.filter("value > 150"), ["user_id", "event_type"], [F.col("event_id")])


@query("upsert_latest", "SELECT user_id, max_by(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1", body=True)
def _(b):
    e = b["table"]("events").select("user_id", "value", "event_id")
    return store.upsert(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id"], "event_id").select("user_id", "value", "event_id")


@query("reply_alignment", """WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS pos FROM conversations)
SELECT conv_id, 'c' || conv_id AS id, (conv_id + min(pos)) % 11 AS score FROM r WHERE NOT (pos = 0 AND conv_id % 3 = 0) GROUP BY conv_id""", body=True)
def _(b):
    """Each conversation is a reply with one object per turn, all for one id; where
    conv_id % 3 = 0 the first object is malformed and claims nothing."""
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    r = b["table"]("conversations").withColumn("pos", F.row_number().over(w) - 1)
    bad = (F.col("pos") == 0) & (F.col("conv_id") % 3 == 0)
    # the score depends on the conversation and the object's place
    obj = F.concat(F.lit('{"id":"c'), F.col("conv_id").cast("string"), F.lit('","topic":"t","score":'), F.when(bad, '"7.5"').otherwise(F.concat(F.lit('"'), ((F.col("conv_id") + F.col("pos")) % 11).cast("string"), F.lit(' "'))), F.lit("}"))
    made = r.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", obj.alias("o")))), lambda x: x["o"]), ",").alias("body"))
    sent = made.select(F.col("conv_id").alias("reply_id"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit('```json\n{"results":['), "body", F.lit("]}\n```"))).otherwise(F.concat(F.lit("["), "body", F.lit("]"))).alias("reply"))
    known = made.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"))
    return parse_replies(sent, known).select(F.col("reply_id").alias("conv_id"), "id", F.col("score").cast("long").alias("score"))


@query("golden_accuracy", "SELECT avg(CASE WHEN quality = CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 1 END THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, count(*)::BIGINT AS n FROM labels", body=True)
def _(b):
    return relational.accuracy(b["table"]("labels"), F.col("quality"), F.when(F.col("doc_id") % 7 == 0, 0).otherwise(1))


@query("inherit_sources", """SELECT DISTINCT sup.winner AS canonical_hash, src.source_name FROM sup JOIN src ON src.canonical_hash = sup.loser WHERE NOT EXISTS (SELECT 1 FROM src x WHERE x.canonical_hash = sup.winner AND x.source_name = src.source_name)""")
def _(b):
    s = b["src"].withColumns({"source_type": F.lit("rss"), "external_id": F.lit("x")})
    return relational.inherit_sources(b["sup"].withColumnRenamed("winner", "root"), s).select("canonical_hash", "source_name")


@query("duplicate_pairs", f"""WITH RECURSIVE {BASE}, {ENTS},
node AS (
  SELECT row_number() OVER (ORDER BY page_id % 11 DESC, CASE WHEN page_id % 50 <> 7 THEN ingested_at END NULLS LAST, canonical_hash) AS k,
    canonical_hash, lower(trim(title)) AS t, CASE WHEN page_id % 50 <> 7 THEN ingested_at END AS p FROM items),
strong AS (SELECT DISTINCT a.canonical_hash AS a, b.canonical_hash AS b FROM ents a JOIN ents b ON a.kind = 'cve' AND b.kind = 'cve' AND a.value = b.value),
met AS (
  SELECT m.k AS better, w.k AS worse, m.t AS x, w.t AS y, CASE WHEN s.a IS NULL THEN 0.92 ELSE 0.85 END::DOUBLE AS bar
  FROM node m JOIN node w ON m.k < w.k AND (m.p IS NULL OR w.p IS NULL OR abs(epoch(m.p) - epoch(w.p)) <= 48 * 3600)
  LEFT JOIN strong s ON s.a = m.canonical_hash AND s.b = w.canonical_hash),
hopeful AS (
  SELECT DISTINCT x, y FROM met WHERE 2 * coalesce(list_sum(list_transform(list_distinct(string_split(x, '')), lambda c: least(len(x) - len(replace(x, c, '')), len(y) - len(replace(y, c, ''))))), 0) >= 0.84 * (len(x) + len(y))),
{similar_titles('hopeful')},
near AS (SELECT better, worse FROM met JOIN alike USING (x, y) WHERE similarity >= bar),
above AS (SELECT k, (SELECT coalesce(list(better), []) FROM near WHERE worse = k) AS betters FROM node),
walk AS (
  SELECT 0::BIGINT AS step, []::BIGINT[] AS winners
  UNION ALL
  SELECT above.k, CASE WHEN list_has_any(betters, winners) THEN winners ELSE list_append(winners, above.k) END FROM walk JOIN above ON above.k = walk.step + 1)
SELECT w.canonical_hash AS loser, m.canonical_hash AS winner
FROM (SELECT worse, min(better) AS better FROM near WHERE list_contains((SELECT winners FROM walk ORDER BY step DESC LIMIT 1), better)
  AND NOT list_contains((SELECT winners FROM walk ORDER BY step DESC LIMIT 1), worse) GROUP BY worse) d
JOIN node w ON w.k = d.worse JOIN node m ON m.k = d.better""", body=True)
def _(b):
    """Loser and winner of fuzzy deduplication over page titles."""
    i = F.col("page_id")
    c = b["items"].select("canonical_hash", "title", F.when(i % 50 != 7, F.col("ingested_at")).alias("published_at"), (i % 11).alias("score"))
    e = ents(b).groupBy("canonical_hash").agg(F.collect_set(F.struct("kind", "value")).alias("entities"))
    full = c.join(e, "canonical_hash", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<struct<kind:string,value:string>>")))
    return dedupe.find_duplicates(full)


# ------------------------------------------------------------------ aggregations


@query("run_totals", "SELECT count(*)::BIGINT AS runs, sum(CASE WHEN failed THEN 1 ELSE 0 END)::BIGINT AS errors, sum(CASE WHEN empty THEN 1 ELSE 0 END)::BIGINT AS empties, bool_or(failed) AS any_error FROM runs")
def _(b):
    return relational.run_totals(b["runs"], F.col("failed"), F.col("empty"))


@query("store_counts", "SELECT count(*)::BIGINT AS items, (SELECT count(*) FROM live WHERE canonical_hash NOT IN (SELECT canonical_hash FROM act))::BIGINT AS unclassified FROM live")
def _(b):
    return relational.store_counts(b["live"], b["act"])


@query("per_source_counts", "SELECT source_name, count(*)::BIGINT AS fetched, count(*) FILTER (WHERE NOT failed)::BIGINT AS kept, count(*) FILTER (WHERE NOT failed AND NOT empty)::BIGINT AS stored FROM runs GROUP BY 1")
def _(b):
    good = ~F.col("failed")
    return relational.outcomes_per_source(b["runs"], fetched=F.lit(True), kept=good, stored=good & ~F.col("empty"))


@query("topic_groups", """, g AS (SELECT topic, count(*)::BIGINT AS n, max(score) AS best FROM active GROUP BY topic), p AS (SELECT *, row_number() OVER (ORDER BY best DESC, topic)::BIGINT AS topic_place FROM g)
SELECT topic, n, best, topic_place, canonical_hash, row_number() OVER (PARTITION BY topic ORDER BY score DESC, published_at DESC NULLS LAST, canonical_hash)::BIGINT AS place FROM active JOIN p USING (topic)""")
def _(b):
    return relational.topic_groups(b["active"]).select("topic", "n", "best", "topic_place", "canonical_hash", "place")


@query("weekly_entities", """SELECT epoch(date_trunc('week', ts))::BIGINT AS week, event_type AS kind, user_id::VARCHAR AS value, array_to_string(list_sort(list_distinct(list(event_id::VARCHAR))), ',') AS related,
 coalesce(min_by('ctx' || event_id, event_id) FILTER (WHERE event_id % 3 = 0), user_id::VARCHAR) AS context FROM events GROUP BY 1, 2, 3""", body=True)
def _(b):
    ts = F.col("ts").cast("timestamp")
    e = b["table"]("events").select(
        F.col("event_id").cast("string").alias("canonical_hash"), F.col("event_id").alias("ingested_at"), F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("value"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("ctx"), F.col("event_id").cast("string"))).alias("context"), ts.alias("at"))
    return relational.weekly_entities(e, dates.week_start(F.col("at"))).select(secs("week_starting").alias("week"), "kind", "value", F.array_join("related_item_hashes", ",").alias("related"), "context")


@query("entity_counts", f", {ENTS} SELECT kind, count(*)::BIGINT AS n FROM ents GROUP BY kind")
def _(b):
    return relational.entity_counts(ents(b))


@query("token_usage", "SELECT conv_id, sum(length(text) // 4)::BIGINT AS tokens, count(*)::BIGINT AS turns FROM conversations GROUP BY conv_id", body=True)
def _(b):
    return relational.usage(b["table"]("conversations"), "conv_id", F.expr("length(text) div 4"))


# ------------------------------------------------------------------ order, batches


@query("entry_order", "SELECT canonical_hash, row_number() OVER (ORDER BY score DESC, published_at DESC NULLS LAST, canonical_hash)::BIGINT AS place FROM active")
def _(b):
    return relational.row_numbers(b["active"], relational.entry_order(), "place").select("canonical_hash", F.col("place").cast("long").alias("place"))


@query("winner_rank", "SELECT canonical_hash, row_number() OVER (PARTITION BY topic ORDER BY score DESC, published_at ASC NULLS LAST, canonical_hash)::BIGINT AS k FROM active")
def _(b):
    """Numbered by ranges over all topics; a topic starts after those before it."""
    numbered = relational.row_numbers(dedupe.ranked(b["active"]).select("canonical_hash", "topic", "rank"), [F.col("topic"), F.col("rank")], "k")
    first = numbered.groupBy("topic").agg(F.min("k").alias("first"))
    return numbered.join(F.broadcast(first), "topic").select("canonical_hash", (F.col("k") - F.col("first") + 1).cast("long").alias("k"))


@query("followup_order", "SELECT id, row_number() OVER (PARTITION BY action ORDER BY item)::BIGINT AS k FROM followups WHERE NOT completed")
def _(b):
    f = b["followups"].withColumn("item_title_snapshot", F.lpad(F.col("item").cast("string"), 20, "0"))
    numbered = relational.row_numbers(relational.open_followups(f.drop("completed"), f.filter("completed")), relational.followup_order(), "k")
    first = numbered.groupBy("action").agg(F.min("k").alias("first"))
    return numbered.join(F.broadcast(first), "action").select("id", (F.col("k") - F.col("first") + 1).cast("long").alias("k"))


@query("token_batches", "SELECT batch, count(*)::BIGINT AS n, (sum(length(title)) // 4 + 16)::BIGINT AS cost FROM (SELECT title, (row_number() OVER (ORDER BY ingested_at, canonical_hash) - 1) // 10 AS batch FROM live) GROUP BY batch")
def _(b):
    pending = dedupe.batches(b["live"], 10, [F.col("ingested_at"), F.col("canonical_hash")])
    return pending.groupBy("batch").agg(F.count("*").alias("n"), (F.floor(F.sum(F.length("title")) / 4) + 16).alias("cost"))


@query("budget_spend", """, b AS (SELECT (row_number() OVER (ORDER BY ingested_at, canonical_hash) - 1) // 10 AS batch, length(title) AS l FROM live), c AS (SELECT batch, (sum(l) // 4 + 16)::BIGINT AS cost FROM b GROUP BY batch)
SELECT batch, sum(cost) OVER (ORDER BY batch)::BIGINT AS spent, sum(cost) OVER (ORDER BY batch) <= 2000 AS affordable FROM c""")
def _(b):
    pending = dedupe.batches(b["live"], 10, [F.col("ingested_at"), F.col("canonical_hash")])
    return relational.spent(pending.groupBy("batch").agg((F.floor(F.sum(F.length("title")) / 4) + 16).alias("cost")), 2000)


PENDING = """, p AS (
  SELECT page_id, canonical_hash, title, raw, (row_number() OVER (ORDER BY ingested_at, canonical_hash) - 1) // 10 AS batch,
    length('{"id": , "title": , "source": , "summary": , "url": }, ') + length(to_json(canonical_hash)::VARCHAR) + length(to_json(title)::VARCHAR)
      + length(to_json('feed' || page_id % 6)::VARCHAR) + length(to_json(raw)::VARCHAR) + length(to_json(url)::VARCHAR) AS letters FROM live)"""


def pending(b):
    return b["live"].select("page_id", "canonical_hash", "title", F.concat(F.lit("feed"), (F.col("page_id") % 6).cast("string")).alias("source_name"), F.col("raw").alias("summary"), "url", "ingested_at")


@query("classify_batches", PENDING + """, c AS (SELECT batch, count(*)::BIGINT AS n, ((length('Pick a topic.') + sum(letters)) // 4 + 16)::BIGINT AS cost FROM p GROUP BY batch)
SELECT batch, n, cost, sum(cost) OVER (ORDER BY batch)::BIGINT AS spent FROM c""")
def _(b):
    """Batches of the items that wait, what a call about each costs, and the running cost."""
    rows = pending(b).drop("page_id").withColumnsRenamed({"canonical_hash": "id", "source_name": "source"})
    return batch_queue(rows, ["ingested_at", "id"], 10, "Pick a topic.").select("batch", F.size("items").cast("long").alias("n"), "cost", "spent")


KEYWORDS = {"agents": ["the ", "age"], "models": ["er"], "tools": ["in", "on"]}
COUNTED = {t: " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in words) for t, words in KEYWORDS.items()}


@query("classify_table", f""", t AS (SELECT page_id, lower(title || ' ' || raw) AS t FROM live),
h AS (SELECT page_id, {", ".join(f"{c} AS {t}" for t, c in COUNTED.items())} FROM t),
best AS (SELECT *, CASE WHEN agents + models + tools = 0 THEN 'other' WHEN agents >= greatest(models, tools) THEN 'agents' WHEN models >= tools THEN 'models' ELSE 'tools' END AS topic, greatest(agents, models, tools) AS hits FROM h)
SELECT page_id, 'classified' AS outcome, topic, least(10, 3 + 2 * hits)::BIGINT AS score, hits || ' keyword(s)' AS rationale,
  array_to_string(list_filter([CASE WHEN agents > 0 AND topic <> 'agents' THEN 'agents' END, CASE WHEN models > 0 AND topic <> 'models' THEN 'models' END, CASE WHEN tools > 0 AND topic <> 'tools' THEN 'tools' END], lambda x: x IS NOT NULL), ',') AS secondary FROM best""")
def _(b):
    """All waiting items classified on the executors by the keyword provider."""
    rows = pending(b)
    found = classify_table(rows, KeywordProvider(KEYWORDS), "Pick a topic.", TOPICS)
    return found.join(rows.select("canonical_hash", "page_id"), "canonical_hash").select("page_id", "outcome", "topic", F.col("score").cast("long").alias("score"), "rationale", F.array_join("secondary_topics", ",").alias("secondary"))


# ------------------------------------------------------------------ sets


@query("configured_union", "SELECT count(*)::BIGINT AS n FROM (SELECT c_custkey FROM customer UNION SELECT user_id FROM events)", body=True)
def _(b):
    return relational.all_sources(b["table"]("customer").select(F.col("c_custkey").alias("source_name")), b["runs"].select("source_name").distinct()).agg(F.count("*").alias("n"))


@query("configured_minus_seen", "SELECT c_custkey AS source_name FROM customer EXCEPT SELECT user_id FROM events", body=True)
def _(b):
    return relational.missing(b["table"]("customer").select(F.col("c_custkey").alias("source_name")), b["table"]("events").select(F.col("user_id").alias("source_name")), "source_name")


@query("entity_intersection", f", {ENTS} SELECT value FROM ents JOIN items USING (canonical_hash) WHERE page_id % 2 = 0 INTERSECT SELECT value FROM ents JOIN items USING (canonical_hash) WHERE page_id % 3 = 0")
def _(b):
    e = ents(b).join(b["items"].select("canonical_hash", "page_id"), "canonical_hash")
    return relational.lookup(e.filter("page_id % 2 = 0").select("value").distinct(), e.filter("page_id % 3 = 0"), "value")


@query("clean_secondaries", """SELECT page_id, array_to_string(list_filter([['agents', 'models', 'tools', 'other'][(page_id + 1) % 4 + 1], ['agents', 'models', 'tools', 'other'][page_id % 4 + 1]], lambda x: x <> ['agents', 'models', 'tools', 'other'][page_id % 4 + 1]), ',') AS secondary FROM pages""", body=True)
def _(b):
    topic = lambda n: F.element_at(F.array(*map(F.lit, TOPICS)), (n % 4 + 1).cast("int"))
    i = F.col("page_id")
    given = F.array(topic(i + 1), F.lit("bogus"), topic(i), topic(i + 1))
    return b["table"]("pages").select("page_id", F.array_join(relational.clean_secondaries(given, topic(i), TOPICS), ",").alias("secondary"))


# ------------------------------------------------------------------ health


STREAKS = """, s AS (SELECT source_name, max(seq) FILTER (WHERE NOT failed) AS ok, max(seq) FILTER (WHERE NOT failed AND NOT empty) AS full_, max_by(ts, seq) FILTER (WHERE NOT failed) AS last_ok FROM runs GROUP BY 1),
h AS (SELECT source_name, count(*) FILTER (WHERE failed AND seq > coalesce(ok, -1))::BIGINT AS errors, count(*) FILTER (WHERE NOT failed AND empty AND seq > coalesce(full_, -1))::BIGINT AS empties, any_value(last_ok) AS last_ok FROM runs JOIN s USING (source_name) GROUP BY 1)
"""


def health(b):
    return relational.streaks(b["runs"], "source_name", "seq", F.col("failed"), F.col("empty"), "ts")


@query("source_streaks", STREAKS + "SELECT source_name, errors, empties, floor(epoch(last_ok))::BIGINT AS last_ok FROM h")
def _(b):
    return health(b).select("source_name", F.col("consecutive_error_runs").alias("errors"), F.col("consecutive_empty_runs").alias("empties"), secs("last_success_at").alias("last_ok"))


@query("source_health", STREAKS + "SELECT source_name, CASE WHEN errors > 0 THEN 'FAILING' WHEN last_ok IS NULL THEN 'no success yet' WHEN floor(epoch(TIMESTAMP '2024-01-31' - last_ok) / 86400) > 1 THEN 'STALE' ELSE 'ok' END AS health FROM h")
def _(b):
    return health(b).select("source_name", relational.health_label(F.col("consecutive_error_runs"), F.col("last_success_at"), at("2024-01-31 00:00:00"), 1).alias("health"))


@query("health_gate", STREAKS + "SELECT count(*)::BIGINT AS failing FROM h WHERE errors >= 2")
def _(b):
    return relational.failing(health(b), 2).agg(F.count("*").alias("failing"))


@query("carried_success", "SELECT seq, floor(epoch(last_value(CASE WHEN NOT failed THEN ts END IGNORE NULLS) OVER (PARTITION BY source_name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))::BIGINT AS last_ok FROM runs")
def _(b):
    return relational.carried_success(b["runs"], "source_name", "seq", F.col("failed"), "ts").select("seq", secs("last_success_at").alias("last_ok"))


@query("current_classification", "SELECT canonical_hash, max(id) AS id, max_by(topic, id) AS topic FROM cls GROUP BY 1")
def _(b):
    return relational.latest(b["cls"], ["canonical_hash"], ["id", "topic"], "id")


@query("supersession_roots", """WITH RECURSIVE e AS (SELECT o_orderkey AS loser, o_orderkey // 2 AS winner FROM orders WHERE o_orderkey >= 2 AND o_orderstatus <> 'P'),
r AS (SELECT loser, winner AS root FROM e UNION ALL SELECT r.loser, e.winner FROM r JOIN e ON e.loser = r.root) SELECT loser, min(root) AS root FROM r GROUP BY loser""", body=True)
def _(b):
    k = F.col("o_orderkey")
    e = b["table"]("orders").filter((k >= 2) & (F.col("o_orderstatus") != "P")).select(k.alias("loser"), F.expr("o_orderkey div 2").alias("winner"), F.lit(1).alias("seq"))
    return store.resolve_roots(e)


# ------------------------------------------------------------------ text


@query("cves", r"SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)\bCVE-\d{4}-\d{4,}\b'), lambda x: upper(x)))), ',') AS cves FROM texts")
def _(b):
    return b["texts"].select("o_orderkey", F.array_join(F.sort_array(F.array_distinct(entities.cves(F.col("text")))), ",").alias("cves"))


@query("packages", r"SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)\b(?:npm|pypi):(?:@[A-Za-z0-9_]+(?:[.-][A-Za-z0-9_]+)*/[A-Za-z0-9_]+(?:[.-][A-Za-z0-9_]+)*|[A-Za-z0-9_]+(?:[.-][A-Za-z0-9_]+)*)'), lambda x: lower(x)))), ',') AS packages FROM texts")
def _(b):
    return b["texts"].select("o_orderkey", F.array_join(F.sort_array(F.array_distinct(entities.packages(F.col("text")))), ",").alias("packages"))


@query("url_repos", r"SELECT o_orderkey, lower(regexp_extract(text, 'github\.com/(Org[0-9]+/Repo_[0-9]+)', 1)) AS repos FROM texts")
def _(b):
    return b["texts"].select("o_orderkey", F.array_join(entities.url_repos(F.col("text")), ",").alias("repos"))


ENTITY_SET = r""", repos AS (
  SELECT o_orderkey, unnest(regexp_extract_all(text, '(?i)github\.com/[a-z0-9][a-z0-9-]{0,38}/[a-z0-9_][a-z0-9._-]{0,99}')) AS hit FROM texts),
bare AS (
  SELECT o_orderkey, lower(unnest(regexp_extract_all(text, '(?:^|[^\w/.@:-])([A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?/[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*)(?:[^\w/-]|$)', 1))) AS value FROM texts)
SELECT o_orderkey, 'cve' AS kind, upper(unnest(regexp_extract_all(text, '(?i)\bCVE-\d{4}-\d{4,}\b'))) AS value FROM texts
UNION SELECT o_orderkey, 'package', lower(unnest(regexp_extract_all(text, '(?i)\b(?:npm|pypi):(?:@[a-z0-9_]+(?:[.-][a-z0-9_]+)*/)?[a-z0-9_]+(?:[.-][a-z0-9_]+)*'))) FROM texts
UNION SELECT o_orderkey, 'repo', regexp_replace(lower(substr(hit, 12)), '\.git$', '') FROM repos WHERE split_part(lower(hit), '/', 2) <> 'sponsors'
UNION SELECT o_orderkey, 'repo', value FROM bare"""


@query("entity_set", ENTITY_SET)
def _(b):
    return b["texts"].select("o_orderkey", F.explode(entities.extract_entities(F.col("text"))).alias("e")).select("o_orderkey", "e.kind", "e.value")


@query("entity_lateral", ENTITY_SET)
def _(b):
    """The entities by SQL: a table function beside each row."""
    spark = b["texts"].sparkSession
    register_functions(spark)
    return spark.sql("SELECT o_orderkey, e.kind, e.value FROM {texts}, LATERAL quill_entities(text) e", texts=b["texts"])


@query("url_sql", "SELECT page_id, url AS canonical_url, sha256(url) AS canonical_hash FROM urls")
def _(b):
    pages = b["table"]("pages").select("page_id", "url")
    register_functions(pages.sparkSession)
    return pages.sparkSession.sql("SELECT page_id, u AS canonical_url, sha2(u, 256) AS canonical_hash FROM (SELECT page_id, quill_canonical_url(url) AS u FROM {pages})", pages=pages)


#: White space of Unicode, for a pattern.
SPACES = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
REFERENCES = {"lt": "<", "gt": ">", "quot": '"', "#39": "''", "apos": "''", "copy": "©", "middot": "·", "nbsp": "\u00a0", "hellip": "…", "mdash": "—", "ndash": "–", "amp": "&"}
NEED_SEMICOLON = ["apos", "hellip", "mdash", "ndash"]
DECODED = r"regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
for _name, _letter in REFERENCES.items():
    DECODED = f"regexp_replace({DECODED}, '&{_name};{'' if _name in NEED_SEMICOLON else '?'}', '{_letter}', 'g')"


@query("html_text", f"SELECT page_id, regexp_replace(regexp_replace({DECODED}, '{SPACES}+', ' ', 'g'), '^ | $', '', 'g') AS text FROM pages", body=True)
def _(b):
    return b["table"]("pages").select("page_id", text.html_to_text("html").alias("text"))


@query("script_free", r"SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g') AS html FROM pages", body=True)
def _(b):
    return b["table"]("pages").select("page_id", text.drop_scripts("html").alias("html"))


@query("code_fences", "SELECT conv_id, turn, trim(text, ' ' || chr(10)) AS body FROM conversations", body=True)
def _(b):
    fenced = F.concat(F.lit("```json\n"), "text", F.lit("\n```"))
    return b["table"]("conversations").select("conv_id", "turn", text.unfence(F.when(F.col("turn") % 2 == 0, fenced).otherwise(F.col("text"))).alias("body"))


@query("safe_names", "SELECT n_nationkey, 'src#' || substr(sha256(n_name), 1, 8) AS safe FROM nation", body=True)
def _(b):
    return b["table"]("nation").select("n_nationkey", text.safe_source_name("n_name").alias("safe"))


@query("markdown_cells", r"SELECT doc_id, trim(replace(replace(text, '|', '\|'), chr(10), ' ')) AS cell FROM documents", body=True)
def _(b):
    return b["table"]("documents").select("doc_id", text.markdown_cell("text").alias("cell"))


@query("secondary_suffix", "SELECT id, ' · also ' || array_to_string(list_sort(secondary_topics), ', ') AS suffix FROM cls")
def _(b):
    return b["cls"].select("id", text.secondary_suffix("secondary_topics").alias("suffix"))


@query("title_similarity", f"""WITH RECURSIVE {BASE}, pairs AS (SELECT DISTINCT lower(trim(i.title)) AS x, lower(trim(n.title)) AS y FROM items i JOIN items n ON n.page_id = i.page_id + 1),
{similar_titles('pairs')}
SELECT i.page_id, similarity FROM items i JOIN items n ON n.page_id = i.page_id + 1 JOIN alike ON x = lower(trim(i.title)) AND y = lower(trim(n.title))""", body=True)
def _(b):
    """Indel similarity of each title with the next page's."""
    from ..functions.similarity import indel_ratio

    i = b["items"].select("page_id", "title")
    n = i.select((F.col("page_id") - 1).alias("page_id"), F.col("title").alias("next"))
    return i.join(n, "page_id").select("page_id", indel_ratio(F.lower(text.strip("title")), F.lower(text.strip("next"))).alias("similarity"))


# ------------------------------------------------------------------ dates, replies


@query("window_labels", """SELECT o_orderkey, 'W' || isoyear(o_orderdate) || '-W' || lpad(weekofyear(o_orderdate)::VARCHAR, 2, '0') AS week, 'D' || strftime(o_orderdate, '%Y-%m-%d') || '-7d' AS trailing,
 'R' || strftime(o_orderdate, '%Y-%m-%d') || '-to-' || strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') AS span FROM orders""", body=True)
def _(b):
    d = F.col("o_orderdate").cast("timestamp")
    return b["table"]("orders").select("o_orderkey", dates.iso_week_label(d).alias("week"), dates.trailing_label(d, 7).alias("trailing"), dates.range_label(d, d + F.expr("INTERVAL 3 DAYS")).alias("span"))


@query("week_start", "SELECT event_id, epoch(date_trunc('week', ts))::BIGINT AS monday FROM events", body=True)
def _(b):
    return b["table"]("events").select("event_id", secs(dates.week_start(F.col("ts").cast("timestamp"))).alias("monday"))


@query("close_in_time", """WITH e AS (SELECT event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS nx FROM events)
SELECT event_id, (event_id % 10 = 0 OR nx IS NULL OR abs(epoch_us(ts) - epoch_us(nx)) <= 3600000000) AS close FROM e""", body=True)
def _(b):
    e = b["table"]("events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    e = e.withColumn("nx", F.lead("ts").over(Window.partitionBy("user_id").orderBy("event_id")))
    return e.select("event_id", dates.close_in_time(F.when(F.col("event_id") % 10 != 0, F.col("ts")), F.col("nx"), 1).alias("close"))


@query("age_days", "SELECT event_id, floor((epoch(TIMESTAMP '2024-02-15') - floor(epoch(ts))) / 86400)::BIGINT AS age FROM events", body=True)
def _(b):
    return b["table"]("events").select("event_id", dates.age_days(F.col("ts").cast("timestamp"), at("2024-02-15 00:00:00")).alias("age"))


@query("reply_scores", """SELECT event_id, CASE event_id % 8 WHEN 0 THEN event_id % 11 WHEN 1 THEN event_id % 11 WHEN 2 THEN event_id % 11 WHEN 3 THEN 1 ELSE NULL END AS score FROM events""", body=True)
def _(b):
    n = (F.col("event_id") % 11).cast("string")
    k = F.col("event_id") % 8
    raw = F.when(k == 0, n).when(k == 1, F.concat(F.lit('" '), n, F.lit(' "'))).when(k == 2, F.concat(n, F.lit(".0"))).when(k == 3, "true").when(k == 4, "7.5").when(k == 5, "null").when(k == 6, "42").otherwise('"high"')
    v = F.parse_json(F.concat(F.lit('{"score":'), raw, F.lit("}")))
    return b["table"]("events").select("event_id", replies.lax_score(v).cast("long").alias("score"))


@query("reply_shapes", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE NULL END::BIGINT AS n FROM events""", body=True)
def _(b):
    k = F.col("event_id") % 6
    r = F.when(k == 0, "[{}, {}]").when(k == 1, '{"items": [{}], "other": [1, 2]}').when(k == 2, '```json\n{"x": [1, 2, 3]}\n```').when(k == 3, '{"x": [1], "y": [2]}').when(k == 4, '"text"').otherwise("not json")
    return b["table"]("events").select("event_id", F.size(replies.reply_entries(r)).cast("long").alias("n")).withColumn("n", F.when(F.col("n") >= 0, F.col("n")))


# ------------------------------------------------------------------ the store's own rules


CHAIN = """WITH RECURSIVE e AS (SELECT o_orderkey AS loser, CASE WHEN o_orderkey % 97 = 5 THEN o_orderkey + 96 WHEN o_orderkey % 97 > 5 THEN o_orderkey - 1 ELSE o_orderkey // 2 END AS winner FROM orders WHERE o_orderkey >= 2),
"""


@query("supersession_repoint", CHAIN.replace("o_orderkey % 97 = 5 THEN o_orderkey + 96 WHEN o_orderkey % 97 > 5", "o_orderkey % 97 > 5") + """r AS (SELECT loser, winner AS root, 1 AS k FROM e UNION ALL SELECT r.loser, e.winner, k + 1 FROM r JOIN e ON e.loser = r.root),
f AS (SELECT loser, arg_max(root, k) AS root FROM r GROUP BY loser) SELECT loser, root FROM f JOIN e USING (loser) WHERE root <> winner""", body=True)
def _(b):
    """Losers whose winner has itself lost, with the root that they are moved to."""
    k = F.col("o_orderkey")
    log = b["table"]("orders").filter(k >= 2).select(k.alias("loser"), F.when(k % 97 > 5, k - 1).otherwise(F.expr("o_orderkey div 2")).alias("winner"))
    return store.repointed(log).select("loser", "root")


@query("supersession_cycles", """WITH e AS (SELECT o_orderkey AS loser, o_orderkey // 10 AS ring FROM orders) SELECT loser, first AS root FROM e JOIN (SELECT ring, min(loser) AS first, count(*) AS n FROM e GROUP BY ring) USING (ring) WHERE loser <> first""", body=True)
def _(b):
    """Rings of up to ten losers, each superseded by the next: the least is the root."""
    e = b["table"]("orders").select(F.col("o_orderkey").alias("loser"), F.expr("o_orderkey div 10").alias("ring"))
    w = Window.partitionBy("ring").orderBy("loser")
    ring = e.withColumn("winner", F.coalesce(F.lead("loser").over(w), F.first("loser").over(w)))
    return store.resolve_roots(ring.select("loser", "winner", F.lit(1).alias("seq")))


@query("classified_outcomes", """SELECT CASE WHEN quality IS NULL THEN 'skipped' WHEN quality = 1 THEN 'classified' ELSE 'fallback' END AS outcome, count(*)::BIGINT AS n FROM labels GROUP BY 1""", body=True)
def _(b):
    return relational.outcomes(b["table"]("labels"), F.col("quality") == 1, F.col("quality") == 0)


@query("source_run_order", "SELECT source_name, row_number() OVER (ORDER BY source_name)::BIGINT AS place FROM (SELECT DISTINCT source_name FROM runs)")
def _(b):
    names = relational.latest(b["runs"], ["source_name"], ["ts"], "seq")
    return relational.row_numbers(names, [F.col("source_name")], "place").select("source_name", F.col("place").cast("long").alias("place"))


@query("followups_stored", """SELECT id, action, created FROM (SELECT row_number() OVER (ORDER BY created_at, lpad(id::VARCHAR, 12, '0'), action)::BIGINT AS id, action, epoch(created_at)::BIGINT AS created FROM followups) WHERE id % 3 <> 0""")
def _(b):
    """Followups written to a store, a third of them done, the open ones read back."""
    f = b["followups"]
    kept = store.Store(f.sparkSession, scratch_path(f.sparkSession, "followups"))
    kept.add_followups(f.select("created_at", F.lpad(F.col("item").cast("string"), 12, "0").alias("item_hash"), F.lit("t").alias("item_title_snapshot"), F.lit("u").alias("item_url_snapshot"), "action", F.lit("").alias("note")))
    kept.append("followups_done", kept.read("followups").filter("id % 3 = 0").select("id"))
    return kept.followups(open_only=True).select("id", "action", secs("created_at").alias("created"))


@query("golden_scan", """SELECT row_number() OVER (ORDER BY 'https://e.com/' || lpad(doc_id::VARCHAR, 12, '0'), 'd' || doc_id)::VARCHAR AS canonical_hash, 'd' || doc_id AS title, (doc_id % 11)::INT AS score, CASE WHEN quality = 1 THEN 'tools' ELSE 'other' END AS topic FROM labels WHERE doc_id % 5 <> 0""", body=True)
def _(b):
    """A golden set written as JSON lines and read back; lines without a title go."""
    d = F.col("doc_id")
    lines = b["table"]("labels").select(
        F.when(d % 5 != 0, F.concat(F.lit("d"), d.cast("string"))).alias("title"), F.concat(F.lit("https://e.com/"), F.lpad(d.cast("string"), 12, "0")).alias("url"),
        (d % 11).cast("int").alias("score"), F.when(F.col("quality") == 1, "tools").otherwise("other").alias("topic"))
    path = scratch_path(lines.sparkSession, "golden")
    lines.write.json(path)
    return load_golden(lines.sparkSession, path).select("canonical_hash", "title", "score", "topic")
