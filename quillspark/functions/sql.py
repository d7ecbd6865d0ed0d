"""The library's functions under SQL names.

They are temporary SQL functions of a session: Spark puts their bodies in place of the
call, so nothing of them runs in Python but title similarity. ``quill_entities`` is a
table function for LATERAL. Their results are those of the Column functions (tested).
"""

from pyspark.sql import SparkSession

from .entities import BARE_REPO, CVE, MAX_PER_ITEM, NOT_REPOS, PACKAGE, REPO_URL, RESERVED_OWNERS, SOURCE_ENDINGS
from .similarity import indel_ratio
from .url import TRACKING, TRACKING_PREFIXES, URL_PARTS


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _pairs(pattern: str) -> str:
    one = "regexp_extract_all(text, r'{}', {})"
    return f"zip_with({one.format(pattern, 1)}, {one.format(pattern, 2)}, (o, r) -> named_struct('owner', lower(o), 'repo', lower(r)))"


_LIKELY = (rf"(concat(p.owner, p.repo) RLIKE r'\p{{L}}' AND p.owner NOT IN {_in(RESERVED_OWNERS)} AND concat_ws('/', p.owner, p.repo) NOT IN {_in(NOT_REPOS)} AND NOT ("
           + " OR ".join(f"endswith(p.repo, '{e}')" for e in SOURCE_ENDINGS) + "))")

def _decoded(c: str) -> str:
    return f"try_url_decode(regexp_replace({c}, '%(?![0-9A-Fa-f]{{2}})', '%25'))"


def _encoded(c: str) -> str:
    return f"replace(replace(url_encode({c}), '*', '%2A'), '%7E', '~')"


def _tracks(name: str) -> str:
    return "(" + " OR ".join([f"lower({name}) IN {_in(TRACKING)}", *[f"startswith(lower({name}), '{p}')" for p in TRACKING_PREFIXES]]) + ")"


_ARXIV = r"""coalesce(nullif(regexp_extract(regexp_replace(path, r'(?i)\.pdf$', ''), r'(?U)(\d{4}\.\d{4,5})', 1), ''),
  nullif(regexp_extract(regexp_replace(path, r'(?i)\.pdf$', ''), r'(?iU)([a-z-]+(?:\.[A-Za-z]{2})?/\d{7})', 1), ''))"""
_QUERY = f"""array_join(transform(filter(transform(filter(split(query, '&'), p -> p <> ''),
  p -> named_struct('k', {_decoded("substring_index(p, '=', 1)")}, 'v', IF(contains(p, '='), {_decoded("substring(p, instr(p, '=') + 1)")}, ''))),
  p -> NOT {_tracks("p.k")}), p -> concat({_encoded("p.k")}, '=', {_encoded("p.v")})), '&')"""
#: The steps of canonical_url, one level of selection each.
_URL = rf"""SELECT CASE WHEN port <> '' AND (number IS NULL OR number > 65535) THEN NULL ELSE coalesce(
    concat('https://arxiv.org/abs/', CASE WHEN host = 'arxiv.org' OR endswith(host, '.arxiv.org') THEN {_ARXIV} END),
    concat(IF(scheme <> '', concat(scheme, ':'), ''), IF(slashes <> '' OR scheme IN ('http', 'https'), concat('//', shown), ''),
      IF(shown <> '' AND trimmed <> '' AND NOT startswith(trimmed, '/'), concat('/', trimmed), trimmed), IF(q <> '', concat('?', q), ''), IF(fragment <> '', concat('#', fragment), ''))) END
  FROM (SELECT *, concat(host, IF(number IS NOT NULL AND NOT ((scheme = 'http' AND number = 80) OR (scheme = 'https' AND number = 443)), concat(':', CAST(number AS STRING)), '')) AS shown,
      CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/+$', '') END AS trimmed, {_QUERY} AS q
    FROM (SELECT *, CASE WHEN port RLIKE '^[0-9]{{1,9}}$' THEN CAST(port AS INT) END AS number
      FROM (SELECT *, regexp_extract(netloc, r'^(?:\[[^\]]*\]|[^:\[]*):(.*)$', 1) AS port,
          lower(IF(startswith(netloc, '['), regexp_extract(netloc, r'^\[([^\]]*)\]', 1), substring_index(netloc, ':', 1))) AS host
        FROM (SELECT lower(regexp_extract(u, p, 1)) AS scheme, regexp_extract(u, p, 2) AS slashes, regexp_replace(regexp_extract(u, p, 3), '^.*@', '') AS netloc,
            regexp_extract(u, p, 4) AS path, regexp_extract(u, p, 5) AS query, regexp_extract(u, p, 6) AS fragment
          FROM (SELECT regexp_replace(regexp_replace(url, r'(?U)^\s+|\s+$', ''), r'[	
]', '') AS u, r'{URL_PARTS}' AS p)))))"""
_CVES = f"transform(regexp_extract_all(text, r'{CVE}', 0), v -> upper(v))"
_PACKAGES = f"transform(regexp_extract_all(text, r'{PACKAGE}', 0), v -> lower(v))"
_REPOS = rf"""concat(transform(filter({_pairs(REPO_URL)}, p -> p.owner NOT IN {_in(RESERVED_OWNERS)}), p -> concat_ws('/', p.owner, regexp_replace(p.repo, r'\.git$', ''))),
  transform(filter({_pairs(BARE_REPO)}, p -> {_LIKELY}), p -> concat_ws('/', p.owner, p.repo)))"""
_ENTITIES = "slice(array_sort(array_distinct(concat(" + ", ".join(
    f"transform({found}, v -> named_struct('kind', '{kind}', 'value', v))" for kind, found in (("cve", _CVES), ("repo", _REPOS), ("package", _PACKAGES))) + f"))), 1, {MAX_PER_ITEM})"

#: Signature, type and body.
FUNCTIONS = [
    ("quill_strip(text STRING)", "STRING", r"regexp_replace(text, r'(?U)^\s+|\s+$', '')"),
    ("quill_collapse(text STRING)", "STRING", r"regexp_replace(regexp_replace(text, r'(?U)\s+', ' '), r'(?U)^\s+|\s+$', '')"),
    ("quill_markdown_cell(text STRING)", "STRING", r"regexp_replace(replace(replace(text, '|', r'\|'), chr(10), ' '), r'(?U)^\s+|\s+$', '')"),
    ("quill_safe_source(name STRING)", "STRING", "concat('src#', left(sha2(name, 256), 8))"),
    ("quill_week(at TIMESTAMP)", "STRING", "concat('W', CAST(extract(YEAROFWEEK FROM at) AS STRING), '-W', lpad(CAST(weekofyear(at) AS STRING), 2, '0'))"),
    ("quill_age_days(since TIMESTAMP, now TIMESTAMP)", "BIGINT", "floor((unix_seconds(now) - unix_seconds(since)) / 86400)"),
    ("quill_close_in_time(a TIMESTAMP, b TIMESTAMP, hours INT)", "BOOLEAN", "a IS NULL OR b IS NULL OR abs(unix_micros(a) - unix_micros(b)) <= hours * 3600000000L"),
    ("quill_is_tracking(name STRING)", "BOOLEAN", _tracks("name")),
    ("quill_arxiv_id(path STRING)", "STRING", _ARXIV),
    ("quill_canonical_url(url STRING)", "STRING", _URL),
    ("quill_cves(text STRING)", "ARRAY<STRING>", _CVES),
    ("quill_packages(text STRING)", "ARRAY<STRING>", _PACKAGES),
    ("quill_repos(text STRING)", "ARRAY<STRING>", f"array_distinct({_REPOS})"),
    ("quill_entity_list(text STRING)", "ARRAY<STRUCT<kind: STRING, value: STRING>>", _ENTITIES),
    ("quill_entities(text STRING)", "TABLE(kind STRING, value STRING)", f"SELECT inline({_ENTITIES})"),
]


def register_functions(spark: SparkSession) -> list[str]:
    """Makes the functions known to ``spark.sql`` of this session; returns their names.
    A second call replaces them. ``quill_canonical_url`` leaves hosts outside ASCII as
    they are, like ``canonical_url(idn=False)``; nulls give null, and no entities."""
    for signature, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    spark.udf.register("quill_title_similarity", indel_ratio)
    return [s.split("(")[0] for s, _, _ in FUNCTIONS] + ["quill_title_similarity"]
