"""Entities named in a text: CVEs, packages and repositories."""

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITY = "array<struct<kind:string,value:string>>"
MAX_PER_ITEM = 64
#: First path segments that are site routes, not owners.
RESERVED_OWNERS = [
    "sponsors", "settings", "marketplace", "features", "about", "pricing", "explore", "topics", "collections", "trending", "notifications", "new", "login", "logout", "join",
    "organizations", "orgs", "users", "search", "apps", "dashboard", "pulls", "issues", "stars", "watching", "security", "site", "contact", "git", "blog", "support", "readme",
]
#: Word pairs that only look like repositories.
NOT_REPOS = ["and/or", "either/or", "he/she", "she/he", "s/he", "yes/no", "on/off", "input/output", "read/write", "client/server", "tcp/ip", "ca/browser", "km/h", "w/o", "n/a", "i/o"]
#: Endings of file names.
SOURCE_ENDINGS = [".py", ".js", ".ts", ".tsx", ".jsx", ".md", ".rst", ".go", ".rs", ".rb", ".java", ".c", ".cpp", ".h", ".json", ".yaml", ".yml", ".toml", ".html", ".css", ".txt", ".sh"]
#: Patterns.
CVE = r"(?iU)\bCVE-\d{4}-\d{4,}\b"
REPO_URL = r"(?i)github\.com/([A-Za-z0-9][A-Za-z0-9-]{0,38})/([A-Za-z0-9_][A-Za-z0-9._-]{0,99})"
BARE_REPO = r"(?U)(?<![\w/.@:-])([A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?)/([A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*)(?![\w/-])"
PACKAGE_NAME = r"[A-Za-z0-9_]+(?:[.-][A-Za-z0-9_]+)*"
PACKAGE = rf"(?iU)\b(?:npm|pypi):(?:@{PACKAGE_NAME}/{PACKAGE_NAME}|{PACKAGE_NAME})"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _as(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def cves(text: Column) -> Column:
    return F.transform(_all(text, CVE, 0), lambda v: F.upper(v))


def packages(text: Column) -> Column:
    return F.transform(_all(text, PACKAGE, 0), lambda v: F.lower(v))


def _pairs(text: Column, pattern: str) -> Column:
    return F.zip_with(_all(text, pattern, 1), _all(text, pattern, 2), lambda o, r: F.struct(F.lower(o).alias("owner"), F.lower(r).alias("repo")))


def url_repos(text: Column) -> Column:
    """owner/repo of repository URLs; only site routes are ruled out."""
    owned = F.filter(_pairs(text, REPO_URL), lambda p: ~p["owner"].isin(RESERVED_OWNERS))
    return F.transform(owned, lambda p: F.concat_ws("/", p["owner"], F.regexp_replace(p["repo"], r"\.git$", "")))


def looks_like_repo(owner: Column, repo: Column) -> Column:
    token = F.concat_ws("/", owner, repo)
    ending = F.lit(False)
    for e in SOURCE_ENDINGS:
        ending = ending | F.endswith(repo, F.lit(e))
    return token.rlike(r"\p{L}") & ~owner.isin(RESERVED_OWNERS) & ~token.isin(NOT_REPOS) & ~ending


def bare_repos(text: Column) -> Column:
    return F.transform(F.filter(_pairs(text, BARE_REPO), lambda p: looks_like_repo(p["owner"], p["repo"])), lambda p: F.concat_ws("/", p["owner"], p["repo"]))


def extract_entities(text: Column, limit: int = MAX_PER_ITEM) -> Column:
    """Distinct (kind, value) in order of kind, then value; at most ``limit``, so
    that the noisy kind is the one cut."""
    found = F.concat(_as("cve", cves(text)), _as("repo", url_repos(text)), _as("repo", bare_repos(text)), _as("package", packages(text)))
    return F.slice(F.array_sort(F.array_distinct(found)), 1, limit)
