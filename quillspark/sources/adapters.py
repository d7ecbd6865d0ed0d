"""The five source types: a request, a parser and a cursor rule each.

``fetch(config, cursor, client)`` gives (rows, new cursor, not_modified); a row
is (external_id, payload as JSON). The cursor is whatever JSON the source needs
to go on where it stopped.
"""

import calendar
import email.utils
import hashlib
import json
import os
import xml.etree.ElementTree as ET
from datetime import UTC, datetime
from html.parser import HTMLParser
from urllib.parse import urlencode, urlsplit

from .http import HttpError

ARXIV_API = "https://export.arxiv.org/api/query"
HN_API, HN_ITEM = "https://hn.algolia.com/api/v1/search_by_date", "https://news.ycombinator.com/item?id={}"
GITHUB_API = "https://api.github.com"
ARXIV_ERRORS = "arxiv.org/api/errors"
#: Per type: required and optional settings with their kinds.
FIELDS = {
    "rss": ({"url": str}, {}),
    "arxiv": ({"query": str}, {"max_results": (int, 50)}),
    "hn_search": ({"query": str}, {"tags": (str, "story"), "hits_per_page": (int, 50)}),
    "github_releases": ({"repo": str}, {"per_page": (int, 30)}),
    "github_topic": ({"topic": str}, {"min_stars": (int, 0), "per_page": (int, 30)}),
}


def _kept(payload: dict) -> dict:
    return {k: v for k, v in payload.items() if v is not None and v != [] and v != ""}


def iso_epoch(value) -> int | None:
    """Epoch seconds of an ISO 8601 time; without a zone UTC; null if unreadable."""
    try:
        at = datetime.fromisoformat(value.replace("Z", "+00:00"))
    except (AttributeError, ValueError):
        return None
    return int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp())


def _feed_epoch(value: str | None) -> int | None:
    if not value:
        return None
    parsed = email.utils.parsedate_tz(value)
    return calendar.timegm(parsed[:6] + (0, 0, 0)) - (parsed[9] or 0) if parsed else iso_epoch(value.strip())


class _Lenient(HTMLParser):
    """Feed entries of a document that is not well-formed: the elements inside every
    item or entry, whatever is left open or badly escaped around them."""

    RAW = {"title", "link", "guid", "id", "description", "summary", "pubdate", "published", "date", "updated", "author", "creator", "name", "category", "encoded", "content"}
    CASED = {"pubdate": "pubDate"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.entries, self.entry, self.field = [], None, None

    def handle_starttag(self, tag, attrs):
        name = tag.rsplit(":", 1)[-1]
        if name in ("item", "entry"):
            self.entry, self.field = ET.Element(name), None
            self.entries.append(self.entry)
        elif self.entry is not None and name in self.RAW and (self.field is None or name != "name"):
            self.field = ET.SubElement(self.entry, self.CASED.get(name, name), {k: v or "" for k, v in attrs})
            self.field.text = ""
        elif self.field is not None and name != "name":
            self.field.text += self.get_starttag_text() or ""

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag.rsplit(":", 1)[-1] in self.RAW:
            self.field = None

    def handle_endtag(self, tag):
        name = tag.rsplit(":", 1)[-1]
        if name in ("item", "entry"):
            self.entry = self.field = None
        elif name in self.RAW:
            self.field = self.field if name == "name" else None
        elif self.field is not None:
            self.field.text += f"</{tag}>"

    def handle_data(self, data):
        if self.field is not None:
            self.field.text += data

    def unknown_decl(self, data):
        if data.startswith("CDATA[") and self.field is not None:
            self.field.text += data[6:]


def _entries(data: bytes) -> list:
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    try:
        return [e for e in ET.fromstring(data).iter() if local(e) in ("item", "entry")]
    except ET.ParseError:
        lenient = _Lenient()
        lenient.feed(data.decode("utf-8", "replace"))
        lenient.close()
        return lenient.entries


def external_id(ident: str | None, link: str | None, title: str | None, published: str | None) -> str:
    """An entry's id, else its link, else a digest of title and time."""
    return str(ident or link or hashlib.sha256(f"{title or ''}|{published or ''}".encode()).hexdigest())


def parse_feed(data: bytes) -> list[dict]:
    """Entries of an RSS or Atom document, as payloads with their id. A document that
    is not well-formed gives what entries can be made out; one that is no feed none."""
    name = lambda e: e.tag.rsplit("}", 1)[-1]
    out = []
    for entry in _entries(data):
        by = {}
        for child in entry:
            by.setdefault(name(child), []).append(child)
        text = lambda *keys: next((t for k in keys for c in by.get(k, []) if (t := "".join(c.itertext()).strip())), None)
        links = by.get("link", [])
        alternate = [c.get("href") for c in links if c.get("href") and c.get("rel", "alternate") == "alternate"]
        link = text("link") or next(iter(alternate), None)
        published, updated = text("pubDate", "published", "date"), text("updated")
        authors = ["".join(c.itertext()).strip() for a in by.get("author", []) + by.get("creator", []) for c in ([g for g in a if name(g) == "name"] or [a])]
        payload = _kept({
            "title": text("title"), "link": link, "id": text("guid", "id"), "summary": text("description", "summary"), "published": published, "updated": updated,
            "authors": [a for a in authors if a], "tags": [t for c in by.get("category", []) if (t := c.get("term") or (c.text or "").strip())],
            "published_timestamp": _feed_epoch(published), "updated_timestamp": _feed_epoch(updated), "content": text("encoded", "content"),
        })
        out.append(payload | {"_key": external_id(payload.get("id"), payload.get("link"), payload.get("title"), payload.get("published"))})
    return out


def _rows(payloads):
    return [(p.pop("_key"), json.dumps(p, ensure_ascii=False)) for p in payloads]


def _checked(reply):
    if reply.status >= 400:
        raise HttpError(f"HTTP {reply.status}")
    return reply


def _json(reply):
    try:
        return json.loads(_checked(reply).body)
    except ValueError as e:
        raise HttpError("body is not JSON") from e


def _github_headers(etag=None) -> dict:
    headers = {"Accept": "application/vnd.github+json", "X-GitHub-Api-Version": "2022-11-28"}
    if token := os.environ.get("GITHUB_TOKEN"):
        headers["Authorization"] = f"Bearer {token}"
    return headers | ({"If-None-Match": etag} if etag else {})


def _rss(c, cursor, client):
    conditional = {h: cursor[k] for h, k in (("If-None-Match", "etag"), ("If-Modified-Since", "last_modified")) if cursor.get(k)}
    reply = client.get(c["url"], conditional)
    if reply.status == 304:
        return [], dict(cursor), True
    rows = _rows(parse_feed(_checked(reply).body))
    fresh = {k: v for k, h in (("etag", "ETag"), ("last_modified", "Last-Modified")) if (v := reply.header(h))}
    return rows, {**cursor, **fresh}, False


def _arxiv(c, cursor, client):
    q = {"search_query": c["query"], "sortBy": "submittedDate", "sortOrder": "descending", "max_results": c["max_results"]}
    entries = parse_feed(_checked(client.get(f"{ARXIV_API}?{urlencode(q)}")).body)
    return _rows(paper_entries(entries)), dict(cursor), False


def paper_entries(entries: list[dict]) -> list[dict]:
    """Entries without the one that tells of an error."""
    return [e for e in entries if ARXIV_ERRORS not in e.get("id", "") and ARXIV_ERRORS not in e.get("link", "")]


def _hn(c, cursor, client):
    q = {"query": c["query"], "tags": c["tags"], "hitsPerPage": c["hits_per_page"]}
    mark = cursor.get("last_created_at_i")
    if isinstance(mark, int):
        q["numericFilters"] = f"created_at_i>{mark}"
    rows, top = hit_rows(_json(client.get(f"{HN_API}?{urlencode(q)}")), mark)
    return rows, {**cursor, "last_created_at_i": top}, False


def hit_rows(body, mark) -> tuple[list, int]:
    """(rows, latest time) of a search reply; the time never goes back behind ``mark``."""
    hits = body.get("hits") if isinstance(body, dict) else None
    rows, top = [], mark if isinstance(mark, int) else 0
    for hit in hits if isinstance(hits, list) else []:
        key = str(hit.get("objectID", "")) if isinstance(hit, dict) else ""
        if not key:
            continue
        created = hit.get("created_at_i")
        timed = isinstance(created, (int, float)) and not isinstance(created, bool)
        page = HN_ITEM.format(key)
        payload = {"title": hit.get("title") or hit.get("story_title"), "link": hit.get("url") or page, "hn_url": page}
        payload |= {k: hit.get(k) for k in ("story_text", "author", "points", "num_comments")}
        payload["published_timestamp"] = int(created) if timed else None
        rows.append((key, json.dumps({k: v for k, v in payload.items() if v is not None}, ensure_ascii=False)))
        top = max(top, created) if isinstance(created, int) else top
    return rows, top


def _releases(c, cursor, client):
    etag = cursor.get("etag")
    reply = client.get(f"{GITHUB_API}/repos/{c['repo']}/releases?per_page={c['per_page']}", _github_headers(etag if isinstance(etag, str) else None))
    if reply.status == 304:
        return [], dict(cursor), True
    rows = release_rows(c["repo"], _json(reply))
    return rows, {**cursor, **({"etag": e} if (e := reply.header("ETag")) else {})}, False


def release_rows(repo: str, body) -> list:
    """Rows of a list of releases; drafts and what is no release are left out."""
    rows = []
    for r in body if isinstance(body, list) else []:
        if not isinstance(r, dict) or r.get("draft"):
            continue
        key = str(r.get("id") or r.get("html_url") or "")
        author = r.get("author")
        if key:
            rows.append((key, json.dumps(_kept({
                "link": r.get("html_url"), "title": f"{repo} {r.get('tag_name') or r.get('name') or ''}".strip(), "summary": r.get("body"), "repo": repo, "tag": r.get("tag_name"),
                "author": author.get("login") if isinstance(author, dict) else None, "published_timestamp": iso_epoch(r.get("published_at"))}), ensure_ascii=False)))
    return rows


def _topic(c, cursor, client):
    q = {"q": f"topic:{c['topic']} stars:>={c['min_stars']}", "sort": "updated", "order": "desc", "per_page": c["per_page"]}
    body = _json(client.get(f"{GITHUB_API}/search/repositories?{urlencode(q)}", _github_headers()))
    repos = body.get("items") if isinstance(body, dict) else None
    mark = cursor.get("last_pushed_epoch")
    mark = mark if isinstance(mark, int) else 0
    seen = {str(s) for s in cursor.get("seen_at_watermark") or []} if isinstance(cursor.get("seen_at_watermark"), list) else set()
    taken = []
    for r in repos if isinstance(repos, list) else []:
        key = str(r.get("id") or r.get("full_name") or "") if isinstance(r, dict) else ""
        pushed = iso_epoch(r.get("pushed_at") or r.get("updated_at")) if key else None
        # the boundary second may still grow, so its ids are remembered
        if not key or (pushed is not None and (pushed < mark or (pushed == mark and key in seen))):
            continue
        taken.append((key, pushed, _kept({"link": r.get("html_url"), "title": r.get("full_name"), "summary": r.get("description"), "repo": r.get("full_name"), "stars": r.get("stargazers_count"), "published_timestamp": pushed})))
    top = max([mark, *(p for _, p, _ in taken if p is not None)])
    edge = {k for k, p, _ in taken if p == top} | (seen if top == mark else set())
    return [(k, json.dumps(p, ensure_ascii=False)) for k, _, p in taken], {**cursor, "last_pushed_epoch": top, "seen_at_watermark": sorted(edge)}, False


ADAPTERS = {"rss": _rss, "arxiv": _arxiv, "hn_search": _hn, "github_releases": _releases, "github_topic": _topic}


#: Where each type asks; the others ask the URL that is configured.
APIS = {"arxiv": ARXIV_API, "hn_search": HN_API, "github_releases": GITHUB_API, "github_topic": GITHUB_API}


def requested_host(config: dict) -> str:
    """The host that a source's requests go to, in lower case."""
    return urlsplit(APIS.get(config["type"]) or config["url"]).hostname or ""


def fetch(config: dict, cursor: dict, client):
    return ADAPTERS[config["type"]](config, cursor, client)


def error_text(error: Exception, production: bool) -> str:
    """What a log may say: in production only the class and a digest of the message,
    because messages name private hosts."""
    text = f"{type(error).__name__}: {error}"
    return f"{type(error).__name__}: msg#{hashlib.sha256(text.encode()).hexdigest()[:8]}" if production else text
