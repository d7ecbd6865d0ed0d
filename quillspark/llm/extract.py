"""HTML extraction by consensus host paths.

Each page's containers are scored by the text of their own blocks; Spark sums the
scores of generalised tag-class paths per host; the winning path of the host is
where every page of the host is read again. A page without that container, or
with far more text elsewhere, keeps its own best one. Either is widened to the
article around it.
"""

import hashlib
import html as entities
import re
from itertools import compress

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import BROADCAST_BYTES, table, text_or_empty
from .urlfilter import url_parts

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:svg|math)(?=[\s/])(?:[^>\"'/]|/(?!>)|\"[^\"]*\"|'[^']*')*+/>"
    r"|<(?P<raw>script|style|noscript|template|iframe|textarea|title|svg|math|object|canvas)(?=[\s/>])[^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[a-zA-Z/!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: Elements whose text is never read; an unclosed one takes what follows only if it holds code.
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template iframe textarea title svg math object canvas".split()}
CODE = {"script", "style"}
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Elements by kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CONTAINERS = set("body main article section div td".split())
SKIPPED = set("head nav footer aside button select menu dialog audio video fieldset".split())
#: Elements that no main stands in: one that is open around it was left open.
NEVER_AROUND_MAIN = set("head nav header footer aside".split())
#: Elements that end an open one of the same group.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of class, id and role that mark what is not the article.
MARKERS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup paywall share sharing social related recommended recommendations trending popular sidebar widget widgets nav navbar navigation "
    "menu breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar comment comments disqus respond responses replies login search hidden skip "
    "complementary contentinfo dialog".split()
)
#: Beginnings of further such words (``commentlist``, ``cookiebar``).
STEMS = ("comment", "cookie", "sidebar", "advert", "sponsor", "newsletter", "breadcrumb", "footer", "disqus", "navbar", "popup")
#: Words with such a beginning that name the article's own text.
OWN_WORDS = ("commentar", "commented")
#: Words that mark whatever stands beside them.
STRONG = set("ad ads adv advert adverts advertisement sponsored comment comments commentlist disqus sidebar newsletter breadcrumb breadcrumbs navbar paywall gdpr".split())
#: Words that say nothing of what an element holds. Any other word beside
#: a marker makes a name that may be of the article's own (``social-science``).
NEUTRAL = set(
    "area articles bar block bottom box button buttons card cards center container count elements float form group head header holder icons inline inner item items layer left line links list "
    "main message more now outer page panel placeholder popover post posts print region right row section site slot stories story strip tag tools top unit wrap wrapper".split()
)
#: Words of class names that describe a page's layout, not what an element holds.
LAYOUT = set("with has no layout".split())
#: A host's path is not taken where it finds less than this share of the page's own best text.
LEAST_SHARE = 0.4
#: A form is read where less than this share of its text stands outside of it.
FORM_SHARE = 0.1
#: Containers open at once; an element deeper inside belongs to the deepest of them.
DEEPEST = 512
#: Letters from which a path is abridged.
LONG_PATH = 2000


def _named(token: str) -> tuple[bool, bool]:
    """(does a class, id or role name something else than the article, has it a marker
    beside words of its own, such as ``social-science`` or ``notice-of-motion``)."""
    words = {w.lower() for w in _WORD.findall(token)}
    if not words or words & LAYOUT:
        return False, False
    marked = {w for w in words if w in MARKERS or (w.startswith(STEMS) and not w.startswith(OWN_WORDS))}
    if not marked:
        return False, False
    named = bool(words & STRONG) or (words - marked <= NEUTRAL and words != {"responses"})
    return named, not named


def _marks(attrs: str):
    """(is hidden, is named as something else than the article, may be so named, is
    named as a header, first class without digits)."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)} if attrs else {}
    if not found:
        return False, False, False, False, ""
    names = " ".join(found.get(k, "") for k in ("class", "id", "role"))
    style = found.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
    said = [_named(t) for t in names.split()]
    words = {w.lower() for w in _WORD.findall(names)} if "eader" in names or "EADER" in names else set()
    header = "header" in words and not words & LAYOUT and (bool(words & {"site", "page", "top", "main"}) or "header" in names.split())
    first = (found.get("class") or found.get("id") or "").split()
    return hidden, any(n for n, _ in said), any(d for _, d in said), header, re.sub(r"\d+", "", first[0]).strip("-_").lower() if first else ""


def parse(page: str):
    """(blocks, containers) of a page; names of classes are not heeded where they
    would leave nothing of it. Forms are skipped but where they hold all the
    page's text, or all but a trifle."""
    blocks, formed, containers = _parse(page, True)
    outside = _without(blocks, formed)
    if outside:
        return outside, containers
    if not any(not f for f in formed):
        others, their_formed, their_containers = _parse(page, False)
        outside = _without(others, their_formed)
        if outside or not blocks:
            return outside or others, their_containers
    return blocks, containers


def _without(blocks, formed):
    """The blocks outside of forms, none if they are a trifle against those inside."""
    outside = [b for b, f in zip(blocks, formed) if not f]
    size = lambda some: sum(len(t) for t, _, _ in some)
    return outside if len(outside) == len(blocks) or size(outside) >= FORM_SHARE * (size(blocks) - size(outside)) else []


def _parse(page: str, heed: bool):
    """(blocks, is each inside a form, containers) of a page.

    A block is (text, share of it in links, indexes of the open containers); a
    container is its generalised path. What is marked as menu, header, footer,
    sidebar, notice, advert, script, style or comment yields no block. An element
    outside an article whose name is in doubt is left out if it is mostly links.
    """
    blocks, formed, containers = [], [], []
    doubts, doubted, within = [], [], []  # [letters, linked ones] of elements in doubt, those open, those of each block
    stack = []  # (tag, skipped, container or None, path)
    inner, paragraphs = [], []  # places in the stack of open containers and paragraphs
    run, linked = [], 0
    skipping, links, forms, own, heads, bodies = 0, 0, 0, 0, 0, 0

    def close_block():
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                blocks.append((text, linked, [stack[k][2] for k in inner]))
                formed.append(forms > 0)
                within.append(tuple(doubted))
                for d in doubted:
                    doubts[d][0] += len(text)
                    doubts[d][1] += linked
            run.clear()
        linked = 0

    def pop_to(depth):
        nonlocal skipping, links, forms, own, heads
        while len(stack) > depth:
            tag, skipped, container, _, doubt = stack.pop()
            if doubt:
                doubted.pop()
            if container is not None:
                inner.pop()
            if tag == "p":
                paragraphs.pop()
            forms -= tag == "form"
            own -= tag in ("article", "main")
            heads -= tag == "head"
            skipping -= skipped
            links -= tag == "a"

    def outermost(tags):
        return next((k for k, s in enumerate(stack) if s[0] in tags), len(stack))

    def text(part):
        nonlocal linked
        if heads and part and not part.isspace():
            pop_to(outermost({"head"}))  # text ends a head that was left open
        if part and not skipping:
            run.append(part := entities.unescape(part))
            if links:
                linked += len(part)

    at, unclosed = 0, set()
    while m := _TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if raw := m["raw"]:
            raw = raw.lower()
            end = None if raw in unclosed else _RAW_END[raw].search(page, at)
            if end:
                at = end.end()
            elif raw in CODE:
                at = len(page)
            else:
                unclosed.add(raw)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br" or tag == "hr":
            text(" ")
            if tag == "hr":
                close_block()
            continue
        if tag in VOID:
            continue
        if m["end"]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if depth is None or (tag in INLINE and inner and inner[-1] >= depth):
                continue
            if tag not in INLINE:
                close_block()
            pop_to(depth)
            continue
        if tag not in INLINE:
            close_block()
            if paragraphs and (not inner or inner[-1] < paragraphs[-1]):
                pop_to(paragraphs[-1])  # a block ends an open paragraph and what is open inside it
            if tag in CLOSES and stack and stack[-1][0] in CLOSES[tag]:
                pop_to(len(stack) - 1)
        if heads:
            pop_to(outermost({"head"}))  # and so does any element that no head can hold
        if tag == "body":
            bodies += 1
            if bodies == 1:
                pop_to(1 if stack and stack[0][0] == "html" else 0)
        elif tag == "main":
            pop_to(outermost(NEVER_AROUND_MAIN))
        hidden, named, doubt, header, name = _marks(m["attrs"])
        skipped = tag not in ("html", "body", "article", "main") and (tag in SKIPPED or hidden or (heed and named) or ((tag == "header" or (heed and header)) and not own))
        path = f"{stack[-1][3] if stack else ''}/{tag}{'.' + name if name else ''}"
        if len(path) > LONG_PATH:  # a long way is told apart by its digest
            path = "/" + hashlib.md5(path.encode("utf-8", "surrogatepass")).hexdigest() + path[path.rindex("/") :]
        container = None
        if tag in CONTAINERS and len(inner) < DEEPEST:
            container = len(containers)
            containers.append(path)
            inner.append(len(stack))
        if tag == "p":
            paragraphs.append(len(stack))
        doubt = heed and doubt and not skipped and not own and tag not in INLINE
        if doubt:
            doubted.append(len(doubts))
            doubts.append([0, 0])
        stack.append((tag, skipped, container, path, doubt))
        forms += tag == "form"
        own += tag in ("article", "main")
        heads += tag == "head"
        skipping += skipped
        links += tag == "a"
    text(page[at:])
    close_block()
    left = {d for d, (size, links) in enumerate(doubts) if 2 * links > size}
    if left:
        kept = [left.isdisjoint(w) for w in within]
        blocks, formed = list(compress(blocks, kept)), list(compress(formed, kept))
    return blocks, formed, containers


def _score(text: str, linked: int) -> float:
    return max(0, len(text) - 2 * linked)


def candidates(blocks, containers) -> list[tuple[str, float, int]]:
    """(path, score, index): a block counts for its nearest container in full and
    half as much for each further one."""
    score = [0.0] * len(containers)
    for text, linked, open_ in blocks:
        value = _score(text, linked)
        for c in reversed(open_):
            score[c] += value
            value /= 2
    return [(p, s, i) for i, (p, s) in enumerate(zip(containers, score)) if s > 0]


def _widened(blocks, containers, chosen: set[int]) -> list[bool]:
    """For every block: does it belong to the article that a chosen container is in?

    That is the nearest article or main, and the main around an article unless what
    else stands in it (other articles too) is mostly links.
    Without one, containers are left outwards up to the body as long as what
    comes in is not mostly links. Of the body itself come in its own headings
    and paragraphs and, beside a section, other sections.
    """
    chain, chars, linked_chars = {}, {}, {}
    kind_of = [p.rsplit("/", 1)[-1].split(".", 1)[0] for p in containers]
    for text, linked, open_ in blocks:
        for k, c in enumerate(open_):
            chain.setdefault(c, open_[: k + 1] if c in chosen else None)
            chars[c] = chars.get(c, 0) + len(text)
            linked_chars[c] = linked_chars.get(c, 0) + linked

    def adds(inner, outer):
        return 2 * (linked_chars[outer] - linked_chars[inner]) <= chars[outer] - chars[inner]

    whole, bodies = set(), {}
    for c in chosen & chain.keys():
        around = chain[c][::-1]
        kinds = [kind_of[a] for a in around]
        at = next((k for k, kind in enumerate(kinds) if kind in ("article", "main")), None)
        if at is not None:
            c = around[at]
            for outer, kind in zip(around[at + 1 :], kinds[at + 1 :]):
                if kind == "main" and adds(c, outer):
                    c = outer
        else:
            last = c
            for outer, kind in zip(around[1:], kinds[1:]):
                if kind == "body":
                    bodies[outer] = bodies.get(outer, False) or kind_of[last] == "section"
                    break
                if not adds(last, outer):
                    break
                last = outer
            c = last
        whole.add(c)

    def belongs(text, linked, open_):
        if whole.intersection(open_):
            return True
        if not open_ or 2 * linked > len(text):
            return False
        # the body's own text, and sections that stand in it
        return open_[-1] in bodies or any(bodies.get(o) and kind_of[i] == "section" for o, i in zip(open_, open_[1:]))

    return [belongs(*b) for b in blocks]


def article(blocks, containers, path: str | None) -> str:
    """The text of the article around the containers at ``path``, else around the
    page's best one."""
    found = candidates(blocks, containers)
    if not found:
        return "\n".join(t for t, _, _ in blocks)
    own = max(found, key=lambda c: (c[1], -c[2]))[2]
    pick = lambda chosen: [t for (t, _, _), keep in zip(blocks, _widened(blocks, containers, chosen)) if keep]
    best = pick({own})
    if path is not None:
        agreed = pick({i for i, p in enumerate(containers) if p == path})
        if sum(map(len, agreed)) >= LEAST_SHARE * sum(map(len, best)):
            return "\n".join(agreed)
    return "\n".join(best)


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Adds ``text`` and ``n_chars`` to ``pages``; columns of these names are
    replaced, all others are kept, whatever their names.

    Blocks stand in page order, joined by one line feed; white space inside a
    block is one space; character references are decoded. Null or empty html
    gives the empty text. Pages without a host are read by their own best
    container. Of paths with equal votes the smaller text wins. Every host is
    decided by sums of votes; no host's pages are gathered. Repeated rows vote and
    are read each for itself; an empty table gives no rows. Pages are read whole;
    beyond DEEPEST containers inside each other a block belongs to the last of them.
    """
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("text", "n_chars")]
    host, _ = url_parts(F.col(url))
    keyed = pages.select(F.struct(*kept).alias("row"), host.alias("host"), text_or_empty(F.col(html)).alias("html"))

    def vote(batches):
        for batch in batches:
            sums = {}
            for h, page in zip(batch["host"], batch["html"]):
                for path, score in {p: s for p, s, _ in sorted(candidates(*parse(page)), key=lambda c: c[1])}.items():
                    sums[h, path] = sums.get((h, path), 0.0) + score
            yield pd.DataFrame([(*k, v) for k, v in sums.items()], columns=["host", "path", "score"])

    votes = keyed.filter("host <> ''").select("host", "html").mapInPandas(vote, "host string, path string, score double")
    winners = votes.groupBy("host", "path").agg(F.round(F.sum("score")).alias("score")).groupBy("host").agg(
        F.min(F.struct((-F.col("score")).alias("s"), F.length("path").alias("n"), "path"))["path"].alias("path"))

    @F.pandas_udf("string")
    def read(page: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([article(*parse(p), None if w is None or w != w else w) for p, w in zip(page, path)], dtype=object)

    winners = materialize(winners, "host-paths")
    size = winners.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 32), F.lit(0))).first()[0]
    placed = keyed.join(F.broadcast(winners) if size <= BROADCAST_BYTES else winners, "host", "left")
    return placed.select("row.*", read("html", "path").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op6_extract(spark, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``; see :func:`extract` for nulls,
    empty and repeated rows."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
