"""The other operators against brute force, round trips and held-out accuracy."""

import base64
import gzip
import hashlib
import os
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, extract, lcp, licenses, mixing, quality, sharding, urlfilter, warc
from quillspark.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(show(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(show(r[i]) for i in at) for r in rel.fetchall())


# ---------------------------------------------------------------- fingerprints


def words(rnd, n, size=4):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(1, size + 3))) for _ in range(n))


def test_equal_substrings_parse_alike():
    rnd = random.Random(1)
    shared = words(rnd, 400).encode()
    for head in (b"", b"x", b"some other beginning "):
        phrases = []
        for text in (shared, head + shared):
            names, owner = np.frombuffer(text, dtype=np.uint8).astype(np.uint64), np.zeros(len(text), dtype=np.int64)
            for _ in range(3):
                names, owner = lcp.parse_level(names, owner)
            phrases.append(set(names.tolist()))
        assert len(phrases[0] & phrases[1]) >= 0.9 * len(phrases[0])


def test_neighbours(spark):
    rnd = random.Random(2)
    rows = [(i * 3, words(rnd, rnd.choice([1, 5, 40, 300]))) for i in range(60)] + [(7, None), (8, ""), (9, "é😀" * 40), (10, "a" * 3000), (None, "no id"), (11, "same"), (11, "same")]
    got = lcp.compare_neighbours(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), range_rows=9).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = sorted((str(i), len(t), hashlib.sha256(lcp.edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r["near_next"] <= 1 and abs(r["near_edited"] - lcp.likeness(r["fingerprint"], r["edited_fingerprint"])) < 1e-9 for r in got)
    long = [r for r in got if r["n_chars"] > 800 and r["doc_id"] not in (9, 10)]
    assert np.mean([r["near_edited"] for r in long]) > 0.3 > 10 * np.mean([r["near_next"] for r in long]) / 2
    assert lcp.compare_neighbours(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = lcp.compare_neighbours(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    fp = {r["text"]: r["fingerprint"] for r in lcp.fingerprint(spark.createDataFrame([("a",), ("a",), (None,), ("",)], "text string")).collect()}
    assert fp[None] == fp[""] != fp["a"]


# ---------------------------------------------------------------- decontamination


def test_leaks(spark):
    rnd = random.Random(3)
    items = [(i, words(rnd, rnd.randrange(20, 50))) for i in range(30)] + [(90, None), (91, ""), (92, "a b")]
    docs, want = [], set()
    for d in range(120):
        text = words(rnd, rnd.randrange(0, 300)).split()
        if d % 4 == 0:
            i = rnd.randrange(30)
            leak = items[i][1].split()
            if d % 8 == 0:
                leak[rnd.randrange(len(leak))] = "changed"
            at = rnd.randrange(len(text) + 1)
            text[at:at] = [w.upper() + "," for w in leak]
            want.add((d, i))
        docs.append((d, " ".join(text)))
    docs += [(500, None), (501, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench).collect()} == want
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench, shard_items=7).collect()} == want
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0


def test_leaks_of_short_items_and_of_scripts_without_spaces(spark):
    chinese, thai = "水在标准大气压下的沸点是多少？一百摄氏度。", "เมืองหลวงของประเทศไทยคือกรุงเทพมหานคร"
    items = [(1, chinese), (2, thai), (3, "2+2? 4"), (4, "Quagga"), (5, "？！"), (6, "第二次世界大战于哪一年结束？一九四五年。"), (7, "quagga")]
    docs = [(1, "前文「" + chinese + "」后文"), (2, "ดู" + thai + "ครับ"), (3, "so 2 + 2 = 4, he said"), (4, "a QUAGGA, seen"), (5, "2 and 2 is 4; quaggas"), (6, "？！"), (7, "今天天气很好，我们去公园散步。" * 9)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(1, 1), (2, 2), (3, 3), (4, 4), (4, 7)}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench, short_items=True).collect()} == want
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench, shard_items=2, short_items=True).collect()} == want


def test_leaks_depend_on_no_other_item(spark):
    """A long item makes no scattered words a leak, and shards score as one index."""
    rnd = random.Random(8)
    fill = lambda n: " ".join(f"f{rnd.randrange(10**6)}" for _ in range(n))
    long = " ".join(f"z{i}" for i in range(2000))
    items = [(1, "which river crosses the old town? Danube"), (2, long)] + [(3 + i, words(rnd, 20 + i)) for i in range(20)]
    scattered = f"which river crosses {fill(500)} crosses the old town {fill(500)} Danube {fill(900)}"
    docs = [(1, scattered), (2, fill(300) + " " + items[0][1] + " " + fill(300)), (3, fill(70) + " " + long + " " + fill(70)), (4, fill(99) + " " + items[9][1])]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(2, 1), (3, 2), (4, items[9][0])}
    show = lambda rows: sorted((*r[:2], *(round(x, 9) for x in r[2:])) for r in rows)
    assert show(decontaminate.find_leaks(df, bench, shard_items=4).collect()) == show(got)
    assert show(decontaminate.find_leaks(df, bench, shard_items=4, scan_shards=2).collect()) == show(got)


def test_shards_are_searched_in_one_scan_of_the_documents(spark):
    rnd = random.Random(21)
    bench = spark.createDataFrame([(i, words(rnd, 20)) for i in range(60)] + [(70, "quagga")], "item_id long, text string")
    df = spark.createDataFrame([(r["item_id"], f"{words(rnd, 40)} {r['text']} {words(rnd, 40)}") for r in bench.collect()], "doc_id long, text string")
    scanned = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            scanned.add(len(batch))
            yield batch

    got = decontaminate.find_leaks(df.mapInPandas(count, df.schema), bench, shard_items=5, short_items=True)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(i, i) for i in [*range(60), 70]}
    assert scanned.value == 61


def test_bounds_lose_nothing():
    """Pruned retrieval finds what scoring every passage against every item finds."""
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(25))) for i in range(40)]
    index = decontaminate.Index(items)
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(300)).encode() for _ in range(20)] + [items[3][1].encode()]
    got = index.search(texts)
    for t, text in enumerate(texts):
        w, _ = decontaminate.hashed_words([text], decontaminate.MARKS)
        for i in range(len(items)):
            best = None
            for lo in range(0, len(w), index.stride):
                passage = w[lo : lo + 2 * index.stride]
                score = index.weights[i][np.isin(index.terms[i], passage)].sum()
                grams = decontaminate._grams_all(passage, decontaminate.NGRAM)
                shares = [np.isin(p, grams).mean() for p in index.parts[i]]
                if score >= index.threshold[i] * (1 - 1e-9) and min(shares) >= decontaminate.OVERLAP:
                    best = max(best or (0,), (score, *shares, lo))
            assert ((t, i) in got) == (best is not None)
            if best:
                assert got[t, i] == pytest.approx(best)


@pytest.mark.parametrize("text,answer", [("What is it? Forty two", "Forty two"), ("Q one two\nAnswer: three", "three"), ("a b c d e f", "e f")])
def test_split(text, answer):
    assert decontaminate.split_item(text)[1].strip() == answer


# ---------------------------------------------------------------- mixing, shards


def test_mix(spark):
    rnd = random.Random(5)
    rows = [(i, words(rnd, rnd.choice([0, 3, 50, 90])), rnd.choice(["a"] * 6 + ["b", "c", "é", None])) for i in range(800)]
    rows += [(9000, None, "a"), (9001, "x y", "empty"), (rows[3])]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df, cell_rows=20).collect()
    assert len(got) == len(rows) and got and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df, cell_rows=20).collect()), key=str)
    assert all(0 <= r["copies"] <= 3 for r in got)
    for s in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["copies"] * r["size"] for r in mine) - mine[0]["target"]) <= 2 * max(r["size"] for r in mine)
    sizes = {s: next(r["source_size"] for r in got if r["source"] == s) for s in {r["source"] for r in got}}
    order = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, left, free = {}, float(sum(sizes.values())), set(order)
    while True:  # the sharing rule, round by round
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]])
    assert mixing.mix(df.limit(0)).count() == 0
    taken = mixing.mixed_documents(df, cell_rows=20)
    assert taken.columns == df.columns and taken.count() == sum(r["copies"] for r in got)


def test_shards(spark):
    rnd = random.Random(6)
    rows = [(i, "é" * rnd.randrange(200), "s") for i in range(500)] + [(9000, None, "s"), (9001, "x" * 3000, "s"), (None, "n", "s"), (7, "again", "s"), (7, "again", "s")]
    df = spark.createDataFrame(rows, DOCS).withColumn("depth", F.lit("clash"))
    got = sharding.shard(df, limit=2000).collect()
    assert len(got) == len(rows)
    held = {}
    for r in got:
        assert len(r["shard"]) == r["depth"]
        held[r["shard"]] = held.get(r["shard"], 0) + r["bytes"]
    assert all(held[r["shard"]] == r["shard_bytes"] for r in got)
    assert [s for s, b in held.items() if b > 2000] == [next(r["shard"] for r in got if r["doc_id"] == 9001)]
    names = sorted(held)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))  # no shard lies inside another
    for s in names:  # every split was needed
        if s and len(s) < sharding.BITS:
            assert sum(b for n, b in held.items() if n.startswith(s[:-1])) > 2000
    assert sharding.shard(df.limit(0)).count() == 0
    assert {r["shard"] for r in sharding.shard(df, limit=1 << 30).collect()} == {""}


def test_rows_without_ids_keep_the_limit(spark):
    rows = [(None, f"{i:05d} " + "x" * 5000, "s") for i in range(2000)]
    got = sharding.shard(spark.createDataFrame(rows, DOCS).repartition(4), limit=1 << 20).groupBy("shard").agg(F.sum("bytes").alias("b"), F.max("shard_bytes").alias("s")).collect()
    assert sum(r["b"] for r in got) == sum(len(t) for _, t, _ in rows) and all(r["b"] == r["s"] <= 1 << 20 for r in got) and len(got) >= 10


# ---------------------------------------------------------------- pages


PAGE = ('<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><a href=x>menu</a></nav><div class="wrap{n}"><div class="sidebar"><p>side</p></div>'
        '<div class="post-{n} content"><h2>Title &eacute;</h2><p>One <a href=x>two</a>\n three &lt;b&gt;<p>Four&nbsp;five<ul><li>a<li>b</ul><div class="ad-slot">AD</div><form>f</form>'
        '<section class=comments><p>c1</p></section>tail < text</div></div><div class="cookie-notice">ok</div><footer>foot</footer><script>var a="<p>no</p>"</script>')
TEXT = "Title é\nOne two three <b>\nFour five\na\nb\ntail < text"


def test_extract(spark):
    rows = [(i, f"http://h{i % 2}.com/{i}", PAGE.replace("{n}", str(i))) for i in range(6)]
    rows += [(10, None, None), (11, "http://h0.com/", ""), (12, "nonsense", "<p>only"), (13, "http://h0.com/x", "plain text"), rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = extract.extract(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    text = {r["page_id"]: r["text"] for r in got}
    assert all(text[i] == TEXT for i in range(6))
    assert [text[i] for i in (10, 11, 12, 13)] == ["", "", "only", "plain text"]
    assert extract.extract(df.limit(0)).count() == 0


def test_host_consensus_beats_the_page(spark):
    """A teaser box that is longer than one short article does not win on its host."""
    long = "<body><article><p>" + "words " * 60 + "</p></article><div class='box'><p>" + "teaser " * 5 + "</p></div>"
    short = "<body><article><p>brief story here, in full</p></article><div class='box'><p>" + "teaser " * 6 + "</p></div>"
    rows = [(i, "http://h.com/", long) for i in range(5)] + [(9, "http://h.com/", short)]
    got = {r["page_id"]: r["text"] for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "brief story here, in full"


BODY = "<article><p>before the mark</p>{}<p>after the mark</p></article>"


@pytest.mark.parametrize("mark", ["<svg class='i'/>", "<math/>", "<svg-icon name=x></svg-icon>", "<object-card></object-card>", "<title-bar></title-bar>", "<object data=x>", "<svg a='1>0' />", "<canvas>", "<iframe src=/a/></iframe>", "<SVG><text>no</text></svg>"])
def test_text_after_raw_elements_stays(mark):
    assert extract.article(*extract.parse(BODY.format(mark)), None) == "before the mark\nafter the mark"


def test_unclosed_code_is_not_read():
    assert extract.article(*extract.parse(BODY.format("<script>var a = 1;")), None) == "before the mark"


def test_article_around_its_longest_part(spark):
    lead, story, tail = "lead " * 60, "story " * 500, "tail " * 40
    parts = [f"<h1>Title</h1><p>{lead}</p>", f"<div class='story'><p>{story}</p></div>", f"<p>{tail}</p>"]
    want = "\n".join(["Title", lead.strip(), story.strip(), tail.strip()])
    menu = "<div class=x><a href=/>" + "link " * 90 + "</a></div>"
    pages = [f"<body>{menu}<article>{''.join(parts)}</article></body>",
             f"<body>{menu}<main>{parts[0]}<article>{parts[1]}{parts[2]}</article></main></body>",
             f"<body><div class=page>{menu}<div class=content>{''.join(parts)}</div></div></body>",
             f"<body>{menu}{''.join(parts)}</body>",
             f"<body>{menu}<section class=a>{parts[0]}</section><section class=b>{story}</section><section class=c>{tail}</section></body>"]
    for page in pages:
        assert extract.article(*extract.parse(page), None) == want
    rows = [(k, f"http://h{k}.com/{n}", page) for k, page in enumerate(pages) for n in range(3)]
    got = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {want}


def test_pages_that_leave_elements_open():
    read = lambda page: extract.article(*extract.parse(page), None)
    assert read("<html><head><title>t</title><meta a=b><body><article><p>a story</p></article>") == "a story"
    assert read("<html><head><title>t</title><p>a story") == "a story"
    assert read("<head><title>t</title>\n a story") == "a story"
    assert read("<body><nav><a href=x>menu</a><main><p>a story</p></main>") == "a story"
    assert read("<div>" * 2000 + "<nav>menu</nav>a story") == "a story"
    assert read("<body><nav><p>menu</p></nav><p>a story</p>") == "a story"


def test_markers_are_whole_names_inside_an_article():
    own = ["social-science", "search-results", "alert-word", "responses", "commentary", "has-sidebar", "popular-culture"]
    other = ["main-comment layout", "share-buttons", "related-posts", "comment-body", "ad", "newsletter-box", "cookie-notice"]
    page = "<body><article><p>lead</p>" + "".join(f"<div class='{c}'>{c.split()[0]} text</div>" for c in own + other) + "</article>"
    assert extract.article(*extract.parse(page), None).split("\n") == ["lead"] + [f"{c} text" for c in own]
    page = "<body><div class=content><p>a story</p></div><div class='main-comment layout'>a longer comment than the story</div>"
    assert extract.article(*extract.parse(page), None) == "a story"


@pytest.mark.parametrize("name", ["notice-of-motion", "popular-science", "search-engines", "hidden-gems"])
def test_names_of_the_articles_own_outside_an_article(name):
    text = "Long text of its own. " * 20
    page = f"<body><nav><a href=x>menu</a></nav><div class=content><p>Lead of the page.</p><div class='{name}'><p>{text}</p></div></div><div class='comments'><p>a comment</p></div><div class='cookie-notice'>cookies</div></body>"
    assert extract.article(*extract.parse(page), None) == f"Lead of the page.\n{text.strip()}"
    links = f"<body><div class=content><p>{text}</p><div class='{name}'><a href=1>one</a> <a href=2>two</a></div></div></body>"
    assert extract.article(*extract.parse(links), None) == text.strip()


def test_all_articles_of_a_main():
    one, two = "First part of it. " * 12, "Second part of it. " * 12
    page = f"<body><main><article class=lead><p>{one}</p></article><article class=more><p>{two}</p></article></main></body>"
    for path in (None, "/body/main/article.lead", "/body/main/article.more"):
        assert extract.article(*extract.parse(page), path) == f"{one.strip()}\n{two.strip()}"
    teasers = f"<body><main><article class=lead><p>{one}</p></article><article class=card><a href=1>Another story of the day</a></article></main></body>"
    assert extract.article(*extract.parse(teasers), None) == one.strip()


def test_extract_against_plain_votes(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    df = spark.read.parquet(f"{SF}/pages.parquet").withColumns({"host": F.lit("h"), "path": F.lit("p"), "row": F.lit(1), "_host": F.lit("x")})
    rows = df.collect()
    host = lambda u: re.match(r"(?:.*?://([^/?#]*))?", u or "", re.S)[1] or ""
    votes = {}
    for r in rows:
        for path, score in {p: s for p, s, _ in sorted(extract.candidates(*extract.parse(r["html"] or "")), key=lambda c: c[1])}.items():
            mine = votes.setdefault(host(r["url"]).lower(), {})
            mine[path] = mine.get(path, 0) + score
    won = {h: min(v, key=lambda p: (-round(v[p]), len(p), p)) for h, v in votes.items() if h and v}
    want = {r["page_id"]: extract.article(*extract.parse(r["html"] or ""), won.get(host(r["url"]).lower())) for r in rows}
    got = extract.extract(df).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and len(got) == len(rows) and {(r["host"], r["path"], r["row"], r["_host"]) for r in got} == {("h", "p", 1, "x")}


def test_form_around_the_page():
    inner = "<div class=nav>menu</div><div class=main-text><h1>Title</h1><p>" + "words " * 20 + "</p></div>"
    want = "Title\n" + ("words " * 20).strip()
    for page in ("<body><form id=aspnetForm>" + inner + "</form></body>", "<body><p>(c)</p><form>" + inner + "</form></body>"):
        assert extract.article(*extract.parse(page), None).endswith(want) and "menu" not in extract.article(*extract.parse(page), None)
    assert extract.article(*extract.parse("<body class=x><div class=popup>all is in here</div><form>Go</form>"), None) == "all is in here"
    assert extract.article(*extract.parse("<body><p>" + "story " * 9 + "</p><form>your mail</form>"), None) == ("story " * 9).strip()


@pytest.mark.parametrize("page", ["<p a='x", "<!-- open", "<script>x", "&am", "<<>>", "</p></div>", "<b>x</p>y", "<p " + "x='" * 2000, "<div>a" * 5000, "<b>" * 5000])
def test_broken_markup(page):
    extract.article(*extract.parse(page), None)


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/", "<p>é</p>\r\n\r\nWARC/1.1 fake"), (2, "http://b/ c\nd", "same"), (5, None, "same"), (3, "u", "same"), (7, "u", None), (8, "u", ""), (None, "u", "lone"), (9, "u", "tiny"), (10, "u", "tiny"), (9, "u", "tiny")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_archive(df, f"{tmp_path}/crawl")
    read = warc.read_archive(spark, f"{tmp_path}/crawl").collect()
    assert sorted((str(r["page_id"]), r["payload"].decode()) for r in read) == sorted((str(p), h or "") for p, _, h in rows)
    warc.deduplicate_archive(spark, f"{tmp_path}/crawl", f"{tmp_path}/fresh")
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.resolve_revisits(spark, f"{tmp_path}/fresh").collect())
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    one = lambda p, s, to=None: (str(p), len(s.encode()), digest(s), "revisit" if to else "response", to)
    assert got == sorted([one(1, rows[0][2]), one(2, "same", 5), one(5, "same"), one(3, "same", 5), one(7, "", 8), one(8, ""), one(None, "lone"), one(9, "tiny", 10), one(9, "tiny", 10), one(10, "tiny")])
    warc.deduplicate_archive(spark, f"{tmp_path}/crawl", f"{tmp_path}/large", min_bytes=5)
    assert {r["record_type"] for r in warc.resolve_revisits(spark, f"{tmp_path}/large").collect()} == {"response"}
    warc.write_archive(df.limit(0), f"{tmp_path}/none")
    assert warc.read_archive(spark, f"{tmp_path}/none").count() == 0


def test_archives_of_others(spark, tmp_path):
    """Records of every kind and fault, packed and plain, one gzip member each or one for all."""
    record = lambda kind, block, **more: b"\r\n".join([b"WARC/1.0", b"WARC-Type: " + kind, *(k.replace("_", "-").encode() + b": " + v for k, v in more.items()), b"", block, b"", b""])
    size = lambda block: str(len(block)).encode()
    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\ncaf\xe9 \xff"
    dns = b"20260101\nexample.com. 300 IN A 1.2.3.4"
    records = [
        record(b"warcinfo", b"software: x", content_length=b"11"), record(b"response", page, warc_record_id=b"<urn:uuid:1>", warc_target_uri=b"http://e.com/\xe9", content_length=size(page), x_page_id=b"7", content_type=b"application/http"),
        record(b"response", dns, warc_record_id=b"<urn:uuid:2>", content_type=b"text/dns", content_length=size(dns)), record(b"response", b"HTTP/1.1 200 OK no blank line", content_length=b"29", x_page_id=b"seven"),
        record(b"response", b"lost", warc_record_id=b"<urn:uuid:4>"), record(b"response", b"lost", content_length=b"many"), record(b"odd", b"", content_length=b"0"),
        record(b"response", page, warc_record_id=b"<urn:uuid:5>", content_length=size(page), x_page_id=b"3"), record(b"response", b"short", content_length=b"900"),
    ]
    whole, members = gzip.compress(b"".join(records)), b"".join(gzip.compress(r) for r in records)
    for name, data in (("plain.warc", b"".join(records)), ("whole.warc.gz", whole), ("members.warc.gz", members)):
        source = tmp_path / name.split(".")[0]
        source.mkdir()
        (source / name).write_bytes(data)
        read = {(r["page_id"], bytes(r["payload"]), bytes(r["http_head"])) for r in warc.read_archive(spark, f"file://{source}").collect()}
        http, body = page.split(b"\r\n\r\n")
        assert read == {(7, body, http + b"\r\n\r\n"), (3, body, http + b"\r\n\r\n"), (None, dns, b""), (None, b"HTTP/1.1 200 OK no blank line", b"")}
        assert sorted(r["reason"] for r in warc.unreadable_records(spark, f"file://{source}").collect()) == ["cut off by the end of the file", "no readable Content-Length", "no readable Content-Length", "type 'odd'"]
        warc.deduplicate_archive(spark, f"file://{source}", f"file://{tmp_path}/{name}-out")
        got = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.resolve_revisits(spark, f"file://{tmp_path}/{name}-out").collect())
        assert got == [("3", len(body), "revisit", 7), ("7", len(body), "response", None), ("None", 29, "response", None), ("None", len(dns), "response", None)]
        assert body in {bytes(r["payload"]) for r in warc.read_archive(spark, f"file://{tmp_path}/{name}-out").collect() if r["payload"] is not None}
        assert warc.unreadable_records(spark, f"file://{tmp_path}/{name}-out").isEmpty()
    (tmp_path / "members" / "members.warc.gz").write_bytes(members[:-9])
    assert warc.read_archive(spark, f"file://{tmp_path}/members").count() == 4
    assert [r["reason"] for r in warc.unreadable_records(spark, f"file://{tmp_path}/members").collect()][-1].startswith(("broken gzip", "cut off"))


def test_url_rules(spark):
    urls = {"http://A.Example.NET/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"), "https://x.net/y?z": ("x.net", "/y", "net/", "block"), "https://x.net": ("x.net", "", None, "allow"),
            "http://example.com/de/#x": ("example.com", "/de/", "example.com/de/", "block"), "ftp://w.org/fr/a/b": ("w.org", "/fr/a/b", "org/fr/", "allow"), "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
            None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), "x://": ("", "", None, "allow"), "http://net/": ("net", "/", "net/", "block"), "http://a.net/" + "d/" * 5000: ("a.net", "/" + "d/" * 5000, "net/", "block")}
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: tuple(r)[1:] for r in urlfilter.filter_urls(df, urlfilter.rule_table(spark, urlfilter.CONTRACT_RULES), "url", "page_id").collect()}
    assert got == dict(enumerate(urls.values()))
    more = [("block", "e.com/a"), ("allow", "e.com"), ("allow", "s.e.com/ab"), ("block", "s.e.com/ab")]
    one = spark.createDataFrame([(1, "http://e.com/abc"), (2, "http://e.com/x"), (3, "http://s.e.com/abc")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.filter_urls(one, urlfilter.rule_table(spark, more), "url", "page_id").collect()}
    assert got == {1: ("e.com/a", "block"), 2: ("e.com", "allow"), 3: ("s.e.com/ab", "block")}
    assert urlfilter.filter_urls(one, urlfilter.rule_table(spark, more).limit(0), "url", "page_id").count() == 3


# ---------------------------------------------------------------- texts


def test_quality(spark):
    rnd = random.Random(7)
    good = [(i, words(rnd, 80).capitalize() + ".") for i in range(400)]
    bad = [(1000 + i, " | ".join(words(rnd, 80).upper().split()) + "!!") for i in range(80)]
    docs = spark.createDataFrame(good + bad + [(5000, None), (5001, ""), good[0]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:200]] + [(i, 0) for i, _ in bad[:40]], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    rows = quality.score_quality(docs.withColumn("score", F.lit("clash")), model).withColumn("held", quality.held_out("doc_id")).collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held"] and r["doc_id"] < 2000]
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] < 1000) for r in held]) > 0.97
    assert len({r["score"] for r in rows if not r["text"]}) == 1
    assert quality.fit(docs, labels.limit(0)) is None and quality.fit(docs.limit(0), labels) is None
    assert {r["score"] for r in quality.score_quality(docs, None).collect()} == {0.5}


def test_risk_against_a_plain_loop():
    """Value by the definition, row by row; gradient by differences."""
    rng = np.random.default_rng(1)
    for shift in (0.0, 3.0):  # with and without a negative estimate
        xp, xu = rng.normal(2, 1, (30, quality.N_FEATURES)), rng.normal(shift, 1, (50, quality.N_FEATURES))
        d, k = quality.N_FEATURES, quality.HIDDEN
        m = {"mean": np.zeros(d), "scale": np.ones(d), "w1": rng.normal(0, 0.3, (d, k)), "b1": rng.normal(size=k), "w2": rng.normal(size=k), "b2": 0.3}
        if shift:
            m["w2"] = m["w2"] - 0.5

        def terms(model, prior=0.7):
            def loss(x, sign):
                out = 0.0
                for row in x:
                    g = sum(np.tanh(sum(row[i] * model["w1"][i, j] for i in range(d)) + model["b1"][j]) * model["w2"][j] for j in range(k)) + model["b2"]
                    out += np.log1p(np.exp(-sign * g)) if sign * g > -30 else -sign * g
                return out / len(x)
            return prior * loss(xp, 1), loss(xu, -1) - prior * loss(xp, -1)

        got, grads = quality.risk(m, quality._positive_parts(m, xp), (*quality._parts(m, xu, -1.0), len(xu)), 0.7)
        good, bad = terms(m)
        assert got == pytest.approx(good + max(0.0, bad))
        aim = (lambda model: sum(terms(model))) if bad >= 0 else (lambda model: -terms(model)[1])
        for name, at in (("w1", (3, 2)), ("b1", (5,)), ("w2", (7,)), ("b2", ())):
            up, down = ({**m, name: np.array(m[name], dtype=float)} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            assert np.asarray(grads[name])[at] == pytest.approx((aim(up) - aim(down)) / 2e-5, abs=1e-5)


@pytest.mark.parametrize("share", [0.2, 0.5, 0.9])
def test_prior_is_estimated_from_texts_alone(share):
    rng = np.random.default_rng(2)
    good, bad = (lambda n: rng.normal(0, 1, (n, 5))), (lambda n: rng.normal(2.5, 1, (n, 5)))
    mixed = np.vstack([good(int(6000 * share)), bad(6000 - int(6000 * share))])
    rng.shuffle(mixed)
    assert abs(quality.estimate_prior(good(2000), mixed, mixed.mean(0), mixed.std(0)) - share) < 0.06


LICENSES = {
    "CC BY cc by-SA 4.0! CC-by": (9, 3, 0, 7, "cc-by"), "é ALL rights\nreserved. all   rights reserved GENERAL Public license": (10, 3, 1, 7, "gpl,reserved"),
    "\u212acc by cc, by cc  by": (6, 2, 2, 4, "cc-by"), "": (0, 0, None, None, ""), None: (0, 0, None, None, ""), "general public licenses": (3, 0, None, None, ""), "plain words": (2, 0, None, None, ""),
}


def test_licenses(spark):
    df = spark.createDataFrame([(t,) for t in LICENSES] + [("all rights reserved " * 300,)], "text string").withColumn("labels", F.lit("clash"))
    got = {r["text"]: r for r in licenses.scan_licenses(df).collect()}
    for t, want in LICENSES.items():
        r = got[t]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want, t
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got["all rights reserved " * 300]["n_base"] == 300


def test_license_rules_and_suppression(spark):
    table = licenses.rules()
    assert len(table) >= 200
    for r in table:
        re.compile(r["pattern"])
    text = "Licensed under CC BY-NC 4.0, the Apache License, Version 2.0 and the GNU Lesser General Public License v2.1"
    labels = licenses.scan_licenses(spark.createDataFrame([(text,)], "text string")).first()["labels"].split(",")
    assert {"cc-by-nc-4.0", "apache-2.0", "lgpl-2.1", "cc-by", "gpl"} <= set(labels)
    assert not {"cc-by-nc", "lgpl", "apache", "copyright"} & set(labels)


def plain_scan(text):
    """Detections by one pattern after the other and every pair compared."""
    w = re.sub("[A-Z]", lambda m: m[0].lower(), " " + " ".join(re.findall("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", text or "")) + " ")
    hits = []
    for r in licenses.rules():
        for m in re.finditer(f"(?<= )(?:{r['pattern']})(?= )", w):
            start = w[: m.start()].count(" ") - 1
            hits.append((start, start + m[0].count(" ") + 1, r["priority"], r["base"], r["label"]))

    def beats(e, d):
        inside, longer = e[0] <= d[0] and e[1] >= d[1], e[1] - e[0] - d[1] + d[0]
        return inside and (e[2] > d[2] or (e[2] == d[2] and (longer > 0 or (longer == 0 and e[4] < d[4]))))

    base = [d for d in hits if d[3]]
    kept = {d for d in hits if d[3] or not any(beats(e, d) for e in hits)}
    return (len(w.split()), len(base), min((d[0] for d in base), default=None), max((d[0] for d in base), default=None), ",".join(sorted({d[4] for d in base})), ",".join(sorted({d[4] for d in kept})),
            max((licenses.CERTAINTY[d[2]] for d in kept), default=0.0)), kept


def test_licenses_against_plain_loops(spark):
    rnd = random.Random(9)
    pieces = ["cc by", "CC-BY-SA 4.0", "all rights reserved", "GNU General Public License", "version 2.0", "the Apache License, Version 2.0", "licensed under", "copyright 2020", "MIT license", "BSD", "3-clause BSD",
              "creative commons attribution share-alike 3.0 unported", "lgpl v2.1 or later", "public domain", "terms of use", "word", "é", "mozilla public license", "for personal use only"]
    texts = [" ".join(rnd.choice(pieces) for _ in range(rnd.randrange(40))) for _ in range(150)] + ["cc by " * 900, None, ""]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, row int, words int")
    for r in licenses.scan_licenses(df).collect():
        want, kept = plain_scan(r["text"])
        assert tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")) == want and (r["row"], r["words"]) == (1, 2)
        assert {(d["start"], d["end"], d["priority"], d["base"], d["label"]) for d in r["detections"]} == kept


def test_license_scan_of_dense_text_is_not_quadratic(spark):
    began, took = 0, []
    for n in (5_000, 50_000):
        df = spark.createDataFrame([("copyright x " * n,)], "text string")
        began = time.time()
        assert licenses.scan_licenses(df).select(F.size("detections").alias("n")).first()["n"] == n
        took.append(time.time() - began)
    assert took[1] < 20 * max(1.0, took[0])
