"""Store, deduplication, health and classification against plain definitions."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.functions.similarity import indel, indels
from quillspark.operators import dedupe, relational, store
from quillspark.operators.classify import KeywordProvider, ProviderError, classify_items, classifier_version, token_estimate
from quillspark.operators.components import components
from quillspark.operators.store import Store, resolve_roots
from quillspark.session import materialize, shared_dir

T0 = datetime(2026, 5, 27, 12, tzinfo=UTC)
CAND = "canonical_hash string, title string, published_at timestamp, score int, entities array<struct<kind:string,value:string>>"


def plain_duplicates(rows, title=0.92, low=0.85, hours=48):
    """The rule as a loop: best rank first, each winner claims what is left."""
    key = lambda r: (-r[3], r[2] is None, r[2] or T0, r[0])
    left, out = sorted(rows, key=key), []
    while left:
        w, rest = left[0], []
        for r in left[1:]:
            near = w[2] is None or r[2] is None or abs((w[2] - r[2]).total_seconds()) <= hours * 3600
            strong = {e for e in w[4] if e[0] == "cve"} & {e for e in r[4] if e[0] == "cve"}
            if near and indel(w[1].strip().lower(), r[1].strip().lower()) >= (low if strong else title):
                out.append((r[0], w[0]))
            else:
                rest.append(r)
        left = rest
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_dedupe_is_the_sequential_rule(spark, seed):
    rnd = random.Random(seed)
    stems = ["mcp server leaks secrets", "agent escapes sandbox via tool", "new prompt injection taxonomy"]
    rows = []
    for i in range(90):
        t = list(rnd.choice(stems))
        for _ in range(rnd.randrange(4)):
            t[rnd.randrange(len(t))] = rnd.choice("abcxyz ")
        rows.append((f"{i:03d}", "".join(t), None if rnd.random() < 0.1 else T0 + timedelta(hours=rnd.randrange(200)), rnd.randrange(4), [("cve", f"C{rnd.randrange(3)}")] if rnd.random() < 0.4 else []))
    got = dedupe.find_duplicates(spark.createDataFrame(rows, CAND)).collect()
    assert sorted(map(tuple, got)) == plain_duplicates(rows)
    assert dedupe.find_duplicates(spark.createDataFrame(rows, CAND), max_pool=10).count() == 0
    assert len(plain_duplicates(rows)) > 10


def test_dedupe_of_many_equal_rows(spark):
    """Rows of equal title, time and entities are not paired with each other."""
    rnd = random.Random(3)
    rows = [(f"{i:05d}", rnd.choice(["Untitled", " untitled", "untitles"]), None if i % 3 else T0 + timedelta(hours=60 * rnd.randrange(3)), rnd.randrange(4), [("cve", "C1")] if i % 2 else []) for i in range(1500)]
    frame = spark.createDataFrame(rows, CAND)
    assert sorted(map(tuple, dedupe.find_duplicates(frame).collect())) == plain_duplicates(rows)
    assert dedupe.find_duplicates(frame.unionByName(frame)).count() == len(plain_duplicates(rows))


@pytest.mark.parametrize("local", [7])
def test_claims_across_slabs(spark, local):
    """A time line that is cut into slabs gives the winners of the whole one."""
    for seed in (0, 2):
        rnd = random.Random(seed)
        titles = ["mcp server leaks secrets", "mcp server leaks secret", "mcp servers leak the secrets", "another thing altogether"]
        rows = [(f"{i:03d}", rnd.choice(titles), T0 + timedelta(minutes=rnd.randrange(40_000)), 0 if seed == 2 else rnd.randrange(5), [("cve", f"C{rnd.randrange(2)}")] if rnd.random() < 0.5 else []) for i in range(160)]
        got = dedupe.claimed(spark.createDataFrame(rows, CAND), local_rows=local).collect()
        assert sorted(map(tuple, got)) == plain_duplicates(rows)


def test_hundred_thousand_rows_of_one_title(spark):
    """Rows in, rows out: the row counts of no step grow with the square of a title's rows."""
    n = 100_000
    frame = spark.range(n).select(F.format_string("%06d", "id").alias("canonical_hash"), F.lit("(untitled)").alias("title"),
        F.timestamp_micros(F.lit(1_780_000_000_000_000) + F.col("id") * 1_700_000).alias("published_at"), F.lit(1).alias("score"), F.array().cast("array<struct<kind:string,value:string>>").alias("entities"))
    got = dedupe.find_duplicates(frame)
    assert got.count() == n - 1 and {r[0] for r in got.select("winner").distinct().collect()} == {"000000"}


@pytest.mark.parametrize("bar,group", [(0.92, None), (0.92, "g"), (0.85, "g"), (0.85, None), (0.5, None), (0.3, "g")])
def test_similar_titles_lose_no_pair(spark, bar, group):
    shared_dir(spark)
    rnd = random.Random(9)
    titles = {""}
    for _ in range(25):
        t = "".join(rnd.choice("abcdeé \N{GRINNING FACE}") for _ in range(rnd.choice([1, 2, 5, 12, 30, 70])))
        for _ in range(4):
            k = rnd.randrange(len(t) + 1)
            t = t[:k] + rnd.choice(["", "x", "yz"]) + t[k + rnd.randrange(3):]
            titles.add(t)
    at = {t: k % 3 for k, t in enumerate(sorted(titles))}
    found = {tuple(r) for r in dedupe._similar(spark.createDataFrame([(t, g) for t, g in at.items()], "t string, g long"), bar, group).collect()}
    want = {(a, b) for a in at for b in at if a < b and indel(a, b) >= bar and (not group or at[a] == at[b])}
    assert want and want <= found and all(a < b for a, b in found)


def test_titles_of_the_same_words_elsewhere_do_not_meet(spark):
    """They have the same letters and, but for the seams, the same short grams."""
    shared_dir(spark)
    words = "agents patches sandbox escapes kernels drivers modules release notices archive plugins tenants".split()
    titles = [(" ".join(words[k:] + words[:k]),) for k in range(0, 12, 3)]
    assert dedupe._similar(spark.createDataFrame(titles, "t string"), 0.92).count() == 0


def test_likeness_of_many_pairs_is_that_of_each():
    rnd = random.Random(4)
    some = lambda: "".join(rnd.choice("abc é\0") for _ in range(rnd.choice([0, 1, 5, 30, 63, 64, 65, 90])))
    xs, ys = [some() for _ in range(2000)], [some() for _ in range(2000)]
    assert list(indels(xs, ys)) == [indel(x, y) for x, y in zip(xs, ys)] and len(indels([], [])) == 0


def test_dedupe_of_nothing(spark):
    assert dedupe.find_duplicates(spark.createDataFrame([], CAND)).count() == 0


@pytest.mark.parametrize("cell", [3, 512])
def test_entity_pairs_are_made_once_and_not_gathered(spark, cell):
    shared_dir(spark)
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["cve", "cve", "package"]), f"v{rnd.randrange(3)}") for i in range(60) for _ in range(3)] + [(7, "cve", None), (8, "cve", None), (None, "cve", "v1")]
    pairs = relational.entity_pairs(spark.createDataFrame(rows, "k long, kind string, value string"), "k", cell=cell)
    sets = {i: {v for k, kind, v in rows if k == i and kind == "cve" and v} for i in range(60)}
    assert sorted(map(tuple, pairs.collect())) == [(a, b) for a in range(60) for b in range(a + 1, 60) if sets[a] & sets[b]]
    assert "Aggregate" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_roots(spark):
    shared_dir(spark)
    edges = [("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("x", "y", 1), ("x", "z", 2)]
    got = resolve_roots(spark.createDataFrame(edges, "loser string, winner string, seq int")).collect()
    assert sorted(map(tuple, got)) == [("a", "d"), ("b", "d"), ("c", "d"), ("x", "z")]


@pytest.mark.parametrize("many", [10, 1_000_000])
def test_roots_of_any_log(spark, many):
    """Hubs, long chains, cycles of many lengths and tails into them, by every way of looking up."""
    shared_dir(spark)
    rnd = random.Random(11)
    to = {k: rnd.randrange(400) for k in range(300)} | {400 + k: 399 + k for k in range(1, 100)} | {500 + k: 450 for k in range(300)}
    to |= {900 + k: 900 + (k + 1) % 33 for k in range(33)} | {1000 + k: 920 for k in range(100)}

    def root(k):
        path = [k]
        while path[-1] in to and to[path[-1]] not in path and to[path[-1]] != path[-1]:
            path.append(to[path[-1]])
        last = to.get(path[-1], path[-1])
        return min(path[path.index(last):]) if last in path else last

    got = resolve_roots(spark.createDataFrame([(k, w, 1) for k, w in to.items()], "loser long, winner long, seq int"), many).collect()
    assert len(got) == len({r["loser"] for r in got})
    assert {r["loser"]: r["root"] for r in got} == {k: root(k) for k in to if root(k) != k}


def test_rings_are_left_once_they_are_known(spark, monkeypatch):
    shared_dir(spark)
    written = []
    monkeypatch.setattr(store, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    rings = [(10 * k + i, 10 * k + (i + 1) % 10, 1) for k in range(50) for i in range(10)]
    got = resolve_roots(spark.createDataFrame(rings, "loser long, winner long, seq int"))
    assert {tuple(r) for r in got.collect()} == {(10 * k + i, 10 * k) for k in range(50) for i in range(1, 10)}
    assert len(written) <= 6  # the links, four doublings, the rings' ends


def test_rings_of_neighbours_are_not_doubled(spark, monkeypatch):
    """Only the rows by which neighbours are entered from elsewhere are written again."""
    shared_dir(spark)
    written = []

    def counted(df, name):
        written.append((out := materialize(df, name)).count())
        return out

    monkeypatch.setattr(store, "materialize", counted)
    rings = [(10 * k + i, 10 * k + (i + 1) % 10, 1) for k in range(60) for i in range(10)]
    edges, want = spark.createDataFrame(rings, "loser long, winner long, seq int"), {(10 * k + i, 10 * k) for k in range(60) for i in range(1, 10)}
    assert {tuple(r) for r in resolve_roots(edges).collect()} == want and 600 <= sum(written) <= 1000
    written.clear()
    assert {tuple(r) for r in resolve_roots(edges, span=64).collect()} == want and 600 < sum(written) <= 1000


@pytest.mark.parametrize(("span", "many", "few"), [(1, 10, 0), (7, 1_000_000, 1000), (40, 10, 0), (40, 1_000_000, 1000)])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_roots_of_neighbours(spark, monkeypatch, span, many, few, kind):
    """Paths and rings that leave their neighbours and come back, the least of a ring anywhere."""
    shared_dir(spark)
    monkeypatch.setattr(store, "FEW", few)
    rnd = random.Random(span)
    to = {k: k + 1 for k in range(300) if k % 97} | {k: k - 1 for k in range(400, 700) if k % 90}  # up and down, with ends
    to |= {k: k + 1 for k in range(700, 900)} | {900: 700, 1000: 903, 1001: 1000}  # a ring over many neighbours
    to |= {k: k - 1 for k in range(1101, 1200)} | {1100: 1199} | {90: 1150, 180: 450, 399: 880}
    ring = rnd.sample(range(1300, 1450), 60)
    to |= dict(zip(ring, ring[1:] + ring[:1], strict=True))
    to |= {k: 1300 + rnd.randrange(150) for k in range(1500, 1560)} | {k: 2000 - rnd.randrange(1900) for k in range(1600, 1640)} | {1700: 1700}
    name = (lambda k: k) if kind == "long" else (lambda k: f"{k:05d}\u00e9")

    def root(k):
        seen = {}
        while k in to and k not in seen:
            seen[k] = len(seen)
            k = to[k]
        return min(x for x in seen if seen[x] >= seen[k]) if k in seen else k

    rows = [(name(k), name(w), 1) for k, w in to.items()] + [(name(k), name(5), 0) for k in range(0, 900, 50) if k in to]
    rnd.shuffle(rows)
    got = resolve_roots(spark.createDataFrame(rows, f"loser {kind}, winner {kind}, seq int"), many, span).collect()
    assert len(got) == len({r["loser"] for r in got})
    assert {r["loser"]: r["root"] for r in got} == {name(k): name(root(k)) for k in to if root(k) != k}


@pytest.mark.parametrize("size", [2, 3, 50])
def test_roots_of_cycles(spark, size):
    ring = [(f"n{i:03d}", f"n{(i + 1) % size:03d}", 1) for i in range(size)]
    tails = [("a", "b", 1), ("b", "n001", 1), ("z", "n000", 1), ("p", "q", 1), ("self", "self", 1), ("gone", None, 1)]
    got = resolve_roots(spark.createDataFrame(ring + tails, "loser string, winner string, seq int")).collect()
    assert {r["loser"]: r["root"] for r in got} == {f"n{i:03d}": "n000" for i in range(1, size)} | {"a": "n000", "b": "n000", "z": "n000", "p": "q"}


@pytest.mark.parametrize("local", [50_000, 3])
def test_star_winners_of_long_chains_and_large_groups(spark, monkeypatch, local):
    monkeypatch.setattr(dedupe, "LOCAL_PAIRS", local)
    rnd = random.Random(3)
    links = {(i, i + 1) for i in range(24)} | {tuple(sorted(rnd.sample(range(100, 140), 2))) for _ in range(60)}
    rows = [(f"{a:03d}", f"{b:03d}", (0, a, f"{a:03d}")) for a, b in links]
    got = dedupe.star_winners(spark.createDataFrame(rows, "better string, worse string, better_rank struct<s:int,p:long,h:string>")).collect()
    claimed, want = set(), []
    for a in sorted({a for a, _ in links}):
        if a not in claimed:
            mine = [b for x, b in links if x == a and b not in claimed]
            claimed.update(mine)
            want += [(f"{b:03d}", f"{a:03d}") for b in mine]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("bar", [0.92, 0.85, 0.6])
def test_similar_titles_always_meet(spark, bar):
    """No pair that reaches the bar is missed, however short or repetitive its titles."""
    rnd = random.Random(int(bar * 100))
    stems = ["".join(rnd.choice("abcde ") for _ in range(rnd.randrange(1, 40))) for _ in range(25)] + ["haha" * 5, "aaaaaaaaaaaaaaaaaaaaaaaa", "a", "ab", ""]
    titles = {s for s in stems}
    for s in stems * 6:
        t = list(s)
        for _ in range(rnd.randrange(5)):
            at = rnd.randrange(len(t) + 1)
            t[at : at + rnd.randrange(2)] = rnd.choice(["x", "a", ""])
        titles.add("".join(t))
    found = {tuple(r) for r in dedupe._similar(spark.createDataFrame([(t,) for t in titles], "t string"), bar, []).collect()}
    order = sorted(titles)
    assert {(a, b) for k, a in enumerate(order) for b in order[k + 1 :] if indel(a, b) >= bar} <= found


def item(spark, hashes):
    return spark.createDataFrame([(h, f"https://e.com/{h}", h.upper(), None, None, T0, "{}", 1) for h in hashes],
                                 "canonical_hash string, url string, title string, summary string, published_at timestamp, ingested_at timestamp, metadata string, canonicalization_version int")


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    assert s.items().count() == 0
    assert s.insert_or_ignore("items", item(spark, ["a", "b", "c"])) == 3
    assert s.insert_or_ignore("items", item(spark, ["b", "d", "d"])) == 1
    assert s.audit_keys() == {"items": 0, "item_sources": 0, "item_entities": 0}
    label = lambda h, t, n: (h, t, [], n, "r", "v", "m", T0)
    ddl = "canonical_hash string, topic string, secondary_topics array<string>, score int, rationale string, classifier_version string, classifier_model string, classified_at timestamp"
    assert s.classify(spark.createDataFrame([label("a", "x", 5), label("zz", "x", 5)], ddl)) == 1
    assert s.classify(spark.createDataFrame([label("a", "y", 7)], ddl)) == 0
    assert [(r["topic"], r["score"]) for r in s.classified().collect()] == [("y", 7)]
    s.supersede(spark.createDataFrame([("a", "b")], "loser string, winner string"))
    s.supersede(spark.createDataFrame([("b", "c")], "loser string, winner string"))
    assert sorted(map(tuple, s.supersessions().collect())) == [("a", "c"), ("b", "c")]
    assert sorted(r[0] for r in s.items().select("canonical_hash").collect()) == ["c", "d"]
    body = spark.createDataFrame([("c", "text", "u", T0), ("nope", "t", "u", T0)], "canonical_hash string, body string, fetched_from_url string, fetched_at timestamp")
    assert s.set_bodies(body) == 1 and s.bodies().count() == 1
    follow = spark.createDataFrame([(T0, "c", "C", "u", "audit", "")], "created_at timestamp, item_hash string, item_title_snapshot string, item_url_snapshot string, action string, note string")
    s.add_followups(follow)
    with pytest.raises(ValueError):
        s.add_followups(follow.withColumn("action", F.lit("dance")))
    s.delete_items(spark.createDataFrame([("c",)], "canonical_hash string"))
    assert s.bodies().count() == 0
    left = s.followups(open_only=True).collect()
    assert len(left) == 1 and left[0]["item_hash"] is None
    s.complete_followup(left[0]["id"])
    assert s.followups(open_only=True).count() == 0
    week = spark.createDataFrame([(T0, "cve", "v", "c", ["a"])], "week_starting timestamp, kind string, value string, context string, related_item_hashes array<string>")
    s.add_weekly_entities(week)
    s.add_weekly_entities(week)
    assert s.weekly_entities().count() == 1
    s.add_weekly_entities(week, mode="append")
    assert s.weekly_entities().count() == 2


def test_streaks_equal_a_loop(spark):
    rnd = random.Random(3)
    runs = [(f"s{i % 5}", i, rnd.random() < 0.4, rnd.random() < 0.5, T0 + timedelta(hours=i)) for i in range(120)]
    want = {}
    for name, _, failed, empty, ts in runs:
        e, m, ok = want.get(name, (0, 0, None))
        want[name] = (e + 1, m, ok) if failed else (0, m + 1 if empty else 0, ts)
    df = spark.createDataFrame(runs, "source string, seq long, failed boolean, empty boolean, ts timestamp")
    got = relational.streaks(df, "source", "seq", F.col("failed"), F.col("empty"), "ts").collect()
    assert {r["source_name"]: (r["consecutive_error_runs"], r["consecutive_empty_runs"], r["last_success_at"].replace(tzinfo=UTC)) for r in got} == want


class Scripted:
    model_id = "test"

    def __init__(self, *replies):
        self.replies, self.calls = list(replies), []

    def classify(self, prompt, items, temperature):
        self.calls.append(([i["id"] for i in items], temperature))
        r = self.replies.pop(0) if self.replies else {}
        if r == "error":
            raise ProviderError
        return {k: {"topic": t, "score": 5, "rationale": "", "secondary_topics": ["x", "x", t, "bogus"]} for k, t in r.items()}


def items(n):
    return [{"id": str(i), "title": "t", "source": None, "summary": None, "url": "u"} for i in range(n)]


def run(provider, n, **kw):
    return classify_items(items(n), provider, "p", {"x", "y", "other"}, batch_size=2, **kw)


def test_classify_retry_and_fallback():
    p = Scripted({"0": "y", "1": "bad"}, {})
    out = run(p, 2)
    assert p.calls == [(["0", "1"], 0.2), (["1"], 0.0)]
    assert out.results["0"]["secondary_topics"] == ["x"] and out.results["1"]["topic"] == "other" and out.fallbacks == {"1"}


def test_classify_outage_skips():
    p = Scripted(*["error"] * 9)
    out = run(p, 8)
    assert out.skipped == [str(i) for i in range(8)] and len(p.calls) == 4 and not out.results


def test_classify_budget():
    cost = token_estimate("p", items(2))
    p = Scripted({"0": "x", "1": "x"}, {"2": "x", "3": "x"})
    assert run(p, 4, token_budget=cost).skipped == ["2", "3"]
    p = Scripted({"0": "x", "1": "x"})
    assert run(p, 4, token_budget=1).skipped == ["2", "3"]
    p = Scripted({"0": "x"})
    out = run(p, 2, token_budget=cost)
    assert out.fallbacks == {"1"} and len(p.calls) == 1


def test_keyword_provider_is_deterministic():
    p = KeywordProvider({"a": ["mcp"], "b": ["agent"]})
    one = p.classify("", [{"id": "1", "title": "MCP agent mcp", "summary": None}], 0)
    assert one["1"]["topic"] == "a" and one["1"]["secondary_topics"] == ["b"]
    assert classifier_version("p", "m") == classifier_version("p", "m") != classifier_version("p", "n")


def test_row_numbers_over_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, (i * 7919) % 501) for i in range(1000)]
        got = relational.row_numbers(spark.createDataFrame(rows, "id int, k int"), [F.desc("k"), F.col("id")], "n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert {r["id"]: r["n"] for r in got} == {i: n for n, (i, _) in enumerate(order, 1)}


def test_components_by_one_task_and_by_joins(spark):
    rnd = random.Random(5)
    for kind, name in (("long", lambda i: i), ("string", lambda i: f"n{i}")):
        links = [(name(rnd.randrange(300)), name(rnd.randrange(300))) for _ in range(180)] + [(name(400), name(i)) for i in range(401, 460)] + [(name(500 + i), name(501 + i)) for i in range(60)] + [(None, name(1)), (name(7), name(7))]
        df = spark.createDataFrame(links, f"a {kind}, b {kind}")
        least = {x: x for ab in links if None not in ab and ab[0] != ab[1] for x in ab}
        for _ in range(100):
            for a, b in links:
                if a in least and b in least and a != b:
                    least[a] = least[b] = min(least[a], least[b])
        for local in (0, 100, 1 << 18):
            assert {r["node"]: r["root"] for r in components(df, local).collect()} == least
        assert components(df.limit(0)).count() == components(df.limit(0), 0).count() == 0
