"""Sources, jobs, reports, agent, streams and the command line, without a network."""

import json
import time
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.__main__ import main
from quillspark.operators.classify import KeywordProvider, ProviderError
from quillspark.operators.store import Store
from quillspark.plans import agent, pipeline, reports
from quillspark.sources import adapters
from quillspark.sources.config import ConfigError, check_source, load_agent, load_sources
from quillspark.sources.http import PacedClient, Response, ResponseTooLarge, retry_after
from quillspark.streaming import ingest

NOW = datetime(2026, 5, 27, 12, tzinfo=UTC)
RSS = b"""<rss><channel><item><title>MCP server leaks</title><link>https://e.com/a?utm_source=x</link><guid>g1</guid><description>cve-2026-1234 &lt;b&gt;</description>
<pubDate>Tue, 26 May 2026 10:00:00 GMT</pubDate><category>c1</category></item><item><title>No link</title></item></channel></rss>"""
ATOM = b"""<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2605.00001v1</id><title>P</title><summary>S</summary><published>2026-05-20T00:00:00Z</published>
<author><name>A</name></author><link rel="alternate" href="http://arxiv.org/abs/2605.00001v1"/><category term="cs.CR"/></entry><entry><id>http://arxiv.org/api/errors#x</id><title>Error</title></entry></feed>"""


class Web:
    def __init__(self, **pages):
        self.pages, self.asked = pages, []

    def get(self, url, headers=None):
        self.asked.append((url, headers or {}))
        for part, page in self.pages.items():
            if part in url:
                return page if isinstance(page, Response) else Response(200, {"ETag": "e1"}, body=page if isinstance(page, bytes) else json.dumps(page).encode())
        return Response(500)


RSS_CONFIG = check_source({"name": "feed", "type": "rss", "url": "https://feed/x"})


def test_feeds():
    rows, cursor, same = adapters.fetch(RSS_CONFIG, {}, Web(feed=RSS))
    p = json.loads(rows[0][1])
    assert rows[0][0] == "g1" and p["published_timestamp"] == 1779789600 and p["tags"] == ["c1"] and len(rows[1][0]) == 64
    assert cursor == {"etag": "e1"} and not same
    web = Web(feed=Response(304))
    assert adapters.fetch(RSS_CONFIG, cursor, web) == ([], cursor, True) and web.asked[0][1]["If-None-Match"] == "e1"
    rows, _, _ = adapters.fetch(check_source({"name": "x", "type": "arxiv", "query": "q"}), {}, Web(arxiv=ATOM))
    assert len(rows) == 1 and json.loads(rows[0][1])["authors"] == ["A"]


def test_hn_cursor():
    c = check_source({"name": "hn", "type": "hn_search", "query": "q"})
    web = Web(algolia={"hits": [{"objectID": "1", "title": "T", "created_at_i": 50}, {"title": "no id"}, {"objectID": "2", "story_title": "S", "url": "https://e.com", "created_at_i": 70}]})
    rows, cursor, _ = adapters.fetch(c, {"last_created_at_i": 40}, web)
    assert [r[0] for r in rows] == ["1", "2"] and cursor == {"last_created_at_i": 70} and "created_at_i%3E40" in web.asked[0][0]
    assert json.loads(rows[0][1])["link"].endswith("id=1")


def test_releases():
    c = check_source({"name": "r", "type": "github_releases", "repo": "o/n"})
    rows, cursor, _ = adapters.fetch(c, {}, Web(repos=[{"id": 1, "tag_name": "v1", "author": "x"}, {"id": 2, "draft": True}, "junk", {"html_url": "u", "author": {"login": "me"}}]))
    assert [r[0] for r in rows] == ["1", "u"] and json.loads(rows[0][1])["title"] == "o/n v1" and json.loads(rows[1][1])["author"] == "me"
    assert adapters.fetch(c, {}, Web(repos={"message": "no"}))[0] == []


def test_topic_watermark_keeps_the_boundary_second():
    c = check_source({"name": "t", "type": "github_topic", "topic": "mcp"})
    repo = lambda i, s: {"id": i, "full_name": f"o/{i}", "pushed_at": f"2026-05-20T00:00:{s:02d}Z"}
    _, cursor, _ = adapters.fetch(c, {}, Web(search={"items": [repo(1, 5), repo(2, 4)]}))
    rows, cursor, _ = adapters.fetch(c, cursor, Web(search={"items": [repo(1, 5), repo(2, 4), repo(3, 5), {"id": 4}]}))
    assert [r[0] for r in rows] == ["3", "4"] and cursor["seen_at_watermark"] == ["1", "3"]


def test_paced_client():
    clock, slept, script = [0.0], [], [(429, {"Retry-After": "7"}, []), (429, {}, []), (200, {}, [b"ab", b"c"])]
    client = PacedClient(transport=lambda u, h, t: script.pop(0), sleep=lambda s: (slept.append(s), clock.__setitem__(0, clock[0] + s)), clock=lambda: clock[0])
    assert client.get("https://e.com/").body == b"abc" and slept == [7.0, 2.0]
    with pytest.raises(ValueError):
        client.get("ftp://e.com")
    with pytest.raises(ResponseTooLarge):
        PacedClient(transport=lambda u, h, t: (200, {}, [b"x" * 20]), max_bytes=10).get("https://e.com")
    assert PacedClient(transport=lambda u, h, t: (429, {"Retry-After": "999"}, []), sleep=lambda s: 1 / 0).get("https://e.com").status == 429
    assert retry_after("Wed, 27 May 2026 12:00:30 GMT", NOW) == 30 and retry_after("Wed, 27 May 2026 11:00:00 GMT", NOW) == 0 and retry_after("soon") is None


@pytest.mark.parametrize("raw", [{"name": "a", "type": "usenet"}, {"name": "a", "type": "rss"}, {"name": "a", "type": "rss", "url": "u", "x": 1}, {"type": "rss", "url": "u"}, "text"])
def test_bad_sources(raw):
    with pytest.raises(ConfigError):
        check_source(raw)


def configs(tmp_path):
    (tmp_path / "sources.yaml").write_text("sources:\n- {name: feed, type: rss, url: 'https://feed/x'}\n- {name: down, type: rss, url: 'https://down/x'}\n")
    (tmp_path / "agent.yaml").write_text("taxonomy:\n- {slug: mcp, description: MCP, examples: [a, b]}\n- {slug: other, description: rest}\n")
    return load_sources(tmp_path / "sources.yaml"), load_agent(tmp_path / "agent.yaml")


def test_collect_classify_synthesize_status(spark, tmp_path):
    sources, config = configs(tmp_path)
    assert config.render_taxonomy() == "- mcp: MCP (e.g. a, b)\n- other: rest"
    store, web = Store(spark, f"file://{tmp_path}/db"), Web(feed=RSS, page=b"<p>hello</p><script>x</script>")
    first = pipeline.collect(store, sources, web, NOW)
    feed, down = first.sources
    assert (feed.fetched, feed.new, feed.skipped, feed.entities) == (2, 1, 1, 1) and down.error and first.any_error
    assert pipeline.collect(store, sources, web, NOW + timedelta(hours=1)).stored_new == 0
    runs = {r["source_name"]: r for r in store.source_runs().collect()}
    assert runs["down"]["consecutive_error_runs"] == 2 and runs["feed"]["consecutive_empty_runs"] == 0 and json.loads(runs["feed"]["cursor"]) == {"etag": "e1"}
    row = store.items().first()
    assert row["url"] == "https://e.com/a" and json.loads(row["metadata"])["original_url"].endswith("utm_source=x")
    assert pipeline.post_process(store, config, None, NOW) == {"skipped": "no provider"}
    done = pipeline.post_process(store, config, KeywordProvider({"mcp": ["mcp"]}), NOW, tmp_path / "vault")
    assert done["classified"] == 1 and "### [MCP server leaks](https://e.com/a) — score 5" in done["report"].read_text()
    key = row["canonical_hash"]

    class Model:
        model_id = "m"
        turns = [agent.Turn("hm", [("1", "query_items", {}), ("2", "get_entities", {"item_hash": key}), ("3", "nope", {})], (5, 5)),
                 agent.Turn(None, [("4", "add_followup", {"item_hash": key, "action": "audit", "note": "n"}), ("5", "fetch_url", {"url": "https://page/1"}), ("6", "add_followup", {"item_hash": key, "action": "dance"})], (1, 1)),
                 agent.Turn("bye", [("7", "finish", {"roundup_markdown": "## Themes"})], (1, 1))]

        def complete(self, system, messages, tools):
            self.seen = messages
            return self.turns.pop(0)

    model = Model()
    out = pipeline.synthesize(store, model, web, reports.trailing(NOW + timedelta(days=1), 7), NOW, tmp_path / "vault")
    assert out["agent"].stop == "finish" and not out["agent"].degraded and out["agent"].tokens == (7, 7) and out["items"] == 1
    results = [json.loads(b["content"]) for m in model.seen for b in m["content"] if b["type"] == "tool_result"]
    assert [r["ok"] for r in results] == [True, True, False, True, True, False, True], results
    assert results[4]["result"]["text"] == "hello"
    assert "| CVE-2026-1234 | CVE-2026-1234 |" in out["text"] and "- **[audit]** [MCP server leaks](https://e.com/a) — n" in out["text"]
    table, failing = pipeline.status(spark, store.source_runs(), ["feed", "down", "new"], NOW + timedelta(days=9), fail_after=2)
    assert {r["source_name"]: r["health"] for r in table.collect()} == {"feed": "STALE", "down": "FAILING", "new": "never run"} and failing


def test_agent_stops():
    class Loop:
        def __init__(self, *turns):
            self.turns = list(turns)

        def complete(self, *a):
            t = self.turns.pop(0)
            if t is None:
                raise ProviderError
            return t

    class NoTools:
        roundup = None

        def dispatch(self, n, a):
            return {"ok": True}

    call = lambda text=None: agent.Turn(text, [("1", "x", {})], (10, 0))
    assert agent.run_agent(Loop(agent.Turn("part")), NoTools(), "", "").roundup.endswith("\n\npart")
    assert agent.run_agent(Loop(None), NoTools(), "", "").stop == "provider_error"
    assert agent.run_agent(Loop(call(), call()), NoTools(), "", "", max_turns=2).stop == "max_turns"
    assert agent.run_agent(Loop(call("x")), NoTools(), "", "", token_budget=10).stop == "budget"


ENTRY = "canonical_hash string, title string, url string, score int, topic string, secondary_topics array<string>, rationale string, published_at timestamp, sources array<string>"


def test_collection_report_bytes(spark):
    rows = [("b", "B", "u/b", 9, "sec", ["z", "a"], "why", NOW, ["s2", "s1"]), ("a", "A", "u/a", 6, "eco", [], "r", None, [])]
    want = ("---\ncounts:\n  by_topic:\n    eco: 1\n    sec: 1\n  total: 2\ndate: '2026-05-27'\nrenderer_version: 1\nschema_version: 2\ntype: collection-report\n---\n\n\n# Collection — 2026-05-27\n\n"
            "## sec (1)\n\n### [B](u/b) — score 9 · also a, z\n> why\n- **Sources:** s1, s2\n- **Published:** 2026-05-27\n\n## eco (1)\n\n### [A](u/a) — score 6\n> r\n")
    assert reports.collection_report(spark.createDataFrame(rows, ENTRY), date(2026, 5, 27)) == want
    assert reports.collection_report(spark.createDataFrame([], ENTRY), date(2026, 5, 27)).endswith("# Collection — 2026-05-27\n\n_No items collected._\n")


def test_labels():
    assert reports.iso_week(datetime(2026, 5, 18, tzinfo=UTC)).label == "W2026-W21"
    assert reports.trailing(NOW, 7).label == "D2026-05-27-7d"
    assert reports.between(NOW, NOW).label == "R2026-05-27-to-2026-05-27"


def test_data_source_and_stream(spark, tmp_path):
    replies = tmp_path / "replies.json"
    replies.write_text(json.dumps([{"url": "https://feed/x", "body": RSS.decode(), "headers": {"ETag": "q"}}]))
    config = json.dumps({"name": "feed", "type": "rss", "url": "https://feed/x"})
    from quillspark.sources.datasource import register

    register(spark)
    assert spark.read.format("quill_feed").option("config", config).option("replies", str(replies)).load().count() == 2
    raw = ingest.stream_sources(spark, config, replies=str(replies))
    store = Store(spark, f"file://{tmp_path}/db")
    q = ingest.start_ingest(raw, store, lambda: NOW, f"file://{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert store.items().count() == 1


def test_two_sources_in_one_stream_survive_a_restart(spark, tmp_path):
    """A batch that failed runs again on what was fetched; the next poll starts from its cursors."""
    hit = lambda i: {"objectID": str(i), "title": f"T{i}", "created_at_i": i}
    replies, folder = tmp_path / "replies.json", {"polls": f"file://{tmp_path}/polls", "replies": str(tmp_path / "replies.json"), "state": "true", "pollSeconds": "3600"}

    def answer(*hits, feed=RSS.decode()):
        replies.write_text(json.dumps([{"url": "https://feed/x", "body": feed}, {"url": "https://hn.algolia.com", "body": {"hits": list(hits)}}, {"url": "https://down/", "status": 500, "body": ""}]))

    config = json.dumps([{"name": "feed", "type": "rss", "url": "https://feed/x"}, {"name": "hn", "type": "hn_search", "query": "q"}, {"name": "down", "type": "rss", "url": "https://down/x"}])
    got = []

    def run(land):
        q = ingest.stream_sources(spark, config, **folder).writeStream.foreachBatch(land).option("checkpointLocation", f"file://{tmp_path}/cp").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    def fail(batch, epoch):
        batch.count()
        raise RuntimeError("lost")

    def keep(batch, epoch):
        got.append(sorted((r["source_name"], r["source_type"], r["external_id"], r["payload"]) for r in batch.collect() if r["source_type"] != "_state"))
        got.append({r["source_name"]: json.loads(r["payload"]) for r in batch.collect() if r["source_type"] == "_state"})

    answer(hit(70))
    with pytest.raises(Exception, match="lost"):
        run(fail)
    answer(hit(90), feed="<rss/>")
    run(keep)
    # the failed batch again, from the log; then a poll of its own
    assert [r[0] for r in got[0]] == ["feed", "feed", "hn"] and got[0][2][2] == "70" and "500" in got[1]["down"]["error"]
    assert [r[:3] for r in got[2]] == [("hn", "hn_search", "90")] and got[3]["hn"]["cursor"]["last_created_at_i"] == 90
    run(keep)
    assert got[4] == [] and got[5]["hn"]["cursor"]["last_created_at_i"] == 90 and got[5]["feed"]["unchanged"]
    assert len(list((tmp_path / "polls").iterdir())) <= 2


def test_partitions_are_hosts():
    from quillspark.sources.datasource import by_host

    configs = [{"name": "r", "type": "github_releases", "repo": "o/n"}, {"name": "t", "type": "github_topic", "topic": "mcp"}, {"name": "a", "type": "rss", "url": "https://E.com/1"}, {"name": "b", "type": "rss", "url": "http://e.com:80/2"}]
    assert sorted((host, [c["name"] for c in group]) for host, group in (p.value for p in by_host({"config": json.dumps(configs)}))) == [("api.github.com", ["r", "t"]), ("e.com", ["a", "b"])]


def test_stream_health(spark, tmp_path):
    rows = [("s", 1, True, False, NOW), ("s", 2, False, True, NOW), ("s", 3, True, False, NOW), ("s", 4, True, False, NOW)]
    ddl = "source_name string, seq long, failed boolean, empty boolean, ts timestamp"
    spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/runs")
    q = ingest.stream_health(spark.readStream.schema(ddl).parquet(f"{tmp_path}/runs")).writeStream.outputMode("update").format("memory").queryName("health").start()
    q.processAllAvailable()
    q.stop()
    r = spark.table("health").collect()[-1]
    assert (r["consecutive_error_runs"], r["consecutive_empty_runs"]) == (2, 1)


def _drain(frame, tmp_path, name, mode="append"):
    q = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/cp-{name}").start()
    q.processAllAvailable()
    q.stop()


def test_replayed_rows_do_not_reach_the_store(spark, tmp_path):
    """Within the time kept each version of a row passes once; late and undated rows pass."""
    ddl = "source_name string, source_type string, external_id string, payload string, fetched_at timestamp"
    at = lambda hours: NOW + timedelta(hours=hours)
    batches = [[("s", "rss", "1", "a", at(0)), ("s", "rss", "1", "a", at(0)), ("s", "rss", None, "x", at(0))], [("s", "rss", "1", "a", at(1)), ("s", "rss", "1", "b", at(1)), ("t", "rss", "1", "a", at(1)), ("s", "rss", None, "x", at(2))]]
    (tmp_path / "rows").mkdir()
    got = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/rows")
        q = ingest.once(spark.readStream.schema(ddl).parquet(f"{tmp_path}/rows")).writeStream.foreachBatch(lambda b, e: got.extend(map(tuple, b.select("source_name", "external_id", "payload").collect()))).option("checkpointLocation", f"file://{tmp_path}/cp").start()
        q.processAllAvailable()
        kept = q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress["stateOperators"] else None
        q.stop()
    assert sorted(map(str, got)) == sorted(map(str, [("s", "1", "a"), ("s", None, "x"), ("s", "1", "b"), ("t", "1", "a")])) and kept in (None, 4)


def test_streams_meet_by_entity_and_time(spark, tmp_path):
    """Pairs of a replay are those of the batch query."""
    ddl = "canonical_hash string, published_at timestamp, kind string, value string"
    rows = [(f"h{i}", NOW + timedelta(hours=17 * (i % 12)), "cve" if i % 5 else "repo", f"C{i % 3}") for i in range(40)] + [("none", None, "cve", "C1")]
    frame = spark.createDataFrame(rows, ddl)
    frame.coalesce(1).write.parquet(f"{tmp_path}/ents")
    ents = lambda: spark.readStream.schema(ddl).parquet(f"{tmp_path}/ents")
    _drain(ingest.entity_pairs(ents(), ents()), tmp_path, "pairs")
    want = {(a[0], b[0], a[3]) for a in rows for b in rows if a[2] == b[2] == "cve" and a[3] == b[3] and a[0] < b[0] and a[1] and b[1] and abs(a[1] - b[1]) <= timedelta(hours=48)}
    assert {tuple(r) for r in spark.table("pairs").select("a", "b", "value").collect()} == want and want


def test_weeks_of_a_stream_begin_on_monday(spark, tmp_path):
    ddl = "k string, ts timestamp"
    days = [datetime(2026, 5, 17, 23, 59, tzinfo=UTC), datetime(2026, 5, 18, tzinfo=UTC), datetime(2026, 5, 24, 12, tzinfo=UTC), datetime(2020, 12, 31, tzinfo=UTC)]
    spark.createDataFrame([("a", d) for d in days], ddl).write.parquet(f"{tmp_path}/ev")
    _drain(ingest.weekly_counts(spark.readStream.schema(ddl).parquet(f"{tmp_path}/ev"), "ts", "k"), tmp_path, "weeks", "complete")
    assert sorted((str(r["week"])[:10], r["label"], r["n"]) for r in spark.table("weeks").collect()) == [("2020-12-28", "2020-W53", 1), ("2026-05-11", "2026-W20", 1), ("2026-05-18", "2026-W21", 2)]


def test_a_silent_source_turns_stale(spark, tmp_path):
    """Counters and labels are those of the batch rule; then nothing comes, and a timer goes off."""
    from quillspark.operators.relational import health_label
    from quillspark.streaming import health

    now = datetime.now(UTC)
    runs = [("quiet", 1, True, False, now), ("quiet", 2, False, True, now), ("down", 1, False, False, now), ("down", 2, True, False, now), ("never", 1, True, False, now), ("old", 1, False, False, now - timedelta(days=1))]
    ddl = "source_name string, seq long, failed boolean, empty boolean, ts timestamp"
    spark.createDataFrame(runs, ddl).coalesce(1).write.parquet(f"{tmp_path}/runs")
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(ddl).parquet(f"{tmp_path}/runs")
        q = health.stream_health(stream, stale_days=0, day_ms=8000).writeStream.outputMode("update").format("memory").queryName("silent").trigger(processingTime="1 second").start()
        try:
            end = time.time() + 90
            while time.time() < end and not spark.sql("SELECT 1 FROM silent WHERE source_name = 'quiet' AND health = 'STALE'").count():
                time.sleep(1)
        finally:
            q.stop()
    finally:
        spark.conf.unset(key)
    seen = {}
    for r in spark.table("silent").collect():
        seen.setdefault(r["source_name"], []).append((r["consecutive_error_runs"], r["consecutive_empty_runs"], r["health"]))
    assert seen["quiet"][-1] == (0, 1, "STALE") and seen["down"][0] == (1, 0, "FAILING") and seen["never"] == [(1, 0, "FAILING")] and seen["old"] == [(0, 0, "STALE")]
    assert seen["down"][-1][2] == "FAILING" and len(seen["quiet"]) <= 2
    # the batch rule at the end of the quiet time
    label = health_label(F.lit(0), F.lit(NOW), F.lit(NOW + timedelta(days=1)), 0)
    assert spark.range(1).select(label).first()[0] == "STALE"


def test_command_line(spark, tmp_path):
    configs(tmp_path)
    said = []
    args = lambda *a: [*a, "--sources", str(tmp_path / "sources.yaml"), "--agent", str(tmp_path / "agent.yaml"), "--db", str(tmp_path / "db")]
    run = lambda *a, **k: main(args(*a), spark=spark, client=Web(feed=RSS), now=NOW, out=said.append, **k)
    assert run("validate-config") == 0
    assert run("status") == 0 and said[-1] == "nothing collected yet"
    assert run("synthesize") == 2
    assert run("collect", "--since", "nonsense") == 2
    assert run("collect", "--source", "missing") == 2
    assert run("collect", "--fail-on-error") == 1
    assert run("collect", "--source", "feed", "--fail-on-error") == 0
    assert run("status", "--fail-after", "1") == 1
    assert run("synthesize") == 0


def test_golden_and_prompts(spark, tmp_path):
    from quillspark.plans.golden import accuracy, load_golden

    rows = [{"title": f"mcp {i}", "url": f"u{i}", "topic": "mcp", "score": 5} for i in range(3)] + [{"title": "else", "url": "x", "topic": "mcp", "score": 1}]
    (tmp_path / "golden.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    share, missed = accuracy(load_golden(spark, str(tmp_path / "golden.jsonl")), KeywordProvider({"mcp": ["mcp"]}), "p")
    assert share == 0.75 and [r["title"] for r in missed.collect()] == ["else"]
    _, config = configs(tmp_path)
    (tmp_path / "classify.md").write_text('{"a": 1} [[taxonomy]] / [[focus]]')
    assert pipeline.system_prompt(config, tmp_path) == '{"a": 1} - mcp: MCP (e.g. a, b)\n- other: rest / (none given)'
    assert "- other: rest" in pipeline.system_prompt(config)


def test_production_hides_names(monkeypatch):
    from quillspark import __main__ as cli

    secret = OSError("https://private.example/feed")
    assert "private" in pipeline.error_text(secret, False) and "private" not in pipeline.error_text(secret, True)
    monkeypatch.setenv("QUILL_LOG_MODE", "production")
    assert cli._shown("feed").startswith("src#")
    monkeypatch.setattr(cli, "main", lambda argv: (_ for _ in ()).throw(secret))
    assert cli.guarded([]) == 1


def test_collection_on_executors(spark, tmp_path):
    """One read of all sources: rows, new cursors and errors as the driver's loop has them."""
    feed = {"name": "feed", "type": "rss", "url": "https://feed/x"}
    down = {"name": "down", "type": "rss", "url": "https://down/x"}
    hits = {"name": "hn", "type": "hn_search", "query": "q"}
    replies = [{"url": "https://feed/", "headers": {"ETag": "e1"}, "body": RSS.decode()}, {"url": "https://down/", "status": 500, "body": ""},
               {"url": "https://hn.algolia.com", "body": {"hits": [{"objectID": "7", "title": "T", "created_at_i": 70}]}}]
    (tmp_path / "replies.json").write_text(json.dumps(replies))
    cursors = {"feed": {}, "down": {"etag": "old"}, "hn": {"last_created_at_i": 40}}
    raw, state = pipeline._fetched_on_executors(spark, [feed, down, hits], cursors, NOW, True, replies=str(tmp_path / "replies.json"))
    assert sorted((r["source_name"], r["external_id"]) for r in raw.collect())[-1] == ("hn", "7") and raw.count() == 3
    assert state["feed"] == ({"etag": "e1"}, False, None) and state["hn"] == ({"last_created_at_i": 70}, False, None)
    assert state["down"][0] == {"etag": "old"} and "msg#" in state["down"][2] and "500" not in state["down"][2]
    assert pipeline._fetched_on_executors(spark, [], {}, NOW, False) == (None, {})
    store = Store(spark, f"file://{tmp_path}/db")
    assert pipeline.ingest(store, raw, NOW)["hn"].new == 1


BROKEN = b"""<?xml version="1.0"?><rss><channel><title>Site & co</title><item><title>Fish & chips <b>now</b></title><link>https://e.com/1</link><guid>g1</guid>
<description><![CDATA[<p>a</p>]]></description><pubDate>Tue, 26 May 2026 10:00:00 GMT</pubDate></item><item><title>Second</title><link>https://e.com/2</link><dc:creator>Me</dc:creator></channel>"""


def test_feeds_that_are_not_well_formed():
    first, second = adapters.parse_feed(BROKEN)
    assert (first["_key"], first["title"], first["summary"], first["published_timestamp"]) == ("g1", "Fish & chips <b>now</b>", "<p>a</p>", 1779789600)
    assert (second["_key"], second["title"], second["authors"]) == ("https://e.com/2", "Second", ["Me"])
    atom = b"<feed><entry><id>i1</id><title>A & B</title><link rel='alternate' href='https://e.com/a'/><author><name>N</name></author><category term='c'/></entry>"
    [entry] = adapters.parse_feed(atom)
    assert (entry["_key"], entry["title"], entry["link"], entry["authors"], entry["tags"]) == ("i1", "A & B", "https://e.com/a", ["N"], ["c"])
    assert adapters.parse_feed(b"no feed at all") == [] and adapters.parse_feed(b"") == []
