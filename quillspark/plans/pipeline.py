"""The three jobs: collect, synthesize, status."""

import json
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce, wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import in_window, week_start
from ..operators.admission import classify_table
from ..operators.classify import classifier_version
from ..operators.dedupe import find_duplicates
from ..operators.normalize import normalize, validate
from ..operators.relational import all_sources, classified_between, dedupe_candidates, failing, health_label, inherit_sources, unclassified, weekly_entities, with_first_source, with_sources
from ..operators.store import Store
from ..session import materialize, scratch
from ..sources.adapters import error_text, fetch
from .agent import Tools, run_agent
from .report_sink import collection_reports, write_reports
from .reports import Span, collection_report, synthesis_report, write_atomically

RAW = "source_name string, source_type string, external_id string, payload string, fetched_at timestamp"
PROMPT = """Classify each item into one topic.

Topics:
[[taxonomy]]

Focus:
[[focus]]

Reply with a JSON array of objects {"id", "topic", "score" (0-10), "rationale", "secondary_topics"}."""


def system_prompt(config, folder=None, name: str = "classify") -> str:
    """The template (``name``.md in ``folder``, else the built-in one), filled in.

    Marks are replaced as text, so braces of JSON examples stay as they are."""
    template = (Path(folder) / f"{name}.md").read_text(encoding="utf-8") if folder else PROMPT
    return template.replace("[[taxonomy]]", config.render_taxonomy()).replace("[[focus]]", config.research_focus or "(none given)")


@dataclass
class SourceResult:
    name: str
    fetched: int = 0
    kept: int = 0
    new: int = 0
    entities: int = 0
    skipped: int = 0
    error: str | None = None


@dataclass
class CollectResult:
    sources: list[SourceResult] = field(default_factory=list)
    notes: dict = field(default_factory=dict)

    @property
    def stored_new(self) -> int:
        return sum(s.new for s in self.sources)

    @property
    def any_error(self) -> bool:
        return any(s.error for s in self.sources)


def ingest(store: Store, raw: DataFrame, now: datetime, since=None, until=None, tracking=()) -> dict[str, SourceResult]:
    """Normalize raw rows (payload as JSON) and store what is new; per source counts.

    All sources go through as one job; rows stay apart by ``source_name``.
    """
    with store.transaction():
        return _ingest(store, raw, now, since, until, tracking)


def _ingest(store, raw, now, since, until, tracking):
    rows = normalize(raw.withColumn("payload", F.parse_json("payload")), F.lit(now), tracking).checkpoint()
    valid, rejected = validate(rows)
    kept = valid.filter(in_window(F.col("published_at"), None if since is None else F.lit(since), None if until is None else F.lit(until))).checkpoint()
    known = store.read("items").select("canonical_hash")
    first = kept.groupBy("canonical_hash").agg(F.min("source_name").alias("_s"))
    new = kept.join(first, "canonical_hash").filter("source_name = _s").select("source_name", "canonical_hash").distinct().join(known, "canonical_hash", "left_anti").checkpoint()
    ents = kept.select("source_name", "canonical_hash", F.explode("entities").alias("e")).select("source_name", "canonical_hash", "e.kind", "e.value").checkpoint()
    fresh = ents.join(store.read("item_entities").select("canonical_hash", "kind", "value"), ["canonical_hash", "kind", "value"], "left_anti")
    counts, parts = {}, {"fetched": raw, "skipped": rejected, "kept": kept, "new": new, "entities": fresh.dropDuplicates(["canonical_hash", "kind", "value"])}
    told = reduce(DataFrame.unionByName, [df.select("source_name", F.lit(label).alias("label")) for label, df in parts.items()])
    for r in told.groupBy("source_name", "label").count().collect():  # one job, five rows a source
        setattr(counts.setdefault(r["source_name"], SourceResult(r["source_name"])), r["label"], r["count"])
    store.insert_or_ignore("items", kept, [F.col("source_name"), F.col("external_id")])
    store.insert_or_ignore("item_sources", kept, [F.col("first_seen_at"), F.col("external_id")])
    store.insert_or_ignore("item_entities", ents.withColumn("context", F.lit(None).cast("string")), [F.col("source_name")])
    return counts


def _fetched_on_executors(spark: SparkSession, configs: list[dict], cursors: dict, now: datetime, production: bool, **options):
    """(raw rows, state per source) of one read of all sources. What each fetched is
    written before it is used, so a task that runs again does not fetch twice."""
    from ..sources.datasource import STATE, register

    if not configs:
        return None, {}
    register(spark)
    read = spark.read.format("quill_feed").options(config=json.dumps(configs), cursors=json.dumps(cursors), state="true", production=str(production).lower(), **options).load()
    read = materialize(read, "fetched")
    state = {}
    for r in read.filter(F.col("source_type") == STATE).collect():  # one row per source
        s = json.loads(r["payload"])
        state[r["source_name"]] = (s["cursor"], s["unchanged"], s["error"])
    return read.filter(F.col("source_type") != STATE).withColumn("fetched_at", F.lit(now)), state


def scratched(job):
    """A job on a store whose intermediate tables go when it ends (it returns no DataFrame)."""

    @wraps(job)
    def run(store: Store, *args, **kwargs):
        with scratch(store.spark):
            return job(store, *args, **kwargs)

    return run


@scratched
def collect(store: Store, configs: list[dict], client, now: datetime, since=None, until=None, tracking=(), only=(), production: bool = False) -> CollectResult:
    """Fetch every source, store what is new, then move the cursors.

    A failing source is recorded and the others go on. Items and cursors become
    visible together, so a crash fetches again and stores nothing twice.
    Without a ``client`` all sources are one Spark read: executors fetch them, those
    of one host one after another. A client that is given fetches on the driver.
    """
    spark, out = store.spark, CollectResult()
    before = {r["source_name"]: r.asDict() for r in store.source_runs().collect()}
    configs = [c for c in configs if not only or c["name"] in only]
    cursors = {c["name"]: json.loads(before.get(c["name"], {}).get("cursor") or "{}") for c in configs}
    if client is None:
        raw, state = _fetched_on_executors(spark, configs, cursors, now, production)
    else:
        rows, state = [], {}
        for c in configs:
            try:
                found, cursor, unchanged = fetch(c, cursors[c["name"]], client)
                rows += [(c["name"], c["type"], key, payload, now) for key, payload in found]
                state[c["name"]] = (cursor, unchanged, None)
            except Exception as e:
                state[c["name"]] = (cursors[c["name"]], False, error_text(e, production))
        raw = spark.createDataFrame(rows, RAW) if rows else None
    with store.transaction():
        _store_run(store, configs, raw, state, before, now, since, until, tracking, out)
    return out


def _store_run(store: Store, configs, raw, state: dict, before: dict, now, since, until, tracking, out: CollectResult) -> None:
    """Items and the cursors behind them, as one batch."""
    counts = ingest(store, raw, now, since, until, tracking) if raw is not None else {}
    runs, seq = [], store.next_seq("source_runs")
    for c in configs:
        name, old = c["name"], before.get(c["name"], {})
        cursor, unchanged, error = state[name]
        result = counts.get(name, SourceResult(name))
        result.error = error
        out.sources.append(result)
        empties, errors = old.get("consecutive_empty_runs") or 0, old.get("consecutive_error_runs") or 0
        empty = unchanged or result.kept == 0
        runs.append((name, json.dumps(cursor, sort_keys=True), now, old.get("last_success_at") if error else now, error,
                     empties if error else (empties + 1 if empty else 0), errors + 1 if error else 0, seq))
    if runs:
        store.append("source_runs", store.spark.createDataFrame(runs, store._schema("source_runs")))


@scratched
def deduplicate(store: Store, now: datetime, days: int = 7, title=0.92, hours=48, entity_title=0.85, max_pool=None) -> int:
    """Supersede duplicates among the recent items; returns how many lost."""
    items = store.items(since=now - timedelta(days=days))
    scores = store.classified().select("canonical_hash", "score")
    pool = dedupe_candidates(items.drop("score"), scores, store.children("item_entities")).checkpoint()
    pairs = find_duplicates(pool, max_pool=max_pool, title=title, hours=hours, entity_title=entity_title).checkpoint()
    n = pairs.count()
    if n:
        with store.transaction():
            inherited = inherit_sources(pairs.select("loser", F.col("winner").alias("root")), store.read("item_sources")).checkpoint()
            store.insert_or_ignore("item_sources", inherited, [F.col("first_seen_at")])
            store.supersede(pairs)
    return n


def report_entries(store: Store, day: datetime) -> DataFrame:
    """The day's classified items with their sources."""
    start = day.replace(hour=0, minute=0, second=0, microsecond=0)
    return with_sources(classified_between(store.classified(start, start + timedelta(days=1)), F.lit(start), F.lit(start + timedelta(days=1))), store.children("item_sources"))


@scratched
def rebuild_reports(store: Store, vault: str) -> None:
    """The collection reports of all days that have classified items, each day a file
    that one task writes; all of them appear, or none."""
    entries = with_sources(store.classified(), store.children("item_sources"))
    write_reports(collection_reports(entries.withColumn("day", F.date_format("ingested_at", "yyyy-MM-dd"))), f"{vault}/collection")


@scratched
def post_process(store: Store, config, provider, now: datetime, vault=None, prompts=None) -> dict:
    """Classify, deduplicate, render. Without a provider nothing of it runs."""
    if provider is None:
        return {"skipped": "no provider"}
    prompt = system_prompt(config, prompts)
    superseded = store.supersessions().withColumnRenamed("loser", "canonical_hash")
    pending = with_first_source(unclassified(store.items().drop("current_classification_id"), store.active(), superseded, config.max_items_per_run), store.read("item_sources")).orderBy("ingested_at", "canonical_hash")
    rows = classify_table(pending, provider, prompt, config.slugs, batch_size=config.batch_size, token_budget=config.token_budget)
    counts = {r["outcome"]: r["count"] for r in rows.groupBy("outcome").count().collect()}  # three rows at most
    labelled = rows.filter("outcome <> 'skipped'").drop("outcome")
    if counts.keys() - {"skipped"}:
        version = classifier_version(prompt, config.model)
        store.classify(labelled.withColumns({"classifier_version": F.lit(version), "classifier_model": F.lit(provider.model_id), "classified_at": F.lit(now)}))
    lost = deduplicate(store, now, title=config.title_threshold, hours=config.window_hours, entity_title=config.entity_threshold)
    out = {"classified": counts.get("classified", 0), "fallbacks": counts.get("fallback", 0), "skipped": counts.get("skipped", 0), "duplicates": lost}
    if vault:
        path = Path(vault) / "collection" / f"{now:%Y-%m-%d}.md"
        out["report"] = write_atomically(path, collection_report(report_entries(store, now), now.date()))
    return out


def synthesize(store: Store, provider, client, span: Span, now: datetime, vault=None, system: str = "", min_score: int = 5, **limits) -> dict:
    """Run the agent over a window, roll its entities up and render the report."""
    items = classified_between(store.classified(span.start, span.end), F.lit(span.start), F.lit(span.end), min_score).checkpoint()
    listed = [r.asDict() for r in items.orderBy("ingested_at", "canonical_hash").select(F.col("canonical_hash").alias("item_hash"), "title", "url", "summary", "topic", "score").collect()]
    opening = f"Window {span.label}: {span.start.isoformat()} to {span.end.isoformat()}, {len(listed)} item(s).\n\n{json.dumps(listed, ensure_ascii=False)}"
    result = run_agent(provider, Tools(store, client, span, now, min_score), system, opening, **limits)
    ents = store.children("item_entities").join(items.select("canonical_hash", "ingested_at"), "canonical_hash")
    weekly = weekly_entities(ents, week_start(F.lit(span.start))).checkpoint()
    store.add_weekly_entities(weekly)
    text = synthesis_report(span, result.roundup, weekly, store.followups(open_only=True))
    path = write_atomically(Path(vault) / "synthesis" / f"{span.label}.md", text) if vault else None
    return {"items": len(listed), "entities": weekly.count(), "agent": result, "report": path, "text": text}


def status(spark: SparkSession, runs: DataFrame, configured: list[str], now: datetime, stale_days: int = 7, fail_after: int = 0) -> tuple[DataFrame, bool]:
    """Health of all configured and seen sources, and whether the gate fails."""
    names = spark.createDataFrame([(c,) for c in configured], "source_name string").distinct()
    label = F.when(F.col("_run").isNull(), "never run").otherwise(health_label(F.col("consecutive_error_runs"), F.col("last_success_at"), F.lit(now), stale_days))
    table = all_sources(names, runs).withColumn("health", label).drop("_run").orderBy("source_name")
    return table, not failing(runs, fail_after).isEmpty()
