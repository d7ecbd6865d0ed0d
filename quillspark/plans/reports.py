"""Markdown reports. Spark orders and groups the rows; the driver assembles the
text, which is a pure function of those rows."""

import os
import tempfile
from datetime import date, datetime, timedelta
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import markdown_cell, secondary_suffix
from ..operators.relational import followup_order, topic_groups

SCHEMA_VERSION, RENDERER_VERSION = 2, 1
#: Headings of entity kinds.
HEADINGS = {"cve": "CVEs", "repo": "Repos", "package": "Packages", "project": "Projects", "person": "People", "technique": "Techniques", "venue": "Venues"}


class Span(NamedTuple):
    """A half-open time window with the label that names its report."""

    start: datetime
    end: datetime
    label: str


def iso_week(monday: datetime) -> Span:
    year, week, _ = monday.isocalendar()
    return Span(monday, monday + timedelta(days=7), f"W{year}-W{week:02d}")


def trailing(end: datetime, days: int) -> Span:
    return Span(end - timedelta(days=days), end, f"D{end:%Y-%m-%d}-{days}d")


def between(start: datetime, end: datetime) -> Span:
    return Span(start, end, f"R{start:%Y-%m-%d}-to-{end:%Y-%m-%d}")


def front_matter(data: dict) -> str:
    import yaml

    return "---\n" + yaml.safe_dump(data, sort_keys=True, default_flow_style=False, allow_unicode=True) + "---\n"


def write_atomically(path: Path, content: str) -> Path:
    """All or nothing: written beside the target, then renamed onto it."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with open(handle, "w", encoding="utf-8", newline="\n") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise
    return path


def collection_lines(entries: DataFrame) -> DataFrame:
    """(topic, n, topic_place, place, block): every entry as a finished Markdown block.

    ``entries``: canonical_hash, title, url, score, topic, secondary_topics,
    rationale, published_at, sources (array of names).
    """
    return topic_groups(entries).select("topic", "n", "topic_place", "place", entry_block().alias("block"))


def entry_block():
    names = F.array_join(F.array_sort(F.array_distinct("sources")), ", ")
    return F.concat(
        F.lit("### ["), "title", F.lit("]("), "url", F.lit(") — score "), F.col("score").cast("string"), secondary_suffix("secondary_topics"),
        F.lit("\n> "), "rationale", F.when(names != "", F.concat(F.lit("\n- **Sources:** "), names)).otherwise(""),
        F.when(F.col("published_at").isNotNull(), F.concat(F.lit("\n- **Published:** "), F.date_format("published_at", "yyyy-MM-dd"))).otherwise(""))


def collection_report(entries: DataFrame, day: date) -> str:
    """The report as text; entries come to the driver partition by partition."""
    counts, body, at = {}, [], None
    for r in collection_lines(entries).orderBy("topic_place", "place").toLocalIterator():
        if r["topic"] != at:
            at = r["topic"]
            counts[at] = r["n"]
            body.append(f"\n## {at} ({r['n']})\n")
        body.append(f"\n{r['block']}\n")
    return collection_head(day.isoformat(), counts) + ("".join(body) if body else "\n_No items collected._\n")


def collection_head(day: str, counts: dict[str, int]) -> str:
    head = front_matter({"date": day, "type": "collection-report", "schema_version": SCHEMA_VERSION, "renderer_version": RENDERER_VERSION,
                         "counts": {"by_topic": counts, "total": sum(counts.values())}})
    return f"{head}\n\n# Collection — {day}\n"


def synthesis_report(span: Span, body: str, entities: DataFrame, followups: DataFrame) -> str:
    """``entities``: kind, value, context; ``followups``: all, with ``completed``."""
    rows = entities.select("kind", "value", markdown_cell("context").alias("cell")).orderBy("kind", "value").collect()
    todo = followups.orderBy(*followup_order()).select("action", "item_title_snapshot", "item_url_snapshot", "note", "completed").collect()
    kinds = list(dict.fromkeys(r["kind"] for r in rows))
    head = front_matter({
        "type": "synthesis-report", "schema_version": SCHEMA_VERSION, "renderer_version": RENDERER_VERSION,
        "window": {"start": span.start.isoformat(), "end": span.end.isoformat(), "label": span.label},
        "entity_counts": {k: sum(r["kind"] == k for r in rows) for k in kinds}, "followup_count": len(todo)})
    text = body.rstrip() if body.strip() else "_(no agent body)_"
    out = f"{head}\n\n# Synthesis — {span.label}\n\n{text}\n\n\n## Entities\n\n"
    if rows:
        tables = ["\n".join([f"### {HEADINGS.get(k, k)}\n\n| Value | Context |\n|---|---|", *[f"| {r['value']} | {r['cell']} |" for r in rows if r["kind"] == k]]) for k in kinds]
        out += "\n\n".join(tables) + "\n"
    else:
        out += "_None extracted in this window._\n"
    out += "\n\n## Followups\n\n"
    still = [f for f in todo if not f["completed"]]
    if not still:
        return out + ("_All caught up._" if todo else "_None queued._") + "\n\n"
    for f in still:
        note = f" — {f['note']}" if f["note"] else ""
        out += f"- **[{f['action']}]** [{f['item_title_snapshot']}]({f['item_url_snapshot']}){note}\n"
    return out + "\n"
