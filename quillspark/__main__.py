"""Command line: collect, status, validate-config, synthesize."""

import argparse
import hashlib
import os
import sys
from datetime import UTC, datetime
from pathlib import Path

from .operators.providers import make_agent, make_classifier
from .operators.store import Store
from .plans import pipeline, reports
from .session import build_session
from .sources.config import ConfigError, load_agent, load_sources
from .sources.http import PacedClient


def _when(text: str | None):
    if text is None:
        return None
    at = datetime.fromisoformat(text)
    return at if at.tzinfo else at.replace(tzinfo=UTC)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspark")
    sub = p.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--sources", default="sources.yaml")
    common.add_argument("--agent", default="agent.yaml")
    common.add_argument("--db", default="quill-store")
    common.add_argument("--vault")
    c = sub.add_parser("collect", parents=[common])
    c.add_argument("--source", action="append", default=[])
    c.add_argument("--since")
    c.add_argument("--until")
    c.add_argument("--fail-on-error", action="store_true")
    s = sub.add_parser("status", parents=[common])
    s.add_argument("--stale-days", type=int, default=7)
    s.add_argument("--fail-after", type=int, default=0)
    sub.add_parser("validate-config", parents=[common])
    y = sub.add_parser("synthesize", parents=[common])
    y.add_argument("--since")
    y.add_argument("--days", type=int)
    y.add_argument("--max-turns", type=int, default=20)
    return p


def _production() -> bool:
    """In production logs are public: names and messages are replaced by digests."""
    return os.environ.get("QUILL_LOG_MODE") == "production"


def _shown(name: str) -> str:
    return f"src#{hashlib.sha256(name.encode()).hexdigest()[:8]}" if _production() else name


def guarded(argv=None) -> int:
    """:func:`main`; in production an unexpected error shows its class and a digest only."""
    try:
        return main(argv)
    except Exception as e:
        if not _production():
            raise
        print(f"fatal: {pipeline.error_text(e, True)}", file=sys.stderr)
        return 1


def main(argv=None, spark=None, client=None, provider=None, agent_provider=None, now=None, out=print) -> int:
    """Exit status: 0 done, 1 a gate failed, 2 a configuration or date is wrong."""
    args = _parser().parse_args(argv)
    now = now or datetime.now(UTC)
    try:
        if args.command == "validate-config":
            out(f"sources: {len(load_sources(args.sources))} ok")
            out(f"topics: {len(load_agent(args.agent).taxonomy)} ok")
            return 0
        since, until = _when(getattr(args, "since", None)), _when(getattr(args, "until", None))
        configs = load_sources(args.sources) if args.command == "collect" else []
        config = load_agent(args.agent) if Path(args.agent).exists() else None
        if args.command == "synthesize" and config is None:
            raise ConfigError(f"config not found: {args.agent}")
        if unknown := set(getattr(args, "source", [])) - {c["name"] for c in configs}:
            raise ConfigError(f"unknown source(s): {sorted(unknown)}")
    except (ConfigError, ValueError) as e:
        out(f"error: {e}")
        return 2
    if args.command == "status" and not Path(args.db).exists():
        out("nothing collected yet")
        return 0
    if args.command == "synthesize" and not Path(args.db).exists():
        out(f"error: no store at {args.db}")
        return 2
    agent_provider = agent_provider or (make_agent() if args.command == "synthesize" else None)
    if args.command == "synthesize" and agent_provider is None:
        out("no synthesis provider: skipped")
        return 0
    store = Store(spark or build_session(), args.db if "://" in args.db else f"file://{Path(args.db).resolve()}")
    if args.command == "collect":
        result = pipeline.collect(store, configs, client, now, since, until, config.tracking if config else (), args.source, _production())
        for s in result.sources:
            out(f"{_shown(s.name)}: fetched {s.fetched}, new {s.new}, entities {s.entities}, skipped {s.skipped}" + (f", error {s.error}" if s.error else ""))
        out(f"total new: {result.stored_new}")
        if config is not None:
            provider = provider or (make_classifier(store.spark, config.provider, config.model) if config.provider != "anthropic" else None)
            out(str(pipeline.post_process(store, config, provider, now, args.vault or config.vault_path)))
        return int(args.fail_on_error and result.any_error)
    if args.command == "status":
        try:
            names = [c["name"] for c in load_sources(args.sources)]
        except ConfigError:
            names = []
        table, failing = pipeline.status(store.spark, store.source_runs(), names, now, args.stale_days, args.fail_after)
        for r in table.collect():
            out(f"{_shown(r['source_name'])}: {r['health']}")
        return int(failing)
    span = reports.trailing(now, args.days) if args.days else reports.between(since, now) if since else reports.trailing(now, 7)
    done = pipeline.synthesize(store, agent_provider, client or PacedClient(), span, now, args.vault or config.vault_path, max_turns=args.max_turns)
    out(f"{span.label}: {done['items']} item(s), {done['entities']} entities, stopped by {done['agent'].stop}")
    return 0


if __name__ == "__main__":
    sys.exit(guarded())
