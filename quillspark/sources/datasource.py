"""The source types as Spark data sources, for batch and streaming reads.

``spark.read.format("quill_feed").option("config", json)`` reads once. As a stream all
sources are polled together, at most once in ``pollSeconds``: the offset is the number
of the poll and the cursors that it starts from, executors fetch, one partition per
host, and what they got goes to the folder ``polls`` before any row is handed on. A
batch that runs again reads that folder and fetches nothing.
Option ``replies`` names a JSON file of canned replies (tests, replays). With option
``state`` every source adds one row of type STATE: its new cursor, whether nothing
changed, and its error, which then does not end the read.
"""

import hashlib
import json
import time
import uuid
from pathlib import Path

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .adapters import error_text, fetch, requested_host
from .config import check_source
from .http import PacedClient, Response

STATE = "_state"
SCHEMA = "source_name string, source_type string, external_id string, payload string"


class CannedClient:
    """Replies by the first URL prefix that fits, in order of use."""

    def __init__(self, path: str):
        self.replies = json.loads(Path(path).read_text(encoding="utf-8"))
        self.asked = []

    def get(self, url, headers=None):
        self.asked.append((url, headers or {}))
        for r in self.replies:
            if url.startswith(r["url"]):
                return Response(r.get("status", 200), r.get("headers", {}), body=(r["body"] if isinstance(r["body"], str) else json.dumps(r["body"])).encode())
        return Response(404)


def _client(options):
    return CannedClient(options["replies"]) if "replies" in options else PacedClient(max_bytes=int(options.get("maxResponseBytes", 10 << 20)))


def _rows(config, found):
    for key, payload in found:
        yield (config["name"], config["type"], key, payload)


def _state_row(config, cursor, unchanged, error):
    return (config["name"], STATE, None, json.dumps({"cursor": cursor, "unchanged": unchanged, "error": error}, sort_keys=True))


def by_host(options) -> list[InputPartition]:
    """One partition for all sources that ask one host, so that its start times hold."""
    configs = json.loads(options["config"])
    hosts: dict[str, list] = {}
    for c in map(check_source, configs if isinstance(configs, list) else [configs]):
        hosts.setdefault(requested_host(c), []).append(c)
    return [InputPartition((host, group)) for host, group in hosts.items()]


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return by_host(self.options)

    def read(self, partition):
        client, state = _client(self.options), self.options.get("state") == "true"
        cursors = json.loads(self.options.get("cursors", "{}"))
        for config in partition.value[1]:
            cursor, unchanged, error = cursors.get(config["name"], {}), False, None
            try:
                rows, cursor, unchanged = fetch(config, cursor, client)
                yield from _rows(config, rows)
            except Exception as e:
                if not state:
                    raise
                error = error_text(e, self.options.get("production") == "true")
            if state:
                yield _state_row(config, cursor, unchanged, error)


class PollLog:
    """What polls fetched: one file per poll and host, on any file system, whole or not there."""

    def __init__(self, uri: str):
        self.fs, self.root = fs.FileSystem.from_uri(uri)

    def _file(self, poll: int, host: str) -> str:
        return f"{self.root}/{poll:012d}/{hashlib.sha256(host.encode()).hexdigest()[:16]}.json"

    def _read(self, path: str):
        with self.fs.open_input_stream(path) as f:
            return json.loads(f.read())

    def load(self, poll: int, host: str):
        path = self._file(poll, host)
        return self._read(path) if self.fs.get_file_info(path).type == fs.FileType.File else None

    def save(self, poll: int, host: str, found: list) -> None:
        path = self._file(poll, host)
        part = f"{path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(f"{self.root}/{poll:012d}", recursive=True)
        with self.fs.open_output_stream(part) as f:
            f.write(json.dumps(found).encode())
        self.fs.move(part, path)

    def polls(self) -> list[int]:
        found = self.fs.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        return sorted(int(f.base_name) for f in found if f.type == fs.FileType.Directory and f.base_name.isdigit())

    def cursors(self, poll: int) -> dict:
        """The cursor of every source after a poll."""
        files = self.fs.get_file_info(fs.FileSelector(f"{self.root}/{poll:012d}", allow_not_found=True))
        return {s["config"]["name"]: s["cursor"] for f in files if f.path.endswith(".json") for s in self._read(f.path)}

    def forget_before(self, poll: int) -> None:
        for old in self.polls():
            if old < poll:
                self.fs.delete_dir(f"{self.root}/{old:012d}")


class _Stream(DataSourceStreamReader):
    def __init__(self, options):
        self.options = dict(options)
        self.every = float(options.get("pollSeconds", 60))
        self.offset, self.polled = None, None

    def initialOffset(self):
        return {"poll": 0, "cursors": {}}

    def latestOffset(self):
        log = PollLog(self.options["polls"])
        last = max([0, *log.polls()])
        now = time.monotonic()
        if self.offset is not None and (last < self.offset["poll"] or now - self.polled < self.every):
            return self.offset  # that poll has not been read yet, or it was just now
        known = self.offset["cursors"] if self.offset else {}
        self.offset, self.polled = {"poll": last + 1, "cursors": {**known, **log.cursors(last)}}, now
        return self.offset

    def partitions(self, start, end):
        return [InputPartition((end["poll"], end["cursors"], *p.value)) for p in by_host(self.options)]

    def read(self, partition):
        poll, cursors, host, configs = partition.value
        log, production = PollLog(self.options["polls"]), self.options.get("production") == "true"
        found = log.load(poll, host)
        if found is None:
            client, found = _client(self.options), []
            for config in configs:
                before = cursors.get(config["name"], {})
                own = {k: v for k, v in before.items() if k != "_seen"}
                try:
                    rows, cursor, unchanged = fetch(config, own, client)
                    # a source without a cursor of its own advances by what it returned
                    seen = hashlib.sha256(json.dumps(rows).encode()).hexdigest()
                    if cursor == own and seen == before.get("_seen"):
                        rows, unchanged = [], True
                    found.append({"config": config, "rows": rows, "cursor": cursor | {"_seen": seen}, "unchanged": unchanged, "error": None})
                except Exception as e:  # recorded, the other sources go on
                    found.append({"config": config, "rows": [], "cursor": before, "unchanged": False, "error": error_text(e, production)})
            log.save(poll, host, found)
        for source in found:
            yield from _rows(source["config"], source["rows"])
            if self.options.get("state") == "true":
                yield _state_row(source["config"], source["cursor"], source["unchanged"], source["error"])

    def commit(self, end):
        PollLog(self.options["polls"]).forget_before(end["poll"])


class FeedSource(DataSource):
    @classmethod
    def name(cls):
        return "quill_feed"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedSource)
