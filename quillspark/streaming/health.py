"""Source health as state with timers: a source that falls silent turns STALE by itself."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HEALTH = "source_name string, consecutive_error_runs long, consecutive_empty_runs long, last_success_at timestamp, health string"
DAY_MS = 86_400_000


class SourceHealth(StatefulProcessor):
    """Counters of one source over its runs (seq, failed, empty, ts), in order of seq
    within a micro-batch; a run counts once, whatever batch it comes in.

    A row goes out for every micro-batch with runs of the source, and one more when
    its last success has become older than ``stale_days`` whole days of processing
    time. Labels are those of :func:`quillspark.operators.relational.health_label`.
    """

    def __init__(self, stale_days: int, day_ms: int = DAY_MS):
        self.stale_ms = (stale_days + 1) * day_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "errors long, empties long, success long, seq long")

    def _row(self, key, errors, empties, success, now_ms):
        stale = success is not None and now_ms >= success // 1000 + self.stale_ms
        label = "FAILING" if errors else "no success yet" if success is None else "STALE" if stale else "ok"
        at = pd.NaT if success is None else pd.Timestamp(success * 1000)
        return pd.DataFrame({"source_name": [key[0]], "consecutive_error_runs": [errors], "consecutive_empty_runs": [empties], "last_success_at": pd.Series([at], dtype="datetime64[ns]"), "health": [label]})

    def handleInputRows(self, key, rows, timerValues):
        errors, empties, success, seen = self.counts.get() if self.counts.exists() else (0, 0, None, None)
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            if seen is not None and r.seq <= seen:
                continue
            seen, errors = int(r.seq), errors + 1 if r.failed else 0
            if not r.failed:
                empties, success = empties + 1 if r.empty else 0, int(r.ts.value // 1000)
        self.counts.update((errors, empties, success, seen))
        now = timerValues.getCurrentProcessingTimeInMs()
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if success is not None and success // 1000 + self.stale_ms > now:
            self.handle.registerTimer(success // 1000 + self.stale_ms)
        yield self._row(key, errors, empties, success, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        errors, empties, success, _ = self.counts.get()
        yield self._row(key, errors, empties, success, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def stream_health(runs: DataFrame, stale_days: int = 7, day_ms: int = DAY_MS) -> DataFrame:
    """(HEALTH) over a stream of (source_name, seq, failed, empty, ts), in update mode.
    Needs the RocksDB state store and a trigger that goes on without new runs."""
    return runs.groupBy("source_name").transformWithStateInPandas(SourceHealth(stale_days, day_ms), HEALTH, "Update", "ProcessingTime")
