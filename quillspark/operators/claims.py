"""The greedy choice of duplicates without listing a pair.

Rows are walked best first. Winners of one title lie further apart than the window,
so a title's winners are a sparse, ordered set of times, and whether a row is claimed
is a look at its neighbours in the sets of its own and of similar titles. Titles that
are linked by similarity are walked together. Where a group has more than LOCAL_ROWS
rows, its time line is cut into slabs that are walked side by side: a row that a
better one across a border might claim stays open, and rounds go on until none is.
"""

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Rows of linked titles that one task walks at once (a slab has one window of time at least).
LOCAL_ROWS = 2_000_000

#: States of a row: undecided, claimed by a winner not yet known, winner, claimed; time of rows without one.
OPEN, LOST, WON, CLAIMED = "?", "l", "W", "L"
UNDATED = -(1 << 62)
ROW = "root string, slab long, t string, at long, strong array<string>, s int, p long, h string, state string, winner string"


class _Title:
    """Winners of one title by time, and open rows better than those still to come."""

    def __init__(self):
        self.times, self.winners = [], {}
        self.undated, self.by_entity, self.undated_by_entity = None, {}, {}
        self.first = None
        self.open_times, self.open_undated, self.open_first = [], None, None

    def win(self, order, at, strong):
        self.first = self.first or order
        if at is None:
            self.undated = self.undated or order
            for e in strong:
                self.undated_by_entity.setdefault(e, order)
        else:
            if at not in self.winners:
                insort(self.times, at)
                self.winners[at] = (order, strong)
        for e in strong:
            self.by_entity.setdefault(e, order)

    def leave_open(self, order, at):
        self.open_first = self.open_first or order
        if at is None:
            self.open_undated = self.open_undated or order
        else:
            insort(self.open_times, (at, order))

    def claims(self, at, strong, plain: bool, reach: int):
        """Winners (their order) that claim a row at ``at``; ``plain`` titles are
        similar enough without a shared entity."""
        if at is None:
            return [self.first] if plain and self.first else [] if plain else [self.by_entity[e] for e in strong if e in self.by_entity]
        found = [self.undated] if plain and self.undated else [] if plain else [self.undated_by_entity[e] for e in strong if e in self.undated_by_entity]
        for k in range(bisect_left(self.times, at - reach), len(self.times)):
            if self.times[k] > at + reach:
                break
            order, own = self.winners[self.times[k]]
            if plain or not strong.isdisjoint(own):
                found.append(order)
        return found

    def open_before(self, at, reach: int, order):
        """Whether an open row better than ``order`` might claim a row at ``at``."""
        if at is None:
            return self.open_first is not None and self.open_first < order
        if self.open_undated is not None and self.open_undated < order:
            return True
        for k in range(bisect_left(self.open_times, (at - reach,)), len(self.open_times)):
            if self.open_times[k][0] > at + reach:
                break
            if self.open_times[k][1] < order:
                return True
        return False


def _walk(reach: int):
    """Turns rows sorted by (root, slab, rank), each group led by its links, into the
    group's own rows with their states."""

    def run(batches):
        group, links, titles, last = None, {}, {}, None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if group != (r.root, r.walk):
                    group, links, titles, last = (r.root, r.walk), {}, {}, None
                if r.other is not None:
                    links.setdefault(r.t, []).append((r.other, bool(r.plain)))
                    continue
                at, strong = None if r.at == UNDATED else int(r.at), frozenset(r.strong)
                order, own, state, winner = (int(r.s), int(r.p), r.h), r.slab == r.walk, r.state, r.winner
                if last == (order, r.t):  # the same row again
                    continue
                last = (order, r.t)
                if own and state in (OPEN, LOST):
                    near = [(titles[y], plain) for y, plain in [(r.t, True), *links.get(r.t, ())] if y in titles]
                    best = min((w for title, plain in near for w in title.claims(at, strong, plain, reach) if w[2] != r.h), default=None)
                    doubtful = any(title.open_before(at, reach, best or order) for title, _ in near)
                    if best is not None:
                        state, winner = (LOST, None) if doubtful else (CLAIMED, best[2])
                    elif not doubtful:
                        state = WON
                if state in (OPEN, WON):
                    title = titles.get(r.t)
                    if title is None:
                        title = titles[r.t] = _Title()
                    if state == WON:
                        title.win(order, at, strong)
                    else:
                        title.leave_open(order, at)
                if own:
                    out.append((r.root, r.slab, r.t, r.at, list(strong), *order, state, winner))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ROW.split(", ")])

    return run


def claim(rows: DataFrame, titles: DataFrame, hours: int, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(loser, winner) of ``rows`` (t, published_at, strong, rank, root).

    ``titles`` (root, t, other, plain) links similar titles from both sides; a link
    that is not ``plain`` holds for rows that share an entity of ``strong``. ``root``
    names the group of linked titles. A row without a date is close to every row, so a
    group with such rows is walked by one task, which holds its winners only.
    """
    reach, width = hours * 3_600_000_000, max(1, hours * 3_600_000_000)
    at = F.coalesce(F.unix_micros("published_at"), F.lit(UNDATED))
    size = rows.groupBy("root").agg(F.count("*").alias("n"), F.count("published_at").alias("dated"))
    sized = materialize(size.filter("n > 1"), "claim-groups")
    cell = F.floor(F.col("at") / width)
    todo = rows.join(sized, "root").select("root", "t", at.alias("at"), "strong", "rank.s", "rank.p", "rank.h", ((F.col("n") > local_rows) & (F.col("n") == F.col("dated"))).alias("cut"))
    todo = materialize(todo.withColumn("cell", F.when(F.col("cut"), cell).otherwise(0)), "claim-rows")
    up = Window.partitionBy("root").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    slabs = todo.filter("cut").groupBy("root", "cell").agg(F.count("*").alias("n")).withColumn("slab", F.floor(F.coalesce(F.sum("n").over(up), F.lit(0)) / local_rows)).select("root", "cell", "slab")
    slabs = materialize(slabs, "claim-slabs")
    cut = not slabs.isEmpty()
    todo = todo.join(slabs, ["root", "cell"], "left").select("root", F.coalesce("slab", F.lit(0)).alias("slab"), "t", "at", "strong", "s", "p", "h", F.lit(OPEN).alias("state"), F.lit(None).cast("string").alias("winner"))
    links = titles.join(sized.select("root"), "root", "left_semi")
    done = None
    while True:
        walked = todo.withColumn("walk", F.col("slab"))
        if cut:
            # rows within one window of a border are also shown to the slab across it
            beside = slabs.select("root", F.explode(F.array(F.col("cell") - 1, F.col("cell") + 1)).alias("cell"), F.col("slab").alias("walk"))
            seen = todo.withColumn("cell", cell).join(beside, ["root", "cell"]).filter("walk <> slab").select(*todo.columns, "walk").distinct()
            walked = walked.unionByName(seen)
        lead = links.join(walked.select("root", "walk").distinct(), "root").select("root", "walk", "t", "other", "plain", *[F.lit(0).alias(c) for c in ("slab", "at", "s", "p")])
        stream = walked.unionByName(lead, allowMissingColumns=True).repartition("root", "walk")
        stream = stream.sortWithinPartitions("root", "walk", F.col("other").isNull(), "s", "p", "h")
        result = materialize(stream.mapInPandas(_walk(reach), ROW), "claimed")
        found = result.filter(F.col("state") == CLAIMED).select(F.col("h").alias("loser"), "winner")
        done = found if done is None else done.unionByName(found)
        if not cut:
            return done
        waiting = materialize(result.filter(F.col("state").isin(OPEN, LOST)).select("root").distinct(), "claims-open")
        if waiting.isEmpty():
            return done
        todo = result.filter(F.col("state") != CLAIMED).join(waiting, "root", "left_semi")
