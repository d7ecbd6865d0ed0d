"""Fuzzy deduplication of items: the best-ranked duplicate wins.

Two items are duplicates if they were published close enough together and their
titles are similar enough; sharing a strong entity lowers the bar. Winners are
chosen greedily in rank order and claim their direct duplicates (stars, not
chains). Similar titles meet on pieces of the longer one of which one must be whole in
the other, so no pair is lost, and are compared once each. Winners claim on the time
line of their title and of similar ones (:mod:`.claims`); pairs of rows are listed on
request only.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import close_in_time
from ..functions.similarity import indel_at_least, indel_ratio
from ..functions.text import strip
from ..session import materialize
from .claims import LOCAL_ROWS, claim
from .components import components
from .relational import pairs_within, row_numbers, strong_overlap

#: Pairs of a group of linked items that one task decides.
LOCAL_PAIRS = 50_000
#: Letters of the pieces of titles below which the titles of a group are all compared;
#: places of a title that are one key of the join on pieces.
SHORT, PLACES = 4, 16
#: Letters and how many of each are counted, in two longs; none named: all others.
LETTERS = [[(" eationshr", 6)], [("bcdfgjklmpquvwxyz", 3), ("", 6)]]


def ranked(candidates: DataFrame) -> DataFrame:
    """Adds ``rank``, a struct that sorts by score down, published up (null last), hash up."""
    return candidates.withColumn("rank", F.struct(
        (-F.col("score")).alias("s"), F.coalesce(F.unix_micros("published_at"), F.lit((1 << 63) - 1)).alias("p"), F.col("canonical_hash").alias("h")))


def _letters(t: Column) -> list[Column]:
    """Two longs with a bit per letter and count, up to the count that LETTERS has for it:
    two titles differ in no more bits than letters must be put in or taken out."""
    left, out = F.length(t), []
    for kinds in LETTERS:
        word, at = F.lit(0).cast("long"), 0
        for letters, most in kinds:
            for letter in letters or [""]:
                n = F.length(t) - F.length(F.replace(t, F.lit(letter))) if letter else left
                left = left - n if letter else left
                ones = F.call_function("shiftleft", F.lit(1).cast("long"), F.least(n, F.lit(most))) - F.lit(1)
                word, at = word + F.call_function("shiftleft", ones, F.lit(at)), at + most
        out.append(word)
    return out


def _may_reach(x: Column, y: Column, bar: float) -> Column:
    """Whether lengths and letters leave it open that two titles reach ``bar``."""
    least = F.bit_count(x["s1"].bitwiseXOR(y["s1"])) + F.bit_count(x["s2"].bitwiseXOR(y["s2"]))
    return F.greatest(least, F.abs(x["n"] - y["n"])) <= (1 - bar) * (x["n"] + y["n"]) + 1e-6


def _similar(titles: DataFrame, bar: float, group: str | None = None) -> DataFrame:
    """Candidates (x, y), x < y, among all titles, or those that agree in ``group``: every
    pair of different titles that reach ``bar``, and some that do not."""
    keys = [group] if group else []
    s1, s2 = _letters(F.col("t"))
    stored = materialize(titles.select(*keys, "t").distinct().select(*keys, "t", F.length("t").alias("n"), s1.alias("s1"), s2.alias("s2")), "title-letters")
    reach = 2 * (1 - bar)
    if reach >= 1 or group and reach > 1 / SHORT:
        # pieces as short as these are in most titles
        named = stored if group else stored.withColumn("_all", F.lit(0))
        met = pairs_within(named, group or "_all", "t").filter(_may_reach(F.col("l"), F.col("r"), bar))
        return met.select(F.least("l.t", "r.t").alias("x"), F.greatest("l.t", "r.t").alias("y")).distinct()
    edits = lambda n: F.floor(n * reach + 1e-9)
    size = lambda n: F.floor(n / (edits(n) + 1)).cast("int")
    n, p = F.col("n"), F.col("p")
    # the longer title is cut into one piece more than letters can change: one is whole in the other
    cut = stored.filter(edits(n) >= 1).withColumn("p", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), edits(n)), lambda i: (F.floor(i * n / (edits(n) + 1)) + 1).cast("int"))))
    cut = cut.withColumn("token", F.xxhash64(F.substring("t", p, size(n))))
    places = F.sequence(F.floor((p - edits(n)) / PLACES), F.floor((p + F.floor(n * (1 - bar) + 1e-9)) / PLACES))
    long = cut.select(*keys, "token", F.explode(places).alias("place"), F.struct("t", "n", "s1", "s2", "p").alias("l"))
    sizes = F.array_distinct(F.transform(F.sequence(n, F.floor(n * ((2 - bar) / bar) + 1e-9).cast("int")), size))
    probes = stored.withColumn("q", F.explode(sizes)).filter("q BETWEEN 1 AND n").withColumn("p", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("q") + 1)))
    short = probes.select(*keys, F.xxhash64(F.substring("t", p, F.col("q"))).alias("token"), F.floor(p / PLACES).alias("place"), F.struct("t", "n", "s1", "s2", "p").alias("r"))
    x, y = F.col("l"), F.col("r")
    most, shift, by = F.floor((1 - bar) * (x["n"] + y["n"]) + 1e-6), y["p"] - x["p"], x["n"] - y["n"]
    met = long.join(short.hint("merge"), [*keys, "token", "place"]).filter(
        ((by > 0) | (by == 0) & (x["t"] > y["t"])) & (2 * shift >= -(most + by)) & (2 * shift <= most - by) & _may_reach(x, y, bar))
    return met.select(F.least("l.t", "r.t").alias("x"), F.greatest("l.t", "r.t").alias("y")).distinct()


def similar_titles(titles: DataFrame, strong: DataFrame, title: float, low: float) -> DataFrame:
    """Stored (x, y, likeness), x < y, of different titles that reach ``title``, or
    ``low`` where they stand with one entity (``strong``: t, entity)."""
    found = _similar(titles, title)
    if low < title:
        found = found.unionByName(_similar(strong, low, "entity")).distinct()
    alike = found.withColumn("bar", F.lit(float(low))).filter(indel_at_least("x", "y", "bar"))
    return materialize(alike.select("x", "y", indel_ratio("x", "y").alias("likeness")), "title-likeness")


def duplicate_pairs(candidates: DataFrame, title: float = 0.92, entity_title: float = 0.85, hours: int = 48, strong_kinds=("cve",)) -> DataFrame:
    """(better, worse, better_rank) of all duplicate pairs, each once.

    ``candidates``: canonical_hash, title, published_at, score, entities. A row
    without a date is close to every row. Titles are compared once, however many
    rows have them: pairs above ``title`` among all, pairs above ``entity_title``
    among those that share a strong entity. Rows without a title are left out.
    """
    width = max(1, hours * 3600)
    rows = materialize(ranked(candidates).withColumn("t", F.lower(strip("title"))).filter("t IS NOT NULL").select(
        "canonical_hash", "t", "published_at", "entities", "rank", F.floor(F.unix_micros("published_at") / (width * 1_000_000)).alias("b")), "dedupe-rows")
    low = min(title, entity_title)
    strong = rows.select("t", F.explode(F.filter("entities", lambda e: e["kind"].isin(*strong_kinds))).alias("e")).select("t", F.concat_ws(":", "e.kind", "e.value").alias("entity"))
    alike = similar_titles(rows.select("t"), strong, title, low)
    both = materialize(alike.unionByName(alike.select(F.col("y").alias("x"), F.col("x").alias("y"), "likeness")), "title-pairs").unionByName(
        rows.select(F.col("t").alias("x"), F.col("t").alias("y"), F.lit(1.0).alias("likeness")).distinct())

    def side(df, name, *more):
        return df.select(*[F.col(c).alias(f"{name}_{c}") for c in ("canonical_hash", "t", "published_at", "entities", "rank")], *more)

    near = F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("jb")
    dated = side(rows.filter("b IS NOT NULL"), "z", F.col("b").alias("jb"))
    left = side(rows.filter("b IS NOT NULL"), "a", near)
    pairs = left.join(both, F.col("a_t") == F.col("x")).join(dated, (F.col("y") == F.col("z_t")) & (left["jb"] == dated["jb"])).drop("jb")
    undated = side(rows.filter("b IS NULL"), "a").join(both, F.col("a_t") == F.col("x")).join(side(rows, "z", F.col("b").isNotNull().alias("dated")), F.col("y") == F.col("z_t"))
    pairs = pairs.withColumn("dated", F.lit(False)).unionByName(undated)
    bar = F.when(strong_overlap(F.col("a_entities"), F.col("z_entities"), strong_kinds), low).otherwise(title)
    first = F.col("a_rank") < F.col("z_rank")
    # two dated or two undated rows meet from both sides; the better one's is taken
    same = pairs.filter((first | F.col("dated")) & (F.col("a_canonical_hash") != F.col("z_canonical_hash")) & (F.col("likeness") >= bar)
                        & close_in_time(F.col("a_published_at"), F.col("z_published_at"), hours))
    choose = lambda yes, no: F.when(first, F.col(yes)).otherwise(F.col(no))
    return same.select(choose("a_canonical_hash", "z_canonical_hash").alias("better"), choose("z_canonical_hash", "a_canonical_hash").alias("worse"), choose("a_rank", "z_rank").alias("better_rank")).distinct()


def star_winners(pairs: DataFrame) -> DataFrame:
    """(loser, winner) of the greedy choice over (better, worse, better_rank).

    Linked items are decided together: a component of at most LOCAL_PAIRS pairs by
    one walk in rank order, a larger one by rounds over all of its pairs.
    """
    edges = materialize(pairs.select("better", "worse", "better_rank"), "duplicate-pairs")
    roots = components(edges.select(F.col("better").alias("a"), F.col("worse").alias("b")))
    placed = materialize(edges.join(roots, F.col("better") == F.col("node")).drop("node"), "placed-pairs")
    large = materialize(placed.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > LOCAL_PAIRS).select("root"), "large-components")

    def walk(rows):
        claimed, out = set(), []
        by = {}
        for better, worse, rank in zip(rows["better"], rows["worse"], rows["better_rank"]):
            by.setdefault((rank["s"], rank["p"], rank["h"], better), []).append(worse)
        for key in sorted(by):
            if key[3] not in claimed:
                taken = [w for w in by[key] if w not in claimed]
                claimed.update(taken)
                out += [(w, key[3]) for w in taken]
        return pd.DataFrame(out, columns=["loser", "winner"])

    done = placed.join(large, "root", "left_anti").groupBy("root").applyInPandas(walk, "loser string, winner string")
    if large.isEmpty():
        return done
    return done.unionByName(_by_rounds(materialize(placed.join(large, "root", "left_semi"), "large-pairs")))


def _by_rounds(edges: DataFrame) -> DataFrame:
    """A node loses once a better neighbour has won, and wins once all its better
    neighbours have lost; rounds go on until all are decided. A loser belongs to
    its best-ranked winning neighbour."""
    nodes = edges.select(F.col("better").alias("node")).union(edges.select("worse")).distinct()
    state = materialize(nodes.withColumn("state", F.lit("?")), "star-state")
    while not state.filter("state = '?'").isEmpty():
        seen = edges.join(state.select(F.col("node").alias("better"), F.col("state").alias("bs")), "better").groupBy(F.col("worse").alias("node")).agg(
            F.bool_or(F.col("bs") == "W").alias("lost"), F.bool_and(F.col("bs") == "L").alias("clear"))
        decide = F.when(F.col("state") != "?", F.col("state")).when(F.coalesce("lost", F.lit(False)), "L").when(F.coalesce("clear", F.lit(True)), "W").otherwise("?")
        state = materialize(state.join(seen, "node", "left").select("node", decide.alias("state")), "star-state")
    winners = edges.join(state.filter("state = 'W'").select(F.col("node").alias("better")), "better", "left_semi")
    losers = winners.join(state.filter("state = 'L'").select(F.col("node").alias("worse")), "worse", "left_semi")
    return losers.groupBy(F.col("worse").alias("loser")).agg(F.min(F.struct("better_rank", "better"))["better"].alias("winner"))


def claimed(candidates: DataFrame, title: float = 0.92, entity_title: float = 0.85, hours: int = 48, strong_kinds=("cve",), local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(loser, winner) of the greedy choice over the rows of :func:`duplicate_pairs`,
    of which none is listed: only *different* titles that are similar are paired."""
    low, kinds = min(title, entity_title), list(strong_kinds)
    rows = ranked(candidates).withColumn("t", F.lower(strip("title"))).filter("t IS NOT NULL").select(
        "t", "published_at", "rank", F.transform(F.filter("entities", lambda e: e["kind"].isin(kinds)), lambda e: F.concat_ws(":", e["kind"], e["value"])).alias("strong"))
    rows = materialize(rows, "dedupe-rows")
    alike = similar_titles(rows.select("t"), rows.select("t", F.explode("strong").alias("entity")), title, low)
    both = materialize(alike.unionByName(alike.select(F.col("y").alias("x"), F.col("x").alias("y"), "likeness")), "title-pairs")
    roots = components(alike.select(F.col("x").alias("a"), F.col("y").alias("b")))
    links = both.join(roots, F.col("x") == F.col("node")).select("root", F.col("x").alias("t"), F.col("y").alias("other"), (F.col("likeness") >= title).alias("plain"))
    rows = rows.join(roots, F.col("t") == F.col("node"), "left").withColumn("root", F.coalesce("root", "t")).drop("node")
    return claim(rows, links, hours, local_rows)


def find_duplicates(candidates: DataFrame, max_pool: int | None = None, **options) -> DataFrame:
    """(loser, winner). With ``max_pool`` a larger pool is left alone, as a guard.

    Rows of equal title, time and entities have the same duplicates, so the best of
    them stands for all: the others share its winner, or it is theirs.
    """
    if max_pool is not None and candidates.limit(max_pool + 1).count() > max_pool:
        return candidates.sparkSession.createDataFrame([], "loser string, winner string")
    alike = F.sha2(F.to_json(F.struct(F.lower(strip("title")).alias("t"), F.unix_micros("published_at").alias("p"), F.array_sort(F.array_distinct("entities")).alias("e"))), 256)
    rows = materialize(ranked(candidates).filter("title IS NOT NULL").withColumn("twin", alike), "dedupe-twins")
    first = rows.groupBy("twin").agg(F.min("rank")["h"].alias("head"), F.count("*").alias("n")).filter("n > 1").select("twin", "head")
    behind = materialize(rows.select("twin", "canonical_hash").join(first, "twin").filter("canonical_hash <> head").select("canonical_hash", "head").distinct(), "dedupe-behind")
    heads = rows.drop("twin", "rank").join(behind.select("canonical_hash"), "canonical_hash", "left_anti")
    lost = materialize(claimed(heads, **options), "dedupe-lost")
    shared = lost.select(F.col("loser").alias("head"), "winner")
    return lost.unionByName(behind.join(shared, "head", "left").select(F.col("canonical_hash").alias("loser"), F.coalesce("winner", "head").alias("winner")))


def batches(df: DataFrame, size: int, order: list) -> DataFrame:
    """Adds ``batch``: consecutive groups of ``size`` rows in order."""
    return row_numbers(df, order, "batch").withColumn("batch", F.floor((F.col("batch") - 1) / size))
