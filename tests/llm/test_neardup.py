"""Near duplicates against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillspark.llm import neardup
from quillspark.llm.neardup import jaccard_components
from quillspark.operators.components import components
from quillspark.session import shared_dir

DDL = "doc_id long, text string"


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent):
    """{doc_id: (set size, smallest doc_id reachable)} with every pair compared."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            same = sets[a][0] is not None and sets[a][0] == sets[b][0]
            if same or (x and y and 100 * len(x & y) >= percent * len(x | y)):
                parent[find(a)] = find(b)
    least = defaultdict(lambda: None)
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = i if least[find(a)] is None else min(i, least[find(a)])
    return Counter((i, len(s), least[find(a)] if s else i) for a, (i, s) in enumerate(sets))


def edited(rnd, words, vocabulary):
    words = list(words)
    for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
        at, kind = rnd.randrange(len(words)), rnd.random()
        if kind < 0.5:
            words[at] = rnd.choice(vocabulary)
        elif kind < 0.8:
            words.insert(at, rnd.choice(vocabulary))
        elif len(words) > 1:
            del words[at]
    return " ".join(words)


@pytest.mark.parametrize("k,percent,seed", [(4, 85, 1), (5, 80, 2)])
def test_against_brute_force(spark, k, percent, seed):
    rnd = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(300)]
    bases = [[rnd.choice(vocabulary) for _ in range(rnd.choice([9, 12, 30, 60, 100]))] for _ in range(12)]
    rows = [(i, edited(rnd, rnd.choice(bases), vocabulary)) for i in range(260)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A\tB"), (905, "a"), (None, rows[0][1]), (None, "alone at last"), rows[7]]
    got = jaccard_components(spark.createDataFrame(rows, DDL).repartition(3), k, percent, batch_chars=8000, count_tokens=6000).collect()
    assert Counter(map(tuple, got)) == brute(rows, k, percent)


def test_edges(spark):
    assert jaccard_components(spark.createDataFrame([], DDL)).count() == 0
    clash = [(1, "one two three four five six"), (1, "other words entirely here now"), (2, "other words entirely here now"), (3, "x")]
    got = Counter(map(tuple, jaccard_components(spark.createDataFrame(clash, DDL)).collect()))
    assert got == brute(clash, 5, 80)
    extra = spark.createDataFrame([(1, "a b c", 5, 6), (2, "a b c", 7, 8)], "doc_id long, text string, n long, component_id long")
    assert {r["component_id"] for r in jaccard_components(extra).collect()} == {1}


def test_every_class_links_by_its_own_set(spark):
    """Repeated ids with different texts, and classes without any id, link and bridge."""
    base = [f"w{i}" for i in range(60)]
    one, two, three = list(base), list(base), list(base)
    one[3] = two[3] = three[3] = "x1"
    two[30] = three[30] = "x2"
    three[50] = "x3"
    other = [f"v{i}" for i in range(60)]
    near = other[:59] + ["end"]
    big = 2**60 + 1
    rows = [(1, " ".join(base[::-1])), (1, " ".join(other)), (5, " ".join(other)), (9, " ".join(near)),
            (20, " ".join(one)), (None, " ".join(two)), (None, " ".join(two)), (30, " ".join(three)), (big, " ".join(base[::-1][:59]))]
    for order in (rows, rows[::-1]):
        got = Counter(map(tuple, jaccard_components(spark.createDataFrame(order, DDL).repartition(3), 5, 80, batch_chars=900, count_tokens=90).collect()))
        assert got == brute(order, 5, 80)
    assert {c for i, _, c in got if i in (5, 9)} == {1} and {c for i, _, c in got if i in (20, 30)} == {20}


def test_only_occupied_tasks_are_visited():
    """A batch's work grows with the counting tasks that it has shingles for."""
    rng = np.random.default_rng(1)
    hashes = np.unique(rng.integers(0, 2**64, 50, dtype=np.uint64))
    for parts in (1, 7, 10**6):
        slots = np.unique(neardup._slots(hashes, parts))
        found = neardup._occupied(slots)
        assert len(found) <= min(parts, len(slots)) and [p for p, _, _ in found] == sorted({int(s) >> 32 for s in slots})
        assert sum(hi - lo for _, lo, hi in found) == len(slots) and all(int(slots[k]) >> 32 == p for p, lo, hi in found for k in range(lo, hi))


def test_components(spark):
    shared_dir(spark)
    rnd = random.Random(4)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    linked = {n for a, b in edges if a != b for n in (a, b)}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in linked}
