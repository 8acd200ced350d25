"""The join against all pairs by brute force."""

import random
import re

import numpy as np
import pytest

from lathe.llm import graph, jaccard
from lathe.llm.jaccard import Rule

SCHEMA = "n_shingles string, doc_id long, text string, component_id double"


def plain(rows, rule):
    def of(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", low) if x]
        return {tuple(w[i : i + rule.k]) for i in range(max(1, len(w) - rule.k + 1))} if w else set()

    sets = [(i, of(t)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and i is not None and j is not None and rule.den * len(a & b) >= rule.num * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return sorted(((i is None, i or 0), len(s), None if i is None else find(i)) for i, s in sets)


def check(spark, rows, rule):
    df = spark.createDataFrame([("x", i, t, 0.5) for i, t in rows], SCHEMA).repartition(3)
    got = sorted(((r[0] is None, r[0] or 0), r[1], r[2]) for r in jaccard.linked(df, rule).collect())
    assert got == plain(rows, rule)
    return got


def copies(rng, n_groups, length, edits):
    rows, i = [], 0
    for g in range(n_groups):
        base = [f"w{g}_{rng.randint(0, 10**6)}" for _ in range(length)]
        for _ in range(rng.randint(1, 5)):
            words = list(base)
            for _ in range(rng.randint(0, edits)):
                words[rng.randrange(length)] = f"e{rng.randint(0, 10**6)}"
            rows.append((i * 7 % 1000, " ".join(words)))
            i += 1
    return rows


@pytest.mark.parametrize("rule", [Rule(3, 90, 100), Rule(5, 80, 100)])
def test_copies(spark, rule, monkeypatch):
    rng = random.Random(rule.k)
    rows = []
    for length, edits in ((3, 1), (7, 1), (12, 1), (22, 2), (45, 3), (90, 4), (200, 8)):
        rows += [(i + 1000 * length, t) for i, t in copies(rng, 3, length, edits)]
    rows += [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (6, "one two"), (None, "one two"), (7, "big " * 20000), (8, "a b c d")]
    same = [f"r{i}" for i in range(80)]
    rows += [(9, " ".join(same))] * 4 + [(9, " ".join(same[1:]))] * 3 + [(10, " ".join(same[:-1])), (11, " ".join(same[2:])), (9, "r1 r2 and other words")]
    want = check(spark, rows, rule)
    monkeypatch.setattr(jaccard, "BLOCK", 300)
    monkeypatch.setattr(jaccard, "SPREAD", 50)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    assert check(spark, rows, rule) == want


def test_sets_that_are_alike(spark, monkeypatch):
    """Lists whose members are not linked with their smallest, but some with each other: blocks find these links."""
    rng, rows = random.Random(11), []
    for g in range(3):
        base = [f"w{g}_{k}" for k in range(70)]
        for i in range(45):
            words = list(base)
            for _ in range(rng.choice((1, 4, 6, 9))):
                words[rng.randrange(70)] = f"e{rng.randint(0, 10**6)}"
            rows.append((1000 * g + i, " ".join(words)))
    used = []
    links = jaccard._block_links
    monkeypatch.setattr(jaccard, "_block_links", lambda *a: used.append(links(*a)) or used[-1])
    want = check(spark, rows, Rule(3, 80, 100))
    monkeypatch.setattr(jaccard, "BLOCK", 700)
    monkeypatch.setattr(jaccard, "SPREAD", 100)
    assert check(spark, rows, Rule(3, 80, 100)) == want and len(used) == 2
    assert len({c for *_, c in want}) > 3


def test_entries_meet():
    """Linked sets have an entry in common, whatever is known as frequent."""
    rng = np.random.default_rng(3)
    for rule in (Rule(3, 90, 100), Rule(5, 80, 100), Rule(1, 50, 100)):
        for _ in range(300):
            n = int(rng.integers(1, 120))
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.97], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 8))).astype(np.uint64)]))
            same = len(np.intersect1d(a, b))
            if len(b) and rule.den * same >= rule.num * (len(a) + len(b) - same):
                known = np.intersect1d(a, b)[:: int(rng.integers(1, 4))]
                x, y = (jaccard._entries(s, np.isin(s, known), rule) for s in (a, b))
                assert np.intersect1d(x, y).size and len(x) == rule.entries(len(a))


def test_one_of_each(spark):
    """Decided by row: of each component of rows one of the smallest id stays, and all rows without shingles or id."""
    rng, rule = random.Random(4), Rule(5, 80, 100)
    rows = copies(rng, 4, 40, 3) + [(500, "a clean text of its own words here"), (500, ""), (500, None), (500, " "), (600, "one two three four five six"), (600, "one two three four five six"), (600, "one two three four five six")]
    rows += [(601, "one two three four five six"), (601, "quite another text than the one before it"), (601, ""), (None, "one two three four five six"), (None, "one two three four five six")]
    df = spark.createDataFrame([(str(k), i, t, 0.5) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)
    kept = {int(r["n_shingles"]) for r in jaccard.one_of_each(df, rule).collect()}
    lone = {k for k, (i, t) in enumerate(rows) if i is None or not (t or "").strip()}
    assert lone <= kept
    number = {k: n for n, k in enumerate(sorted(set(range(len(rows))) - lone, key=lambda k: (rows[k][0], k)))}
    row_of = {n: k for k, n in number.items()}
    groups = {}
    for (_, n), _, first in plain([(n, rows[k][1]) for k, n in number.items()], rule):
        groups.setdefault(first, []).append(row_of[n])
    for members in groups.values():
        stay = [k for k in members if k in kept]
        assert len(stay) == 1 and rows[stay[0]][0] == min(rows[k][0] for k in members)
    twice = jaccard.one_of_each(df.repartition(5), rule).collect()
    assert {int(r["n_shingles"]) for r in twice} == kept and set(twice[0].asDict()) == set(df.columns)


def test_light_sets(spark, monkeypatch):
    """All sizes as light sets."""
    monkeypatch.setattr(Rule, "boundary", lambda self, sizes: 24)
    rng = random.Random(9)
    rows = [(i + 1000 * n, t) for n in range(2, 27, 3) for i, t in copies(rng, 3, n, 2)]
    check(spark, rows, Rule(1, 80, 100))
    check(spark, rows, Rule(2, 90, 100))


def test_no_rows(spark):
    assert check(spark, [], Rule()) == []
    assert check(spark, [(5, None)], Rule()) == [((False, 5), 0, 5)]


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for p in links for x in p}
    for _ in range(200):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {i: root[i] for i in got} and set(got) == {x for a, b in links if a != b for x in (a, b)}
