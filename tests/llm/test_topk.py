"""Top-k against all inner products."""

import math
import random

from lathe.llm import topk

SCHEMA = "label string, vec_id long, embedding array<float>, score int"


def plain(rows, k=5):
    import numpy as np

    ints = [(i, [(math.floor(256 * float(np.float32(x))) if abs(x) < 1e15 else 256 * int(float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in {(i, tuple(v)) for i, v in ints if i % 50 == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ints if i != q and len(w) == len(v))[:k]  # noqa: B905
        out |= {(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(best)}
    return out


def check(spark, rows):
    got = topk.top_k(spark.createDataFrame([("x", i, v, 1) for i, v in rows], SCHEMA)).collect()
    assert {tuple(r) for r in got} == plain(rows) and len(got) == len({tuple(r) for r in got})


def test_top_k(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 0.4) for _ in range(7)]) for i in range(260)]
    rows += [(i, [1.0] * 7) for i in range(300, 360)]  # ties
    rows += [(1000, None), (1050, [1.0, None] + [0.0] * 5), (1100, [float("nan")] * 7), (1150, [float("inf")] + [0.0] * 6), (1200, []), (None, [1.0] * 7), (401, [0.1] * 7), (401, [0.1] * 7), (1250, [1.0, 2.0, 3.0]), (1251, [1.0, 2.0, 3.5])]
    check(spark, rows)
    monkeypatch.setattr(topk, "QUERY_ROWS", 2)
    monkeypatch.setattr(topk, "BLOCK_VALUES", 400)
    monkeypatch.setattr(topk, "SAMPLE", 20)
    check(spark, rows)


def test_large_components(spark):
    """Components whose products or integers a long does not hold."""
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) * 10.0 ** rng.randint(-3, 3) for _ in range(4)]) for i in range(120)] + [(200, [1e18, 1.0, 0.0, 0.0]), (201, [1e18, 2.0, 0.0, 0.0]), (202, [2e7] * 4), (250, [2e7] * 4), (251, [-2e7] * 4), (203, [-1e18, 0.0, 0.0, 0.5]), (300, [3e38] * 4), (301, [-3e38, 3e38, 1.0, 0.0])]
    check(spark, rows)
    check(spark, [(0, [2e7] * 4), (1, [2e7] * 4), (2, [1.9e7] * 4)])
    far = [(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e300, 2.0]), (3, [1.7e308, 0.0]), (50, [0.25, 0.5])]
    got = topk.top_k(spark.createDataFrame(far, "vec_id long, embedding array<double>")).collect()
    assert [r["vec_id"] for r in sorted(got) if r["query_id"] == 0] == [3, 1, 50, 2] and len(got) == 8


def test_repeated_vectors(spark):
    """A vector that most rows have: only its smallest ids are candidates, and few exact vectors are read."""
    rng = random.Random(6)
    rows = [(i, [0.5, 0.5, 0.5]) for i in range(400)] + [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(400, 500)] + [(0, [0.5, 0.5, 0.5]), (7, [0.5, 0.5, 0.5]), (7, [0.5, 0.5, 0.5])]
    want = plain(rows)
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_few_exact_vectors_are_read(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(32)]) for i in range(3000)]
    read, scores = [], topk._scores
    monkeypatch.setattr(topk, "_scores", lambda pairs, shift: read.append(pairs.count()) or scores(pairs, shift))
    check(spark, rows)
    assert len(read) == 2 and sum(read) < 60 * 100  # of 60 queries x 3000 vectors


def test_few(spark):
    check(spark, [])
    check(spark, [(0, [1.0])])
    check(spark, [(0, [1.0]), (1, [2.0]), (50, [0.0])])
