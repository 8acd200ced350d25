"""The language model against a plain one in dictionaries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

from lathe.llm import lm

SCHEMA = "doc_id long, text string, extra string, score double"


def plain(rows, order):
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w] + ["</s>"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    train = [split(t) for i, t in rows if not held(i)]
    words = Counter(w for x in train for w in x)
    n, v = sum(words.values()), len(words)
    raw = {k: Counter(tuple(x[i : i + k]) for x in (["<s>", *t] for t in train) for i in range(k == 1, len(x) - k + 1)) for k in range(1, order + 1)}

    def discounts(values):
        c = Counter(values)
        n1, n2, n3, n4 = (c[i] for i in range(1, 5))
        half = [0, 0.5, 0.5, 0.5]
        if not (n1 and n2 and n3 and n4):
            return half
        y = n1 / (n1 + 2 * n2)
        d = [0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        return d if all(0 < d[i] <= i for i in (1, 2, 3)) else half

    count = {order: raw[order]}
    for k in range(order - 1, 0, -1):
        before = Counter(g[1:] for g in raw[k + 1])
        count[k] = {g: c if g[0] == "<s>" else before[g] for g, c in raw[k].items()}
    off = {k: discounts(c.values()) for k, c in count.items()}
    total, given = defaultdict(int), defaultdict(float)
    for k, c in count.items():
        for g, x in c.items():
            total[k, g[:-1]] += x
            given[k, g[:-1]] += off[k][min(x, 3)]

    def p(w, h):
        k = len(h) + 1
        lower = p(w, h[1:]) if h else 1 / (v + 1)
        if not total[k, h]:
            return lower
        c = count[k].get((*h, w), 0)
        return max(0, c - off[k][min(c, 3)]) / total[k, h] + given[k, h] / total[k, h] * lower

    out = []
    for i, t in rows:
        x = split(t)
        padded = ["<s>", *x]
        out.append((i, held(i), len(x), sum(w in words for w in x), n, sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x), sum(math.log10(p(w, tuple(padded[max(0, j + 2 - order) : j + 1]))) for j, w in enumerate(x))))
    some = [("<s>",), ("never",), *[h for k, h in list(total)[:200] if k == order]]
    return out, [sum(p(w, h) for w in [*words, "???"]) for h in some]


def check(spark, rows, order=2):
    got = lm.language_model_scores(spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], SCHEMA), order=order).collect()
    want, sums = plain(rows, order)
    assert all(abs(s - 1) < 1e-9 for s in sums)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(a)[:5] == b[:5]
        assert abs(a[5] - b[5]) < 1e-6 and abs(a[6] - b[6]) < 1e-6, (a, b)


def test_matches_plain_model(spark, monkeypatch):
    rng = random.Random(3)
    words = ["a", "B", "é", "the", "of", "x1", "Y", "zz", "q-q", "w w"]
    rows = [(i, "\t ".join(rng.choices(words, range(1, 11), k=rng.randint(0, 40)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n\x0b "), (None, "the of"), (3, "the of the"), (3, "the of the"), (203, "never seen words of"), (204, "long " * 30000)]
    check(spark, rows)
    monkeypatch.setattr(lm, "BYTES_A_SHARD", 20_000)
    monkeypatch.setattr(lm, "COUNTED", 60)
    monkeypatch.setattr(lm, "SCORED", 50)
    monkeypatch.setattr(lm, "SPLIT", 40)
    check(spark, rows)
    check(spark, rows, 3)
    check(spark, rows, 4)


def test_without_rows(spark):
    check(spark, [])
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    got = lm.language_model_scores(spark.createDataFrame([(held, "a b", "x", 1.0)], SCHEMA)).collect()
    assert [tuple(r)[:5] for r in got] == [(held, True, 3, 0, 0)]
