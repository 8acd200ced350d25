"""Roles recovered on held-out transcripts; parts of any size give the path of one pass."""

import random
import zlib

import pytest

from lathe.llm import chat

TABLE = "/root/testdata/sf0.01/conversations.parquet"


def split(spark):
    lines = chat.transcript_lines(spark.read.parquet(TABLE)).cache()
    held = lambda r: zlib.crc32(str(r["conv_id"]).encode()) % 4 == 0
    rows = lines.collect()
    some = [r for r in rows if not held(r)]
    return spark.createDataFrame(some, lines.schema), [r for r in rows if held(r)], lines.schema


@pytest.fixture(scope="module")
def parts(spark):
    train, held, schema = split(spark)
    return chat.trained(train), held, schema


def test_held_out(spark, parts):
    model, held, schema = parts
    got = chat.parsed(spark.createDataFrame(held, schema).drop("role"), model).collect()
    begins = {(r["conv_id"], r["pos"], r["line"] <= 1): r["role"] for r in got}
    right = sum(begins.get((r["conv_id"], r["turn"], True)) == r["role"] for r in held)
    assert right / len(held) > 0.9 and right / len(got) > 0.85


def test_parts_give_the_same(spark, parts, monkeypatch):
    model, held, schema = parts
    rng = random.Random(6)
    rows = [(7, i, rng.choice(["User: hi?", "AI: so\nand so", "", "plain", "System: be\n\nkind", "x" * 90])) for i in range(60)] + [(8, 0, "Human: one"), (8, 1, None), (None, 3, "User: x"), (9, None, "AI: y"), (9, 2, "User: z"), (9, 2, "User: z"), (10, 0, "word " * 50000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    whole = chat.parsed(df, model).collect()
    monkeypatch.setattr(chat, "PART", 4)
    parted = chat.parsed(df, model).collect()
    of = lambda out, c: sorted((r for r in out if r["conv_id"] == c), key=lambda r: (r["pos"], r["line"]))
    text = lambda out, c: "".join(r["rendered"] for r in of(out, c))
    for c in (7, 8, 10):
        assert [(r["pos"], r["line"], r["role"]) for r in of(parted, c) if not r["continues"]] == [(r["pos"], r["line"], r["role"]) for r in of(whole, c)]
        assert text(whole, c) == text(parted, c)
        assert text(whole, c).count("<|im_end|>") == text(parted, c).count("<|im_end|>") == text(whole, c).count("<|im_start|>")
    assert sum(r["n_lines"] for r in whole) == sum(r["n_lines"] for r in parted) == sum((t or "").count("\n") + 1 for _, _, t in rows)
    assert chat.parsed(df.limit(0), model).collect() == []


def test_parts_are_bounded(spark, parts, monkeypatch):
    """Rows without id are transcripts of their own; rows that repeat a position, or have none, are parted."""
    model = parts[0]
    monkeypatch.setattr(chat, "PART", 4)
    alone = [(None, p, t) for p in (None, 3) for t in ("plain\nand so", "plain\nand so", "x" * 90, "AI: y") for _ in range(10)]
    rows = [(1, 5, "plain")] * 30 + [(2, None, f"word {i:02d}") for i in range(30)] + [(3, 10**9 * i, "User: far") for i in range(3)]
    out = chat.parsed(spark.createDataFrame(alone + rows, "conv_id long, turn long, text string").repartition(3), model).collect()
    each = [(p, s) for _, p, t in alone for s in [model.path(chat._symbols(t.split("\n")))]]
    assert sum(r["conv_id"] is None for r in out) == sum(1 + sum(x % 2 == 0 for x in s[1:]) for _, s in each)
    assert sum(r["n_lines"] for r in out if r["conv_id"] is None) == sum(len(s) for _, s in each)
    for c, n in ((1, 30), (2, 30), (3, 3)):
        mine = [r for r in out if r["conv_id"] == c]
        lines = [t for i, _, t in rows if i == c]
        states = model.path(chat._symbols(lines))
        assert sum(r["n_lines"] for r in mine) == n and max(r["n_lines"] for r in mine) <= 4
        assert sum(not r["continues"] for r in mine) == sum(s % 2 == 0 for s in states)
        assert sum(r["rendered"].count("<|im_end|>") for r in mine) == sum(r["rendered"].count("<|im_start|>") for r in mine)


def test_path_by_brute_force(parts):
    import itertools

    model = parts[0]
    for symbols in ([0, 3, 60], [12, 1, 1], [60, 24, 5, 0]):
        score = lambda p: model.start[p[0]] + sum(model.step[a, b] for a, b in zip(p, p[1:])) + sum(model.seen[a, s] for a, s in zip(p, symbols, strict=True))  # noqa: B023, E731
        best = max(itertools.product(range(chat.N), repeat=len(symbols)), key=score)
        assert abs(score(tuple(model.path(symbols))) - score(best)) < 1e-9


@pytest.mark.parametrize(("line", "kind"), [("User: hi", 2), ("### Assistant", 3), ("**Human:** x", 2), ("[INST] x", 0), ("Bob: hello", 4), ("a plain line", 0), ("Answer is: x", 0), ("<|user|>", 2), ("A: yes", 3)])
def test_markers(line, kind):
    assert chat.marker(line)[0] == kind
