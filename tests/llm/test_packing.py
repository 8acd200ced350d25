"""Packing: ids of whole texts, every id once, no gaps, little padding."""

import functools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lathe.llm import packing
from lathe.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, length long, sequence_id string, ids string"


@functools.cache
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def encoded(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 1]


def check(spark, rows):
    out = packing.packed(spark.createDataFrame([(i, t, 5, "x", "y") for i, t in rows], SCHEMA), tokenizer_path(), keep_ids=True).collect()
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(encoded(t))
    got, sequences = {}, {}
    for r in out:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] and r["length"] > 0
        got.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], ids.tolist()))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, docs in want.items():
        for n in {len(d) for d in docs}:
            same = [d for d in docs if len(d) == n]
            pieces = sorted(got.pop((i, n)))
            assert sum(len(p) for _, p in pieces) == n * len(same)
            if len(same) == 1:
                assert [x for _, p in pieces for x in p] == same[0]
                assert [s for s, _ in pieces] == np.cumsum([0, *(len(p) for _, p in pieces)])[:-1].tolist()
            else:
                assert sorted(x for _, p in pieces for x in p) == sorted(x for d in same for x in d)
    assert not got
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    return sequences


def test_cases(spark):
    rows = [(0, None), (1, ""), (2, " \n "), (3, "one"), (3, "one"), (3, "two words"), (None, "no id"), (4, "long " * 9000), (5, "It's 'sad we'LL'd 12ab <|startoftext|>x <|endoftext|> <| _a_ É́é İ ΑΣ ß  x y\x1cz \x85 ÀÉ,ñ# ½ ª")]
    rows += [(6, "x" * 30000), (7, "%%% ### " * 40)]
    check(spark, rows)


def test_no_rows(spark):
    assert not check(spark, [])


def test_padding(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "Gamma,", "d", "e-e"], k=int(rng.expovariate(1 / 700))))) for i in range(800)]
    sequences = check(spark, rows)
    assert sum(n for s in sequences.values() for _, n in s) / (2048 * len(sequences)) > 0.98


@pytest.mark.parametrize("n", [1, 2, 7, 682, 683, 1024, 1025, 2047, 2048, 2049, 10000])
def test_cuts(n):
    assert sum(packing.cuts(n)) == n and all(0 < x <= 2048 for x in packing.cuts(n))


def test_words_of_documents(spark):
    """Word by word, ids are those of the whole text."""
    encode = packing._Encoder(tokenizer_path())
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["it's 'sad we'LL'd I've''s x'", "'", "'s", "'lx 'Ll", "a'", "r'e 're", "", "É'T9'm 12", None, "dots... 'rE'v 'vE"] * 2
    texts += [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(40).collect()]
    for t, ids in zip(texts, encode(pa.array(texts, pa.string())), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoded(t)[:-1]
