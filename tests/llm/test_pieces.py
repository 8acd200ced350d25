"""Encoding and decoding against the library that the models are from."""

import random

import numpy as np
import pytest
import sentencepiece

from lathe.llm import pieces
from lathe.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
CASES = [None, "", " ", "  ", "a", " a", "a ", "Hello  world\n\tq é x", "   three", "x" * 500, "é́ ▁ 你好 \U0001f600", "tab\tand\r\n\x00\x7f", "ending\n", "aaaaabbbbb " * 300, " nbsp", "1234567 89.5%", "don't--stop"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_same_ids_as_the_library(spark, library):
    model = pieces.Pieces(PATH)
    rng = random.Random(4)
    texts = CASES + ["".join(rng.choices("abcdefgh ABC  éß,.\n", k=rng.randint(1, 80))) for _ in range(800)]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(30).collect()]
    for t, raw in zip(texts, model.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(t or ""), repr(t)[:100]
    for t in texts:
        ids = library.encode(t or "")
        assert model.decode(ids) == library.decode(ids), repr(t)[:100]


def test_unigram_by_brute_force():
    model = pieces.Pieces(PATH)
    model.bpe = False
    rng = random.Random(5)

    def best(word):
        if not word:
            return 0.0
        found = [best(word[n:]) + model.scores[word[:n]] for n in range(1, len(word) + 1) if word[:n] in model.ids]
        return max(found, default=model.floor + best(word[1:]))

    words = [pieces.MARK + "".join(rng.choices("thein", k=rng.randint(1, 8))) for _ in range(200)]
    model._learn(words)
    names = {i: p for p, i in model.ids.items()}
    for w in words:
        got = [names[i] for i in np.frombuffer(model.known[w], "<u4").tolist()]
        assert "".join(got) == w and abs(sum(model.scores[p] for p in got) - best(w)) < 1e-6


def test_columns(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(CASES)] + [(None, "a b", None), (3, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = pieces.decoded(pieces.encoded(df, PATH), PATH).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["ids"] == library.encode(r["text"] or "") and r["decoded"] == library.decode(r["ids"])
    assert pieces.digests(df.limit(0), PATH).collect() == []
    assert sum(not r["round_trip"] for r in pieces.digests(df, PATH).collect()) == 1  # a text that has the mark itself
