"""The registered queries over the smallest tables: against their SQL in DuckDB, or what their contracts fix, by brute force."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__
from lathe.llm import pii, queries

from .test_lm import plain as plain_scores
from .test_pii import plain as plain_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def rows(spark, name):
    return __spark_entry__.queries()[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    got = rows(spark, name)
    assert set(got[0].asDict()) == set(want.columns)
    assert sorted(tuple(r[c] for c in want.columns) for r in got) == sorted(want.fetchall())


def test_op1(spark, docs):
    got = rows(spark, "op1_co_training_quality")
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in docs)
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = [r["keep"] == bool(truth[r["doc_id"]]) for r in got if r["doc_id"] in truth]
    assert sum(right) / len(right) > 0.9 and all(r["keep"] == (r["score"] >= 0.5) for r in got)


def test_op2(spark, docs):
    texts = dict(docs)
    for r in rows(spark, "op2_weak_supervision_pii"):
        spans = plain_spans(texts[r["doc_id"]] or "")
        joined = [f"{pii.BASE[k]}:{s}:{e}" for k, s, e in spans]
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x == i for x, *_ in spans) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(r["spans"].split(","))


def test_op5(spark, docs):
    want, _ = plain_scores(docs, 2)
    got = {r["doc_id"]: tuple(r) for r in rows(spark, "op5_kneser_ney")}
    assert len(got) == len(want)
    for w in want:
        g = got[w[0]]
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9)


def test_op6(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in rows(spark, "op6_sentencepiece")}
    for i, t in docs:
        ids = np.array(library.encode(t or ""), "<u4")
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_crc32"] == zlib.crc32(ids.tobytes()) and got[i]["round_trip"] == (library.decode(ids.tolist()) == (t or ""))


def test_op8(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    got = rows(spark, "op8_transcript_roles")
    assert {r["conv_id"] for r in got} == {r["conv_id"] for r in turns} and {r["role"] for r in got} <= {"system", "user", "assistant"}
    begins = {(r["conv_id"], r["pos"]): r["role"] for r in got if r["line"] <= 1}
    assert sum(begins.get((r["conv_id"], r["turn"])) == r["role"] for r in turns) / len(turns) > 0.9


def test_op9(spark, docs):
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    got, sequences = {}, {}
    for r in rows(spark, "op9_harmonic_packing"):
        got.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(got[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for places in sequences.values():
        ends = [0, *(a + n for a, n in sorted(places))]
        assert [a for a, _ in sorted(places)] == ends[:-1] and ends[-1] <= 2048
    assert sum(r["length"] for x in got.values() for r in x) > 0.97 * 2048 * len(sequences)


def test_op10(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op10_matroska")}
    for i, t in docs:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])


def test_op4(spark, docs):
    texts = dict(docs)
    for r in rows(spark, "op4_secret_forest"):
        assert hashlib.sha256(texts[r["doc_id"]][r["start"] : r["end"]].encode()).hexdigest() == r["value_sha256"] and 0 <= r["probability"] <= 1
