"""Held-out accuracy, and texts and labels of all kinds."""

import zlib

import numpy as np
import pyarrow as pa

from lathe.llm import quality


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = {i for i in truth if zlib.crc32(b"t" + str(i).encode()) % 3 == 0}
    known = labels.where(~labels["doc_id"].isin(list(held)))
    out = quality.scored(docs, known).collect()
    assert len(out) == docs.count()
    right = [r["keep"] == bool(truth[r["doc_id"]]) for r in out if r["doc_id"] in held]
    assert sum(right) / len(right) > 0.95
    kept = quality.filtered(docs.withColumn("extra", docs["lang"]), known)
    assert kept.columns == [*docs.columns, "extra"] and {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in out if r["keep"]}


def test_cases(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", -5), (3, " \n ", "en", "s", 3), (3, " \n ", "en", "s", 3), (None, "a b", "de", "t", 3), (4, "w " * 200000, "en", "s", 400000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = quality.scored(df, labels).collect()
    assert len(out) == len(rows) and all(r["keep"] and r["score"] == 1.0 for r in out)  # labels of one kind only
    assert quality.scored(df.limit(0), labels).collect() == []
    assert quality.filtered(df, labels).count() == len(rows)


def test_distinct_words_of_the_tail():
    """What stands after the first 400 words counts."""
    at = list(quality.EDGES).index("distinct")
    of = lambda text: quality.text_view(text)[0][at]
    head = " ".join(f"w{i}" for i in range(400))
    clean, tail = head + " " + " ".join(f"v{i}" for i in range(1200)), head + " again" * 1200
    assert of(head) == of(clean) == len(quality.EDGES["distinct"])
    assert of(tail) == 2  # (400 + 3) / 1600
    assert of("a b a b") == 5 and of("a " * 401) == 0


def test_words():
    """Buckets of each text's distinct words."""
    texts = [None, "", "a b A", "c", "w " * 300000 + "z", " \t", "b a"]
    raw = [quality.text_view(t)[1] for t in texts]
    got = [np.frombuffer(x, "<u2").tolist() for x in raw]
    assert [len(x) for x in got] == [0, 0, 2, 1, 2, 0, 2] and got[2] == got[6] == sorted(zlib.crc32(w) % quality.WORDS for w in (b"a", b"b"))
    row, buckets = quality._flat(pa.array(raw, pa.binary()).slice(2, 3))
    assert row.tolist() == [0, 0, 1, 2, 2] and buckets.tolist() == [*got[2], *got[3], *got[4]]


def test_counts_by_brute_force(spark):
    """One reading of all rows, before and after the views teach each other."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    rows = quality._rows(docs.unionByName(docs.limit(3)), labels)
    views = quality._trained_on(rows)
    for teach in (False, True):
        n, words = quality._counted(rows, views, teach)
        want, want_words = np.zeros_like(n), np.zeros_like(words)
        taught = 0
        for r in rows.collect():
            w, t, m = pa.array([r["w"]]), np.array([r["t"]]), np.array([r["m"]])
            text, meta = (float(x[0]) for x in views.odds(w, t, m))
            for classes, other, first in ((r["t"], meta, 0), (r["m"], text, quality.N_TEXT)):
                label, weight = max(r["y"], 0), 1.0 if r["y"] >= 0 and not r["held"] else 0.0
                p = 1 / (1 + np.exp(-other))
                if teach and r["y"] < 0 and (p > quality.CONFIDENT or p < 1 - quality.CONFIDENT):
                    label, weight = int(p > 0.5), quality.PSEUDO_WEIGHT
                    taught += 1
                for f, c in enumerate(classes):
                    want[first + f, c, label] += weight
                if not first:
                    for b in np.frombuffer(r["w"], "<u2"):
                        want_words[b, label] += weight
        assert np.allclose(n, want) and np.allclose(words, want_words) and (taught > 0) == teach


def test_clashing_names(spark):
    """Columns of the names that the operator uses itself; columns that are missing, or written otherwise."""
    rows = [(i, f"text number {i} of some words " * (1 + i % 7), 1, 2, 0, True, 0.5, "w", "x") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, Text string, t int, m int, y int, held boolean, score double, w string, Lang string")
    labels = spark.createDataFrame([(i, i % 2, 0, 1) for i in range(30)], "doc_id long, quality int, toxic int, y int")
    out = quality.scored(df, labels).collect()
    kept = quality.filtered(df, labels)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in out if r["keep"]} and len(out) == 40
