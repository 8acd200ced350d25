"""The pipeline against brute force: which documents stay, and their tokens."""

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from lathe.llm import packing, quality, secrets
from lathe.llm.jaccard import Rule
from lathe.llm.queries import tokenizer_path

from .test_jaccard import plain

SF = "/root/testdata/sf0.001"


def test_run(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    good = {r["doc_id"] for r in quality.scored(docs, labels).where("keep").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good]
    firsts = {i for (_, i), n, c in plain(rows, Rule(5, 80, 100)) if i == c or not n}
    text = {r["doc_id"]: r["text"] for r in secrets.masked(docs.where(docs["doc_id"].isin(list(firsts)))).collect()}

    of_doc, of_sequence = {}, {}
    for r in corpus_pipeline.run(spark, SF).collect():
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"]
        of_doc.setdefault(r["doc_id"], []).append((r["start"], ids))
        of_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    tokenizer = Tokenizer.from_file(tokenizer_path())
    assert of_doc.keys() == text.keys() and 0 < len(text) < docs.count()
    for i, pieces in of_doc.items():
        assert [x for _, ids in sorted(pieces) for x in ids] == [*tokenizer.encode(text[i] or "", add_special_tokens=False).ids, packing.END_ID]
    for places in of_sequence.values():
        ends = [0, *(a + n for a, n in sorted(places))]
        assert [a for a, _ in sorted(places)] == ends[:-1] and ends[-1] <= packing.CAPACITY


def written(spark, folder, rows, labels):
    """A folder with tables of documents, with columns of names that stages use themselves, and labels."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, start long, id long, component_id string"
    spark.createDataFrame([(*r, 0.5, 1, 7, 3, "c") for r in rows], schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_cases(spark, tmp_path):
    """Null and empty texts, repeated rows and ids, null columns, extra columns."""
    text = "the first of a few texts that say the same with secret token = '0a1b2c3d4e5f60718293a4b5c6d7e8f901234567' at their end"
    rows = [(1, text, "en", "s", 10), (1, text, "en", "s", 10), (2, text.upper(), "en", "s", 10), (3, None, None, None, None), (4, "", "en", None, 0), (4, "quite another text of its own words", None, "s", None), (None, "a text without id has no duplicates", "en", "s", 3), (None, text, "en", "s", 3), (6, "long " * 30000, "en", "s", 150000)]
    sf = written(spark, tmp_path / "a", rows, [(1, 1, 0), (None, 0, 0)])  # labels of one kind: all are kept
    found = corpus_pipeline.run(spark, sf).collect()
    of_doc = {}
    for r in found:
        of_doc.setdefault(r["doc_id"], []).append(r)
    assert of_doc.keys() == {1, 3, 4, 6, None}
    assert sum(r["length"] for r in of_doc[1]) == of_doc[1][0]["doc_tokens"]  # one of the three
    assert [r["length"] for r in of_doc[3]] == [1] and sorted(r["start"] for r in of_doc[4]) == [0, 0] and len([r for r in of_doc[None] if r["start"] == 0]) == 2
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = [x for r in sorted(of_doc[1], key=lambda r: r["start"]) for x in np.frombuffer(r["ids"], "<u4").tolist()]
    assert ids == [*tokenizer.encode(text.replace("0a1b2c3d4e5f60718293a4b5c6d7e8f901234567", "[SECRET]"), add_special_tokens=False).ids, packing.END_ID]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == spark.read.parquet(f"{sf}/documents.parquet").columns


def test_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path / "a", [], [])).collect() == []
