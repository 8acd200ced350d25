"""Quality by co-training: a classifier of the text and one of the page's metadata teach each other.

The text's view: its distinct words, hashed to WORDS buckets, and statistics of the
whole text by classes of their value. The metadata's view: source (hashed),
language and length by class. Each view's classifier is naive Bayes on its
classes; the words count by the mean of their log odds, as WORD_WEIGHT classes
would, so that long texts are not surer than short ones. In each round every row is read: labelled rows count for
both views, and a row without label counts, with a lower weight, for the view
that the other one is confident about. Confidence is the other view's calibrated
probability (Platt's method on labelled rows that no view was trained on). At
the end a logistic combination of both calibrated views, fitted on the same
rows, scores every row.

What the driver gets are counts by class, label and score class: tables whose
size is fixed, whatever the input.

Null and empty texts have the statistics of an empty text; null metadata is a
class of its own. Of several labels for an id the lowest counts; rows with equal
ids are scored each, rows without id have no label. Very long texts are read
whole. A score that ties with the threshold keeps its row. Without labels of both
kinds every row is kept, at score 1.0. Empty table: no rows. Extra columns,
whatever their names, are kept by filtered() and not read otherwise; columns that
are missing count as null.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import discard, lean, written

ROUNDS, CONFIDENT, PSEUDO_WEIGHT, FOLDS, THRESHOLD = 3, 0.97, 0.3, 5, 0.5
SOURCES, WORDS, WORD_WEIGHT = 512, 4096, 10.0
#: Labels of up to so many documents are broadcast.
BROADCAST_LABELS = 1_000_000
#: The share of distinct words is the mean over a text's consecutive blocks of so many words, weighted by their words: a whole text's share falls with its length.
BLOCK = 400
#: Upper ends of the classes of each statistic of a text.
EDGES = {
    "words": (1, 5, 20, 60, 200, 1000), "upper": (0.005, 0.02, 0.04, 0.08, 0.15, 0.3, 0.6), "digits": (0.0005, 0.002, 0.01, 0.03, 0.1, 0.3), "signs": (0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.35),
    "rare_signs": (0.0005, 0.002, 0.005, 0.01, 0.03, 0.1, 0.2), "word_length": (2.5, 3.5, 4.2, 5, 6, 7.5, 10, 15), "distinct": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), "repeated_lines": (0.001, 0.05, 0.1, 0.2, 0.4, 0.6),
    "line_length": (10, 25, 50, 100, 200, 500, 1500), "top_word": (0.03, 0.05, 0.08, 0.12, 0.2, 0.4), "upper_words": (0.01, 0.03, 0.1, 0.3, 0.6), "sign_words": (0.02, 0.05, 0.1, 0.15, 0.25, 0.5, 0.8),
    "shouts": (0.001, 0.01, 0.05, 0.2), "next_same": (0.002, 0.01, 0.03, 0.1, 0.3),
}
_EDGES = list(EDGES.values())
N_TEXT, N_META, WIDTH = len(EDGES), 4, max(SOURCES, 16)
_LETTER = bytes(i for i in range(256) if chr(i).isalpha() and i < 128 or i >= 128)
_SIGNS = [i for i in range(33, 127) if not chr(i).isalnum()]
_RARE = [ord(c) for c in "#$%&*|<>{}[]\\^~_=+@"]


def text_view(text: str | None) -> tuple[list[int], bytes]:
    """The classes of a text's statistics, and the buckets of its distinct words (A-Z count as a-z), sorted, two bytes each."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, m = len(raw), len(words)
    if not m:
        return [0] * N_TEXT, b""
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(1, int(count[65:91].sum() + count[97:123].sum() + count[128:].sum() // 2))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    upper = sum(c for w, c in seen.items() if len(w) > 1 and w.isupper())
    signed = sum(c for w, c in seen.items() if not w[-1:].isalnum() and w[-1] < 128)
    values = (
        m, count[65:91].sum() / letters, count[48:58].sum() / n, count[_SIGNS].sum() / n, count[_RARE].sum() / n, sum(map(len, words)) / m, sum(len(set(words[i : i + BLOCK])) for i in range(0, m, BLOCK)) / m,
        1 - len(set(lines)) / len(lines), n / len(lines), max(seen.values()) / m, upper / m, signed / m, count[33] / m, same / m,
    )
    buckets = np.array(sorted({zlib.crc32(w.lower()) % WORDS for w in seen}), "<u2")
    return [bisect_right(e, v) for e, v in zip(_EDGES, values, strict=True)], buckets.tobytes()


def meta_classes(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    s = 0 if source is None else 1 + zlib.crc32(source.encode()) % (SOURCES - 1)
    g = 0 if lang is None else 1 + zlib.crc32(lang.encode()) % 255
    size = 0 if n_chars is None or n_chars < 0 else min(15, 1 + int(n_chars).bit_length() // 2)
    return [s, g, size, (g * 31 + size) % SOURCES]


def _flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row of each bucket, buckets) of a column of buckets as text_view() gives them."""
    n = np.diff(np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4)) // 2 if len(words) else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(words)), n), np.frombuffer(b"".join(words.to_pylist()), "<u2").astype(np.int64)


class Views:
    """Log odds of the classes in both views, their calibration, and the weights of both in the end."""

    def __init__(self):
        self.text, self.meta = np.zeros((N_TEXT, WIDTH)), np.zeros((N_META, WIDTH))
        self.words, self.prior = np.zeros(WORDS), 0.0
        self.scale = [np.array([0.0, 1.0])] * 2
        self.mix = np.array([0.0, 1.0, 1.0])
        self.trained = False

    def odds(self, w: pa.Array, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, buckets = _flat(w)
        words = np.bincount(row, self.words[buckets], len(t)) / np.maximum(np.bincount(row, minlength=len(t)), 1)
        raw = self.prior + self.text[np.arange(N_TEXT), t].sum(1) + WORD_WEIGHT * words, self.prior + self.meta[np.arange(N_META), m].sum(1)
        return tuple(a + b * np.clip(x, -30, 30) for (a, b), x in zip(self.scale, raw, strict=True))

    def score(self, w: pa.Array, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.odds(w, t, m)
        return _p(a), _p(b), _p(self.mix[0] + self.mix[1] * a + self.mix[2] * b) if self.trained else np.ones(len(t))


def _p(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Weights (the first for the constant) fitted to n rows each of x with label y."""
    x, w = np.column_stack([np.ones(len(x)), x]), start.astype(float)
    for _ in range(50):
        q = _p(x @ w)
        h = x.T @ (x * (n * q * (1 - q))[:, None]) + 1e-3 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (n * (y - q)) - 1e-3 * (w - start))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


_FEATURES = "doc_id long, w binary, t array<int>, m array<int>"


def features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                t, w = zip(*(text_view(x.as_py()) for x in part.column(1)), strict=True)
                m = [meta_classes(*r) for r in zip(*(c.to_pylist() for c in part.columns[2:5]), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(w, pa.binary()), pa.array(t, pa.list_(pa.int32())), pa.array(m, pa.list_(pa.int32()))], ["doc_id", "w", "t", "m"])

    return _columns(docs).mapInArrow(lean(run), _FEATURES)


def _columns(docs: DataFrame) -> DataFrame:
    has = {c.lower() for c in docs.columns}
    pick = lambda c, kind: (F.col(c) if c in has else F.lit(None)).cast(kind).alias(c)
    return docs.select(pick("doc_id", "long"), pick("text", "string"), pick("source", "string"), pick("lang", "string"), pick("n_chars", "long"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def _counted(rows: DataFrame, views: Views, teach: bool) -> tuple[np.ndarray, np.ndarray]:
    """Counts (feature of both views, class, label), and (bucket of words, label), of one reading of all rows."""
    shape = (N_TEXT + N_META, WIDTH, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = np.zeros(shape), np.zeros((WORDS, 2))
        for batch in batches:
            w, t, m, y = batch.column(0), _matrix(batch.column(1), N_TEXT), _matrix(batch.column(2), N_META), np.asarray(batch.column(3))
            held = np.asarray(batch.column(4))
            a, b = views.odds(w, t, m)
            for classes, other, first in ((t, b, 0), (m, a, N_TEXT)):
                label, weight = np.where(y == 1, 1, 0), np.where((y >= 0) & ~held, 1.0, 0.0)
                if teach:
                    p = _p(other)
                    sure = (y < 0) & ((p > CONFIDENT) | (p < 1 - CONFIDENT))
                    label, weight = np.where(sure, p > 0.5, label), np.where(sure, PSEUDO_WEIGHT, weight)
                for f in range(classes.shape[1]):
                    np.add.at(total[first + f], (classes[:, f], label), weight)
                if not first:
                    row, buckets = _flat(w)
                    words += np.bincount(buckets * 2 + label[row], weight[row], 2 * WORDS).reshape(WORDS, 2)
        flat = np.concatenate([total.ravel(), words.ravel()])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["at", "n"])

    summed = rows.select("w", "t", "m", "y", "held").mapInArrow(lean(run), "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(int(np.prod(shape)) + 2 * WORDS)
    for r in summed:
        out[r["at"]] = r["n"]
    return out[: -2 * WORDS].reshape(shape), out[-2 * WORDS :].reshape(WORDS, 2)


def _calibrate(rows: DataFrame, views: Views) -> None:
    """Fits both calibrations and the combination to the labelled rows that were held out, by classes of their scores."""
    steps = 64
    views.scale = [np.array([0.0, 1.0])] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((steps + 1, steps + 1, 2))
        for batch in batches:
            a, b = views.odds(batch.column(0), _matrix(batch.column(1), N_TEXT), _matrix(batch.column(2), N_META))
            i, j = (np.round((np.clip(x, -16, 16) + 16) * 2).astype(int) for x in (a, b))
            np.add.at(total, (i, j, np.asarray(batch.column(3))), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "n"])

    found = rows.where("held AND y >= 0").select("w", "t", "m", "y").mapInArrow(lean(run), "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
    if not found:
        return
    i, j, y = np.unravel_index([r["at"] for r in found], (steps + 1, steps + 1, 2))
    n, z = np.array([r["n"] for r in found]), np.column_stack([i, j]) / 2 - 16
    views.scale = [_logistic(z[:, k], y, n, np.array([0.0, 1.0])) for k in (0, 1)]
    z = np.column_stack([s[0] + s[1] * z[:, k] for k, s in enumerate(views.scale)])
    views.mix = _logistic(z, y, n, np.array([0.0, 0.5, 0.5]))


def _trained_on(rows: DataFrame) -> Views:
    views = Views()
    for turn in range(ROUNDS + 1):
        n, words = _counted(rows, views, teach=turn > 0)
        both = n[0].sum(0)
        if not both.all():
            return views
        odds = np.log((n[..., 1] + 0.5) / (n[..., 1].sum(1, keepdims=True) + 1)) - np.log((n[..., 0] + 0.5) / (n[..., 0].sum(1, keepdims=True) + 1))
        odds[n.sum(2) == 0] = 0
        share = (words + 0.5) / (both + 1)
        views.words = np.where(words.sum(1) > 0, np.log(share[:, 1]) - np.log(share[:, 0]), 0)
        views.text, views.meta, views.prior = odds[:N_TEXT], odds[N_TEXT:], float(np.log(both[1] / both[0]))
        _calibrate(rows, views)
    views.trained = True
    return views


def _rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Features of all rows with y (-1 without label) and held: labelled rows that no view is trained on."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS) == 0
    known = F.broadcast(known) if known.count() <= BROADCAST_LABELS else known
    # Rows without id, of which there may be many, meet no label and are not dealt out by it.
    named, others = (features(_columns(docs).where(c)) for c in ("doc_id IS NOT NULL", "doc_id IS NULL"))
    rows = named.join(known, "doc_id", "left").unionByName(others.withColumn("y", F.lit(None).cast("int")))
    return written(rows.select("doc_id", "w", "t", "m", F.coalesce("y", F.lit(-1)).alias("y"), held.alias("held")), "quality")


def co_trained(docs: DataFrame, labels: DataFrame) -> Views:
    rows = _rows(docs, labels)
    views = _trained_on(rows)
    discard(rows)
    return views


def scored(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_score, meta_score, score, keep for each row of docs."""
    rows = _rows(docs, labels)
    views = _trained_on(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, p = views.score(batch.column(1), _matrix(batch.column(2), N_TEXT), _matrix(batch.column(3), N_META))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in (a, b, p, p >= threshold))], ["doc_id", "text_score", "meta_score", "score", "keep"])

    return rows.select("doc_id", "w", "t", "m").mapInArrow(lean(run), "doc_id long, text_score double, meta_score double, score double, keep boolean")


def filtered(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all columns, that the classifier keeps."""
    views = co_trained(docs, labels)
    place = {c.lower(): i for i, c in reversed(list(enumerate(docs.columns)))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                read = lambda c, kind: batch.column(place[c]).cast(kind) if c in place else pa.nulls(batch.num_rows, kind)  # noqa: B023, E731
                text, size = read("text", pa.string()), read("n_chars", pa.int64()).to_pylist()
                t, w = zip(*(text_view(x.as_py()) for x in text), strict=True)
                m = np.array([meta_classes(*r) for r in zip(read("source", pa.string()).to_pylist(), read("lang", pa.string()).to_pylist(), size, strict=True)])
                yield batch.filter(pa.array(views.score(pa.array(w, pa.binary()), np.array(t), m)[2] >= threshold))

    return docs.mapInArrow(lean(run), docs.schema)
