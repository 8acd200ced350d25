"""An interpolated modified Kneser-Ney n-gram model, counted in Spark.

A text's tokens are its words, then one end; a begin mark stands before the first.
A gram of n tokens has a 64-bit key: of one token the word's hash, of more a hash
of the keys of the two grams of n - 1 tokens that make it up, its context and its
suffix. Grams are dealt to shards by a hash of their context; those whose context
ends in a frequent word also by one of their suffix, to as many shards as the
word's count asks for. So a shard has a context's grams together, but neither a
frequent word nor a frequent context fills one, and no table of bounds is needed.

- Words are counted first. For each order, from the highest down, a chunk's
  distinct grams go to their shards, as contexts, each with its suffixes and their
  counts. A shard's sorted keys and counts
  are arrays in files of the shared folder. Below the highest order a gram counts
  as often as different tokens stand before it; if it begins with the begin mark,
  as often as it occurs.
- Each shard gives on, by key, one for each suffix (the counts of the next order),
  and the sums of each context, from which back-off weights are made.
- Workers map the files into memory and score texts by binary search of sorted
  keys, in the shards that these keys are in; only the discounts and a few sums go
  with the tasks.

Shards grow in number with the bytes of the training part, so what a task holds
does not. A file gets its final name when it is complete, and a task that runs
again writes the same bytes; so lost executors leave no half-written file behind.

Discounts follow Chen and Goodman from the counts of counts of each order; where
these make no sense (tiny inputs), 0.5 is taken. Null text is an empty text: its
end is its only token. Very long texts are read whole. A null id counts as the
text ''; rows with equal ids are trained on and scored each. Words not in the
training part have the probability that the uniform distribution over V + 1 words
is given. Without training rows every token is unknown, at probability 1 (score
0). Empty table: no rows. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import discard, new_path, posix, written
from .words import hashed_words, mix

END, BEGIN = np.uint64(0x1F0E4D2C3B5A6978), np.uint64(0x6A09E667F3BCC908)
#: Training text for each shard of an order. Tokens of one chunk when counting, and when scoring.
BYTES_A_SHARD, COUNTED, SCORED = 24_000_000, 2_000_000, 1_000_000
#: Contexts that end in a word of so many occurrences, or a multiple, are dealt to one shard more for each.
SPLIT = 1_000_000
STATS, CONTEXT, SUFFIX, TEXT = range(4)
#: Grams of texts (a: contexts, or words; b: suffixes; runs: for each context how many, twice, and one more if it begins with the begin mark) and sums by key (a: keys, counts: a row for each number).
BLOBS = "kind int, shard int, a binary, b binary, counts binary, runs binary, stats array<long>"
_TYPES = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
_NAMES = [c.split()[0] for c in BLOBS.split(", ")]


def held_out(doc_id) -> Any:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _save(path: str, x: np.ndarray) -> None:
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.lib.format.write_array(f, x)
    os.replace(part, path)


def _load(path: str) -> np.ndarray:
    return np.load(path, mmap_mode="r")


def _fit(x: np.ndarray) -> np.ndarray:
    """Counts in the smallest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _packed(x: np.ndarray) -> bytes:
    """Counts as the width of their type, then their bytes."""
    x = _fit(x)
    return bytes([x.itemsize]) + x.tobytes()


def _unpacked(data: pa.Scalar) -> np.ndarray:
    raw = data.as_buffer()
    return np.frombuffer(raw, f"<u{np.frombuffer(raw, np.uint8, 1)[0]}", offset=1).astype(np.int64)


def _gram(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    return mix(context * np.uint64(0x9FB21C651E98DF25) + mix(suffix + np.uint64(0x2545F4914F6CDD1D)))


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Rises with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _gram_shard(contexts: np.ndarray, suffixes: np.ndarray, said: np.ndarray, shards: int) -> np.ndarray:
    """The shards of grams; said: how often the last words of their contexts occur."""
    part = mix(suffixes + np.uint64(0x1234567)) % (1 + said // SPLIT).astype(np.uint64)
    return _shard(mix(contexts ^ (part * np.uint64(0xD1342543DE82EF95))), shards)


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    cuts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))).tolist() if len(x) else []
    return list(zip(cuts, [*cuts[1:], len(x)], strict=True)) if cuts else []


def _summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, where each stood first, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(keys[order]) != 0))) if len(keys) else np.zeros(0, np.int64)
    return keys[order][first], order[first], *(np.add.reduceat(c[order], first) if len(keys) else c for c in counts)


def _sequences(column: pa.Array, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tokens with the begin mark before and the end after each text, how far each is from its text's begin mark) for runs of rows."""
    held, size = [], 0
    for _, words, at in hashed_words(column):
        n = len(at) - 1
        starts = at + 2 * np.arange(n + 1)
        out = np.empty(len(words) + 2 * n, np.uint64)
        inside = np.ones(len(out), bool)
        inside[starts[:-1]] = inside[starts[1:] - 1] = False
        out[starts[:-1]], out[starts[1:] - 1], out[inside] = BEGIN, END, words
        held.append((out, (np.arange(len(out)) - np.repeat(starts[:-1], np.diff(starts))).astype(np.int32)))
        size += len(out)
        if size >= most:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As _sequences, over all batches of a task."""
    held, size = [], 0
    for batch in batches:
        for chunk in _sequences(batch.column(0), COUNTED):
            held.append(chunk)
            size += len(chunk[0])
            if size >= COUNTED:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _grams(tokens: np.ndarray, n: int) -> np.ndarray:
    """Keys of the n tokens that end at each place; those that reach over a text's begin mean nothing."""
    keys = tokens
    for _ in range(n - 1):
        longer = keys.copy()
        longer[1:] = _gram(keys[:-1], keys[1:])
        keys = longer
    return keys


def _table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[]] * len(_NAMES)
    return pa.table([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)


class Model:
    """Where a model's files are, and the few numbers that go with them."""

    def __init__(self, folder: str, shards: int, order: int):
        self.folder, self.shards, self.order = folder, shards, order
        self.tokens = self.words = self.texts = 0
        #: By order: discounts of counts 0, 1, 2, and 3 or more.
        self.discounts = {n: np.zeros(4) for n in range(1, order + 1)}
        #: Of the lowest order: the sum of counts, and what of it the uniform distribution is given.
        self.total, self.uniform = 1, 1.0

    def path(self, name: str, n: int, shard: int) -> str:
        return f"{self.folder}/{name}-{n}-{shard}.npy"

    def values(self, n: int, keys: np.ndarray, of: str, names: tuple[str, ...], shard: np.ndarray | None = None) -> list[np.ndarray]:
        """Arrays' values at sorted keys, 0 for those that are not in the files of. shard: the keys' shards, if not by the keys themselves."""
        out = [np.zeros(len(keys)) for _ in names]
        if not self.tokens:
            return out
        shard = _shard(keys, self.shards) if shard is None else shard
        order = np.argsort(shard, kind="stable")
        for a, b in _runs(shard[order]):
            here = order[a:b]
            k = int(shard[here[0]])
            known = _load(self.path(of, n, k))
            if len(known):
                at = np.minimum(np.searchsorted(known, keys[here]), len(known) - 1)
                hit = known[at] == keys[here]
                for x, name in zip(out, names, strict=True):
                    x[here[hit]] = _load(self.path(name, n, k))[at[hit]]
        return out

    def before(self, n: int, keys: np.ndarray) -> np.ndarray:
        """How many different tokens stand before grams, whose keys are sorted."""
        return self.values(n, keys, "followed", ("before",))[0].astype(np.int64)

    def said(self, tokens: np.ndarray) -> np.ndarray:
        """How often the words of tokens occur in the training part; the begin mark, as often as there are texts."""
        words, inverse = np.unique(tokens, return_inverse=True)
        (raw,) = self.values(1, words, "keys", ("raw",))
        raw[words == BEGIN] = self.texts
        return raw.astype(np.int64)[inverse]

    def scores(self, tokens: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each text: tokens, known tokens, base score, log10 probability."""
        said = np.flatnonzero(place > 0)
        keys, inverse = np.unique(tokens[said], return_inverse=True)
        raw, count = self.values(1, keys, "keys", ("raw", "counts"))
        base = np.log10((raw + 0.1) / (self.tokens + 0.1 * (self.words + 1)))
        low = (count - self.discounts[1][np.minimum(count, 3).astype(int)]) / self.total + self.uniform / (self.words + 1)
        p, grams = low[inverse], tokens
        often = np.full(len(tokens), self.texts, np.int64)
        often[said] = raw.astype(np.int64)[inverse]
        for n in range(2, self.order + 1):
            here = np.flatnonzero(place[said] >= n - 1)
            at = said[here]
            contexts, of_context = np.unique(grams[at - 1], return_inverse=True)
            total, weight = self.values(n, contexts, "contexts", ("totals", "weights"))
            shorter, grams = grams, grams.copy()
            grams[1:] = _gram(shorter[:-1], shorter[1:])
            known = total[of_context] > 0
            here, of_context = here[known], of_context[known]
            at = at[known]
            keys, first, of_key = np.unique(grams[at], return_index=True, return_inverse=True)
            at = at[first]
            (count,) = self.values(n, keys, "keys", ("counts",), _gram_shard(shorter[at - 1], shorter[at], often[at - 1], self.shards))
            high = (count - self.discounts[n][np.minimum(count, 3).astype(int)])[of_key] / total[of_context]
            p[here] = high + weight[of_context] * p[here]
        starts = np.flatnonzero(place[said] == 1)
        one = np.ones(len(said), np.int64)
        return tuple(np.add.reduceat(x, starts) for x in (one, (raw > 0).astype(np.int64)[inverse], base[inverse], np.log10(p)))


def _discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts of counts 0, 1, 2, and 3 or more."""
    half = np.array([0, 0.5, 0.5, 0.5])
    if not (n1 and n2 and n3 and n4):
        return half
    y = n1 / (n1 + 2 * n2)
    d = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return d if (d[1:] > 0).all() and (d[1:] <= [1, 2, 3]).all() else half


def _of_texts(model: Model, n: int):
    """The distinct words (n = 1), or grams of n tokens, of each chunk, by shards."""

    def words(tokens: np.ndarray, place: np.ndarray) -> Iterator[tuple]:
        keys, counts = np.unique(tokens[place > 0], return_counts=True)
        shard = _shard(keys, model.shards)
        for a, b in _runs(shard):
            yield TEXT, int(shard[a]), keys[a:b].tobytes(), b"", _packed(counts[a:b]), b"", None

    def grams(tokens: np.ndarray, place: np.ndarray) -> Iterator[tuple]:
        shorter = _grams(tokens, n - 1)
        at = np.flatnonzero(place >= n - 1)
        index, counts = np.unique(_gram(shorter[at - 1], shorter[at]), return_index=True, return_counts=True)[1:]
        at = at[index]
        contexts, suffixes, begins = shorter[at - 1], shorter[at], place[at] == n - 1
        shard = _gram_shard(contexts, suffixes, model.said(tokens[at - 1]), model.shards)
        order = np.lexsort((contexts, shard))
        contexts, suffixes, begins, counts, shard = contexts[order], suffixes[order], begins[order], counts[order], shard[order]
        for a, b in _runs(shard):
            runs = _runs(contexts[a:b])
            first = np.array([i for i, _ in runs]) + a
            sizes = np.array([j - i for i, j in runs])
            yield TEXT, int(shard[a]), contexts[first].tobytes(), suffixes[a:b].tobytes(), _packed(counts[a:b]), _packed(2 * sizes + begins[first]), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            for row in words(*chunk) if n == 1 else grams(*chunk):
                yield from _table([row]).to_batches()

    return run


class _Parts:
    """A group's columns, by kind."""

    def __init__(self, table: pa.Table):
        self.kind = np.asarray(table.column("kind"))
        self.columns = {c: table.column(c).combine_chunks() for c in ("a", "b", "counts", "runs")}

    def each(self, name: str, kind: int) -> Iterator[pa.Scalar]:
        return (self.columns[name][int(i)] for i in np.flatnonzero(self.kind == kind))

    def keys(self, name: str, kind: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_buffer(), np.uint64) for x in self.each(name, kind))])

    def counts(self, name: str, kind: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(_unpacked(x) for x in self.each(name, kind) if len(x.as_buffer()))])


def _stats(k: int, counts: np.ndarray, raw: np.ndarray) -> tuple:
    many = [int((counts == i).sum()) for i in range(1, 5)] + [int((counts > 2).sum()), int(counts.sum()), int(raw.sum()), len(counts)]
    return STATS, k, b"", b"", b"", b"", many


def _words(model: Model):
    """A shard's words go to files."""

    def run(key, table):
        k = int(key[0].as_py())
        parts = _Parts(table)
        keys, _, raw = _summed(parts.keys("a", TEXT), parts.counts("counts", TEXT))
        _save(model.path("keys", 1, k), keys)
        _save(model.path("raw", 1, k), _fit(raw))
        return _table([(STATS, k, b"", b"", b"", b"", [0, 0, 0, 0, 0, int(raw[keys == END].sum()), int(raw.sum()), len(keys)])])

    return run


def _sums(model: Model, n: int):
    """A shard's grams go to files; what contexts and suffixes get from them goes on, by shards of their keys."""

    def run(key, table):
        k = int(key[0].as_py())
        parts = _Parts(table)
        known, _, before = _summed(parts.keys("a", SUFFIX), parts.counts("counts", SUFFIX))
        if n == 1:
            keys = _load(model.path("keys", 1, k))
            counts = np.zeros(len(keys), np.int64)
            counts[np.searchsorted(keys, known)] = before
            _save(model.path("counts", 1, k), _fit(counts))
            return _table([_stats(k, counts, counts)])
        runs = parts.counts("runs", TEXT)
        contexts = np.repeat(parts.keys("a", TEXT), runs // 2)
        suffixes = parts.keys("b", TEXT)
        keys, index, raw = _summed(_gram(contexts, suffixes), parts.counts("counts", TEXT))
        contexts, suffixes, counts = contexts[index], suffixes[index], raw
        if n < model.order:
            begins = np.repeat(runs % 2, runs // 2)[index] == 1
            counts = np.where(begins, raw, 0)
            # Sums of suffixes come by their keys' shards: here all are at hand, there only some.
            counts[~begins] = model.before(n, keys[~begins])
        _save(model.path("keys", n, k), keys)
        _save(model.path("counts", n, k), _fit(counts))
        rows = [_stats(k, counts, raw)]
        of_context, _, *sums = _summed(contexts, counts, *((counts == i).astype(np.int64) for i in (1, 2)), (counts > 2).astype(np.int64))
        of_suffix, _, ones = _summed(suffixes, np.ones(len(suffixes), np.int64))
        for of, x, values in ((CONTEXT, of_context, sums), (SUFFIX, of_suffix, [ones])):
            shard = _shard(x, model.shards)
            rows += [(of, int(shard[i]), x[i:j].tobytes(), b"", _packed(np.concatenate([v[i:j] for v in values])), b"", None) for i, j in _runs(shard)]
        return _table(rows)

    return run


def _before(model: Model, n: int):
    """For each gram of n tokens how many different tokens stand before it: a file for each shard of its key."""

    def run(key, table):
        k = int(key[0].as_py())
        parts = _Parts(table)
        keys, _, before = _summed(parts.keys("a", SUFFIX), parts.counts("counts", SUFFIX))
        _save(model.path("followed", n, k), keys)
        _save(model.path("before", n, k), _fit(before))
        return pa.table({"shard": pa.array([k], pa.int32())})

    return run


def _weights(model: Model, n: int):
    """The contexts of grams of n tokens: their totals, and the weights with which they back off."""

    def run(key, table):
        k = int(key[0].as_py())
        column = {c: table.column(c).combine_chunks() for c in ("a", "counts")}
        keys = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in column["a"]])
        parts = [_unpacked(x).reshape(4, -1) for x in column["counts"] if len(x.as_buffer())]
        sums = np.concatenate(parts, 1) if parts else np.zeros((4, 0), np.int64)
        keys, _, total, *met = _summed(keys, *sums)
        _save(model.path("contexts", n, k), keys)
        _save(model.path("totals", n, k), _fit(total))
        _save(model.path("weights", n, k), model.discounts[n][1:] @ np.array(met).reshape(3, -1) / np.maximum(total, 1))
        return pa.table({"shard": pa.array([k], pa.int32())})

    return run


def train(texts: DataFrame, order: int = 2) -> Model:
    """A model of the rows of texts, whose only column is the text, of grams of up to order tokens (two at least)."""
    spark = texts.sparkSession
    uri = new_path(spark, "lm")
    at = spark._jvm.org.apache.hadoop.fs.Path(uri)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    n_rows, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(texts.columns[0]))), F.lit(0))).first()
    model = Model(posix(uri), max(1, -(-size // BYTES_A_SHARD)), order)
    if not n_rows:
        return model
    # Each shard has its files, also where nothing falls into it.
    none = F.lit(b"")
    shards = lambda of: spark.range(model.shards).select(F.lit(of).alias("kind"), F.col("id").cast("int").alias("shard"), none.alias("a"), none.alias("b"), none.alias("counts"), none.alias("runs"), F.lit(None).cast("array<long>").alias("stats"))
    counted = lambda blobs, run, schema: blobs.groupBy("shard").applyInArrow(run, schema)
    first = counted(texts.mapInArrow(_of_texts(model, 1), BLOBS).unionAll(shards(TEXT)), _words(model), BLOBS)
    model.texts, model.tokens, model.words = first.agg(*(F.sum(F.col("stats")[i]) for i in (5, 6, 7))).first()
    above = None
    for n in range(order, 0, -1):
        suffixes = above.where(F.col("kind") == SUFFIX).unionAll(shards(SUFFIX)) if above is not None else None
        if n == 1:
            blobs = suffixes
        else:
            if above is not None:
                counted(suffixes, _before(model, n), "shard int").agg(F.count("*")).collect()
            blobs = texts.mapInArrow(_of_texts(model, n), BLOBS).unionAll(shards(TEXT))
        sums = written(counted(blobs, _sums(model, n), BLOBS), "sums")
        stats = sums.where(F.col("kind") == STATS).select(*(F.sum(F.col("stats")[i]) for i in range(6))).first()
        model.discounts[n] = _discounts(*stats[:4])
        if n > 1:
            contexts = sums.where(F.col("kind") == CONTEXT).unionAll(shards(CONTEXT))
            counted(contexts, _weights(model, n), "shard int").agg(F.count("*")).collect()
        else:
            model.total = stats[5]
            model.uniform = float(model.discounts[1][1:] @ [stats[0], stats[1], stats[4]]) / model.total
        if above is not None:
            discard(above)
        above = sums
    discard(above)
    return model


def scored(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [model.scores(*chunk) for chunk in _sequences(batch.column(2), SCORED)]
            if not done:
                continue
            n, known, base, score = (np.concatenate(x) for x in zip(*done, strict=True))
            cols = [pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens)), pa.array(base), pa.array(score), pa.array(10.0 ** np.minimum(300, -score / n))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *cols], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def language_model_scores(docs: DataFrame, *, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all rows under a model of those that are not held out."""
    return scored(docs, train(docs.where(~held_out(F.col(id_col))).select(text_col), order), id_col=id_col, text_col=text_col)
