"""Exact top-k by inner product over vector-approximation files.

Components become integers floor(256 * x). Each dimension is divided into CELLS
cells: two for what lies outside of nearly all values of a bounded sample of rows
(SAMPLE, by hash), the others of equal width; the first and the last cell end at
the least and the largest value of all rows, so every value is in a cell. A
vector's approximation is its cells, a byte a dimension. For a query, the cells
give a lower and an upper bound of the score.

First only approximations are read: queries and vectors meet in blocks of at most
QUERY_ROWS queries and about BLOCK_VALUES cells, every query every vector once,
and the kth lower bound rules out all vectors whose upper bound is below it. Then
exact vectors are read in the order of their upper bounds: for each query the
first FIRST * k, then those whose upper bound still reaches the kth exact score;
after that the result is certain.

Equal vectors are one: of the rows of one vector, only the k + 1 with the
smallest ids can be among the k best of any query. So a vector that a third of
all rows repeat costs as much as another.

Null vectors, empty vectors, and vectors with a null, NaN or infinite component,
take no part on either side; nor do rows without id. Vectors of another dimension
than the query's are no candidates. Ties go to the smaller id. Rows that repeat
an id are candidates each, but none for a query of that id; equal rows are one
query, and different vectors of one id a query each. Scores beyond a long are
given as the long that is nearest, and ranked by their exact value. Empty table:
no rows. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import discard, written

CELLS, SAMPLE, OUTSIDE = 256, 4096, 0.001
QUERY_ROWS, BLOCK_VALUES, FIRST = 1024, 1 << 19, 4
#: Components are scaled down so that their largest has this exponent at most: no product overflows.
LARGEST = 400
KEYS, QUERY = ["h", "g"], ["query_id", "qh", "qg"]


def taking_part(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x (doubles), dim, h, g (128 bits of a hash of x) of the rows that take part."""
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    ok = F.size(vector_col) > 0
    ok &= ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    out = df.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.coalesce(ok, F.lit(False)))
    return out.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).withColumns({"dim": F.size("x"), "h": F.xxhash64("x"), "g": F.xxhash64(F.lit(1), "x")})


def _by_dim(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of a batch's vectors of each length."""
    sizes, flat = np.diff(np.asarray(column.offsets)), np.asarray(column.flatten())
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield at, flat[starts[at][:, None] + np.arange(dim)]


def scaled(x: np.ndarray, shift: int) -> np.ndarray:
    """floor(256 * x) / 2 ** shift."""
    big = np.abs(x) >= 2.0**60  # these are integers already
    return np.where(big, np.ldexp(x, 8 - shift), np.ldexp(np.floor(256 * np.where(big, 0, x)), -shift))


class Cells:
    """Where cells begin and end: for each length of vectors, and each dimension, CELLS + 1 numbers. Its size depends on the vectors' lengths alone."""

    def __init__(self, rows: DataFrame):
        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, x in _by_dim(batch.column(0)):
                    dim = x.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim)), pa.array(np.arange(dim)), pa.array(x.min(0)), pa.array(x.max(0))], ["dim", "at", "low", "high"])

        found = rows.select("x").mapInArrow(ranges, "dim long, at long, low double, high double").groupBy("dim", "at").agg(F.min("low"), F.max("high")).collect()
        largest = max((max(abs(r[2]), abs(r[3])) for r in found), default=0.0)
        self.shift = max(0, math.frexp(largest)[1] + 8 - LARGEST)
        self.edges: dict[int, np.ndarray] = {}
        for dim, at, low, high in found:
            self.edges.setdefault(dim, np.zeros((dim, CELLS + 1)))[at, [0, -1]] = low, high
        sample = rows.select("x", *KEYS).orderBy(*KEYS).limit(SAMPLE).select("x").toArrow().column("x").combine_chunks()
        known = {x.shape[1]: x for _, x in _by_dim(sample)} if len(sample) else {}
        for dim, e in self.edges.items():
            low, high = e[:, 0], e[:, -1]
            a, b = np.quantile(known[dim], [OUTSIDE, 1 - OUTSIDE], axis=0) if dim in known else (low, high)
            e[:, 1:-1] = np.linspace(a / 2, b / 2, CELLS - 1, axis=1) * 2
            e[:] = np.maximum.accumulate(scaled(np.clip(e, low[:, None], high[:, None]), self.shift), axis=1)

    def of(self, x: np.ndarray) -> np.ndarray:
        edges, v = self.edges[x.shape[1]], scaled(x, self.shift)
        return np.stack([np.searchsorted(e[1:-1], c, "right") for e, c in zip(edges, v.T, strict=True)], 1).astype(np.uint8)

    def approximations(self, rows: DataFrame) -> DataFrame:
        """h, g, dim, cells: one row for each different vector."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, x in _by_dim(batch.column(2)):
                    h, g = (batch.column(c).take(pa.array(at)) for c in (0, 1))
                    yield pa.RecordBatch.from_arrays([h, g, pa.array(np.full(len(at), x.shape[1])), pa.array([c.tobytes() for c in self.of(x)], pa.binary())], ["h", "g", "dim", "cells"])

        return rows.select(*KEYS, "x").mapInArrow(run, "h long, g long, dim long, cells binary").dropDuplicates(KEYS)


BOUNDS = "query_id long, qh long, qg long, h long, g long, least double, most double"


def _block(k: int, cells: Cells):
    """Bounds of the vectors that a block's kth lower bounds don't rule out. The query's own vector is kept, as other rows may have it, but rules out none."""

    def run(key, queries, data):
        out: list[tuple] = []
        if queries.num_rows and data.num_rows:
            dim = key[2].as_py()
            edges = cells.edges[dim]
            q = scaled(np.asarray(queries.column("qx").combine_chunks().flatten()).reshape(-1, dim), cells.shift)
            qh, qg = (np.asarray(queries.column(c))[:, None] for c in ("qh", "qg"))
            h, g = (np.asarray(data.column(c)) for c in KEYS)
            packed = np.frombuffer(b"".join(data.column("cells").to_pylist()), np.uint8).reshape(-1, dim)
            up, down = np.maximum(q, 0), np.minimum(q, 0)
            slip = 16 * (dim + 4) * 2.0**-53 * (np.abs(q) @ np.abs(edges[:, [0, -1]]).max(1))[:, None]  # of the sums' rounding
            enough = np.full((len(q), k), -np.inf)
            step = max(1, (1 << 22) // max(dim, len(q)))
            for a in range(0, len(h), step):
                c = packed[a : a + step].astype(np.int64)
                low, high = (edges[np.arange(dim), c + i].T for i in (0, 1))
                least, most = up @ low + down @ high - slip, up @ high + down @ low + slip
                own = (h[a : a + step] == qh) & (g[a : a + step] == qg)
                best = np.concatenate([enough, np.where(own, -np.inf, least)], 1)
                enough = np.partition(best, best.shape[1] - k, 1)[:, -k:]
                i, j = np.nonzero(own | (most >= enough.min(1)[:, None]))
                out.append((i, a + j, least[i, j], most[i, j], own[i, j]))
        i, j, least, most, own = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 5
        if len(i):
            keep = (own == 1) | (most >= enough.min(1)[i])
            i, j, least, most, own = i[keep], j[keep], least[keep], most[keep], own[keep]
        of_query = [queries.column(c).combine_chunks().take(pa.array(i, pa.int64())) for c in QUERY]
        of_data = [data.column(c).combine_chunks().take(pa.array(j, pa.int64())) for c in KEYS]
        return pa.table([*of_query, *of_data, pa.array(np.where(own == 1, -np.inf, least), pa.float64()), pa.array(most, pa.float64())], names=[*QUERY, *KEYS, "least", "most"])

    return run


SCORES = "query_id long, qh long, qg long, h long, g long, score long, beyond string, near double"


def _scores(pairs: DataFrame, shift: int) -> DataFrame:
    """Exact scores of pairs of vectors (qx, x): as a long, what orders those beyond it, and divided by 4 ** shift."""

    def beyond(s: int) -> str:
        digits = str(abs(s))
        if -(1 << 63) < s < 1 << 63:
            return ""
        if s > 0:
            return f"{len(digits):05d}{digits}"
        return "~" if s == -(1 << 63) else f"{99999 - len(digits):05d}{digits.translate(str.maketrans('0123456789', '9876543210'))}"

    def whole(x: float) -> int:
        return int(x) * 256 if abs(x) >= 2.0**60 else math.floor(256 * x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, score, order = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, "", object)
            for (at, q), (_, x) in zip(_by_dim(batch.column(5)), _by_dim(batch.column(6)), strict=True):
                a, b = np.abs(q).max(1) * 256 + 1, np.abs(x).max(1) * 256 + 1
                small = np.log2(a) + np.log2(b) + np.log2(q.shape[1]) < 61
                score[at[small]] = (np.floor(256 * q[small]).astype(np.int64) * np.floor(256 * x[small]).astype(np.int64)).sum(1)
                near[at[small]] = np.ldexp(score[at[small]].astype(float), -2 * shift)
                for i in np.flatnonzero(~small):
                    s = sum(whole(u) * whole(v) for u, v in zip(q[i].tolist(), x[i].tolist(), strict=True))
                    score[at[i]], order[at[i]], near[at[i]] = max(-(1 << 63), min(s, (1 << 63) - 1)), beyond(s), s / (1 << 2 * shift)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(score), pa.array(order, pa.string()), pa.array(near)], [*QUERY, *KEYS, "score", "beyond", "near"])

    return pairs.select(*QUERY, *KEYS, "qx", "x").mapInArrow(run, SCORES)


def top_k(vectors: DataFrame, *, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose id is divisible by every, their k best among the other rows."""
    rows = taking_part(vectors, id_col, vector_col)
    cells = Cells(rows)
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("h").alias("qh"), F.col("g").alias("qg"), F.col("x").alias("qx"), F.col("dim").cast("long").alias("dim")).distinct()
    n_queries, values = rows.agg(F.count_if(F.col("vec_id") % every == 0), F.coalesce(F.sum("dim"), F.lit(0))).first()
    q_blocks, d_blocks = max(1, -(-n_queries // QUERY_ROWS)), max(1, -(-values // BLOCK_VALUES))

    # The k + 1 smallest ids of each vector, with how many rows have them (k count at most).
    of_vector = rows.groupBy(*KEYS, "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy("vec_id"))
    ids = written(of_vector.withColumn("place", place).where(F.col("place") <= k + 1).drop("place"), "ids")

    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int")).withColumn("db", every_block(d_blocks))
    data = cells.approximations(rows).withColumn("db", F.pmod("h", F.lit(d_blocks)).cast("int")).withColumn("qb", every_block(q_blocks))
    met = dealt.groupBy("qb", "db", "dim").cogroup(data.groupBy("qb", "db", "dim")).applyInArrow(_block(k, cells), BOUNDS)
    found = written(met, "bounds")

    # The kth lower bound over all blocks.
    of_query = Window.partitionBy(*QUERY)
    best = found.select(*QUERY, "least").withColumn("r", F.row_number().over(of_query.orderBy(F.desc("least")))).where(F.col("r") <= k)
    enough = best.groupBy(*QUERY).agg(F.when(F.count("*") == k, F.min("least")).otherwise(float("-inf")).alias("enough"))
    near = found.join(enough, QUERY).where("most >= enough OR least = double('-inf')").drop("enough", "least")
    near = written(near.withColumn("r", F.row_number().over(of_query.orderBy(F.desc("most"), *KEYS))), "near")

    def ranked(scores: DataFrame) -> DataFrame:
        each = scores.join(ids, KEYS).where("vec_id <> query_id").withColumn("time", F.explode(F.sequence(F.lit(1), "times")))
        rank = F.row_number().over(of_query.orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
        return each.withColumn("rank", rank).where(F.col("rank") <= k)

    def exact(pairs: DataFrame) -> DataFrame:
        """Reads the vectors of pairs, and no others."""
        wanted = rows.join(pairs.select(*KEYS).distinct(), KEYS, "left_semi").select(*KEYS, "x").dropDuplicates(KEYS)
        return _scores(pairs.join(queries.drop("dim"), QUERY).join(wanted, KEYS), cells.shift)

    first = written(exact(near.where(F.col("r") <= FIRST * k)), "first")
    certain = ranked(first).groupBy(*QUERY).agg(F.when(F.count("*") == k, F.min("near")).alias("certain"))
    left = near.where(F.col("r") > FIRST * k).join(certain, QUERY, "left").where("certain IS NULL OR most >= certain").drop("certain")
    rest = written(exact(left), "rest")
    discard(found, near)
    return ranked(first.unionAll(rest)).select("query_id", "rank", "vec_id", "score")
