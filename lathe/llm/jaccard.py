"""Jaccard self-join of documents' word shingles by a size-aware heavy-light join.

A document's set has its distinct shingles of k words. Two documents link when
den * |A & B| >= num * |A | B|. Equal sets are one class from the start.

Light sets, of at most B shingles: sets of sizes s <= t link just when they
share c shingles, where c depends on s and t alone; so each light set lists the
hashes of its c-subsets for each size of partner, and equal entries are links.

Heavy sets: inverted lists. Lists by single shingles grow with the square of the
input, as unlike texts share some; so the lists are by classes of shingles. Sizes
are divided into ranges, and in each range the hashes of shingles fall into m
classes. Linked sets differ in at most d shingles, by their sizes, so they agree
wholly in m - d classes at least; and of any order of classes' contents that both
sides share, the first d + 1 of each side have one in common. Those of many rare
shingles come first: an entry stands for two rare shingles or more wherever a set
has them, and their number depends on the set's size alone. "Rare" are shingles
that are not known as frequent; this steers the order, never the result. Light
sets large enough to link with a heavy one are in the lists too.

Each list first tries all members against its smallest; pairs whose shingles,
counted by cells of their hashes, cannot overlap enough are dropped before any
set is read. Members found to be linked form one component. What is left are
lists whose other members are in different components. Lists that share members
form groups, groups are dealt to blocks of bounded size, and each pair of blocks
counts overlaps by scanning the inverted lists of its shingles. A set is sent to
its blocks once, not to each pair; no list's pairs are written out. A group of S
shingles is sent S / BLOCK times: the cost of sets that are all alike, though not
linked, grows with the square of their number, that of all others in proportion.

B is the boundary at which the subsets to list and the list entries to scan,
weighed by their costs, are fewest for the sizes that are there.

Null, empty and blank texts have no shingles and link with nothing. Rows with
equal ids count as one document with several texts. A null id has a null
component. Very long texts are read whole, as are all others; ties (equal
similarity, equal sets) need no order, as every link counts. An empty table gives
no rows. Extra columns are not read, whatever their names. Shingles are 64-bit
hashes.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .staging import BATCH_BYTES, discard, lean, lean_group, written
from .words import hashed_words, mix, shingles

#: Sets up to this size may be light. Shingles known as frequent, at most. Shingles in a block, at most; groups of more than SPREAD shingles are several blocks.
MOST_LIGHT, FREQUENT, BLOCK, SPREAD, CELLS = 40, 1 << 18, 1 << 21, 1 << 17, 128
SETS = "doc_id long, n long, d1 long, d2 long, tokens array<long>, entries array<long>, cells binary"
#: Tables of up to so many rows with a single long, or a quarter of that with four, may be broadcast.
BROADCAST_ROWS = 3_000_000
#: What a list entry costs, in subsets: it is matched, and its candidates' sets are read.
ENTRY_COST = 10
#: Ranges of sizes begin at about the powers of this. Classes beyond those that may differ, as a share of these.
RANGE, SPARE = 1.75, 0.25


@cache
def _starts() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * RANGE)))
    return np.array(out)


class Rule(NamedTuple):
    """Shingles of k words; links at a similarity of num / den or more."""

    k: int = 3
    num: int = 90
    den: int = 100

    def shared(self, s: int, t: int) -> int:
        """The least overlap of linked sets of sizes s and t."""
        return -(-self.num * (s + t) // (self.num + self.den))

    def partners(self, n: int) -> range:
        return range(-(-self.num * n // self.den), self.den * n // self.num + 1)

    def differing(self, sizes: int) -> int:
        """The most shingles in which linked sets differ whose sizes add up to at most this."""
        return sizes * (self.den - self.num) // (self.den + self.num)

    def ranges(self, n: int) -> list[tuple[int, int, int]]:
        """For a set's size: (range of the larger set's size, classes there, the set's entries)."""
        starts = _starts()
        i, out = int(np.searchsorted(starts, n, "right")) - 1, []
        while self.den * n >= self.num * int(starts[i]):
            last = int(starts[i + 1]) - 1
            most = self.differing(2 * last)
            out.append((i, most + 1 + int(most * SPARE), self.differing(n + min(last, self.den * n // self.num)) + 1))
            i += 1
        return out

    def entries(self, n: int) -> int:
        return sum(e for *_, e in self.ranges(n))

    def subsets(self, n: int) -> int:
        return sum(math.comb(n, self.shared(n, m)) for m in self.partners(n))

    def boundary(self, sizes: dict[int, int]) -> int:
        """The largest light size, for so many sets of each size up to MOST_LIGHT."""
        def cost(b: int) -> int:
            heavy = -(-self.num * (b + 1) // self.den)
            return sum(c * ((n <= b) * self.subsets(n) + (n >= heavy) * ENTRY_COST * self.entries(n)) for n, c in sizes.items())

        return min(range(MOST_LIGHT), key=cost)


def _each_set(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    for batch in batches:
        for row, words, at in hashed_words(batch.column(1)):
            for i in range(len(at) - 1):
                yield batch, row + i, shingles(words[at[i] : at[i + 1]], k)


def frequent(docs: DataFrame, k: int) -> np.ndarray:
    """At most FREQUENT shingles that many documents have, most frequent last. It steers the order alone, never the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[n >= 4].view(np.int64)), pa.array(n[n >= 4])], ["h", "n"])

        held, size = [], 0
        for _, _, s in _each_set(batches, k):
            held.append(s)
            size += len(s)
            if size > 3_000_000:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    top = docs.mapInArrow(lean(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(FREQUENT)
    found = top.toArrow()
    return np.asarray(found.column("h")).astype(np.int64)[::-1].copy()


def _entries(s: np.ndarray, frequent: np.ndarray, rule: Rule) -> np.ndarray:
    """The keys of a set's inverted lists: in each range of sizes, of its first classes, those with most rare shingles first."""
    h, out = mix(s + np.uint64(0x77)), []
    for i, m, e in rule.ranges(len(s)):
        of = (mix(s + np.uint64(i)) % np.uint64(m)).astype(np.int64)
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, of, h)
        key = mix(sums + mix(np.arange(m, dtype=np.uint64) + np.uint64(i << 40)))
        out.append(key[np.lexsort((key, -np.bincount(of[~frequent], minlength=m)))[:e]])
    return np.concatenate(out)


def _lists_of(x: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, x)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64)))


def _sets(known: np.ndarray, rule: Rule):
    """doc_id, n, two hashes of the set, the shingles of sets that may be light, the keys of its lists, and its counts by cells."""
    values = np.sort(known.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "d1", "d2", "tokens", "entries", "cells"]
        rows: list[tuple] = []
        last, size = None, 0
        none = np.zeros(0, np.uint64)

        def table() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), _lists_of(cols[4]), _lists_of(cols[5]), pa.array(cols[6], pa.binary())], names)

        for batch, i, s in _each_set(batches, rule.k):
            if last is not batch:
                ids, last = batch.column(0).to_pylist(), batch
            n = len(s)
            d1 = d2 = 0
            entries = none
            if n:
                d1, d2 = int(s.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(s + np.uint64(0x51))).view(np.int64))
                frequent = values[np.minimum(np.searchsorted(values, s), len(values) - 1)] == s if len(values) else np.zeros(n, bool)
                entries = _entries(s, frequent, rule)
            width = CELLS << max(0, (n // (8 * CELLS)).bit_length())
            cells = np.minimum(np.bincount((s >> np.uint64(11)).astype(np.int64) % width, minlength=width), 255)
            rows.append((ids[i], n, d1, d2, s if n <= MOST_LIGHT else none, entries, cells.astype(np.uint8).tobytes()))
            size += len(entries) + width
            if size > 400_000:
                yield table()
                rows, size = [], 0
        if rows:
            yield table()

    return run


def _subset_keys(rule: Rule, light: int):
    """small, large, key, id, n: each light set's subsets for each size of light partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for i in range(batch.num_rows):
                doc_id, n = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                s = mix(np.asarray(batch.column(2)[i].values, np.int64).view(np.uint64) ^ np.uint64(0xA5A5))
                total = s.sum(dtype=np.uint64)
                without: dict[int, np.ndarray] = {}
                for m in rule.partners(n):
                    if not 0 < m <= light:
                        continue
                    r = n - rule.shared(n, m)
                    if r not in without:
                        drop = np.array(list(itertools.combinations(range(n), r)), np.int64).reshape(math.comb(n, r), r)
                        without[r] = total - s[drop].sum(1, dtype=np.uint64)
                    keys = without[r].view(np.int64)
                    for c, v in zip(out, (min(n, m), max(n, m), keys, doc_id, n), strict=True):
                        c.append(np.broadcast_to(np.int64(v) if not isinstance(v, np.ndarray) else v, len(keys)))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["small", "large", "key", "id", "n"])

    return run


def _light_links(sets: DataFrame, rule: Rule, light: int) -> DataFrame:
    keys = sets.where(F.col("n") <= light).select("id", "n", "tokens").mapInArrow(lean(_subset_keys(rule, light)), "small long, large long, key long, id long, n long")
    by = ["small", "large", "key"]
    met = keys.groupBy(*by).agg(F.min("id").alias("b"), F.max("id").alias("top"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    met = met.where("b < top AND (small = large OR n0 < n1)").select(*by, "b")
    return keys.join(met, by).where("id <> b").select(F.col("id").alias("a"), "b").distinct()


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its counted rows are few enough."""
    return F.broadcast(df) if len(df.columns) * df.count() <= BROADCAST_ROWS else df


def _shingle_sets(docs: DataFrame, ids: DataFrame, rule: Rule, repeated: bool) -> DataFrame:
    """id, set: all shingles, sorted, of the documents in ids; repeated: whether rows may repeat, of which one is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sets, size, last = [], [], 0, None
        for batch, i, s in _each_set(batches, rule.k):
            if last is not batch:
                names, last = batch.column(0).to_pylist(), batch
            rows.append(names[i])
            sets.append(s)
            size += len(s)
            if size > 400_000:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), _lists_of(sets)], ["id", "set"])
                rows, sets, size = [], [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), _lists_of(sets)], ["id", "set"])

    wanted = docs.join(_small(ids), docs["doc_id"] == ids["id"], "left_semi")
    out = wanted.mapInArrow(lean(run), "id long, set array<long>")
    return out.distinct() if repeated else out


def _possible(pairs: DataFrame, cells: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose counts by cells allow a link. A count of 255 may stand for more.

    A set has CELLS cells or that times a power of two, about eight shingles
    each; cells of the larger side are summed to those of the smaller.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, keep = np.asarray(batch.column(4)) + np.asarray(batch.column(5)), []
            for x, y, n in zip(batch.column(2), batch.column(3), total.tolist(), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint8).astype(np.int64) for v in (x, y))
                width = min(len(x), len(y))
                x, y = (np.where(v == 255, 1 << 40, v).reshape(-1, width).sum(0) for v in (x, y))
                most = int(np.minimum(x, y).sum())
                keep.append(rule.den * most >= rule.num * (n - most))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (cells.select(F.col("id").alias(i), F.col("cells").alias(c), F.col("n").alias(n)) for i, c, n in (("a", "x", "p"), ("b", "y", "q")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", "p", "q").mapInArrow(lean(run), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that link."""
    left, right = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    same = F.size(F.array_intersect("x", "y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", (F.size("x") + F.size("y")).alias("sizes"), same.alias("same"))
    return both.where(rule.den * F.col("same") >= rule.num * (F.col("sizes") - F.col("same"))).select("a", "b")


def _scan(rule: Rule):
    """Links that join components, between two blocks or within one, by counting overlaps over inverted lists.

    Sets of the component that is largest at first, and of what joins it, are not scanned: links to others are found from those.
    """

    def run(key, table):
        side = np.asarray(table.column("block"))
        sets = [np.asarray(x.values).view(np.uint64) for x in table.column("set").combine_chunks()]
        size = np.array([len(s) for s in sets], np.int64)
        ids = np.asarray(table.column("id"))
        names, comp = np.unique(np.asarray(table.column("comp")), return_inverse=True)
        root, members = np.arange(len(names)), np.bincount(comp, minlength=len(names))

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        def lists(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            words = np.concatenate([sets[i] for i in of]) if len(of) else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(of)), size[of])
            order = np.argsort(words, kind="stable")
            return of, words[order], owner[order]

        if key[1].as_py() == key[2].as_py():
            sides = [lists(np.arange(len(ids)))] * 2
            other = np.zeros(len(ids), int)
        else:
            sides = [lists(np.flatnonzero(side == k.as_py())) for k in key[1:]]
            other = np.where(side == key[1].as_py(), 1, 0)
        out, largest, left = [], int(members.argmax()), len(names)
        for i in np.argsort(members[comp], kind="stable"):
            if left == 1:
                break
            if find(comp[i]) == largest:
                continue
            of, words, owner = sides[other[i]]
            lo, hi = np.searchsorted(words, sets[i], "left"), np.searchsorted(words, sets[i], "right")
            n = hi - lo
            flat = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            same = np.bincount(owner[flat], minlength=len(of))
            for j in of[rule.den * same >= rule.num * (size[i] + size[of] - same)]:
                p, q = find(comp[i]), find(comp[j])
                if p != q:
                    root[p] = q
                    left -= 1
                    if p == largest:
                        largest = q
                    out.append((int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _lists(sets: DataFrame, least: int) -> DataFrame:
    """key, id, first: the entries of lists of two or more, with the smallest id in the list."""
    entries = sets.where(F.col("n") >= least).select(F.explode("entries").alias("key"), "id")
    # Nearly all keys occur once, so nothing is summed before they are dealt out.
    lists = entries.repartition("key").groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    lists = written(lists.select("key", "first"), "lists")
    return written(entries.join(_small(lists), "key"), "entries")


def _labelled(entries: DataFrame, label: DataFrame) -> DataFrame:
    return entries.join(label, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")


def linked(docs: DataFrame, rule: Rule = Rule(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id for each row of docs."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(docs.mapInArrow(lean(_sets(frequent(docs, rule.k), rule)), SETS), "sets", BATCH_BYTES)
    by = ["n", "d1", "d2"]
    classes = written(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy(*by).agg(F.min("doc_id").alias("id")), "classes")
    sets = rows.withColumn("id", F.col("doc_id")).join(_small(classes), [*by, "id"], "left_semi").select(*by, "id", "tokens", "entries", "cells")
    if repeated := sets.count() > classes.count():
        sets = written(sets.dropDuplicates([*by, "id"]), "distinct")
    sets = sets.drop("d1", "d2")
    light = rule.boundary({r["n"]: r["count"] for r in classes.where(F.col("n") < MOST_LIGHT).groupBy("n").count().collect()})

    links = written(_light_links(sets, rule, light), "light")
    entries = _lists(sets, -(-rule.num * (light + 1) // rule.den))

    # Each list's members against its smallest.
    stars = entries.where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    stars = written(_possible(stars, sets.select("id", "n", "cells"), rule), "stars", BATCH_BYTES)
    ids = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    full = written(_shingle_sets(docs, ids(stars), rule, repeated), "full", BATCH_BYTES)
    found = written(links.select("a", "b").unionAll(_verified(stars, full, rule)), "found")
    label = components(found)
    discard(links, stars, found, full)

    # Other members of one list that are in different components.
    rest = _labelled(entries.where("id <> first").select("key", "id"), label)
    open_lists = rest.groupBy("key").agg(F.min("id").alias("second"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key", "second")
    apart = written(rest.join(open_lists, "key"), "apart")
    more = apart.limit(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    blocks = full = None
    if not apart.isEmpty():
        group = components(apart.select(F.col("id").alias("a"), F.col("second").alias("b")))
        members = apart.select("id", "comp").distinct().join(sets.select("id", "n"), "id").select("id", "n", "comp")
        blocks = written(_blocks(members, group), "blocks")
        full = written(_shingle_sets(docs, blocks.select("id").distinct(), rule, repeated), "full", BATCH_BYTES)
        more = written(_block_links(blocks, full, rule), "more")
    if not more.isEmpty():
        ends = [more.select(F.col(c).alias("id"), F.monotonically_increasing_id().alias("link")) for c in "ab"]
        a, b = (_labelled(e, label).select("link", F.col("comp").alias(c)) for e, c in zip(ends, "ab", strict=True))
        merged = components(a.join(b, "link"))
        every = label.select("id", "component").unionAll(ids(more).select("id", F.col("id").alias("component")).join(label, "id", "left_anti"))
        every = every.join(merged.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
        label = written(every.select("id", F.coalesce("to", "component").alias("component")), "label")
    discard(entries, apart, *(x for x in (blocks, more, full) if x is not None))

    class_of = _labelled(classes, label).select(*by, F.col("comp").alias("component_id"))
    out = rows.select("doc_id", *by).join(class_of, by, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, rule: Rule, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those that are linked, directly or over others, with an earlier row.

    Rows stand in the order of their ids; rows with one id are decided each, in the
    order of hashes of their text and of their other columns. Rows without shingles
    or id are all kept.
    """
    rows, key = docs, id_col
    ids = docs.select(F.col(id_col).cast("long").alias("__id")).where("__id IS NOT NULL")
    if not ids.groupBy("__id").count().where("count > 1").isEmpty():
        rows, key = _numbered(docs, id_col, text_col), "__row"
    found = written(linked(rows, rule, id_col=key, text_col=text_col), "linked")
    gone = written(found.where("doc_id > component_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return rows.join(_small(gone), F.col(key).cast("long") == F.col("__gone"), "left_anti").select(docs.columns)


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with __row, different in each row with an id and rising with the id. The salt deals rows that are equal otherwise."""
    others = [F.col(c) for c in docs.columns if c not in (id_col, text_col)]
    order = {"__id": F.col(id_col).cast("long"), "__text": F.xxhash64(text_col), "__others": F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0), "__salt": F.rand(7)}
    rows = docs.withColumns(order).repartitionByRange(*order).sortWithinPartitions(*order)
    return written(rows.withColumn("__row", F.when(F.col("__id").isNotNull(), F.monotonically_increasing_id())).drop(*order), "rows")


def _blocks(members: DataFrame, group: DataFrame) -> DataFrame:
    """id, n, comp, component, blocks and block: each component of group has its sets dealt to blocks of about BLOCK shingles at most."""
    members = members.join(group, "id")
    size = F.sum("n")
    count = F.greatest(F.ceil(size / BLOCK), F.least(F.lit(4), F.ceil(size / SPREAD)))
    return members.join(members.groupBy("component").agg(count.cast("int").alias("blocks")), "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))


def _block_links(members: DataFrame, full: DataFrame, rule: Rule) -> DataFrame:
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "comp").join(full, "id")
    return dealt.groupBy("component", "i", "j").applyInArrow(lean_group(_scan(rule)), "a long, b long")
