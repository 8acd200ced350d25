"""Harmonic packing of tokenised documents into fixed-length sequences.

Class j holds the pieces that fit j times, but not j + 1 times, into a sequence
of C tokens: lengths in (C/(j+1), C/j]. A sequence of class j takes j pieces of
that class, whichever they are, so that classes are packed independently, and
so are the parts into which a class is dealt.

Cutting: a document gives full pieces of C tokens. A rest that would waste more
than C/64 tokens of a sequence of its class, in one of the first eight classes,
gives a head of C // (j+1) tokens, which fits j + 1 times, and what is left is
looked at again.

A class's pieces are numbered by parts of bounded size: parts are counted, the
counts are summed to offsets (a few rows for each class and part), and a
piece's number is its part's offset and its place there. So each class has one
unfilled sequence at most. The pieces of these (fewer than j from class j,
whatever the input) share sequences, longest first.

Null, empty text: the document is its end id alone. Rows with equal ids are
packed each. Empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import BATCH_BYTES, give_back, lean, written
from .words import span_hashes

CAPACITY, END_ID, CACHED_RUNS = 2048, 1, 2_000_000
#: Texts that are encoded at once: so many bytes, or one text.
TEXTS_BYTES = 2 << 20
#: The counts of up to so many parts of each class are broadcast.
BROADCAST_PARTS = 4096
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, row_key long"


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of n tokens, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        j = capacity // rest
        if j > 8 or capacity - j * rest <= capacity // 64:
            out.append(rest)
            break
        head = capacity // (j + 1)
        out.append(head)
        rest -= head
    return out


class _Encoder:
    """Ids of texts, with what the vocabulary gives for their distinct runs.

    The vocabulary's rule divides a text into runs (letters, single digits, other
    signs, some endings after an apostrophe), which it encodes each by itself. In
    texts of ASCII and Latin-1 letters runs are found for many texts at once, and
    only distinct runs that are new are encoded, many at once with spaces between
    them. Other texts are encoded one by one.
    """

    WORD_END = "</w>"
    # The rule of the vocabulary file for which runs are found here. Texts of any other file are encoded one by one.
    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
    RUNS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    PRE_TOKENIZER = {
        "type": "Sequence",
        "pretokenizers": [{"type": "Split", "pattern": {"Regex": RUNS}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
    }
    #: Classes of bytes: 0 space, 1 letter, 2 digit, 3 other sign, 4 a text that has it is encoded by itself.
    CLASS = np.full(256, 4, np.uint8)
    CLASS[33:127] = 3
    CLASS[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = 1
    CLASS[48:58] = 2
    CLASS[[9, 10, 11, 12, 13, 32]] = 0

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rule = json.loads(self.tokenizer.to_str())
        known = rule["normalizer"] == self.NORMALIZER and rule["pre_tokenizer"] == self.PRE_TOKENIZER and rule["post_processor"] is None and rule["model"]["type"] == "BPE"
        self.runs = None
        if known and rule["model"]["end_of_word_suffix"] == self.WORD_END:
            # The same vocabulary without what runs have behind them: they are divided, and lower-cased before they are encoded.
            rule |= {"normalizer": None, "added_tokens": []}
            rule["pre_tokenizer"]["pretokenizers"][0] = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
            self.runs = Tokenizer.from_str(json.dumps(rule))
            self.ends_run = np.zeros(self.runs.get_vocab_size(), bool)
            self.ends_run[[i for piece, i in self.runs.get_vocab().items() if piece.endswith(self.WORD_END)]] = True
        self._forget()
        # The rule as text and dictionaries is as large again as both vocabularies.
        rule = None
        give_back()

    def _forget(self) -> None:
        self.known, self.at, self.ids = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, "<u4")
        self.place = np.zeros(0, np.int64)

    def _runs(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the runs of plain texts begin and end."""
        kind = self.CLASS[raw]
        first = kind > 0
        first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        cuts = off[:-1][np.diff(off) > 0]
        first[cuts] = kind[cuts] > 0
        last = kind > 0
        last[:-1] &= (kind[:-1] != kind[1:]) | (kind[:-1] == 2)
        last[cuts[1:] - 1] = kind[cuts[1:] - 1] > 0
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        # The endings after an apostrophe that are runs of their own.
        lone = np.flatnonzero((raw[starts] == 39) & (ends - starts == 1))
        lone = lone[lone + 1 < len(starts)]
        lone = lone[(starts[lone + 1] == ends[lone]) & (kind[ends[lone]] == 1) & ~np.isin(ends[lone], off)]
        if len(lone):
            low = lambda i: raw[np.minimum(i, len(raw) - 1)] | 32
            c, d, two = low(ends[lone]), low(ends[lone] + 1), ends[lone + 1] - ends[lone] > 1
            one = np.isin(c, [ord(x) for x in "stmd"])
            both = two & ((c == ord("r")) & (d == ord("e")) | (c == ord("v")) & (d == ord("e")) | (c == ord("l")) & (d == ord("l")))
            take = np.where(one, 1, np.where(both, 2, 0))
            ends[lone] += take
            starts[lone + 1] += take
            keep = starts < ends
            starts, ends = starts[keep], ends[keep]
        return starts, ends

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        if len(self.known) + len(hashes) > CACHED_RUNS and len(hashes) < CACHED_RUNS:
            self._forget()
        ids, ends = [], []
        base = len(self.ids)
        for at in range(0, len(texts), 2048):
            got = np.array(self.runs.encode_batch_fast([" ".join(texts[at : at + 2048]).lower()], add_special_tokens=False)[0].ids, "<u4")
            ends.append(np.flatnonzero(self.ends_run[got]) + 1 + base)
            ids.append(got)
            base += len(got)
        self.at = np.concatenate([self.at, *ends])
        self.ids = np.concatenate([self.ids, *ids])
        known, place = np.concatenate([self.known, hashes]), np.concatenate([self.place, len(self.known) + np.arange(len(hashes))])
        order = np.argsort(known, kind="stable")
        self.known, self.place = known[order], place[order]

    def _plain(self, texts: pa.Array) -> list[bytes]:
        _, offsets, values = texts.buffers()
        off = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        raw = np.frombuffer(values, np.uint8)[off[0] : off[-1]] if values else np.zeros(0, np.uint8)
        off -= off[0]
        starts, ends = self._runs(raw, off)
        hashes = span_hashes(raw, starts, ends)
        coded = pa.array(hashes).dictionary_encode()
        inverse, distinct = np.asarray(coded.indices), np.asarray(coded.dictionary)
        # Values stand in the dictionary in the order in which they come first.
        first = np.flatnonzero(np.diff(np.maximum.accumulate(inverse), prepend=-1)) if len(inverse) else inverse
        at = np.searchsorted(self.known, distinct)
        new = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(new):
            data = raw.tobytes()
            if len(self.known) + len(new) > CACHED_RUNS:
                self._forget()
                new = np.arange(len(distinct))
            self._learn(distinct[new], [data[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            at = np.searchsorted(self.known, distinct)
        place = self.place[at][inverse]
        n = self.at[place + 1] - self.at[place]
        total = np.concatenate(([0], np.cumsum(n)))
        flat = self.ids[np.repeat(self.at[place] - total[:-1], n) + np.arange(total[-1])].tobytes()
        cuts = (4 * total[np.searchsorted(starts, off)]).tolist()
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def __call__(self, texts: pa.Array) -> list[bytes]:
        texts = texts.fill_null("").cast(pa.string())
        _, offsets, values = texts.buffers()
        off = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        raw = np.frombuffer(values, np.uint8) if values else np.zeros(0, np.uint8)
        part = raw[off[0] : off[-1]]
        odd = self.CLASS[part] == 4
        odd[1:] |= (part[1:] == ord("|")) & (part[:-1] == ord("<"))
        odd[1:] |= (part[:-1] == 0xC3) & np.isin(part[1:], [0x97, 0xB7])
        before = np.concatenate(([0], np.cumsum(odd)))
        plain = before[off[1:] - off[0]] == before[off[:-1] - off[0]]
        if self.runs is None:
            plain[:] = False
        out: list[bytes] = [b""] * len(texts)
        for i, ids in zip(np.flatnonzero(plain).tolist(), self._plain(texts.filter(pa.array(plain))), strict=True):
            out[i] = ids
        rest = np.flatnonzero(~plain).tolist()
        for i in rest:
            out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
        return out


_encoders: dict[str, _Encoder] = {}


def _by_bytes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have TEXTS_BYTES together at most, or one row; a null text has no bytes."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + TEXTS_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def _pieces(path: str, capacity: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoders.get(path) or _encoders.setdefault(path, _Encoder(path))
        last = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in _by_bytes(batch):
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1)), strict=True):
                    ids += last
                    n, start = len(ids) // 4, 0
                    key = zlib.crc32(ids)
                    for length in cuts(n, capacity):
                        piece = ids[4 * start : 4 * (start + length)]
                        rows.append((doc_id, start, length, zlib.crc32(piece), n, piece if keep_ids else None, key))
                        start += length
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 5 else pa.int64()) for k, c in enumerate(cols)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "row_key"])

    return run


def tokenised(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of documents: where each starts, its length, the crc32 of its ids and, with keep_ids, the ids."""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(lean(_pieces(path, capacity, end_id, keep_ids)), _PIECES)


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, part_rows: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to pieces, which must be a table that reads the same each time. piece: a number that no two rows share.

    Places are found without the ids, which meet them at the end, so that tokens are dealt out once.
    """
    whole, n = pieces, pieces.count()
    pieces = pieces.drop("ids")
    parts = max(1, -(-n // part_rows))
    small = F.broadcast if parts <= BROADCAST_PARTS else lambda df: df
    order = ["doc_id", "row_key", "start", "length", "ids_crc32", "piece"]
    pieces = pieces.withColumn("kind", F.expr(f"{capacity} div length")).withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "row_key"), F.lit(parts)))
    # A few rows for each class and part: at most about 2 * sqrt(capacity) classes.
    counts = pieces.groupBy("kind", "part").agg(F.count("*").alias("here"))
    counts = counts.withColumn("before", F.sum("here").over(Window.partitionBy("kind").orderBy("part")) - F.col("here")).drop("here")
    sizes = pieces.groupBy("kind").agg((F.count("*")).alias("of_kind"))
    sizes = sizes.withColumn("bins", F.expr("of_kind div kind"))
    sizes = sizes.withColumn("first_bin", F.sum("bins").over(Window.partitionBy(F.lit(0)).orderBy("kind")) - F.col("bins"))
    sizes = sizes.withColumn("filled", F.sum("bins").over(Window.partitionBy(F.lit(0)))).drop("of_kind")
    ranked = (
        pieces.withColumn("at", F.row_number().over(Window.partitionBy("kind", "part").orderBy(*order)))
        .join(small(counts), ["kind", "part"])
        .join(F.broadcast(sizes), "kind")
        .withColumn("at", F.col("before") + F.col("at") - 1)
        .withColumn("bin", F.expr("at div kind"))
    )
    full = ranked.where("bin < bins").withColumn("sequence_id", F.col("first_bin") + F.col("bin"))
    full = full.withColumn("offset", F.sum("length").over(Window.partitionBy("sequence_id").orderBy("at")) - F.col("length"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rest = _rest(ranked.where("bin >= bins"), capacity, [*names, "piece"])
    placed = full.select(*names, "piece").unionByName(rest.select(*names, "piece"))
    return placed.join(whole.select("piece", "ids"), "piece").select(*names, "ids") if "ids" in whole.columns else placed.select(*names)


def _rest(left: DataFrame, capacity: int, names: list[str]) -> DataFrame:
    """The unfilled sequences' pieces, longest first, each into the first sequence with room. Fewer than j for each class j: a fixed bound."""

    def run(key, table):
        n = table.num_rows
        cols = {c: table.column(c).to_pylist() for c in ("length", "kind", "at")}
        room: list[int] = []
        sequence, offset = [0] * n, [0] * n
        for i in sorted(range(n), key=lambda i: (-cols["length"][i], cols["kind"][i], cols["at"][i])):
            length = cols["length"][i]
            k = next((k for k, r in enumerate(room) if r >= length), len(room))
            if k == len(room):
                room.append(capacity)
            sequence[i], offset[i] = k, capacity - room[k]
            room[k] -= length
        first = table.column("filled")[0].as_py()
        table = table.append_column("sequence_id", pa.array([first + k for k in sequence], pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
        return table.select(names)

    kinds = dict(left.dtypes) | {"sequence_id": "bigint", "offset": "bigint"}
    return left.groupBy(F.lit(1).alias("one")).applyInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names))


def packed(docs: DataFrame, path: str, *, keep_ids: bool = False, **kw) -> DataFrame:
    """Documents to pieces with their sequence and offset there, and with keep_ids their ids."""
    pieces = tokenised(docs, path, keep_ids=keep_ids, **kw).withColumn("piece", F.monotonically_increasing_id())
    return pack(written(pieces if keep_ids else pieces.drop("ids"), "pieces", BATCH_BYTES), capacity=kw.get("capacity", CAPACITY))
