"""SentencePiece encoding and decoding by a Viterbi search that shares prefixes.

A text, with spaces marked, is divided where no piece can reach across. The
distinct marked words of a run of texts are sorted; taken in this order they are
a depth-first walk of their trie, in which the forward scores of the prefix that
a word shares with the one before stay as they are.

The forward score of a prefix is the best sum of scores of pieces that make it
up. In BPE models a path may join two pieces only if merging their characters
gives these two again, and pieces that do not join have no path; of the paths of
joinable pieces that make up a prefix, the best by its sum is what merging the
whole gives. Whether two pieces join is remembered.

Characters that are no piece become bytes, or the unknown piece in models
without bytes. Models whose normalizer changes more than spaces are refused.
Null and empty texts have no ids. Decoding takes pieces' texts and bytes
together; ids out of range and control pieces are left out. Very long texts are
one row like others; rows are independent, so repeats keep their ids. Of paths
whose scores tie, the one whose last piece is longest is taken. Empty table: no
rows. Extra columns are not read by encoded() and digests(), and kept by
decoded(), whatever their names but for the new column's.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CACHED_WORDS, CACHED_PAIRS, RUN = 300_000, 1_000_000, 1000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, data[at : at + n]
            at += n


class Pieces:
    """A model's pieces, and the search."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        top = dict((k, v) for k, v in _fields(model.serialized_model_proto()) if k in (2, 3))
        trainer, normalizer = dict(_fields(top.get(2, b""))), dict(_fields(top.get(3, b"")))
        self.bpe = trainer.get(3, 1) == 2
        self.prefix = bool(normalizer.get(3, 1))
        if trainer.get(3, 1) not in (1, 2) or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only unigram and BPE models that keep all characters and mark spaces are supported")
        n = model.get_piece_size()
        self.unknown = model.unk_id()
        self.byte_ids: dict[int, int] = {}
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes_of: list[bytes] = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            elif model.is_control(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.ids[piece], self.scores[piece] = i, model.get_score(i)
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        self.longest = max(map(len, self.ids), default=1)
        #: Lengths of pieces by their last three characters, longest first; shorter pieces are tried everywhere.
        lengths: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 2:
                lengths.setdefault(p[-3:], {1, 2}).add(len(p))
        self.lengths = {c: tuple(sorted(x, reverse=True)) for c, x in lengths.items()}
        self.floor = min(self.scores.values(), default=0.0) - 10.0
        inside = {c for p in self.ids for c in p}
        alone = "".join(re.escape(chr(c)) for c in (*range(32), 127) if chr(c) not in inside)
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            self.words = re.compile(f"[{alone}]|[^{alone}]+" if alone else r"(?s:.+)")
        else:
            self.words = re.compile(f"[{alone}]|{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" if alone else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.known: dict[str, bytes] = {}
        self.joins: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """A text's pieces by merging: the best pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _join(self, a: str, b: str) -> bool:
        if (a, b) not in self.joins:
            if len(self.joins) > CACHED_PAIRS:
                self.joins.clear()
            self.joins[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return self.joins[a, b]

    def _forward(self, word: str, shared: int, last: list[str], score: list[float]) -> None:
        """Fills in, for each prefix longer than shared, its score and the piece that ends it."""
        del last[shared + 1 :], score[shared + 1 :]
        ids, scores, lengths, joins, bpe = self.ids, self.scores, self.lengths, self.joins, self.bpe
        for end in range(shared + 1, len(word) + 1):
            best, value = None, 0.0
            for n in lengths.get(word[end - 3 : end], (2, 1)) if end > 2 else (2, 1):
                if n > end:
                    continue
                piece = word[end - n : end]
                if piece not in ids:
                    continue
                if bpe:
                    join = joins.get((last[end - n], piece))
                    if not (self._join(last[end - n], piece) if join is None else join):
                        continue
                s = score[end - n] + scores[piece]
                if best is None or s > value:
                    best, value = piece, s
            if word[end - 1] not in ids:
                s = score[end - 1] + self.floor
                if best is None or s > value and not bpe:
                    best, value = word[end - 1], s
            last.append(word[end - 1] if best is None else best)
            score.append(value)

    def _ids_of(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        if not self.byte_ids:
            return [self.unknown]
        return [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]

    def _learn(self, new: list[str]) -> None:
        last, score, before = [""], [0.0], ""
        for word in sorted(new):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            self._forward(word, shared, last, score)
            before, end, parts = word, len(word), []
            while end:
                parts.append(last[end])
                end -= len(last[end])
            self.known[word] = np.array([i for p in reversed(parts) for i in self._ids_of(p)], "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, four bytes each."""
        first = MARK if self.prefix else ""
        split = [self.words.findall(first + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known = self.known
        self._learn(list({w for x in split for w in x if w not in known}))
        return [b"".join([known[w] for w in x]) for x in split]

    def decode(self, ids: list[int]) -> str:
        n, table = len(self.bytes_of), self.bytes_of
        text = b"".join([table[i] for i in ids if 0 <= i < n]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_loaded: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    return _loaded.get(path) or _loaded.setdefault(path, Pieces(path))


def encoded(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, ids (array of int)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _pieces(path)
        for batch in batches:
            for at in range(0, batch.num_rows, RUN):
                part = batch.slice(at, RUN)
                ids = model.encode(part.column(1).to_pylist())
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "text", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, text string, ids array<int>")


def decoded(rows: DataFrame, path: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with the texts of their ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _pieces(path)
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            texts = [None if x is None else model.decode([i for i in x if i is not None]) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out_col])

    return rows.mapInArrow(run, rows.select("*", F.lit("").alias(out_col)).schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_crc32 and whether decoding gives the text again, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _pieces(path)
        is_byte = np.zeros(len(model.bytes_of), bool)
        is_byte[list(model.byte_ids.values())] = True
        for batch in batches:
            for at in range(0, batch.num_rows, RUN):
                part = batch.slice(at, RUN)
                texts, out = part.column(1).to_pylist(), []
                for text, raw in zip(texts, model.encode(texts), strict=True):
                    ids = np.frombuffer(raw, "<u4")
                    out.append((len(ids), int(is_byte[ids].sum()), zlib.crc32(raw), model.decode(ids.tolist()) == (text or "")))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True))], ["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean")
