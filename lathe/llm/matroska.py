"""Matroska files as columns: a writer for byte payloads, and a reader to packet tables.

A file: EBML header, Segment(Info, Tracks, Cluster..., Cues). Samples are 8-bit
PCM at 8 kHz. The reader takes any file of variable-length EBML elements: all
four kinds of lacing, SimpleBlock and BlockGroup, elements of unknown size,
unknown elements (skipped), Cues before or after the clusters.

Null or damaged bytes: no packets from where the damage begins; packets before
it are kept. Null text is an empty text. Rows with equal ids are stored each; equal
texts give equal files, so there are no ties. A very long text is one file; a batch
holds BATCH_BYTES of files, or one. Empty table: no rows. Extra columns are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element ids of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMECODE_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMECODE, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

FRAME, FRAMES_A_BLOCK, BLOCKS_A_CLUSTER, BYTES_A_MS, ALIGN = 1024, 8, 16, 8, 64
_MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
_TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES}

PACKETS = "track long, timestamp long, cluster long, block long, lace long, keyframe boolean, byte_start long, byte_end long, cued boolean"


def vint(n: int) -> bytes:
    """A size in the fewest bytes; all ones are kept for unknown sizes."""
    k = 1
    while n >= (1 << 7 * k) - 1:
        k += 1
    return (n | 1 << 7 * k).to_bytes(k, "big")


def element(kind: int, body: bytes | int | str) -> bytes:
    if isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    elif isinstance(body, str):
        body = body.encode()
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def block(track: int, at: int, frames: list[bytes]) -> bytes:
    """A SimpleBlock's body: without lacing for one frame, of fixed size for equal ones, else EBML lacing."""
    sizes = [len(f) for f in frames]
    head = vint(track) + at.to_bytes(2, "big", signed=True)
    if len(frames) == 1:
        return head + b"\x80" + frames[0]
    if len(set(sizes)) == 1:
        return head + bytes([0x80 | 0x04, len(frames) - 1]) + b"".join(frames)
    laces = vint(sizes[0]) + b"".join(_signed(b - a) for a, b in zip(sizes, sizes[1:-1], strict=False))
    return head + bytes([0x80 | 0x06, len(frames) - 1]) + laces + b"".join(frames)


def _signed(n: int) -> bytes:
    k = 1
    while not -(1 << 7 * k - 1) < n < 1 << 7 * k - 1:
        k += 1
    return (n + (1 << 7 * k - 1) - 1 | 1 << 7 * k).to_bytes(k, "big")


_HEAD = element(EBML, element(0x4286, 1) + element(0x42F7, 1) + element(0x42F2, 4) + element(0x42F3, 8) + element(0x4282, "matroska") + element(0x4287, 4) + element(0x4285, 2))


def write_matroska(payload: bytes) -> bytes:
    """A payload of 8-bit samples as a Matroska file."""
    info = element(INFO, element(TIMECODE_SCALE, 1_000_000) + element(MUXING_APP, "lathe") + element(WRITING_APP, "lathe"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, np.array([8000.0], ">f8").tobytes()) + element(CHANNELS, 1) + element(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, element(TRACK_NUMBER, 1) + element(TRACK_UID, 1) + element(TRACK_TYPE, 2) + element(CODEC_ID, "A_PCM/INT/LIT") + audio))
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    step = FRAME * FRAMES_A_BLOCK
    for first in range(0, len(payload), step * BLOCKS_A_CLUSTER):
        stop = min(len(payload), first + step * BLOCKS_A_CLUSTER)
        time = first // BYTES_A_MS
        blocks = [element(SIMPLE_BLOCK, block(1, b // BYTES_A_MS - time, [payload[f : f + FRAME] for f in range(b, min(stop, b + step), FRAME)])) for b in range(first, stop, step)]
        cluster = element(CLUSTER, element(TIMECODE, time) + b"".join(blocks))
        cues.append(element(CUE_POINT, element(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    return _HEAD + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


class Damaged(ValueError):
    pass


def _id(data: bytes, at: int) -> tuple[int, int]:
    if at >= len(data) or not data[at] or (k := 9 - data[at].bit_length()) > 4 or at + k > len(data):
        raise Damaged
    return int.from_bytes(data[at : at + k], "big"), at + k


def _size(data: bytes, at: int) -> tuple[int | None, int]:
    if at >= len(data) or not data[at]:
        raise Damaged
    k = 9 - data[at].bit_length()
    if at + k > len(data):
        raise Damaged
    n = int.from_bytes(data[at : at + k], "big") & ((1 << 7 * k) - 1)
    return (None if n == (1 << 7 * k) - 1 else n), at + k


def _frames(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    if not lacing:
        return [(at, end)]
    if at >= end:
        raise Damaged
    n, at = data[at] + 1, at + 1
    if lacing == 2:
        size, rest = divmod(end - at, n)
        if rest:
            raise Damaged
        sizes = [size] * n
    else:
        sizes = []
        for k in range(n - 1):
            if lacing == 1:
                size = 0
                while True:
                    if at >= end:
                        raise Damaged
                    size, at = size + data[at], at + 1
                    if data[at - 1] != 255:
                        break
            else:
                begin = at
                size, at = _size(data, at)
                if size is None:
                    raise Damaged
                if k:
                    size = sizes[-1] + size - ((1 << 7 * (at - begin) - 1) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Damaged
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    if at > end:
        raise Damaged
    return out


def read_matroska(data: bytes | None) -> tuple[list[tuple], bool]:
    """(rows of PACKETS, whether the file was whole)."""
    packets: list[list] = []
    cued: set[int] = set()
    clusters: dict[int, int] = {}
    segment, time, number, count = 0, 0, -1, 0
    data = data or b""
    stack: list[tuple[int, int]] = []  # kinds and ends of the masters around the place
    at, whole = 0, bool(data)
    try:
        while at < len(data):
            begin = at
            kind, at = _id(data, at)
            size, at = _size(data, at)
            while stack and (begin >= stack[-1][1] or stack[-1][1] == len(data) and kind in _TOP and stack[-1][0] not in (SEGMENT,)):
                stack.pop()
            end = len(data) if size is None else at + size
            if end > len(data):
                whole, end = False, len(data)
                if kind not in _MASTERS:
                    break
            if kind in _MASTERS:
                stack.append((kind, end))
                if kind == SEGMENT:
                    segment = at
                elif kind == CLUSTER:
                    number, time = number + 1, 0
                    clusters[begin - segment] = number
                continue
            if kind == TIMECODE:
                time = int.from_bytes(data[at:end], "big")
            elif kind == CUE_CLUSTER_POSITION:
                cued.add(int.from_bytes(data[at:end], "big"))
            elif kind == REFERENCE and packets:
                packets[-1][5] = False
            elif kind in (SIMPLE_BLOCK, BLOCK):
                track, p = _size(data, at)
                if track is None or p + 3 > end:
                    raise Damaged
                when, flags = time + int.from_bytes(data[p : p + 2], "big", signed=True), data[p + 2]
                for lace, (a, b) in enumerate(_frames(data, p + 3, end, flags >> 1 & 3)):
                    packets.append([track, when, number, count, lace, kind == BLOCK or bool(flags & 0x80), a, b])
                count += 1
            at = end
    except Damaged:
        whole = False
    marked = {clusters[c] for c in cued if c in clusters}
    return [(*p, p[2] in marked) for p in packets], whole


def packet_table(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each packet of each file: id, then PACKETS. Laced packets carry their block's timestamp."""
    names = [x.split()[0] for x in PACKETS.split(", ")]
    kind = dict(media.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, _ = read_matroska(batch.column(1)[i].as_py())
                if rows:
                    cols = list(zip(*rows, strict=True))
                    types = [pa.bool_() if n in ("keyframe", "cued") else pa.int64() for n in names]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(rows), batch.column(0).type), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [id_col, *names])

    return media.select(id_col, media_col).mapInArrow(run, f"`{id_col}` {kind}, {PACKETS}")


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % ALIGN or (0 if raw else ALIGN))


def features(data: bytes, packets: list[tuple]) -> str:
    """Of the stored samples: packets, blocks, clusters, duration in ms, sum and sum of squares, and 8 classes of sample values."""
    samples = np.frombuffer(b"".join([data[p[6] : p[7]] for p in packets]), np.uint8)
    counts = np.bincount(samples, minlength=256)
    value = np.arange(256)
    bins = ",".join(map(str, counts.reshape(8, 32).sum(1).tolist()))
    return f"packets={len(packets)};blocks={packets[-1][3] + 1};clusters={packets[-1][2] + 1};ms={len(samples) // BYTES_A_MS};sum={int(counts @ value)};squares={int(counts @ (value * value))};bins={bins}"


#: Files in one batch, at most, unless one file is longer.
BATCH_BYTES = 1 << 24
STORED = "doc_id long, n_bytes long, payload_bytes long, media binary"


def stored(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as Matroska files: doc_id, n_bytes, payload_bytes, media."""

    def table(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "n_bytes", "payload_bytes", "media"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                n, payload = payload_of(text.as_py())
                media = write_matroska(payload)
                if rows and size + len(media) > BATCH_BYTES:
                    yield table(rows)
                    rows, size = [], 0
                rows.append((doc_id.as_py(), n, len(payload), media))
                size += len(media)
            if rows:
                yield table(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, STORED)


def digests(media: DataFrame) -> DataFrame:
    """What stored() has made, read back: hashes of payload and file, and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(3):
                data = data.as_py()
                packets, _ = read_matroska(data)
                payload = b"".join([data[p[6] : p[7]] for p in packets])
                out.append((hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), features(data, packets)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
