"""Round trips, all kinds of lacing, unknown sizes and damage."""

import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from lathe.llm import matroska as M


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trip(raw):
    payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
    data = M.write_matroska(payload)
    packets, whole = M.read_matroska(data)
    assert whole and b"".join(data[p[6] : p[7]] for p in packets) == payload
    assert [p[1] for p in packets] == sorted(p[1] for p in packets) and all(p[8] for p in packets)


def test_long_payload_has_clusters_and_cues():
    payload = random.Random(1).randbytes(64 * 9001)
    data = M.write_matroska(payload)
    packets, whole = M.read_matroska(data)
    assert whole and b"".join(data[p[6] : p[7]] for p in packets) == payload
    assert max(p[2] for p in packets) == len(payload) // (1024 * 8 * 16) and all(p[8] for p in packets)
    starts = {}
    for p in packets:
        starts.setdefault(p[3], p[1])
    assert all(p[1] == starts[p[3]] for p in packets)


def file_of(*blocks, unknown=False):
    body = M.element(M.TIMECODE, 1000) + b"".join(blocks)
    cluster = M.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body if unknown else M.element(M.CLUSTER, body)
    segment = M.element(M.INFO, M.element(M.TIMECODE_SCALE, 1000000)) + M.element(0xEC, b"void") + cluster
    head = M.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 if unknown else M.SEGMENT.to_bytes(4, "big") + M.vint(len(segment))
    return M._HEAD + head + segment


def test_lacing():
    frames = [b"a" * 300, b"b" * 10, b"c" * 255, b"d" * 7]
    head = M.vint(2) + (-5).to_bytes(2, "big", signed=True)
    xiph = head + b"\x02" + bytes([3, 255, 45, 10, 255, 0]) + b"".join(frames)
    fixed = head + b"\x84" + bytes([2]) + b"xxyyzz"
    ebml = M.block(2, -5, frames)
    single = M.block(1, 7, [b"solo"])
    group = M.element(M.BLOCK_GROUP, M.element(M.BLOCK, head + b"\x00" + b"ref") + M.element(M.REFERENCE, 1))
    for unknown in (False, True):
        data = file_of(*(M.element(M.SIMPLE_BLOCK, b) for b in (xiph, fixed, ebml, single)), group, unknown=unknown)
        packets, whole = M.read_matroska(data)
        assert whole
        assert [data[p[6] : p[7]] for p in packets] == [*frames, b"xx", b"yy", b"zz", *frames, b"solo", b"ref"]
        assert [p[1] for p in packets] == [995] * 11 + [1007, 995] and [p[5] for p in packets] == [False] * 4 + [True] * 8 + [False]
    other = data + M.element(M.CLUSTER, M.element(M.TIMECODE, 2) + M.element(M.SIMPLE_BLOCK, single))
    packets, whole = M.read_matroska(other)
    assert whole and packets[-1][1] == 9 and packets[-1][2] == 1


def test_damage():
    data = M.write_matroska(bytes(range(256)) * 64)
    full, _ = M.read_matroska(data)
    for cut in range(0, len(data), 97):
        packets, whole = M.read_matroska(data[:cut])
        assert not whole and packets == [(*p[:8], False) for p in full[: len(packets)]]
    assert M.read_matroska(None) == ([], False) and M.read_matroska(b"\x00junk") == ([], False)
    M.read_matroska(bytes(200) + data)


def test_columns(spark):
    texts = [None, "", "x", "é" * 700, "word " * 60000, "x"]
    df = spark.createDataFrame([(i if i else None, t, b"clash") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    out = {(r["doc_id"], r["n_bytes"]): r for r in M.digests(M.stored(df)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = out[i if i else None, len(raw)]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        data = M.write_matroska(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(data), hashlib.sha256(data).hexdigest())
    assert out[2, 1]["feature"] == out[5, 1]["feature"]
    assert M.packet_table(M.stored(df)).where("doc_id = 4").count() == -(-300000 // 1024)
    assert M.digests(M.stored(df.limit(0))).collect() == []
