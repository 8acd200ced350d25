"""Memory that a worker keeps after its task."""

import subprocess
import sys

import pyarrow as pa
import pytest

from lathe.llm import staging

# In a process of its own, as a worker is one.
SCRIPT = """
import re, sys
import numpy as np, pyarrow as pa
from pyspark.sql import DataFrame
from lathe.llm import {module} as module

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches():
    rng = np.random.default_rng(1)
    for at in range(0, 30000, 10000):
        texts = [" ".join(map(str, rng.integers(0, 1 << 40, 300).tolist())) for _ in range(10000)]
        yield pa.RecordBatch.from_arrays([pa.array(range(at, at + 10000), pa.int64()), pa.array(texts)] + [pa.nulls(10000, t) for t in (pa.string(), pa.string(), pa.int64())], list("abcde"))

class Docs:
    columns, dtypes = ["doc_id", "text"], []
    def select(self, *_):
        return self
    def mapInArrow(self, run, schema):
        rows, first = 0, held()
        for out in run(batches()):
            rows += out.num_rows
        del out
        print(rows, held() - first)
        sys.exit()

{call}
"""


@pytest.mark.parametrize(
    ("module", "call"),
    [
        ("jaccard", "module.frequent = lambda *_: np.zeros(0, np.int64)\nmodule.F.col = lambda c: type('C', (), dict(cast=lambda s, _: s, alias=lambda s, _: s))()\nmodule.linked(Docs(), module.Rule(5, 80, 100))"),
        ("quality", "module._columns = lambda docs: docs\nmodule.features(Docs())"),
    ],
)
def test_given_back(module, call):
    """A task over batches of 40 MB leaves its worker at about the size that it had."""
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(module=module, call=call)], capture_output=True, text=True, check=True, timeout=300)
    rows, more = done.stdout.split()
    assert int(rows) == 30000 and float(more) < 40, done.stdout


PACKING = """
import re, threading, time
import numpy as np, pyarrow as pa
from lathe.llm import packing
from lathe.llm.queries import tokenizer_path

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

words = np.array([f"{a}{b}" for a in "abcdefghijklmnop" for b in ("ing", "er", "ation", "s")])
texts = [" ".join(np.random.default_rng(i % 50).choice(words, 5000).tolist()) for i in range(1500)]
batch = pa.RecordBatch.from_arrays([pa.array(range(1500), pa.int64()), pa.array(texts)], ["doc_id", "text"])
del texts
run = packing._pieces(tokenizer_path(), packing.CAPACITY, packing.END_ID, False)
few = [x for out in run(iter([batch.slice(0, 50)])) for x in out.to_pylist()]
first, most, on = held(), [0.0], [True]

def watch():
    while on:
        most[0] = max(most[0], held())
        time.sleep(0.01)

thread = threading.Thread(target=watch)
thread.start()
out = list(run(iter([batch])))
on.clear()
thread.join()
rows = [x | {"doc_id": x["doc_id"] % 50} for b in out for x in b.to_pylist()]
assert rows == few * 30
print(batch.nbytes >> 20, most[0] - first)
"""


def test_packing_parts_by_bytes():
    """A task that packs one batch of long texts takes memory for a part of it, and its pieces are those of the same texts in smaller batches."""
    done = subprocess.run([sys.executable, "-c", PACKING], capture_output=True, text=True, check=True, timeout=300)
    size, more = done.stdout.split()
    assert int(size) > 30 and float(more) < 150, done.stdout


def test_batches_by_bytes(spark):
    """A staged table's job deals rows to Python in batches of bounded bytes; the session's setting stays, also after a failure."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    def fails(batches):
        raise ValueError("no")
        yield from batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    had = spark.conf.get(key)
    docs = spark.range(0, 1000, 1, 1).selectExpr("id", "repeat('0123456789', IF(id = 500, 1000000, 1000)) AS text")
    got = staging.written(docs.mapInArrow(sizes, "rows long, bytes long"), "sizes", staging.BATCH_BYTES).collect()
    assert sum(r["rows"] for r in got) == 1000
    # A row is taken before it is counted.
    assert all(r["bytes"] < 1.1 * staging.BATCH_BYTES for r in got if r["bytes"] < 10_000_000) and len(got) > 3
    assert spark.conf.get(key) == had
    with pytest.raises(Exception, match="no"):
        staging.written(docs.mapInArrow(fails, "id long, text string"), "fails", staging.BATCH_BYTES)
    assert spark.conf.get(key) == had


def test_lean_group_runs_by_groups(spark):
    sums = staging.lean_group(lambda key, t: pa.table({"k": pa.array([key[0].as_py()]), "rows": pa.array([t.num_rows], pa.int64())}))
    got = spark.range(10).selectExpr("id % 2 AS k", "id").groupBy("k").applyInArrow(sums, "k long, rows long").collect()
    assert sorted(tuple(r) for r in got) == [(0, 5), (1, 5)]


def test_given_back_after_a_group(monkeypatch):
    calls = []
    monkeypatch.setattr(staging, "give_back", lambda: calls.append(1))
    table = pa.table({"a": [1]})
    assert staging.lean_group(lambda key, t: t)((1,), table) is table and calls == [1]
