"""Tables that cut a plan's lineage, in the folder that the whole cluster shares; memory that workers give back."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A batch of a stage that reads texts, lists or ids in Python: so many bytes, or one row. Spark's own bound is 64 MB on either side.
BATCH_BYTES = 4 << 20
_left: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only where it is unset and the master is local (tests), a temporary folder takes its place."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lathe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lathe-{name}-{uuid.uuid4().hex}"
    _left.append((spark, path))
    return path


@contextlib.contextmanager
def _batches_of(spark: SparkSession, most: int | None) -> Iterator[None]:
    """Jobs that begin here deal rows to Python in batches of at most so many bytes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    had = spark.conf.get(key)
    if not most or 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(had) <= most:
        yield
        return
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, had)


def written(df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder. A lost executor costs the reread of a file, not the work before it.

    batch_bytes: what a batch has at most that this job deals to Python; a longer row is a batch by itself.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with _batches_of(spark, batch_bytes):
        df.write.parquet(path)
    out = spark.read.parquet(path)
    out._staged = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes tables made by written() that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_staged", None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _left:
        try:
            remove(spark, path)
        except Exception:  # the session is gone; whoever owns the shared folder clears it
            return


def give_back() -> None:
    """What Arrow and the C library keep of freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, a function of mapInArrow, whose worker gives back what it has freed when its task ends.

    Workers wait for further tasks. What Arrow and the C library keep for those
    lies idle beside the JVM's memory meanwhile, also in stages without Python.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def lean_group(run: Callable[..., pa.Table]):
    """lean for a function of applyInArrow, after each group."""

    # Without hints: Spark reads them, and takes only those it knows.
    def whole(key, table):
        try:
            return run(key, table)
        finally:
            give_back()

    return whole


def posix(path: str) -> str:
    """The path under which every worker can open a file of the shared folder."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: memory-mapped files need a shared folder that is mounted on every worker (file://...)")
    return path
