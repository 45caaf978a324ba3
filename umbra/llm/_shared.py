"""Shared-folder files, intermediate tables and graph components.

Executors and driver share no local disk, so whatever one process writes for
another lives under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is named, on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="umbra-shared-"))
    return _own[0]


def fresh_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/umbra-{tag}-{uuid.uuid4().hex[:12]}"


@contextmanager
def tidy(spark: SparkSession):
    """A query that ends in here takes its shuffle files with it; else they stay until the driver collects garbage."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage cut, computed once."""
    path = fresh_dir(df.sparkSession, tag)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(*tables: DataFrame | str | None) -> None:
    """Deletes written tables and folders that nothing reads any more."""
    spark = SparkSession.active()
    for t in tables:
        for path in [] if t is None else [t] if isinstance(t, str) else sorted({f.rpartition("/")[0] for f in t.inputFiles()}):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Bound an Arrow batch of whole texts by rows and bytes (session settings); one longer text is a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def partitions_for(df: DataFrame) -> int:
    """A number of buckets that follows the input's size."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(n, df.rdd.getNumPartitions())


def by_range(rows: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """rows in n partitions by ascending ranges of the key, sorted within each; nulls come first.

    A partition's number is its range's place. Rows of one key are dealt by their
    texts' hashes and rows equal in both at random, so no key is too hot for its
    range. Spark samples the ranges' borders: none stands in the plan.
    """
    first, then = F.col(key).asc_nulls_first(), F.xxhash64(text)
    return rows.repartitionByRange(n, first, then, F.rand(7)).sortWithinPartitions(first, then, text)


def part_number() -> int:
    """The running task's partition, the same when the task runs again."""
    return TaskContext.get().partitionId()


def local_path(uri: str) -> str | None:
    if "://" not in uri and not uri.startswith("file:"):
        return uri
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None


def put_bytes(uri: str, chunks) -> None:
    """Write a file whole or not at all, so a task that runs twice does no harm."""
    tmp = f"{uri}.{uuid.uuid4().hex[:8]}.tmp"
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(local_path(tmp), "wb") as f:
            for c in chunks:
                f.write(c)
        os.replace(local_path(tmp), path)
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(tmp)
    with store.open_output_stream(at) as f:
        for c in chunks:
            f.write(c)
    store.move(at, fs.FileSystem.from_uri(uri)[1])


def mapped(uri: str) -> np.ndarray:
    """A file's bytes as a read-only memory map; remote ones by an unlinked copy."""
    path = local_path(uri)
    if path is None:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(uri)
        with tempfile.NamedTemporaryFile() as tmp:
            with store.open_input_stream(at) as f:
                while chunk := f.read(1 << 22):
                    tmp.write(chunk)
            tmp.flush()
            return _map(tmp.name)
    return _map(path)


def _map(path: str) -> np.ndarray:
    if not os.path.getsize(path):
        return np.zeros(0, np.uint8)
    return np.memmap(path, np.uint8, "r")


def among(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of x are in the ascending, non-empty ``some``."""
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def run_starts(x: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def six(x: np.ndarray) -> bytes:
    """Numbers below 2 ** 48 in six bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unsix(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def numbered(rows: DataFrame, tag: str) -> DataFrame:
    """A written table of ``uid`` and ``row`` (a struct of all columns); a uid's upper bits name the task that gave it."""
    return written(rows.select(F.monotonically_increasing_id().alias("uid"), F.struct("*").alias("row")), tag)


def put_ids(ids: DataFrame, tag: str) -> str:
    """The column uid as ascending numbers, a file for each task that gave them; their folder."""
    path = fresh_dir(ids.sparkSession, tag)

    def write(table: pa.Table) -> pa.Table:
        uid = np.unique(table.column("uid").to_numpy())
        put_bytes(f"{path}/{uid[0] >> 33}", [uid.astype("<i8").tobytes()])
        return pa.table({"n": pa.array([len(uid)], pa.int64())})

    parts = ids.select("uid", F.shiftright("uid", 33).alias("part"))
    with tidy(ids.sparkSession):
        parts.groupBy("part").applyInArrow(write, "n long").agg(F.sum("n")).collect()
    return path


def with_ids(rows: DataFrame, path: str, then=None, schema=None) -> DataFrame:
    """The rows whose uid is in the folder's files, which workers map; the rows stay where they are.

    A semi-join would shuffle whole texts, or broadcast a list that grows with
    them. A task reads the files of its own rows alone. then: takes the batches
    further in the same worker, to rows of ``schema``.
    """
    at = rows.columns.index("uid")

    def run(batches):
        have, ids = None, None
        for b in batches:
            uid = b.column(at).to_numpy()
            keep = np.zeros(len(uid), bool)
            for part in np.unique(uid >> 33):
                if part != have:
                    have = part
                    try:
                        ids = mapped(f"{path}/{part}").view("<i8")
                    except FileNotFoundError:
                        ids = np.zeros(0, np.int64)
                if len(ids):
                    own = uid >> 33 == part
                    keep[own] = among(uid[own], ids)
            yield b.filter(pa.array(keep))
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run if then is None else lambda batches: then(run(batches)), schema or rows.schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components: (a, b) long pairs to (node, root), root the least node.

    Labels spread along edges and then along themselves (pointer jumping), so
    the rounds follow the logarithm of the diameter. Every round is one join of
    two written tables, which adaptive execution splits at a hot node, and one
    grouped minimum with map-side combination. Edges may repeat and may join a
    node to itself; an empty table gives an empty result.
    """
    both = written(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")), "labels")
    while True:
        along = both.join(labels, both.a == labels.node).select(F.col("b").alias("node"), "root")
        spread = written(
            labels.unionByName(along).groupBy("node").agg(F.min("root").alias("root")), "labels"
        )
        up = spread.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = written(
            spread.join(up, "root").select("node", F.least("root", "top").alias("root")), "labels"
        )
        changed = (
            jumped.join(labels.withColumnRenamed("root", "was"), "node").where("root <> was").limit(1).count()
        )
        remove(labels, spread)
        labels = jumped
        if not changed:
            remove(both)
            return labels
