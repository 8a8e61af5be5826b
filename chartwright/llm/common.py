"""What the operators share: the folder that all executors see, staged tables, splits, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text are runs of anything but these six ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]+"

#: Rows up to which the smaller side of joined() is broadcast.
BROADCAST = 200_000
#: Edges up to which components are united in one task.
LOCAL = 200_000
#: Keys with at least this share of the rows are the frequent ones: 1 / OFTEN keys at most.
OFTEN = 1e-5

_STAGED: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a folder of this session's own if Spark runs in one process, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="chartwright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def staged_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; release() deletes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows as a table in the shared folder and reads them back: the plan ends here and a lost executor costs nothing before it."""
    path = staged_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes all that staged_path() has given out so far. Call it only when no frame that reads those tables is in use."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _STAGED:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(conf).delete(path, True)


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows in slices whose texts take at most that many bytes; a longer text is a slice of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Python workers get at most that many rows at once: whole texts can be long, and Spark counts rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", most: int = BROADCAST) -> DataFrame:
    """A join with a staged table, by broadcast up to `most` rows of it. Beyond, both sides are plain exchanges, whose skewed partitions adaptive execution splits."""
    few = right.limit(most + 1).count() <= most
    return left.join(F.broadcast(right) if few else right, on, how)


def tiered(left: DataFrame, right: DataFrame, on: str | list[str], often: Column) -> DataFrame:
    """Inner join whose frequent keys, those rows of right, are broadcast."""
    return left.join(F.broadcast(right.where(often)), on).unionByName(left.join(right.where(~often), on))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches sorted by keys of numbers as tables of some rows that cut no group apart, and the bounds of their groups."""
    held: list[pa.RecordBatch] = []

    def bounds(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, dtype=bool)
        new[0] = True
        for k in keys:
            x = t.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.append(np.flatnonzero(new), t.num_rows)

    size = 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= rows:
            t = pa.Table.from_batches(held)
            at = bounds(t)
            if len(at) > 2:
                yield t.slice(0, int(at[-2])), at[:-1]
            held = t.slice(int(at[-2])).to_batches()
            size = sum(x.num_rows for x in held)
    if size:
        t = pa.Table.from_batches(held)
        yield t, bounds(t)


def lean() -> None:
    """Has a Python worker take large blocks from the system and return them as they are freed; workers are used again, and would keep the most that any task of theirs has needed."""
    import ctypes

    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        for option, value in ((-3, 1 << 20), (-1, 4 << 20)):  # blocks from 1 MB on are mapped; up to 4 MB may stay free on top
            libc.mallopt(option, value)
    except (OSError, AttributeError):  # another C library
        pass


def give_back() -> None:
    """Returns a Python worker's free memory to the system."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def crc_bucket(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo buckets; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(buckets)), F.lit(0)).cast("int")


def _united(edges: DataFrame) -> DataFrame:
    """connected_components() of few edges, in one task."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for b in batches:
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                x, y = root(up.setdefault(x, x)), root(up.setdefault(y, y))
                up[max(x, y)] = min(x, y)
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([root(x) for x in list(up)], pa.int64())], ["node", "component"])

    return edges.coalesce(1).mapInArrow(go, "node long, component long")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (node, component) of an undirected graph given as rows (a, b) of longs; component is the smallest node reachable.

    Up to LOCAL edges are united in one task. Beyond, star contractions alternate: each node's
    neighbours are linked to the smallest of them, which halves distances, so the rounds grow with the
    logarithm of the longest path. Neighbour minima are aggregates that combine before the shuffle; they
    are written, as each round is, so that the edges of a node with very many links meet its minimum in a
    plain join, which adaptive execution splits. An empty input gives no rows.
    """
    digest = lambda d: d.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    known = digest(edges)
    if known["n"] <= LOCAL:
        return staged(_united(edges), "united")
    for _ in range(rounds):
        # each node's larger neighbours go to the smallest of its neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = staged(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        # each node's smaller neighbours, and itself, go to the smallest of them
        down = staged(large.groupBy("a").agg(F.min("b").alias("m")), "down")
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = staged(small, "edges")
        before, known = known, digest(edges)
        if before == known:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return staged(roots.unionByName(edges.select(F.col("a").alias("node"), F.col("b").alias("component"))), "components")
