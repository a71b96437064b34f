"""Shared plumbing: tables in the shared folder, row numbering helpers, text hashing."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the control characters 9 to 13. bytes.split() uses the same set.
WORD = r"[^\x20\x09-\x0D]+"


#: Most bytes of a table that is broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 16 * 2**20
#: The rarity sketch: counters, the pieces in which they are summed, and how many pieces one task sums.
CELLS_LOG2 = 20
SLABS = 64
SUMMED = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir. In local mode alone, where driver and executors are one
    process, a temporary one is made if it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def materialise(df: DataFrame, codec: str = "zstd", last: bool = False) -> DataFrame:
    """Write df once to the shared folder and read it back, which cuts its lineage; removed when the session ends.

    last: nothing reads df's shuffles any more, so Spark is asked to look for shuffle files that it can delete."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    fs, where = _file_system(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    if scopes := _scopes(spark):
        scopes[-1].append(out)
    if last:
        del df
        release(spark)
    return out


def _scopes(spark: SparkSession) -> list[list[DataFrame]]:
    """The open scratch scopes. They hang on the context: modules are shipped to executors and must hold no DataFrames."""
    return spark.sparkContext.__dict__.setdefault("_graphloom_scopes", [])


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables that are written inside, but for those handed to the function it gives."""
    _scopes(spark).append([])
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        for df in _scopes(spark).pop():
            if not any(df is k for k in kept):
                discard(df)
        release(spark)


def release(spark: SparkSession) -> None:
    """Spark deletes the files of a shuffle when the driver collects its plan as garbage, which may be long after its use."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete a table that materialise() wrote, once nothing reads it any more."""
    path = getattr(df, "_graphloom_path", None)
    if path:
        fs, where = _file_system(df.sparkSession, path)
        fs.delete(where, True)


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_enough(df: DataFrame, size: Column) -> bool:
    """Whether df, a written table whose rows take `size` bytes, may be broadcast."""
    return (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def _count_cells(hashes_of: Callable[[list[bytes]], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        counts = np.zeros(2**CELLS_LOG2, np.int64)
        for batch in (part for whole in batches for part in pieces(whole, "text", 2**20)):
            cells = (hashes_of([x.as_py() for x in batch.column("text")]) >> np.uint64(64 - CELLS_LOG2)).astype(np.int64)
            counts += np.bincount(cells, minlength=len(counts))
        slabs = counts.astype(np.float64).reshape(SLABS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLABS), pa.int32()), pa.array([s.tobytes() for s in slabs], pa.binary())], ["slab", "counts"])

    return run


def _sum_slabs(table: pa.Table) -> pa.Table:
    total = np.zeros(2**CELLS_LOG2 // SLABS)
    for x in table.column("counts"):
        total += np.frombuffer(x.as_py(), np.float64)
    return pa.table({"slab": table.column("slab")[:1], "part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def rarity(texts: DataFrame, hashes_of: Callable[[list[bytes]], np.ndarray]):
    """Broadcast array of 2**CELLS_LOG2 order classes (1 MB whatever the input): the rounded logarithm of how many tokens fall
    in each cell. texts: text (binary). Counts are summed in a tree of SUMMED per task."""
    spark = texts.sparkSession
    level = texts.mapInArrow(_count_cells(hashes_of), "slab int, counts binary").withColumn("part", F.spark_partition_id())
    many = texts._jdf.queryExecution().toRdd().getNumPartitions()
    while True:
        level = level.withColumn("part", F.floor(F.col("part") / SUMMED).cast("int")).groupBy("slab", "part").applyInArrow(
            _sum_slabs, "slab int, part int, counts binary"
        )
        many = -(-many // SUMMED)
        if many <= 1:
            break
    order = np.zeros((SLABS, 2**CELLS_LOG2 // SLABS), np.uint8)
    for r in level.collect():  # SLABS rows of 128 KB
        order[r["slab"]] = np.minimum(np.floor(2 * np.log2(np.frombuffer(r["counts"], np.float64) + 1)), 63)
    return spark.sparkContext.broadcast(order.reshape(-1))


def trim() -> None:
    """Give back memory that a reused Python worker still holds from earlier tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def pieces(batch, column: str, most: int):
    """Slices of an Arrow batch whose values in a string or binary column take about `most` bytes; one row at least each."""
    values = batch.column(batch.schema.get_field_index(column))
    if not len(values):
        return
    lengths = np.array([0 if not v.is_valid else len(v.as_buffer()) for v in values], np.int64)
    part = np.cumsum(lengths) // most
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    for s, e in zip(starts, [*starts[1:], len(values)], strict=True):
        yield batch.slice(int(s), int(e - s))
