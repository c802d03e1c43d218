"""Helpers for jobs whose executors share nothing but the cluster's checkpoint folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20  # of rows sent to Python at once


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in spark.checkpoint.dir; only a local session without one makes its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    sc.setCheckpointDir(folder)


def settle(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, so that a lost executor costs no recomputation of what led to them."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def fresh(name: str, *frames: DataFrame) -> str:
    """The name, with underscores before it as long as a column has it (in any case of letters)."""
    used = {c.lower() for f in frames for c in f.columns}
    while name.lower() in used:
        name = "_" + name
    return name


def masked(df: DataFrame, keep) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with the columns outside `keep` under names that nothing else uses, and a function that selects all columns under their own names again."""
    names = {c: f"_column_{i}" for i, c in enumerate(df.columns) if c not in keep}
    columns = df.columns
    return df.withColumnsRenamed(names), lambda out: out.select(*[F.col(names.get(c, c)).alias(c) for c in columns])


def attach(big: DataFrame, small: DataFrame, keys: list[str], rows: int = 50_000, salts: int = 32, nulls: bool = True) -> DataFrame:
    """Left join of a small grouped table to many rows, null keys matching null keys (with `nulls`; else they match nothing).

    `small` has one row per key. It is broadcast when a count shows at most `rows` rows; beyond that both
    sides are spread over `salts` per key, so no key's rows meet in one task. The rows are the same either way.
    Without `nulls` a table of whole numbers is broadcast as such, which takes under half the memory of the driver.
    """
    names = {k: fresh(f"_k{i}", big, small) for i, k in enumerate(keys)}
    salt, other = fresh("_salt", big, small), fresh("_s", big, small)
    right = small.withColumnsRenamed(names)
    equal = (lambda a, b: a.eqNullSafe(b)) if nulls else (lambda a, b: a == b)
    match = [equal(big[k], right[n]) for k, n in names.items()]
    if small.limit(rows + 1).count() <= rows:
        joined = big.join(F.broadcast(right), reduce(lambda a, b: a & b, match), "left")
        return joined.drop(*names.values())
    left = big.withColumn(salt, F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(salts)).cast("int"))
    right = right.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    match = [equal(left[k], right[n]) for k, n in names.items()] + [left[salt] == right[other]]
    return left.join(right, reduce(lambda a, b: a & b, match), "left").drop(*names.values(), salt, other)


def filter_by(big: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", rows: int = 1_000_000) -> DataFrame:
    """Rows whose key is (left_semi) or is not (left_anti) among ids. At most `rows` counted ids are broadcast, else both sides are shuffled."""
    keys = settle(ids.select(key).distinct())
    return big.join(F.broadcast(keys) if keys.limit(rows + 1).count() <= rows else keys, key, how)


def shared_path(spark: SparkSession) -> str:
    """A new place in the shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4()}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that shared_path() named and nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settle_table(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table of its own in the shared folder, read back with its columns prunable."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(df: DataFrame, col: str, name: str) -> DataFrame:
    """Rows numbered from 1 in the order of a column without ties: places inside each range of the sort plus the ranges' running size."""
    ranges = settle(df.orderBy(col)).withColumn("_part", F.spark_partition_id())
    sizes = ranges.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = sizes.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(col))
    return attach(ranges.withColumn("_place", place), before, ["_part"]).withColumn(name, (F.col("_before") + F.col("_place")).cast("int")).drop("_part", "_place", "_before")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside send rows to Python in Arrow batches of about BATCH_BYTES at most.

    Ten thousand whole texts, the usual batch, take up to 64 MB outside the heap of an executor, more while they grow, and again in its worker.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def release() -> None:
    """Gives the system back what a Python worker has freed: workers outlive their tasks, and allocators keep such memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
