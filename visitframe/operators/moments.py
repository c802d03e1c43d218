"""Sums of arrays by a small key: the one way rows are reduced for model fitting.

Each task folds its Arrow batches into one array per key with numpy; Spark then adds whole arrays,
over groups of tasks and over the groups. What reaches the driver is keys x entries and never grows with the rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# A task holding more than this hands its sums on and starts anew, so many keys cost rows, not memory.
TASK_BYTES = 64 << 20
FAN = 64


def sum_arrays(df: DataFrame, kernel: Callable, keys: list[tuple[str, str]]) -> DataFrame:
    """Add up `kernel(pdf) -> iterable of (key tuple, 1-D array)` over all batches of all tasks.

    Returns one row per key with `values array<double>`.
    """
    names = [k for k, _ in keys]

    def part(total):
        out = pd.DataFrame(list(total), columns=names)
        out["values"] = list(total.values())
        return out

    def fold(batches):
        total = {}
        for pdf in batches:
            if len(pdf) == 0:
                continue
            for key, arr in kernel(pdf):
                if key in total:
                    total[key] += arr
                else:
                    total[key] = np.array(arr, dtype=float)
            if sum(a.nbytes for a in total.values()) > TASK_BYTES:
                yield part(total)
                total = {}
        if total:
            yield part(total)

    schema = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in keys]
                          + [T.StructField("values", T.ArrayType(T.DoubleType()))])
    # whole arrays are added over groups of FAN tasks first, then over the groups: a shuffle moves one row per task and key, then per group and key
    partial = df.mapInPandas(fold, schema).withColumn("_group", F.floor(F.spark_partition_id() / FAN))
    return _added(_added(partial, [*names, "_group"]), names)


def _added(arrays: DataFrame, keys: list[str]) -> DataFrame:
    """`values` of equal length added entry by entry per key."""
    held = arrays.groupBy(*keys).agg(F.collect_list("values").alias("_all"))
    total = F.aggregate(F.slice("_all", 2, F.size("_all")), F.col("_all")[0], lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return held.select(*keys, total.alias("values"))


def collect_sums(df: DataFrame, kernel: Callable, keys: list[tuple[str, str]]) -> dict:
    """The same, brought to the driver as {key tuple: array}."""
    names = [k for k, _ in keys]
    rows = sum_arrays(df, kernel, keys).collect()
    return {tuple(r[n] for n in names): np.array(r["values"], dtype=float) for r in rows}


def upper(m: np.ndarray) -> np.ndarray:
    """Upper triangle of a symmetric matrix as a vector."""
    return m[np.triu_indices(m.shape[0])]


def symmetric(v: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    i, j = np.triu_indices(k)
    out[i, j] = v
    out[j, i] = v
    return out


def split_by(pdf: pd.DataFrame, keys: list[str]):
    """(key tuple, rows) pairs of a batch; the key count is small."""
    if not keys:
        yield (), pdf
        return
    for key, part in pdf.groupby(keys, sort=False):
        key = key if isinstance(key, tuple) else (key,)
        yield tuple(k.item() if hasattr(k, "item") else k for k in key), part
