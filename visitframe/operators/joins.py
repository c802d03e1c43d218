"""The equi-joins and one-row joins of the analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitframe.functions.cluster import attach


def attach_row(df: DataFrame, stats: DataFrame) -> DataFrame:
    """A global aggregate (exactly one row) attached to all rows."""
    return df.crossJoin(F.broadcast(stats))


def attach_by_key(df: DataFrame, stats: DataFrame, keys) -> DataFrame:
    """Grouped statistics to rows: a broadcast behind a count, else salted; rows with a null key get none."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    out = attach(df, stats.dropna(subset=keys), keys)
    return out.select(*keys, *[c for c in out.columns if c not in keys])


def attach_originals(imputed: DataFrame, wide: DataFrame, cols, id: str = "PATID", prefix: str = "o_") -> DataFrame:
    """Imputed rows with the original, possibly missing, values beside them."""
    return imputed.join(wide.select(id, *[F.col(c).alias(prefix + c) for c in cols]), id, "left")


def flag_members(df: DataFrame, ids: DataFrame, id: str, name: str, yes="yes", no="no") -> DataFrame:
    """Label rows by whether their key is in a set."""
    keys = ids.select(id).distinct().withColumn("_hit", F.lit(1))
    return (df.join(keys, id, "left")
              .withColumn(name, F.when(F.col("_hit").isNotNull(), yes).otherwise(no)).drop("_hit"))


def keep_members(df: DataFrame, ids: DataFrame, id: str) -> DataFrame:
    return df.join(ids.select(id), id, "left_semi")


def merge_by_time(*tables: DataFrame, key: str = "time_tenths") -> DataFrame:
    """Full outer merge of curves and observed values on whole tenths of a visit."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, key, "full")
    return out
