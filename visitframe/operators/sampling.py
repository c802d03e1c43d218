"""Sampling whole subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_ids(df: DataFrame, n: int, seed: int = 123, id: str = "PATID") -> DataFrame:
    """n distinct subjects in keyed-hash order: a top-k, the same on every run and layout."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id).cast("string")))
    return df.select(id).distinct().withColumn("_k", key).orderBy("_k").limit(n).select(id)


def sample_subjects(df: DataFrame, n: int, seed: int = 123, id: str = "PATID") -> DataFrame:
    """All rows of n sampled subjects."""
    return df.join(sample_ids(df, n, seed, id), id, "left_semi")
