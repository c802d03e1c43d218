"""Means, standard deviations, z-scores, frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitframe.operators.joins import attach_by_key, attach_row


def mean_sd(df: DataFrame, cols, by=()) -> DataFrame:
    """mean_<c> and sd_<c> (n-1 form), overall or by group."""
    aggs = [a for c in cols for a in (F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"sd_{c}"))]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def apply_zscore(df: DataFrame, stats: DataFrame, cols, by=(), suffix: str = "_STD") -> DataFrame:
    """Standardise with a given statistics table."""
    out = attach_by_key(df, stats, list(by)) if by else attach_row(df, stats)
    out = out.withColumns({f"{c}{suffix}": (F.col(c) - F.col(f"mean_{c}")) / F.col(f"sd_{c}") for c in cols})
    return out.drop(*[f"{k}_{c}" for c in cols for k in ("mean", "sd")])


def zscore(df: DataFrame, cols, scope="all", reference: DataFrame | None = None, suffix: str = "_STD") -> DataFrame:
    """scope: "all" rows of df, "reference" rows of another table, or a list of group columns."""
    by = () if isinstance(scope, str) else tuple(scope)
    base = reference if scope == "reference" else df
    return apply_zscore(df, mean_sd(base, cols, by), cols, by, suffix)


def zscore_visits(wide: DataFrame, stats: DataFrame, family: str, visits, suffix: str = "_STD") -> DataFrame:
    """Standardise every visit column of a family with the family's long-form mean and sd."""
    out = attach_row(wide, stats.select(f"mean_{family}", f"sd_{family}"))
    mean, sd = F.col(f"mean_{family}"), F.col(f"sd_{family}")
    out = out.withColumns({f"{family.upper()}{suffix}{t}": (F.col(f"{family}{t}") - mean) / sd for t in visits})
    return out.drop(f"mean_{family}", f"sd_{family}")


def mean_var_count(df: DataFrame, by, value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("variance"),
                               F.count(value).alias("n"))


def missing_report(df: DataFrame, cols) -> DataFrame:
    """n, nmiss and min of each column, one row per column."""
    rows = F.array(*[
        F.struct(F.lit(c).alias("variable"), F.count(c).alias("n"), F.count_if(F.col(c).isNull()).alias("nmiss"),
                 F.min(F.col(c).cast("double")).alias("min"))
        for c in cols
    ])
    return df.agg(rows.alias("r")).select(F.inline("r"))


def frequency(df: DataFrame, *cols) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def group_mean(df: DataFrame, by, value: str, name: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias(name))


def empirical_variance(residuals: DataFrame, col: str = "residual", time: str = "TIME") -> DataFrame:
    """Mean squared residual by visit."""
    return residuals.groupBy(time).agg(F.avg(F.col(col) * F.col(col)).alias("empirical_variance"))
