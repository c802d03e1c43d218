"""Rubin's rules over tables of per-imputation estimates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from visitframe.functions.dist import t_quantile, t_sf2


@pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_sf2(t.to_numpy(float), df.to_numpy(float)))


@pandas_udf(DoubleType())
def t_upper_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    import numpy as np

    return pd.Series(t_quantile(p.to_numpy(float), np.minimum(df.to_numpy(float), 1e9)))


def pool(params: DataFrame, by=(), df: str = "rubin", dfcom=None) -> DataFrame:
    """Per term: estimate, within, between and total variance, degrees of freedom and t.

    `params` needs term, estimate, std_error; `by` adds groups such as scenario. Identical fits have
    no between variance and infinite (NULL) degrees of freedom. df="barnard_rubin" takes the
    complete-data degrees of freedom `dfcom`, a number or a column.
    """
    m, w, b, t = (F.col(c) for c in ("m", "within", "between", "total"))
    out = params.groupBy(*by, "term").agg(
        F.count("estimate").alias("m"),
        F.avg("estimate").alias("estimate"),
        F.avg(F.col("std_error") * F.col("std_error")).alias("within"),
        F.coalesce(F.var_samp("estimate"), F.lit(0.0)).alias("between"),
        *([F.first(dfcom).alias("_dfcom")] if isinstance(dfcom, str) else []),
    )
    inflated = (1 + 1 / m) * b
    out = out.withColumn("total", w + inflated).withColumn("std_error", F.sqrt(t))
    share = F.when(t > 0, inflated / t)
    old = F.when(b > 0, (m - 1) / (share * share))
    if df == "barnard_rubin":
        com = F.col("_dfcom") if isinstance(dfcom, str) else F.lit(float(dfcom))
        seen = (com + 1) / (com + 3) * com * (1 - F.coalesce(share, F.lit(0.0)))
        nu = F.when(old.isNull(), seen).otherwise(old * seen / (old + seen))
    else:
        nu = old
    out = out.withColumns({
        "df": nu, "t_value": F.col("estimate") / F.col("std_error"),
        "rel_increase": F.when(w > 0, inflated / w), "fraction_missing": share,
    })
    return out.drop("_dfcom") if isinstance(dfcom, str) else out


def inference(pooled: DataFrame, level: float = 0.95) -> DataFrame:
    """p-value and confidence limits beside a pooled table."""
    nu = F.coalesce(F.col("df"), F.lit(1e9))
    out = pooled.withColumn("p_value", t_two_sided("t_value", nu))
    half = t_upper_quantile(F.lit(0.5 + level / 2), nu) * F.col("std_error")
    return out.withColumns({"lcl": F.col("estimate") - half, "ucl": F.col("estimate") + half})


def pool_wide(table: DataFrame, terms, by=("imp",), prefix: str = "SE_") -> DataFrame:
    """Pooling of one row per imputation with a column per estimate and per standard error."""
    rows = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"`{t}`").alias("estimate"),
                              F.col(f"`{prefix}{t}`").alias("std_error")) for t in terms])
    return pool(table.select(*by, F.inline(rows)), [c for c in by if c != "imp"])


def pool_cov(params: DataFrame, covariances: DataFrame, by=()) -> DataFrame:
    """Within, between and total covariance of every pair of terms.

    Both inputs hold terms x imputations rows, so the pairing join is bounded by the model's size.
    """
    on = [*by, "imp"]
    left = params.select(*on, F.col("term").alias("row_term"), F.col("estimate").alias("_a"))
    right = params.select(*on, F.col("term").alias("col_term"), F.col("estimate").alias("_b"))
    cells = covariances.join(left, [*on, "row_term"]).join(right, [*on, "col_term"])
    out = cells.groupBy(*by, "row_term", "col_term").agg(
        F.count("value").alias("m"), F.avg("value").alias("within"),
        F.coalesce(F.covar_samp("_a", "_b"), F.lit(0.0)).alias("between"))
    return out.withColumn("total", F.col("within") + (1 + 1 / F.col("m")) * F.col("between"))


def pool_variance_components(cov_params: DataFrame, by=()) -> DataFrame:
    """Mean of each covariance parameter, and the mean with (1 + 1/m) times its variance added as reported."""
    out = cov_params.groupBy(*by, "cov_parm").agg(
        F.avg("estimate").alias("avg"), F.var_samp("estimate").alias("between"), F.count("estimate").alias("m"))
    m, b = F.col("m"), F.col("between")
    return out.withColumn("avg_plus_between", F.when(m > 1, F.col("avg") + (1 + 1 / m) * b).otherwise(F.col("avg")))
