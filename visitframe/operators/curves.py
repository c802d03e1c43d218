"""Variance, probability and calibration curves over the visit axis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitframe.functions.scalar import binomial_variance, linear_predictor, logistic
from visitframe.operators.joins import merge_by_time
from visitframe.operators.reshape import evaluation_grid


def variance_function(cov_params: DataFrame, value: str = "estimate", name: str = "fitted_variance", by=(),
                      last_visit: int = 6) -> DataFrame:
    """d11 + 2 t d12 + t^2 d22 + residual on the grid of tenths."""
    def pick(p):
        return F.max(F.when(F.col("cov_parm") == p, F.col(value)))

    one = cov_params.groupBy(*by).agg(pick("UN(1,1)").alias("d11"), pick("UN(2,1)").alias("d12"),
                                      pick("UN(2,2)").alias("d22"), pick("Residual").alias("s2"))
    t = F.col("TIME")
    var = F.col("d11") + 2 * t * F.col("d12") + t * t * F.col("d22") + F.col("s2")
    return evaluation_grid(one, last_visit).select(*by, "time_tenths", var.alias(name))


def at_visits(df: DataFrame, time: str = "TIME") -> DataFrame:
    """Replace the visit by its whole-tenths key, so that curves and visits merge exactly."""
    return df.withColumn("time_tenths", (F.col(time) * 10).cast("int")).drop(time)


def variance_comparison(empirical: DataFrame, *curves: DataFrame) -> DataFrame:
    """Empirical variance by visit beside fitted curves."""
    return merge_by_time(at_visits(empirical), *curves)


def prediction_curve(pooled: DataFrame, at: dict, name: str = "pred_prob", by=(), last_visit: int = 6) -> DataFrame:
    """Probability over time at fixed covariates from a (term, estimate) table.

    `at` maps a term's non-time factors to numbers; factors that are absent count as 0.
    """
    grid = evaluation_grid(pooled, last_visit)
    t = F.col("TIME")
    parts = F.split("term", r"\*")
    values = F.create_map(*[x for k, v in at.items() for x in (F.lit(k), F.lit(float(v)))]) if at else None

    def factor(f):
        fixed = F.coalesce(values[f], F.lit(0.0)) if values is not None else F.lit(0.0)
        return F.when(f == "TIME", t).when(f == "Intercept", 1.0).otherwise(fixed)

    product = F.aggregate(parts, F.lit(1.0), lambda a, f: a * factor(f))
    eta = grid.groupBy(*by, "time_tenths").agg(F.sum(F.col("estimate") * product).alias("eta"))
    return eta.select(*by, "time_tenths", logistic("eta").alias(name))


def prediction_curve_for(coefficients: dict, values: dict, grid: DataFrame, name: str = "pred_prob") -> DataFrame:
    """The same for literal coefficients keyed by factor tuples."""
    eta = linear_predictor(coefficients, {**values, "TIME": F.col("TIME")})
    return grid.withColumn(name, logistic(eta))


def pooled_probability_curve(predictions: DataFrame, time: str = "TIME") -> DataFrame:
    """Mean probability and mean of the limits by visit, over subjects and imputations."""
    return predictions.groupBy(time).agg(
        F.avg("pred_prob").alias("mean_prob"), F.avg("lower_ci").alias("mean_lower"), F.avg("upper_ci").alias("mean_upper"))


def binomial_variance_curve(curve: DataFrame) -> DataFrame:
    return curve.withColumn("fitted_variance", binomial_variance("mean_prob"))


def calibration_table(observed: DataFrame, imputed: DataFrame, curve: DataFrame) -> DataFrame:
    """Observed, imputed and predicted proportion on the merged time axis."""
    return merge_by_time(at_visits(observed), at_visits(imputed), curve)
