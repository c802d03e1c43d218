"""Column helpers: all are plain expressions that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def binarize(c, cut: float, closed: str = "right") -> Column:
    """0/1 by a cut. closed="right": value >= cut is 1; closed="left": value > cut is 1. NULL stays NULL."""
    c = _c(c)
    zero = c < cut if closed == "right" else c <= cut
    return F.when(c.isNull(), F.lit(None).cast("int")).when(zero, 0).otherwise(1)


def observed(c) -> Column:
    return _c(c).isNotNull().cast("int")


def observed_count(cols) -> Column:
    """Number of non-missing values across columns of a row."""
    total = F.lit(0)
    for c in cols:
        total = total + observed(c)
    return total


def logistic(c) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(c)))


def inverse_probability(p) -> Column:
    """1/p where p is positive, else NULL."""
    p = _c(p)
    return F.when(p > 0, F.lit(1.0) / p)


def binomial_variance(p) -> Column:
    p = _c(p)
    return p * (F.lit(1.0) - p)


def estimate_cell(estimate, se) -> Column:
    """Text cell of a comparison table."""
    return F.format_string("%.3f (sd=%.3f)", _c(estimate), _c(se))


def clean_name(c) -> Column:
    """Effect name as a column name: products get underscores, blanks go."""
    return F.upper(F.replace(F.translate(_c(c), "*", "_"), F.lit(" "), F.lit("")))


def linear_predictor(coefficients: dict, values: dict) -> Column:
    """Sum of coefficient x product of factor values; keys of `coefficients` are factor tuples."""
    eta = F.lit(0.0)
    for factors, beta in coefficients.items():
        term = _c(beta) if isinstance(beta, str) else (beta if isinstance(beta, Column) else F.lit(float(beta)))
        for f in factors:
            v = values[f]
            term = term * (v if isinstance(v, Column) else F.lit(float(v)))
        eta = eta + term
    return eta
