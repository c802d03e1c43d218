"""Per-subject ordered operations. A subject has at most one row per visit, so windows stay small."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitframe.spec import PANEL, PanelSpec


def _w(spec):
    return Window.partitionBy(spec.id).orderBy(spec.time)


def previous_values(long: DataFrame, cols, spec: PanelSpec = PANEL, prefix: str = "prev_") -> DataFrame:
    return long.withColumns({prefix + c: F.lag(c).over(_w(spec)) for c in cols})


def previous_response(long: DataFrame, col: str, name: str = "prev_resp", default=0, spec: PanelSpec = PANEL):
    """Value at the previous row, `default` at the subject's first row."""
    w = _w(spec)
    first = F.row_number().over(w) == 1
    return long.withColumn(name, F.when(first, F.lit(default)).otherwise(F.lag(col).over(w)))


def missing_next(long: DataFrame, col: str, name: str = "is_missing_next", spec: PanelSpec = PANEL) -> DataFrame:
    return long.withColumn(name, F.lead(F.col(col).isNull()).over(_w(spec)))


def drop_last_visit(long: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    last = F.max(spec.time).over(Window.partitionBy(spec.id))
    return long.withColumn("_last", last).filter(F.col(spec.time) < F.col("_last")).drop("_last")


def first_row_flag(long: DataFrame, name: str = "is_first", spec: PanelSpec = PANEL) -> DataFrame:
    return long.withColumn(name, (F.row_number().over(_w(spec)) == 1).cast("int"))


def running_product(long: DataFrame, col: str, name: str, spec: PanelSpec = PANEL) -> DataFrame:
    """Product of a positive column over the subject's rows so far; a NULL factor counts as 1."""
    w = _w(spec).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return long.withColumn(name, F.exp(F.sum(F.coalesce(F.log(col), F.lit(0.0))).over(w)))


def person_period(wide: DataFrame, family: str = "cdrsb", keep=None, prev: str = "CDRSB_PREV",
                  spec: PanelSpec = PANEL) -> DataFrame:
    """Rows at risk: observed visits up to the first gap, with R = next visit observed.

    Everything needed sits in the wide row, so this is a narrow explode without a window.
    """
    keep = [spec.id, *spec.covariates] if keep is None else keep
    at_risk, rows = F.lit(True), []
    for t, nxt in zip(spec.visits[:-1], spec.visits[1:]):
        here, after = F.col(f"{family}{t}"), F.col(f"{family}{nxt}")
        seen = at_risk & here.isNotNull()
        rows.append(F.struct(seen.alias("_keep"), F.lit(t).alias(spec.time),
                             after.isNotNull().cast("int").alias("R"), here.alias(prev)))
        # The walk stops after the first visit whose successor is missing.
        at_risk = at_risk & after.isNotNull()
    return wide.select(*keep, F.inline(F.filter(F.array(*rows), lambda r: r["_keep"]))).drop("_keep")


def shift_time(df: DataFrame, by: int = 1, spec: PanelSpec = PANEL) -> DataFrame:
    return df.withColumn(spec.time, F.col(spec.time) + by)


def dropout_rows(wide: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Visits after the first with the missing flag and the previous visit's outcomes.

    The wide row already holds the previous visit, so no shuffle is needed.
    """
    keep = [c for c in wide.columns if c not in set(spec.all_visit_columns())]
    rows = F.array(*[
        F.struct(F.lit(t).alias(spec.time), F.col(f"cdrsb{t}").isNull().cast("int").alias("is_missing"),
                 *[F.col(f"{f}{p}").alias(f"prev_{f}") for f in spec.families])
        for p, t in zip(spec.visits[:-1], spec.visits[1:])
    ])
    return wide.select(*keep, F.inline(rows))


def next_missing_rows(wide: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """All visits but the last with the flag `missing at the next visit`, without a window."""
    rows = F.array(*[
        F.struct(F.lit(t).alias(spec.time), F.col(f"cdrsb{n}").isNull().alias("is_missing_next"),
                 *[F.col(f"{f}{t}").alias(f) for f in spec.families])
        for t, n in zip(spec.visits[:-1], spec.visits[1:])
    ])
    return wide.select(spec.id, F.inline(rows))
