"""Missingness profiles. Wide input, few-row output; each is one aggregate job."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitframe.functions.cluster import attach, settle
from visitframe.functions.scalar import binarize
from visitframe.operators.joins import flag_members
from visitframe.operators.reshape import wide_to_long
from visitframe.spec import PANEL, PanelSpec


def dropout_table(long: DataFrame, outcome: str = "cdrsb", time: str = "TIME") -> DataFrame:
    missing = F.col(outcome).isNull()
    return long.groupBy(time).agg(
        F.count("*").alias("n_total"),
        F.count(outcome).alias("observed"),
        F.count_if(missing).alias("missing"),
        F.round(F.avg(missing.cast("int")) * 100, 2).alias("pct_missing"),
    )


def _pct_missing(c) -> Column:
    return F.avg(F.col(c).isNull().cast("int")) * 100


def missing_by_variable(df: DataFrame, cols) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.count_if(F.col(c).isNull()).alias("n_miss"),
                              _pct_missing(c).alias("pct_missing")) for c in cols])
    return df.agg(rows.alias("r")).select(F.inline("r"))


def missing_by_group(df: DataFrame, factors, cols) -> DataFrame:
    """Percent missing per variable and level, every factor in the same pass."""
    levels = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors])
    flags = [F.col(c).isNull().cast("int").alias(f"_m_{c}") for c in cols]
    counts = (
        df.select(F.inline(levels), *flags)
        .groupBy("factor", "level")
        .agg(F.count("*").alias("n"), *[F.sum(f"_m_{c}").alias(f"_m_{c}") for c in cols])
    )
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), (F.col(f"_m_{c}") * 100.0 / F.col("n")).alias("pct_missing"))
                     for c in cols])
    return counts.select("factor", "level", "n", F.inline(rows))


def missing_flags(df: DataFrame, cols, id: str = "PATID") -> DataFrame:
    """Cell-level missing matrix."""
    return df.select(id, *[F.col(c).isNull().alias(c) for c in cols])


def missing_share(df: DataFrame, cols) -> DataFrame:
    """Overall share of missing cells."""
    gone = F.lit(0)
    for c in cols:
        gone = gone + F.col(c).isNull().cast("int")
    return df.agg(F.count("*").alias("n_rows"), F.sum(gone).alias("n_missing"),
                  (F.sum(gone) * 100.0 / (F.count("*") * len(cols))).alias("pct_missing"))


def pattern_string(family: str, spec: PanelSpec = PANEL) -> Column:
    """Observed visits as text, e.g. 1110000."""
    return F.concat(*[F.col(f"{family}{t}").isNotNull().cast("int").cast("string") for t in spec.visits])


def pattern_mask(family: str, spec: PanelSpec = PANEL) -> Column:
    """Observed visits as an integer bit mask, visit 0 lowest."""
    bits = F.lit(0)
    for i, t in enumerate(spec.visits):
        bits = bits + F.col(f"{family}{t}").isNotNull().cast("int") * F.lit(1 << i)
    return bits


def subject_patterns(wide: DataFrame, family: str = "cdrsb", spec: PanelSpec = PANEL) -> DataFrame:
    return wide.select(spec.id, pattern_string(family, spec).alias("pattern"),
                       pattern_mask(family, spec).alias("mask"))


def missing_patterns(wide: DataFrame, family: str = "cdrsb", spec: PanelSpec = PANEL) -> DataFrame:
    return wide.groupBy(pattern_string(family, spec).alias("pattern")).agg(F.count("*").alias("n"))


def is_monotone(wide: DataFrame, family: str = "cdrsb", spec: PanelSpec = PANEL) -> DataFrame:
    """One row: whether no subject returns after a gap, and how many do."""
    back = pattern_string(family, spec).rlike("01")
    return wide.agg(F.bool_and(~back).alias("monotone"), F.count_if(back).alias("n_intermittent"))


def dropout_time(family: str = "cdrsb", spec: PanelSpec = PANEL) -> Column:
    """First missing visit of a wide row as text, or Complete."""
    gaps = [F.when(F.col(f"{family}{t}").isNull(), F.lit(t)) for t in spec.visits]
    return F.coalesce(F.least(*gaps).cast("string"), F.lit("Complete"))


def last_observed_visit(family: str = "cdrsb", spec: PanelSpec = PANEL) -> Column:
    return F.greatest(*[F.when(F.col(f"{family}{t}").isNotNull(), F.lit(t)) for t in spec.visits])


def mean_profile(wide: DataFrame, spec: PanelSpec = PANEL, by: Column | None = None) -> DataFrame:
    """Mean of every family by visit and dropout time, in one job."""
    label = dropout_time(spec.families[0], spec) if by is None else by
    long = wide_to_long(wide.withColumn("first_missing", label), spec)
    return long.groupBy(spec.time, "first_missing").agg(*[F.avg(f).alias(f"mean_{f}") for f in spec.families])


def completers(wide: DataFrame, family: str = "cdrsb", spec: PanelSpec = PANEL) -> DataFrame:
    return wide.filter(F.col(f"{family}{spec.visits[-1]}").isNotNull()).select(spec.id)


def baseline_compare(wide: DataFrame, spec: PanelSpec = PANEL, adl: str = "ADL_NUM") -> DataFrame:
    """Completers against dropouts: N and baseline means. The flag comes from the row itself."""
    status = F.when(F.col(f"cdrsb{spec.visits[-1]}").isNotNull(), "Completer").otherwise("Dropout")
    means = {"cdrsb_base_mean": "cdrsb0", "bprs_base_mean": "bprs0", "taupet_base_mean": "taupet0",
             "abpet_base_mean": "abpet0", "sex_mean": "SEX", "age_mean": "AGE", "bmi_mean": "BMI",
             "inkomen_mean": "INKOMEN", "job_mean": "JOB", "adl_mean": adl, "wzc_mean": "WZC"}
    return wide.groupBy(status.alias("status")).agg(
        F.count("*").alias("n"), *[F.avg(F.col(c).cast("double")).alias(a) for a, c in means.items()])


def flag_completers(wide: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """The same flag by set membership, for tables that lack the last visit."""
    return flag_members(wide, completers(wide, spec=spec), spec.id, "status", "Completer", "Dropout")


def group_quantiles(df: DataFrame, value: str, by, probs, accuracy: int = 100_000) -> DataFrame:
    """Exact interpolated quantiles by group, one row per group and probability.

    A bounded sketch gives a narrow band around each rank; a second pass counts the rows below
    the band and the distinct values inside it. No task ever holds a large group's values; a group
    of at most `accuracy` rows is its own band.
    """
    margin = 2.0 / accuracy
    bounds = [min(max(p + s * margin, 0.0), 1.0) for p in probs for s in (-1, 1)]
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    sketch = rows.groupBy(*by).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", F.array(*[F.lit(b) for b in bounds]), accuracy).alias("_b"))
    v, small = F.col("_v"), F.col("_n") <= accuracy
    hits = F.array(*[
        F.when(v <= F.when(small, F.col("_max")).otherwise(F.col("_b")[2 * i + 1]),
               F.struct(F.lit(float(p)).alias("p"),
                        F.when(v >= F.when(small, F.col("_min")).otherwise(F.col("_b")[2 * i]), v).alias("_v")))
        for i, p in enumerate(probs)
    ])
    joined = _null_safe_join(rows, settle(sketch), by)
    counts = (
        joined.select(*by, "_n", F.inline(F.filter(hits, lambda h: h.isNotNull())))
        .groupBy(*by, "_n", "p", "_v").agg(F.count("*").alias("_c"))
    )
    w = Window.partitionBy(*by, "p").orderBy(F.col("_v").asc_nulls_first())
    w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = (F.col("_n") - 1) * F.col("p")
    rank = F.floor(at)
    pick = [F.min(F.when(F.col("_cum") > r, F.col("_v"))).alias(a)
            for r, a in ((rank, "_lo"), (F.least(rank + 1, F.col("_n") - 1), "_hi"))]
    ends = counts.withColumn("_cum", F.sum("_c").over(w)).groupBy(*by, "_n", "p").agg(*pick)
    return ends.select(*by, "p", (F.col("_lo") + (at - rank) * (F.col("_hi") - F.col("_lo"))).alias("quantile"))


def _null_safe_join(left: DataFrame, right: DataFrame, by) -> DataFrame:
    """Left rows with the matching group row, of which each has one; NULL groups match too and no key's rows meet in a task."""
    return attach(left, right, list(by))


def box_summary(df: DataFrame, value: str, by, exact: bool = True, accuracy: int = 100_000) -> DataFrame:
    """Quartiles, whiskers and outlier counts per group; `exact=False` takes the sketch as it is."""
    by = list(by)
    rows = df.filter(F.col(value).isNotNull()).select(*by, value)
    if exact:
        quart = group_quantiles(rows, value, by, (0.25, 0.5, 0.75), accuracy).groupBy(*by).agg(*[
            F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(a)
            for p, a in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    else:
        q = F.percentile_approx(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), accuracy)
        quart = rows.groupBy(*by).agg(q.alias("_q")).select(
            *by, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
    v = F.col(value)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    lo, hi = F.col("q1") - reach, F.col("q3") + reach
    return _null_safe_join(rows, settle(quart), by).groupBy(*by, "q1", "median", "q3").agg(
        F.count("*").alias("n"),
        F.min(F.when(v >= lo, v)).alias("whisker_low"), F.max(F.when(v <= hi, v)).alias("whisker_high"),
        F.count_if((v < lo) | (v > hi)).alias("n_outliers"))


def correlation_matrix(df: DataFrame, cols, digits: int = 2) -> DataFrame:
    """Listwise-complete correlations in long form, from one aggregate."""
    pairs = [(a, b) for a, b in combinations_with_replacement(cols, 2)]
    aggs = [F.round(F.corr(a, b), digits).alias(f"{a}|{b}") for a, b in pairs]
    one = df.select(*cols).dropna().agg(*aggs)
    cells = [F.struct(F.lit(x).alias("row_var"), F.lit(y).alias("col_var"), F.col(f"`{a}|{b}`").alias("corr"))
             for a, b in pairs for x, y in ({(a, b), (b, a)})]
    return one.select(F.inline(F.array(*cells)))


def bar_counts(long: DataFrame, level: str, time: str = "TIME") -> DataFrame:
    return long.groupBy(time, level).agg(F.count("*").alias("n"))


def histogram(long: DataFrame, value: str, width: float = 1.0, time: str = "TIME") -> DataFrame:
    """Counts by visit in bins centred on multiples of the width."""
    v = F.col(value)
    bin_ = (F.floor((v + width / 2.0) / width) * width).cast("double")
    return long.filter(v.isNotNull()).groupBy(time, bin_.alias("bin_centre")).agg(F.count("*").alias("n"))


def mean_trend(long: DataFrame, value: str, time: str = "TIME") -> DataFrame:
    return long.groupBy(time).agg(F.avg(value).alias(f"mean_{value}"))


def observed_proportion(wide: DataFrame, family: str = "cdrsb", cut: float = 10.0, name: str = "prop_observed",
                        by=(), spec: PanelSpec = PANEL) -> DataFrame:
    """Share at or above the cut by visit, original or stacked imputed rows."""
    long = wide_to_long(wide, spec, families=(family,), keep=list(by))
    return long.groupBy(*by, spec.time).agg(F.avg(binarize(family, cut)).alias(name))
