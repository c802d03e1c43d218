"""Wide <-> long, derived columns, class levels, grids and stacking."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitframe.functions.cluster import numbered
from visitframe.operators.joins import attach_by_key
from visitframe.functions.scalar import binarize, observed, observed_count
from visitframe.spec import PANEL, PanelSpec


def wide_to_long(df: DataFrame, spec: PanelSpec = PANEL, families=None, visits=None, keep=None) -> DataFrame:
    """All families unpivoted together: one row per subject and visit, with no shuffle."""
    families = spec.families if families is None else families
    visits = spec.visits if visits is None else visits
    if keep is None:
        gone = {f"{f}{t}" for f in spec.families for t in spec.visits}
        keep = [c for c in df.columns if c not in gone]
    rows = F.array(*[
        F.struct(F.lit(t).alias(spec.time), *[F.col(f"{f}{t}").alias(f) for f in families]) for t in visits
    ])
    return df.select(*keep, F.inline(rows))


def pivot_longer(df: DataFrame, pattern: str = r"(.*)(\d)$", spec: PanelSpec = PANEL) -> DataFrame:
    """Unpivot the columns whose name splits into (family, visit digit) by `pattern`.

    As in the greedy original, only the last digit is the visit.
    """
    split = {c: re.match(pattern, c) for c in df.columns}
    hits = {c: (m.group(1), int(m.group(2))) for c, m in split.items() if m}
    families = list(dict.fromkeys(f for f, _ in hits.values()))
    visits = sorted({t for _, t in hits.values()})
    have = set(hits.values())
    rows = F.array(*[
        F.struct(F.lit(t).alias(spec.time.lower()), *[
            (F.col(f"{f}{t}") if (f, t) in have else F.lit(None).cast("double")).alias(f) for f in families
        ]) for t in visits
    ])
    return df.select(*[c for c in df.columns if c not in hits], F.inline(rows))


def columns_like(df: DataFrame, pattern: str) -> DataFrame:
    """Keep the columns whose name matches a regular expression."""
    return df.select(*[c for c in df.columns if re.search(pattern, c)])


def complete_cases(df: DataFrame, cols) -> DataFrame:
    return df.dropna(subset=list(cols))


def response_indicator(df: DataFrame, col: str, name: str = "R") -> DataFrame:
    return df.withColumn(name, observed(col))


def add_bins(df: DataFrame, family: str, cut: float, closed: str = "right", suffix: str = "_bin",
             spec: PanelSpec = PANEL) -> DataFrame:
    """0/1 copy of every visit column of a family."""
    return df.withColumns({f"{family}{suffix}{t}": binarize(f"{family}{t}", cut, closed) for t in spec.visits})


def add_baseline(df: DataFrame, names: dict) -> DataFrame:
    """Copies under a new name, e.g. {"cdrsb_base": "cdrsb0"}."""
    return df.withColumns({new: F.col(old) for new, old in names.items()})


def class_levels(df: DataFrame, cols, limit: int = 10_000) -> dict:
    """Sorted distinct levels of class columns, all from one job; a class column has few by definition."""
    cols = list(cols)
    if not cols:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("string").alias("level")) for c in cols])
    found = df.select(F.inline(pairs)).where(F.col("level").isNotNull()).distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{cols} have more than {limit} levels; they are not class columns")
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    cast = {"string": str, "double": float, "float": float, "boolean": lambda x: x == "true"}
    out = {c: [] for c in cols}
    for r in found:
        out[r["factor"]].append(cast.get(kinds[r["factor"]], int)(r["level"]))
    return {c: sorted(v) for c, v in out.items()}


def factor_code(df: DataFrame, col: str, name: str) -> DataFrame:
    """1-based position of the value among the sorted distinct levels.

    Levels are numbered where a range sort puts them; rows get their code through a broadcast behind a count.
    """
    levels = df.select(col).where(F.col(col).isNotNull()).distinct()
    return attach_by_key(df, numbered(levels, col, name), [col])


def factor_codes(df: DataFrame, names: dict) -> DataFrame:
    """The same for several class columns {column: new name}, whose levels are looked up in one job and stand in the plan."""
    out = {}
    for col, levels in class_levels(df, names).items():
        pairs = [x for i, lv in enumerate(levels) for x in (F.lit(lv), F.lit(i + 1))]
        out[names[col]] = F.element_at(F.create_map(*pairs), F.col(col)) if pairs else F.lit(None).cast("int")
    return df.withColumns(out)


def add_observed_count(df: DataFrame, cols, name: str = "n_obs_data") -> DataFrame:
    return df.withColumn(name, observed_count(cols))


def pattern_column(family: str = "bprs", spec: PanelSpec = PANEL) -> Column:
    """Last observed visit of a wide row; -1 if none."""
    seen = [F.when(F.col(f"{family}{t}").isNotNull(), F.lit(t)) for t in spec.visits]
    return F.coalesce(F.greatest(*seen), F.lit(-1))


def long_to_wide(df: DataFrame, id_cols, names: str, values: str, levels, prefix: str = "") -> DataFrame:
    """One column per level of `names`; the level list is given, so no extra job looks for it."""
    out = df.groupBy(*id_cols).pivot(names, list(levels)).agg(F.first(values))
    return out.withColumnsRenamed({str(x): f"{prefix}{x}" for x in levels}) if prefix else out


def evaluation_grid(df: DataFrame, last_visit: int = 6, step_tenths: int = 1) -> DataFrame:
    """Each row repeated over time 0..last in steps of a tenth, keyed by whole tenths."""
    grid = F.explode(F.sequence(F.lit(0), F.lit(last_visit * 10), F.lit(step_tenths)))
    return df.select("*", grid.alias("time_tenths")).withColumn("TIME", F.col("time_tenths") / 10.0)


def expand_imputations(df: DataFrame, m: int) -> DataFrame:
    """m copies of every row with `imp` = 1..m; a narrow step."""
    return df.select(F.explode(F.sequence(F.lit(1), F.lit(m))).alias("imp"), "*")


def stack(**tables: DataFrame) -> DataFrame:
    """Concatenate tables with different columns; `source` tells where a row came from."""
    out = None
    for label, t in tables.items():
        t = t.withColumn("source", F.lit(label))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def model_panel(panel: DataFrame, spec: PanelSpec = PANEL, cut: float = 10.0) -> DataFrame:
    """Long rows seen in all four families, with the 0/1 outcome and a text visit label."""
    kept = ["cdrsb0", "abpet0", "taupet0"]
    long = wide_to_long(panel.withColumns({f"{c}_base": F.col(c) for c in kept}), spec)
    return (
        complete_cases(long, spec.families)
        .withColumn("cdrsb_cat", binarize("cdrsb", cut))
        .withColumn("timeclss", F.col(spec.time).cast("string"))
    )
