"""Sensitivity analyses: many scenarios of imputation, one model, one comparison table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitframe.functions.scalar import estimate_cell
from visitframe.operators.aggregates import zscore
from visitframe.operators.impute import impute
from visitframe.operators.linear import fit_lmm
from visitframe.operators.pool import inference, pool
from visitframe.operators.reshape import factor_codes, pattern_column
from visitframe.sources.panel import stage
from visitframe.spec import IMPUTATIONS, MODELS, PANEL, ImputationSpec, ModelSpec, PanelSpec


def grid_base(wide: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Wide table with what the grid's model reads: z-scores, the ADL level code and the dropout pattern.

    The z-scores stand for the columns; fits on copies replace them by those of each copy.
    """
    out = factor_codes(zscore(wide, ["AGE", "BMI"]), {"ADL": "ADL_NUM"})
    return out.withColumn("pattern", pattern_column("bprs", spec))


def shifts(spec: ImputationSpec, values, prefix: str, family: str = "bprs", first: int = 1) -> dict:
    """One scenario per shift: the constant is added to each draw of visits `first`.. inside the chain."""
    cols = [v for v in spec.variables if v[:-1] == family and int(v[-1]) >= first]
    return {f"{prefix}{s}": spec.variant(delta={c: float(s) for c in cols}) for s in values}


def sensitivity_grid(wide: DataFrame, values=(0, 2, 4, 6, 8, 10), m: int | None = None,
                     model: ModelSpec = MODELS["lmer_shift"], standard: ImputationSpec = IMPUTATIONS["mice_shift"],
                     pattern: ImputationSpec | None = IMPUTATIONS["mice_pattern_shift"],
                     spec: PanelSpec = PANEL) -> DataFrame:
    """Pooled estimates per scenario and term for shifts x {standard, pattern mixture}.

    A method without donors or class gaps reads the rows for the sums that drive all its chains, for each copy's means and sds of AGE
    and BMI, and to draw every scenario's copies and reduce them to the model's sums on the spot. Others draw row-wise, all
    scenarios and imputations together.
    """
    base = stage(grid_base(wide, spec))
    fits = []
    for imputation, prefix in ((standard, "STD_Shift_"), (pattern, "PAT_Shift_")):
        if imputation is None:
            continue
        if m is not None:
            imputation = imputation.variant(m=m)
        filled = impute(base, imputation, shifts(imputation, values, prefix), spec)
        used = {f for t in model.terms for f in t}
        fits.append(fit_lmm(filled, model, spec=spec, standard={f"{c}_STD": c for c in ("AGE", "BMI") if f"{c}_STD" in used and c in imputation.variables}))
    params = fits[0].params()
    for f in fits[1:]:
        params = params.unionByName(f.params())
    com = [(k[0], float(f["df"])) for fit in fits for k, f in fit.fits.items()]
    dfcom = wide.sparkSession.createDataFrame(com, "scenario string, dfcom double").groupBy("scenario").agg(
        F.min("dfcom").alias("dfcom"))
    return inference(pool(params.join(dfcom, "scenario"), ["scenario"], "barnard_rubin", "dfcom"))


def scenario_names(values=(0, 2, 4, 6, 8, 10), prefixes=("STD_Shift_", "PAT_Shift_")):
    return [f"{p}{s}" for p in prefixes for s in values]


def scenario_table(pooled: DataFrame, scenarios) -> DataFrame:
    """Term x scenario, cells `estimate (sd=se)`, in the given column order."""
    cells = pooled.select("term", "scenario", estimate_cell("estimate", "std_error").alias("cell"))
    return cells.groupBy("term").pivot("scenario", list(scenarios)).agg(F.first("cell"))


def robustness_table(mar: DataFrame, shifted: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per term: whether the conclusion at `alpha` is the same with and without the shift."""
    a = mar.select("term", F.col("estimate").alias("estimate_mar"), F.col("p_value").alias("p_mar"))
    b = shifted.select("term", F.col("estimate").alias("estimate_shifted"), F.col("p_value").alias("p_shifted"))
    same = (F.col("p_mar") < alpha) == (F.col("p_shifted") < alpha)
    return a.join(b, "term").withColumn("verdict", F.when(same, "robust").otherwise("sensitive"))
