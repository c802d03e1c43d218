"""Inverse-probability-of-observation weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitframe.functions.scalar import binarize, inverse_probability, observed
from visitframe.operators.logistic import LogitFit, fit_visit_logits
from visitframe.operators.mechanism import observation_model, response_spec
from visitframe.operators.reshape import complete_cases, wide_to_long
from visitframe.spec import PANEL, PanelSpec


def weight_cells(wide: DataFrame, mode: str = "cumulative", model: LogitFit | None = None, spec: PanelSpec = PANEL,
                 cut: float = 10.0, prev: str = "CDRSB_PREV") -> DataFrame:
    """The wide table with `_weights`: per visit that has a weight a struct (time, prob_obs, W), all inside the row.

    cumulative: product over visits so far of 1/P(observed); a missing or zero probability leaves it as is.
    point_shifted: 1 at the first visit, else 1/P of this visit. Both judge P at the previous visit; visits that follow a gap have none.
    visit: 1/P from a model of being observed at the same visit given the previous response.
    """
    family, rows = spec.families[0], []
    if mode == "visit":
        logit = response_spec(cut=cut, spec=spec)
        model = model or fit_visit_logits(wide, {"same": logit}, spec)["same"]
        for t in spec.visits:
            p = model.probability({spec.time: F.lit(t), "prev_resp": logit.varying["prev_resp"][t]})
            rows.append(F.struct((F.col(f"{family}{t}").isNotNull()).alias("keep"), F.lit(t).alias(spec.time), p.cast("double").alias("prob_obs")))
    else:
        model = model or observation_model(wide, spec=spec)
        at_risk = F.lit(True)
        for i, t in enumerate(spec.visits):
            full = F.lit(True)
            for f in spec.families:
                full = full & F.col(f"{f}{t}").isNotNull()
            p = F.lit(None).cast("double")
            if i:
                s = spec.visits[i - 1]
                p = F.when(at_risk & F.col(f"{family}{s}").isNotNull(), model.probability({spec.time: F.lit(s), prev: F.col(f"{family}{s}")}))
                at_risk = at_risk & F.col(f"{family}{t}").isNotNull()
            rows.append(F.struct(full.alias("keep"), F.lit(t).alias(spec.time), p.alias("prob_obs")))
    seen = wide.withColumn("_weights", F.filter(F.array(*rows), lambda r: r["keep"]))

    def one(r, w):
        return F.struct(r[spec.time].alias(spec.time), r["prob_obs"].alias("prob_obs"), w.cast("double").alias("W"))

    if mode == "cumulative":
        empty = F.array().cast(f"array<struct<{spec.time}:int,prob_obs:double,W:double>>")
        upto = F.aggregate("_weights", F.struct(F.lit(1.0).alias("w"), empty.alias("out")), lambda a, r: F.struct(
            (a["w"] * F.coalesce(inverse_probability(r["prob_obs"]), F.lit(1.0))).alias("w"),
            F.concat(a["out"], F.array(one(r, a["w"] * F.coalesce(inverse_probability(r["prob_obs"]), F.lit(1.0))))).alias("out")))
        return seen.withColumn("_weights", upto["out"])
    if mode == "point_shifted":
        return seen.withColumn("_weights", F.transform("_weights", lambda r: one(r, F.when(r[spec.time] == spec.visits[0], 1.0).otherwise(inverse_probability(r["prob_obs"])))))
    return seen.withColumn("_weights", F.transform("_weights", lambda r: one(r, inverse_probability(r["prob_obs"]))))


def ipw(wide: DataFrame, mode: str = "cumulative", model: LogitFit | None = None, spec: PanelSpec = PANEL,
        cut: float = 10.0) -> DataFrame:
    """Weights per subject and observed visit, modes as in weight_cells(); no row leaves its place."""
    return weight_cells(wide, mode, model, spec, cut).select(spec.id, F.inline("_weights"))


def with_weights(wide: DataFrame, mode: str = "cumulative", model: LogitFit | None = None, spec: PanelSpec = PANEL, cut: float = 10.0, prefix: str = "W") -> DataFrame:
    """The same as visit columns W0.. of the wide table, the form the weighted fit reads."""
    found = weight_cells(wide, mode, model, spec, cut)

    def at(t):
        mine = F.filter("_weights", lambda r: r[spec.time] == t)
        return F.when(F.size(mine) > 0, F.element_at(mine, 1)["W"])

    return found.withColumns({f"{prefix}{t}": at(t) for t in spec.visits}).drop("_weights")


def response_rows(wide: DataFrame, spec: PanelSpec = PANEL, cut: float = 10.0) -> DataFrame:
    """Every visit with R, the 0/1 outcome and the previous response (0 at the first visit), from the wide row alone."""
    family, keep = spec.families[0], [c for c in wide.columns if c not in set(spec.all_visit_columns())]
    before = response_spec(cut=cut, spec=spec).varying["prev_resp"]
    rows = [F.struct(F.lit(t).alias(spec.time), *[F.col(f"{f}{t}").alias(f) for f in spec.families], observed(f"{family}{t}").alias("R"),
                     binarize(f"{family}{t}", cut).alias("cdrsb_cat"), before[t].alias("prev_resp")) for t in spec.visits]
    return wide.select(*keep, F.inline(F.array(*rows)))


def weighted_panel(wide: DataFrame, weights: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Weights joined to the long complete-case panel on (id, time)."""
    long = complete_cases(wide_to_long(wide, spec), spec.families)
    return long.join(weights, [spec.id, spec.time], "left")
