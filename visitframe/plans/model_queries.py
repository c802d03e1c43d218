"""Named analyses that test, weight, impute, fit, pool and compare."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from visitframe.functions import scalar
from visitframe.functions.cluster import settle
from visitframe.operators import (aggregates, curves, gee, glmm, impute, linear, logistic, mechanism, pool, profile,
                                  reshape, sensitivity, weights, windows)
from visitframe.operators.design import Design
from visitframe.operators.reshape import class_levels
from visitframe.plans.queries import BPRS, CDRSB, FAMILIES, V, _region_params, model_base, query, rnd
from visitframe.sources.panel import customer_panel, stage
from visitframe.spec import IMPUTATIONS, MODELS, PANEL, ImputationSpec, ModelSpec, mains

BY_VISIT = tuple(f"VISIT{t}_" for t in V)
SATURATED = ModelSpec("saturated", "gee", "cdrsb", mains(*BY_VISIT), cut=10.0)
LINE = ModelSpec("line", "lmm", "bprs", mains("TIME"))
EFFECT_LINE = ModelSpec("effect_line", "lmm", "score", mains("TIME"))

# Each visit regressed on the one before it, estimates plugged in: the imputation SQL can repeat.
PLUGIN = ImputationSpec("plugin", "monotone", tuple(BPRS), m=4, seed=7, proper=False,
                        predictors={b: (a,) for a, b in zip(BPRS, BPRS[1:])})
SHIFTS = (0, 4, 8)


def _visit_dummies(wide):
    """One indicator family per visit, so that a model with them has one free level per visit."""
    return wide.withColumns({f"VISIT{k}_{t}": F.lit(1.0 if k == t else 0.0) for k in V for t in V})


def _saturated_design():
    return Design(SATURATED.terms, varying=BY_VISIT, intercept=False)


def _complete(wide):
    return wide.dropna(subset=CDRSB)


def _with_effects(wide):
    """Complete subjects with a score that carries known subject-level intercepts and slopes."""
    a, b = 6.0 * (F.col("PATID") % 7 - 3), 2.0 * (F.col("PATID") % 5 - 2)
    return _complete(wide).withColumns({f"score{t}": F.col(f"bprs{t}") + a + b * t for t in V})


# ---- dropout mechanism and weights -----------------------------------------------------------


@query
def dropout_model(spark, sf):
    return mechanism.dropout_model(model_base(spark, sf)).params()


@query
def dropout_model_one_factor(spark, sf):
    """Missing on one 0/1 covariate, where the fit has a closed form."""
    fit = mechanism.dropout_model(customer_panel(spark, sf), mains("SEX"), ())
    return rnd(fit.params(), "estimate", "std_error", "z_value", d=4).drop("p_value")


@query
def dropout_model_score(spark, sf):
    """The score of each term at the fitted dropout model, summed over long rows by Spark: zero."""
    base = model_base(spark, sf)
    fit = mechanism.dropout_model(base)
    return rnd(fit.score(windows.dropout_rows(base), "is_missing").withColumn("n_rows", F.lit(fit.n_rows)), "score", d=3)


@query
def observation_model_score(spark, sf):
    """The same for the model of the next visit, on the person-period rows."""
    base = model_base(spark, sf)
    fit = mechanism.observation_model(base)
    return rnd(fit.score(windows.person_period(base), "R").withColumn("n_rows", F.lit(fit.n_rows)), "score", d=3)


@query
def observation_model(spark, sf):
    return mechanism.observation_model(model_base(spark, sf)).params()


@query
def observation_probability_by_sex(spark, sf):
    rows = windows.person_period(customer_panel(spark, sf), keep=["PATID", "SEX"])
    fit = logistic.fit_logit(rows, "R", mains("SEX"), ("SEX",), "last", "effect")
    return rnd(rows.select("PATID", "TIME", "R", fit.probability().alias("prob_obs")), "prob_obs", d=4)


@query
def little_mcar(spark, sf):
    """Little's test of each outcome family over all seven visits."""
    wide = stage(customer_panel(spark, sf))
    out = None
    for f in FAMILIES:
        t = mechanism.little_mcar_test(wide, PANEL.visit_columns(f)).withColumn("family", F.lit(f))
        out = t if out is None else out.unionByName(t)
    return out


@query
def little_mcar_two_visits(spark, sf):
    """Two visits with monotone gaps, where the likelihood estimate has a closed form."""
    out = mechanism.little_mcar_test(customer_panel(spark, sf, True), ["bprs0", "bprs1"])
    return rnd(out, "statistic", d=4).drop("p_value")


@query
def ipw_cumulative(spark, sf):
    return rnd(weights.ipw(stage(customer_panel(spark, sf))), "prob_obs", "W", d=6)


def _sex_model(wide):
    return mechanism.observation_model(wide, mains("SEX"), ("SEX",))


@query
def ipw_cumulative_by_sex(spark, sf):
    wide = customer_panel(spark, sf)
    return rnd(weights.ipw(wide, "cumulative", _sex_model(wide)), "prob_obs", "W", d=4)


@query
def ipw_point_shifted_by_sex(spark, sf):
    wide = customer_panel(spark, sf)
    return rnd(weights.ipw(wide, "point_shifted", _sex_model(wide)), "prob_obs", "W", d=4)


def _sex_response(wide):
    return logistic.fit_visit_logits(wide, {"R": mechanism.response_spec(mains("SEX"), reference="first", coding="ref")})["R"]


def _same_visit_by_sex(wide):
    return weights.ipw(wide, "visit", _sex_response(wide))


@query
def ipw_visit_by_sex(spark, sf):
    return rnd(_same_visit_by_sex(customer_panel(spark, sf)), "prob_obs", "W", d=4)


@query
def ipw_visit(spark, sf):
    return rnd(weights.ipw(stage(customer_panel(spark, sf)), "visit"), "prob_obs", "W", d=6)


@query
def weights_joined_to_panel(spark, sf):
    wide = customer_panel(spark, sf)
    w = weights.ipw(wide, "cumulative", _sex_model(wide)).drop("prob_obs")
    out = weights.weighted_panel(wide, w).select("PATID", "TIME", "cdrsb", "W")
    return rnd(rnd(out, "cdrsb"), "W", d=4)


# ---- imputation ------------------------------------------------------------------------------


def _values(spark, sf, name, monotone=False, **changes):
    base = model_base(spark, sf, monotone)
    spec = IMPUTATIONS[name].variant(**changes) if changes else IMPUTATIONS[name]
    filled = impute.impute(base, spec)
    cols = [v for v in spec.variables if v[-1].isdigit()]
    return filled.complete(["PATID", *dict.fromkeys(cols)])


@query
def impute_fcs(spark, sf):
    return _values(spark, sf, "fcs_bprs")


@query
def impute_fcs_full(spark, sf):
    return _values(spark, sf, "fcs_bprs_full")


@query
def impute_fcs_default(spark, sf):
    return _values(spark, sf, "fcs_bprs_default")


@query
def impute_fcs_shifted_in_chain(spark, sf):
    return _values(spark, sf, "fcs_bprs_mnar")


@query
def impute_fcs_cdrsb(spark, sf):
    return _values(spark, sf, "fcs_cdrsb")


@query
def impute_monotone(spark, sf):
    return _values(spark, sf, "monotone_glmm", monotone=True)


@query
def impute_mvn(spark, sf):
    return _values(spark, sf, "mvn_gee")


@query
def impute_mvn_cdrsb(spark, sf):
    return _values(spark, sf, "mvn_cdrsb")


@query
def impute_mvn_all(spark, sf):
    return _values(spark, sf, "mvn_all")


@query
def impute_norm_shifted(spark, sf):
    spec = sensitivity.shifts(IMPUTATIONS["mice_shift"], (5,), "S")["S5"]
    return impute.impute(model_base(spark, sf), spec).complete(["PATID", *BPRS])


@query
def impute_past_only_patterns(spark, sf):
    return _values(spark, sf, "mice_ncmv")


@query
def impute_donor_matching(spark, sf):
    """Predictive mean matching of one family, one round of the chain."""
    return _values(spark, sf, "mice_whole_frame", m=3, iterations=1, variables=("SEX", "AGE", "ADL", *CDRSB[:4]),
                   categorical=("SEX",))


@query
def impute_class_variable(spark, sf):
    """A class column with gaps (every fifth subject) drawn from its class probabilities."""
    wide = customer_panel(spark, sf).withColumn("EDU", F.when(F.col("PATID") % 5 != 0, F.col("EDU")))
    spec = IMPUTATIONS["fcs_bprs"].variant(variables=("EDU", "SEX", "AGE", "bprs0", "bprs1"),
                                           categorical=("EDU", "SEX"), m=2, iterations=1)
    filled = impute.impute(stage(wide), spec).complete(["PATID", "EDU", "bprs0", "bprs1"])
    return filled


@query
def audit_fcs(spark, sf):
    base = model_base(spark, sf)
    return impute.imputation_audit(impute.impute(base, IMPUTATIONS["fcs_bprs"]).complete(["PATID", *BPRS]), base, BPRS)


@query
def audit_mvn(spark, sf):
    base = model_base(spark, sf)
    done = impute.impute(base, IMPUTATIONS["mvn_gee"]).complete(["PATID", *CDRSB])
    return impute.imputation_audit(done, base, CDRSB)


def _with_gaps(base, every):
    return base.withColumns({c: F.when(F.col("PATID") % k != 0, F.col(c)) for c, k in every.items()})


@query
def audit_whole_number_gaps(spark, sf):
    """Gaps in columns of whole numbers are filled by every method."""
    base, out = model_base(spark, sf), None
    for name, gaps in (("mvn_all", {"JOB": 5, "ADL": 7, "WZC": 6}), ("fcs_bprs_mnar", {"JOB": 5, "ADL": 7, "WZC": 6}), ("monotone_glmm", {"ADL": 7})):
        wide = stage(_with_gaps(base, gaps))
        spec = IMPUTATIONS[name].variant(variables=("SEX", "AGE", "BMI", *gaps), categorical=())
        done = impute.imputation_audit(impute.impute(wide, spec).complete(["PATID", *gaps]), wide, list(gaps))
        done = done.withColumn("method", F.lit(spec.method))
        out = done if out is None else out.unionByName(done)
    return out


@query
def audit_many_patterns(spark, sf):
    """Multivariate normal imputation where each of the 28 visit cells has gaps of its own, so nearly every subject is a pattern."""
    base = customer_panel(spark, sf)
    cells = PANEL.all_visit_columns()
    holes = {c: F.when((F.col("PATID") * (2 * i + 3) + i * i) % (7 + i) != 0, F.col(c)) for i, c in enumerate(cells)}
    wide = stage(base.withColumns(holes))
    spec = ImputationSpec("mvn_many_patterns", "mvn", ("SEX", "AGE", "BMI", *cells), m=2, iterations=5)
    return impute.imputation_audit(impute.impute(wide, spec).complete(["PATID", *cells]), wide, cells)


@query
def audit_many_patterns_chained(spark, sf):
    """Chained regressions of two scenarios where nearly every subject is a pattern of its own."""
    base = customer_panel(spark, sf)
    holes = {c: F.when((F.col("PATID") * (2 * i + 3) + i * i) % (7 + i) != 0, F.col(c)) for i, c in enumerate(BPRS)}
    wide = stage(base.select("PATID", "SEX", "AGE", "BMI", *CDRSB, *BPRS).withColumns(holes))
    spec = ImputationSpec("fcs_many_patterns", "fcs", ("SEX", "AGE", "BMI", *CDRSB, *BPRS), m=2, iterations=3)
    scen = {"PLAIN": spec, "UP": spec.variant(delta={c: 5.0 for c in BPRS})}
    done = impute.impute(wide, spec, scen).complete(["PATID", *BPRS])
    out = [impute.imputation_audit(done.filter(F.col("scenario") == n), wide, BPRS).withColumn("scenario", F.lit(n)) for n in scen]
    return out[0].unionByName(out[1])


@query
def audit_past_only(spark, sf):
    """Chains that see earlier visits and the dropout pattern only, and normal draws of every visit."""
    base = model_base(spark, sf)
    out = None
    for name in ("mice_ncmv", "mice_shift"):
        done = impute.impute(base, IMPUTATIONS[name].variant(m=5)).complete(["PATID", *BPRS])
        t = impute.imputation_audit(done, base, BPRS).withColumn("method", F.lit(name))
        out = t if out is None else out.unionByName(t)
    return out


@query
def audit_catalogue(spark, sf):
    """The catalogue's chained specifications with all their copies: what each filled, left and changed in its visits."""
    base, out = model_base(spark, sf), None
    for name, family in (("fcs_bprs_full", "bprs"), ("fcs_bprs_default", "bprs"), ("fcs_bprs_mnar", "bprs"), ("fcs_cdrsb", "cdrsb")):
        cells = PANEL.visit_columns(family)
        t = impute.imputation_audit(impute.impute(base, IMPUTATIONS[name]).complete(["PATID", *cells]), base, cells).withColumn("spec", F.lit(name))
        out = t if out is None else out.unionByName(t)
    return out


@query
def audit_monotone(spark, sf):
    """The monotone method on the interleaved visits of the monotone panel."""
    base = stage(customer_panel(spark, sf, True))
    return impute.imputation_audit(impute.impute(base, IMPUTATIONS["monotone_glmm"]).complete(["PATID", *CDRSB, *PANEL.visit_columns("taupet")]), base, [*CDRSB, *PANEL.visit_columns("taupet")])


@query
def audit_class_variables(spark, sf):
    """Class columns with gaps in the full specification of the primary imputation: what is filled, left and changed."""
    base = customer_panel(spark, sf)
    gaps = {"EDU": 5, "WZC": 7}
    wide = stage(_with_gaps(base, gaps))
    spec = IMPUTATIONS["fcs_bprs"].variant(m=5, iterations=3)
    done = impute.impute(wide, spec).complete(["PATID", *gaps, *BPRS])
    was = wide.select("PATID", *[F.col(c).alias(f"was_{c}") for c in (*gaps, *BPRS)])
    both = done.join(was, "PATID")
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).isNull().alias("empty"), F.col(f"was_{c}").isNull().alias("gap"),
                              (F.col(c) != F.col(f"was_{c}")).alias("other")) for c in (*gaps, *BPRS)])
    return both.select("imp", F.inline(rows)).groupBy("imp", "variable").agg(
        F.count("*").alias("n"), F.count_if(F.col("gap") & ~F.col("empty")).alias("n_imputed"), F.count_if("empty").alias("n_left"),
        F.count_if(F.coalesce("other", F.lit(False))).alias("n_changed"))


@query
def donors_of_whole_frame(spark, sf):
    """Donor matching of every column with gaps on the whole frame, shifts of the last visits beside it: filled cells, and cells whose value no subject has."""
    base = model_base(spark, sf)
    spec = IMPUTATIONS["mice_whole_frame"].variant(m=1, iterations=1)
    cells = [c for c in PANEL.all_visit_columns() if spec.columns.get(c) == "pmm"]
    done = impute.impute(base, spec, sensitivity.shifts(spec, (0, 4), "S")).complete(["PATID", *cells])
    long = done.select("scenario", F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("v")) for c in cells])))
    known = base.select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("v")) for c in cells]))).dropna().distinct()
    strange = long.join(known.withColumn("known", F.lit(1)), ["variable", "v"], "left")
    return strange.groupBy("scenario", "variable").agg(F.count("v").alias("n"), F.count_if(F.col("known").isNull()).alias("n_strange"))


@query
def shift_after_imputation_moves(spark, sf):
    """What a shift after imputation moves: every gap by the shift, nothing else."""
    base, filled = _plugin(spark, sf)
    done = filled.complete()
    moved = impute.delta_adjust(done, base, BPRS[1:], 5.0).select("imp", "PATID", *[F.col(c).alias(f"new_{c}") for c in BPRS])
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), (F.col(f"new_{c}") - F.col(c)).alias("move")) for c in BPRS])
    found = done.join(moved, ["imp", "PATID"]).select("imp", F.inline(rows)).groupBy("imp", "variable").agg(F.count("*").alias("n"), F.count_if(F.abs("move") > 1e-9).alias("n_moved"), F.sum("move").alias("moved"))
    return rnd(found, "moved", d=4)


@query
def imputed_long_counts(spark, sf):
    """Visits left in the long table of imputed copies once empty ones go: all."""
    base, filled = _plugin(spark, sf)
    long = reshape.wide_to_long(filled.complete(), families=("bprs",), keep=["imp", "PATID"])
    return long.filter(F.col("bprs").isNotNull()).groupBy("imp", "TIME").agg(F.count("*").alias("n"))


@query
def scenario_rounding(spark, sf):
    """A scenario's own rounding and seed hold for it alone."""
    base = stage(customer_panel(spark, sf, True).select("PATID", *BPRS))
    scen = {"PLAIN": PLUGIN, "ROUNDED": PLUGIN.variant(round_to=1.0, seed=8)}
    out = impute.impute(base, PLUGIN, scen).complete()
    was = base.select("PATID", *[F.col(c).isNull().alias(f"gap_{c}") for c in BPRS])
    whole = sum(((F.col(f"gap_{c}") & (F.col(c) != F.round(c))).cast("int") for c in BPRS), F.lit(0))
    found = out.join(was, "PATID").groupBy("scenario").agg(F.count("*").alias("n"), (F.sum(whole) == 0).alias("all_round"))
    return found


@query
def audit_donor_matching(spark, sf):
    base = model_base(spark, sf)
    spec = IMPUTATIONS["mice_whole_frame"].variant(m=2, iterations=1, variables=("SEX", "AGE", *CDRSB[:3]),
                                                   categorical=("SEX",))
    return impute.imputation_audit(impute.impute(base, spec).complete(["PATID", *CDRSB[:3]]), base, CDRSB[:3])


@query
def donor_values_are_observed(spark, sf):
    """Imputed values of donor matching that no observed row holds: none."""
    base = model_base(spark, sf)
    spec = IMPUTATIONS["mice_whole_frame"].variant(m=2, iterations=1, variables=("SEX", "AGE", *CDRSB[:2]),
                                                   categorical=("SEX",))
    done = impute.impute(base, spec).complete(["PATID", "cdrsb1"])
    known = base.select(F.col("cdrsb1").alias("v")).where("v IS NOT NULL").distinct()
    strange = done.join(known, F.col("cdrsb1") == F.col("v"), "left_anti")
    return done.groupBy("imp").agg(F.count("*").alias("n")).join(
        strange.groupBy("imp").agg(F.count("*").alias("n_strange")), "imp", "left").fillna(0, ["n_strange"])


def _plugin(spark, sf, scenarios=None):
    base = stage(customer_panel(spark, sf, True).select("PATID", *BPRS))
    return base, impute.impute(base, PLUGIN, scenarios)


def _chain_shifts():
    return {f"SHIFT_{s}": PLUGIN.variant(delta={c: float(s) for c in BPRS[1:]}) for s in SHIFTS}


@query
def impute_monotone_plugin(spark, sf):
    _, filled = _plugin(spark, sf)
    return rnd(filled.complete(), *BPRS)


@query
def impute_plugin_rounded(spark, sf):
    base = customer_panel(spark, sf, True).select("PATID", *BPRS)
    out = impute.impute(stage(base), PLUGIN.variant(round_to=1.0)).complete()
    was = base.select("PATID", *[F.col(c).isNull().alias(f"gap_{c}") for c in BPRS])
    wrong = F.lit(0)
    for c in BPRS:
        wrong = wrong + (F.col(f"gap_{c}") & (F.col(c) != F.round(c))).cast("int")
    return out.join(was, "PATID").groupBy("imp").agg(F.count("*").alias("n"), F.sum(wrong).alias("n_unrounded"))


@query
def shift_inside_chain(spark, sf):
    _, filled = _plugin(spark, sf, _chain_shifts())
    return rnd(filled.complete(), *BPRS)


@query
def shift_after_imputation(spark, sf):
    base, filled = _plugin(spark, sf)
    return rnd(impute.delta_adjust(filled.complete(), base, BPRS[1:], 5.0), *BPRS)


@query
def imputed_long_rows(spark, sf):
    base, filled = _plugin(spark, sf)
    long = reshape.wide_to_long(filled.complete(), families=("bprs",), keep=["imp", "PATID"])
    return rnd(long.filter(F.col("bprs").isNotNull()), "bprs")


@query
def imputed_proportion(spark, sf):
    _, filled = _plugin(spark, sf)
    return rnd(profile.observed_proportion(filled.complete(), "bprs", 25.0, "prop_imputed"), "prop_imputed")


# ---- linear models ---------------------------------------------------------------------------


@query
def ols_line(spark, sf):
    return rnd(linear.fit_ols(customer_panel(spark, sf), LINE).params().select("term", "estimate", "std_error", "t_value"),
               "estimate", "std_error", "t_value")


@query
def ols_full(spark, sf):
    return linear.fit_ols(model_base(spark, sf), MODELS["lme_primary"]).params()


@query
def ols_residuals(spark, sf):
    wide = customer_panel(spark, sf)
    long = reshape.model_panel(wide)
    out = linear.linear_residuals(long, linear.fit_ols(wide, LINE), "bprs")
    return rnd(out.select("PATID", "TIME", "residual"), "residual")


@query
def ols_residuals_primary(spark, sf):
    """Residuals of the primary model by least squares: their sums, by visit and with each subject-level number, over the visits that the model can use."""
    wide = stage(customer_panel(spark, sf))
    left = linear.visit_residuals(wide, linear.fit_ols(wide, MODELS["lme_primary"]))
    both = left.join(wide.select("PATID", "AGE", "BMI", "ADL", "cdrsb0"), "PATID")
    sums = {"Intercept": F.lit(1.0), "TIME": F.col("TIME"), **{c: F.col(c) for c in ("AGE", "BMI", "ADL", "cdrsb0")}, "TIME*cdrsb0": F.col("TIME") * F.col("cdrsb0")}
    one = both.agg(F.count("*").alias("n"), *[F.sum(F.col("residual") * e).alias(f"s{i}") for i, e in enumerate(sums.values())])
    rows = F.array(*[F.struct(F.lit(n).alias("term"), F.col(f"s{i}").alias("residual_sum")) for i, n in enumerate(sums)])
    return rnd(one.select("n", F.inline(rows)), "residual_sum", d=3)


@query
def empirical_variance(spark, sf):
    wide = customer_panel(spark, sf)
    long = linear.linear_residuals(reshape.model_panel(wide), linear.fit_ols(wide, LINE), "bprs")
    return rnd(aggregates.empirical_variance(long), "empirical_variance")


@query
def lmm_balanced(spark, sf):
    """Complete subjects with known subject effects: REML has a closed form here."""
    fit = linear.fit_lmm(_with_effects(customer_panel(spark, sf)), EFFECT_LINE)
    return rnd(fit.params().select("term", "estimate", "std_error"), "estimate", "std_error", d=3)


@query
def lmm_balanced_covariance(spark, sf):
    fit = linear.fit_lmm(_with_effects(customer_panel(spark, sf)), EFFECT_LINE)
    return rnd(fit.cov_params().select("cov_parm", "estimate"), "estimate", d=2)


@query
def lmm_balanced_effects(spark, sf):
    wide = stage(_with_effects(customer_panel(spark, sf)))
    out = linear.predict_lmm(wide, linear.fit_lmm(wide, EFFECT_LINE)).filter("TIME = 0")
    return rnd(out.select("PATID", "intercept_effect", "slope_effect"), "intercept_effect", "slope_effect", d=2)


def _fit(spark, sf, name, table="params"):
    fit = linear.fit_lmm(model_base(spark, sf), MODELS[name])
    return getattr(fit, table)()


@query
def lmm_primary(spark, sf):
    return _fit(spark, sf, "lme_primary")


@query
def lmm_primary_covariance(spark, sf):
    return _fit(spark, sf, "lme_primary", "cov_params")


def _mean_scores(rows, base, gap, columns):
    """term, n, score: mean over rows (PATID, TIME, ...) of gap x column, for the columns of subjects and their products with TIME."""
    both = rows.join(base.select("PATID", *columns), "PATID")
    terms = {"Intercept": F.lit(1.0), "TIME": F.col("TIME"), **{c: F.col(c) for c in columns}, **{f"TIME*{c}": F.col("TIME") * F.col(c) for c in columns}}
    one = both.agg(F.count("*").alias("n"), *[F.avg(gap * e).alias(f"s{i}") for i, e in enumerate(terms.values())])
    return rnd(one.select("n", F.inline(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"s{i}").alias("score")) for i, t in enumerate(terms)]))), "score", d=4)


def _mixed_equations(spark, sf, name, columns):
    """At the solution the residuals from fixed part and subject effects are orthogonal to the fixed terms."""
    base = model_base(spark, sf)
    fitted = linear.predict_lmm(base, linear.fit_lmm(base, MODELS[name]))
    return _mean_scores(fitted, base, F.col("observed") - F.col("predicted"), columns)


@query
def lmm_primary_equations(spark, sf):
    """The mixed-model equations of the primary model, summed over visits by Spark: zero."""
    return _mixed_equations(spark, sf, "lme_primary", ["AGE", "cdrsb0"])


@query
def lmm_shift_equations(spark, sf):
    """The same for the model of the sensitivity grid."""
    return _mixed_equations(spark, sf, "lmer_shift", ["AGE_STD", "ADL_NUM", "cdrsb0"])


@query
def lmm_effect_equations(spark, sf):
    """The subjects' half of the mixed-model equations: residual sums times the effects' covariance, which may be singular, are the effects times residual variance; the largest gap of a subject."""
    base = model_base(spark, sf)
    fit = linear.fit_lmm(base, MODELS["lme_primary"])
    d11, d12, d22, s2 = (float(x) for x in next(iter(fit.fits.values()))["cov"])
    rows = linear.predict_lmm(base, fit).withColumn("gap", F.col("observed") - F.col("predicted"))
    by = rows.groupBy("PATID").agg(F.sum("gap").alias("one"), F.sum(F.col("gap") * F.col("TIME")).alias("time"), F.first("intercept_effect").alias("b0"), F.first("slope_effect").alias("b1"))
    left0 = d11 * F.col("one") + d12 * F.col("time") - s2 * F.col("b0")
    left1 = d12 * F.col("one") + d22 * F.col("time") - s2 * F.col("b1")
    return rnd(by.agg(F.count("*").alias("n"), F.max(F.abs(left0)).alias("intercept_gap"), F.max(F.abs(left1)).alias("slope_gap")), "intercept_gap", "slope_gap", d=4)


@query
def lmm_predictions(spark, sf):
    base = model_base(spark, sf)
    return linear.predict_lmm(base, linear.fit_lmm(base, MODELS["lme_primary"]))


@query
def lmm_catalogue(spark, sf):
    """Every other mixed-model specification on the observed panel."""
    base, out = model_base(spark, sf), None
    for n in ("lme_full", "lme_all_by_time", "lme_reduced", "lme_small", "lmer_shift", "lmer_shift_raw"):
        t = linear.fit_lmm(base, MODELS[n]).params().withColumn("model", F.lit(n))
        out = t if out is None else out.unionByName(t)
    return out


@query
def lmm_influence(spark, sf):
    base = model_base(spark, sf)
    return linear.influence(base, linear.fit_lmm(base, MODELS["lme_small"]))


@query
def lmm_per_imputation_pooled(spark, sf):
    base = model_base(spark, sf)
    fit = linear.fit_lmm(impute.impute(base, IMPUTATIONS["fcs_bprs"]), MODELS["lme_primary"])
    return pool.inference(pool.pool(fit.params()))


# ---- binary panel models ---------------------------------------------------------------------


@query
def gee_complete_saturated(spark, sf):
    """Complete subjects, one level per visit: estimates and robust errors have closed forms."""
    wide = _visit_dummies(_complete(customer_panel(spark, sf)))
    fit = gee.fit_gee(wide, SATURATED, design=_saturated_design())
    return rnd(fit.params().select("term", "estimate", "std_error"), "estimate", "std_error", d=4)


@query
def gee_complete_correlation(spark, sf):
    wide = _visit_dummies(_complete(customer_panel(spark, sf)))
    return rnd(gee.fit_gee(wide, SATURATED, design=_saturated_design()).working_correlation(), "corr", d=4)


@query
def gee_weighted_saturated(spark, sf):
    """Weighted estimating equations under independence, one level per visit."""
    wide = customer_panel(spark, sf)
    wide = weights.with_weights(_visit_dummies(wide), "visit", _sex_response(wide))
    fit = gee.fit_gee(wide, SATURATED, weight="W", design=_saturated_design(), independence=True)
    return rnd(fit.params().select("term", "estimate", "std_error"), "estimate", "std_error", d=4)


@query
def gee_reduced(spark, sf):
    return gee.fit_gee(model_base(spark, sf), MODELS["gee_reduced"]).params()


@query
def gee_weighted(spark, sf):
    base = model_base(spark, sf)
    wide = stage(weights.with_weights(base))
    return gee.fit_gee(wide, MODELS["gee_reduced"], weight="W").params()


@query
def gee_independence_score(spark, sf):
    """Predictions under independence: responses less probabilities are orthogonal to the terms."""
    base = model_base(spark, sf)
    rows = gee.predict_gee(base, gee.fit_gee(base, MODELS["gee_reduced"], independence=True))
    return _mean_scores(rows, base, F.col("observed") - F.col("pred_prob"), ["ADL", "BMI_STD"])


@query
def gee_predictions(spark, sf):
    base = model_base(spark, sf)
    return gee.predict_gee(base, gee.fit_gee(base, MODELS["gee_reduced"]))


def _gee_imputed(spark, sf, name):
    """Impute, standardise over all stacked rows, fit per imputation. Each pass draws the copies, so their stack never exists as rows."""
    panel, visits = impute.impute(stage(customer_panel(spark, sf)), IMPUTATIONS["mvn_gee"]), PANEL.visit_columns
    done = panel.complete(["AGE", "BMI", *visits("taupet"), *visits("abpet")])
    long = reshape.wide_to_long(done, families=("abpet", "taupet"), keep=["AGE", "BMI"])
    stats = settle(aggregates.mean_sd(long, ["AGE", "BMI", "abpet", "taupet"]))
    out = aggregates.apply_zscore(panel.base, stats.select("mean_AGE", "sd_AGE", "mean_BMI", "sd_BMI"), ["AGE", "BMI"])
    for f in ("abpet", "taupet"):
        out = aggregates.zscore_visits(out, stats, f, V)
    of = {"AGE_STD": ("AGE", "AGE"), "BMI_STD": ("BMI", "BMI")} | {f"{f.upper()}_STD{t}": (f"{f}{t}", f) for f in ("abpet", "taupet") for t in V}
    one = {k: np.nan if v is None else v for k, v in stats.first().asDict().items()}
    scales = {new: (old, one[f"mean_{c}"], one[f"sd_{c}"]) for new, (old, c) in of.items()}
    design = Design.of(out, MODELS[name])
    if drawn := sorted(set(design.levels) & panel.gaps):
        design = Design(MODELS[name].terms, design.levels | class_levels(panel.complete(drawn), drawn), MODELS[name].reference, varying=design.varying)
    return panel.complete(["PATID", *CDRSB]), gee.fit_gee(panel.over(out), MODELS[name], design=design, scales=scales)


@query
def gee_full_imputed_pooled(spark, sf):
    return pool.inference(pool.pool(_gee_imputed(spark, sf, "gee_full_quadratic")[1].params()))


@query
def gee_full_covariance_pooled(spark, sf):
    fit = _gee_imputed(spark, sf, "gee_full_linear")[1]
    return pool.pool_cov(fit.params(), fit.covariance())


@query
def gee_imputed_calibration(spark, sf):
    """Observed, imputed and predicted proportions on one time axis."""
    done, fit = _gee_imputed(spark, sf, "gee_full_quadratic")
    pooled = pool.pool(fit.params())
    curve = curves.prediction_curve(pooled, {"SEX[0]": 1.0, "ADL": 10.0})
    observed = profile.observed_proportion(customer_panel(spark, sf))
    return curves.calibration_table(observed, profile.observed_proportion(done, name="prop_imputed"), curve)


@query
def glmm_pql(spark, sf):
    return glmm.fit_pql(model_base(spark, sf), MODELS["glmm_primary"]).params()


@query
def glmm_pql_score(spark, sf):
    """At the pseudo-likelihood solution responses less probabilities at the subjects' modes are orthogonal to the terms."""
    base = model_base(spark, sf)
    rows = glmm.predict_glmm(base, glmm.fit_pql(base, MODELS["glmm_primary"]))
    return _mean_scores(rows, base, F.col("observed") - F.col("pred_prob"), ["BMI_STD"])


@query
def glmm_quadrature(spark, sf):
    return glmm.fit_quad(model_base(spark, sf), MODELS["glmm_primary"]).params()


@query
def glmm_quadrature_full(spark, sf):
    return glmm.fit_quad(model_base(spark, sf), MODELS["glmm_full"]).params()


@query
def glmm_effects(spark, sf):
    base = model_base(spark, sf)
    return glmm.predict_glmm(base, glmm.fit_pql(base, MODELS["glmm_primary"]))


def _glmm_imputed(spark, sf):
    """Monotone regression imputation, complete-case biomarker scaling, pseudo-likelihood per imputation."""
    base = stage(customer_panel(spark, sf, True))
    done = impute.impute(base, IMPUTATIONS["monotone_glmm"]).complete(
        ["PATID", "SEX", "AGE", "BMI", "ADL", *CDRSB, *PANEL.visit_columns("taupet"), *PANEL.visit_columns("abpet")])
    out = aggregates.zscore(done, ["AGE", "BMI"], "reference", base)
    stats = aggregates.mean_sd(reshape.model_panel(base), ["abpet", "taupet"])
    for f in ("abpet", "taupet"):
        out = aggregates.zscore_visits(out, stats, f, V)
    return out, glmm.fit_pql(out, MODELS["glmm_full"], keys=("imp",))


@query
def glmm_imputed_pooled(spark, sf):
    return pool.inference(pool.pool(_glmm_imputed(spark, sf)[1].params()))


@query
def glmm_probability_and_variance_curve(spark, sf):
    done, fit = _glmm_imputed(spark, sf)
    return curves.binomial_variance_curve(curves.pooled_probability_curve(glmm.predict_glmm(done, fit)))


# ---- pooling, curves, sensitivity ------------------------------------------------------------


@query
def pool_rubin(spark, sf):
    out = pool.pool(_region_params(spark, sf))
    return rnd(out, "estimate", "within", "between", "total", "std_error", "df", "t_value", "rel_increase",
               "fraction_missing", d=5)


@query
def pool_rubin_inference(spark, sf):
    return pool.inference(pool.pool(_region_params(spark, sf)))


@query
def pool_rubin_p_values(spark, sf):
    """Two-sided p-values on Rubin's degrees of freedom."""
    return rnd(pool.inference(pool.pool(_region_params(spark, sf))).select("term", "p_value"), "p_value", d=5)


@query
def pool_barnard_rubin(spark, sf):
    out = pool.pool(_region_params(spark, sf), df="barnard_rubin", dfcom=1000)
    return rnd(out.select("term", "m", "estimate", "std_error", "df"), "estimate", "std_error", "df")


@query
def pool_wide_input(spark, sf):
    p = _region_params(spark, sf)
    est = reshape.long_to_wide(p, ["imp"], "term", "estimate", FAMILIES)
    se = reshape.long_to_wide(p, ["imp"], "term", "std_error", FAMILIES, prefix="SE_")
    out = pool.pool_wide(est.join(se, "imp"), FAMILIES)
    return rnd(out.select("term", "m", "estimate", "total", "df"), "estimate", "total", "df", d=5)


def _imputed_lines(spark, sf, scenarios=None):
    _, filled = _plugin(spark, sf, scenarios)
    stacked = filled.complete()
    return linear.fit_ols(stacked, LINE, keys=("scenario", "imp") if scenarios else ("imp",))


@query
def impute_fit_pool(spark, sf):
    """The whole path: impute, one line per imputation, Rubin's rules."""
    out = pool.pool(_imputed_lines(spark, sf).params())
    return rnd(out.select("term", "m", "estimate", "within", "between", "total", "std_error"),
               "estimate", "within", "between", "total", "std_error")


@query
def pool_covariance_matrices(spark, sf):
    fit = _imputed_lines(spark, sf)
    out = pool.pool_cov(fit.params(), fit.covariance())
    return rnd(out, "within", "between", "total", d=5)


def _region_components(spark, sf):
    """Variance components by region from moments of the first and last visit."""
    d = F.col("bprs6") - F.col("bprs0")
    one = customer_panel(spark, sf).groupBy((F.col("TRIAL") + 1).alias("imp")).agg(
        F.var_samp("bprs0").alias("a"), F.covar_samp("bprs0", d).alias("b"), F.var_samp(d).alias("c"),
        F.var_samp("bprs3").alias("e"))
    names = dict(zip(linear.COV_PARMS, "abce"))
    return one.select("imp", F.inline(F.array(*[F.struct(F.lit(n).alias("cov_parm"), F.col(c).alias("estimate"))
                                                for n, c in names.items()])))


@query
def pool_variance_components(spark, sf):
    out = pool.pool_variance_components(_region_components(spark, sf))
    return rnd(out, "avg", "between", "avg_plus_between")


@query
def variance_curves(spark, sf):
    pooled = pool.pool_variance_components(_region_components(spark, sf))
    a = curves.variance_function(pooled, "avg", "var_avg")
    b = curves.variance_function(pooled, "avg_plus_between", "var_rubin")
    return rnd(a.join(b, "time_tenths"), "var_avg", "var_rubin", d=3)


@query
def variance_comparison(spark, sf):
    """Empirical against fitted variance on one time axis."""
    wide = customer_panel(spark, sf)
    long = linear.linear_residuals(reshape.model_panel(wide), linear.fit_ols(wide, LINE), "bprs")
    pooled = pool.pool_variance_components(_region_components(spark, sf))
    out = curves.variance_comparison(aggregates.empirical_variance(long),
                                     curves.variance_function(pooled, "avg", "fitted_variance"))
    return rnd(out, "empirical_variance", "fitted_variance", d=3)


@query
def variance_comparison_imputed(spark, sf):
    """Empirical, complete-case and multiple-imputation variance curves of the primary mixed model."""
    base = model_base(spark, sf)
    primary = MODELS["lme_primary"]
    ols = linear.visit_residuals(base, linear.fit_ols(base, primary))
    fit = linear.fit_lmm(base, primary)
    mi = pool.pool_variance_components(
        linear.fit_lmm(impute.impute(base, IMPUTATIONS["fcs_bprs"]), primary).cov_params())
    return curves.variance_comparison(
        aggregates.empirical_variance(ols), curves.variance_function(fit.cov_params(), "estimate", "fitted_marginal_var"),
        curves.variance_function(mi, "avg", "var_avg"), curves.variance_function(mi, "avg_plus_between", "var_rubin"))


@query
def prediction_curve(spark, sf):
    """Probability over time from pooled coefficients at fixed covariates."""
    p = pool.pool(_region_params(spark, sf)).withColumn(
        "term", F.expr("CASE term WHEN 'bprs' THEN 'Intercept' WHEN 'cdrsb' THEN 'TIME' WHEN 'abpet' THEN 'TIME*TIME' "
                       "ELSE 'TIME*ADL' END"))
    return rnd(curves.prediction_curve(p, {"ADL": 10.0}), "pred_prob", d=6)


def _rows_as_predictions(wide):
    p = scalar.logistic(F.col("cdrsb") / 10.0 - 1.0)
    return reshape.model_panel(wide).select("TIME", p.alias("pred_prob"), (p - 0.1).alias("lower_ci"),
                                            (p + 0.1).alias("upper_ci"))


@query
def probability_and_variance_curve(spark, sf):
    rows = _rows_as_predictions(customer_panel(spark, sf))
    out = curves.binomial_variance_curve(curves.pooled_probability_curve(rows))
    return rnd(out, "mean_prob", "mean_lower", "mean_upper", "fitted_variance", d=6)


@query
def calibration_table(spark, sf):
    wide = customer_panel(spark, sf)
    _, filled = _plugin(spark, sf)
    pooled = pool.pool(_region_params(spark, sf)).withColumn(
        "term", F.expr("CASE term WHEN 'bprs' THEN 'Intercept' ELSE 'TIME' END")).filter("term = 'Intercept'")
    observed = profile.observed_proportion(wide, "bprs", 25.0)
    imputed = profile.observed_proportion(filled.complete(), "bprs", 25.0, "prop_imputed")
    out = curves.calibration_table(observed, imputed, curves.prediction_curve(pooled, {}))
    return rnd(out, "prop_observed", "prop_imputed", "pred_prob")


@query
def scenario_comparison(spark, sf):
    """Term by scenario from shifted imputations, cells with estimate and error."""
    pooled = pool.pool(_imputed_lines(spark, sf, _chain_shifts()).params(), ["scenario"])
    return sensitivity.scenario_table(pooled, [f"SHIFT_{s}" for s in SHIFTS])


@query
def robustness_of_terms(spark, sf):
    """Whether each term's conclusion survives a shift of 5 for those who left."""
    base = model_base(spark, sf)
    spec = IMPUTATIONS["fcs_bprs_default"]
    scen = {"MAR": spec, "SHIFT": spec.variant(delta={c: 5.0 for c in BPRS[1:]})}
    fit = linear.fit_lmm(impute.impute(base, spec, scen), MODELS["lme_primary"])
    pooled = pool.inference(pool.pool(fit.params(), ["scenario"]))
    return sensitivity.robustness_table(pooled.filter("scenario = 'MAR'"), pooled.filter("scenario = 'SHIFT'"))


@query
def robustness_of_lines(spark, sf):
    """The same verdict on the lines of plugged-in imputations, judged by |t| > 1.96."""
    fits = pool.pool(_imputed_lines(spark, sf, _chain_shifts()).params(), ["scenario"])
    p = fits.withColumn("p_value", F.when(F.abs("t_value") > 1.96, 0.0).otherwise(1.0))
    out = sensitivity.robustness_table(p.filter("scenario = 'SHIFT_0'"), p.filter("scenario = 'SHIFT_8'"))
    return rnd(out, "estimate_mar", "estimate_shifted")


@query
def sensitivity_grid(spark, sf):
    """Six shifts x {standard, pattern mixture} x 20 imputations, pooled and laid out by scenario."""
    pooled = sensitivity.sensitivity_grid(customer_panel(spark, sf))
    return sensitivity.scenario_table(pooled, sensitivity.scenario_names())
