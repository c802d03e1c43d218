"""Named analyses over the customer panel; each takes (spark, folder) and returns a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitframe.functions import scalar
from visitframe.functions.cluster import shared_path
from visitframe.operators import (aggregates, curves, gee, glmm, impute, joins, linear, logistic, mechanism, pool,
                                  profile, reshape, sampling, sensitivity, weights, windows)
from visitframe.operators.design import Design
from visitframe.sources.panel import customer_panel, read_panel, stage, write_table
from visitframe.spec import IMPUTATIONS, MODELS, PANEL, ImputationSpec, ModelSpec, mains

QUERIES = {}
V = PANEL.visits
BPRS, CDRSB = PANEL.visit_columns("bprs"), PANEL.visit_columns("cdrsb")
FAMILIES = list(PANEL.families)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rnd(df, *cols, d=6):
    """Round for comparison, off the ties that exact decimals fall on; adding zero turns -0 into 0."""
    return df.withColumns({c: F.round(F.col(c) + F.lit(float(f"3.07e-{d + 2}")), d) + F.lit(0.0) for c in cols})


def model_base(spark, sf, monotone=False):
    """Wide panel with every standardised column the model catalogue names, held for several passes."""
    wide = stage(customer_panel(spark, sf, monotone))
    out = reshape.factor_codes(aggregates.zscore(wide, ["AGE", "BMI"]), {"ADL": "ADL_NUM", "EDU": "EDU_NUM"})
    stats = aggregates.mean_sd(reshape.model_panel(wide), ["abpet", "taupet"])
    for f in ("abpet", "taupet"):
        out = aggregates.zscore_visits(out, stats, f, V)
    held = stage(out.withColumn("pattern", reshape.pattern_column("bprs")))
    wide.unpersist()
    return held


# ---- sources and reshaping -------------------------------------------------------------------


@query
def panel_wide(spark, sf):
    return rnd(customer_panel(spark, sf), "AGE", "BMI", "INKOMEN", *PANEL.all_visit_columns())


@query
def panel_written_and_read(spark, sf):
    """The panel through write_table and read_panel, as Parquet and as CSV, in the shared folder."""
    out = None
    for kind in ("parquet", "csv"):
        path = shared_path(spark)
        write_table(customer_panel(spark, sf), path, kind)
        back = read_panel(spark, path, format=kind).withColumn("format", F.lit(kind))
        out = back if out is None else out.unionByName(back)
    return rnd(out, "AGE", "BMI", "INKOMEN", *PANEL.all_visit_columns())


@query
def panel_monotone(spark, sf):
    return rnd(customer_panel(spark, sf, True).select("PATID", *PANEL.all_visit_columns()), *PANEL.all_visit_columns())


@query
def wide_to_long(spark, sf):
    return rnd(reshape.wide_to_long(customer_panel(spark, sf), keep=["PATID", "SEX", "AGE"]), "AGE", *FAMILIES)


@query
def pivot_longer_by_name(spark, sf):
    wide = customer_panel(spark, sf).select("PATID", *CDRSB, *BPRS)
    return rnd(reshape.pivot_longer(wide), "cdrsb", "bprs")


@query
def complete_case_visits(spark, sf):
    long = reshape.model_panel(customer_panel(spark, sf))
    return rnd(long.select("PATID", "TIME", "timeclss", "cdrsb_cat", *FAMILIES), *FAMILIES)


@query
def response_indicator(spark, sf):
    long = reshape.response_indicator(reshape.wide_to_long(customer_panel(spark, sf), keep=["PATID"]), "cdrsb")
    return long.select("PATID", "TIME", "R", scalar.binarize("cdrsb", 10.0).alias("cdrsb_cat"))


@query
def binarize_closed_right(spark, sf):
    wide = reshape.add_bins(customer_panel(spark, sf), "cdrsb", 10.0)
    return wide.select("PATID", *[f"cdrsb_bin{t}" for t in V])


@query
def binarize_closed_left(spark, sf):
    wide = reshape.add_bins(customer_panel(spark, sf), "taupet", 2.0, closed="left")
    return wide.select("PATID", *[f"taupet_bin{t}" for t in V])


@query
def keep_drop_rename(spark, sf):
    wide = customer_panel(spark, sf).select("PATID", "SEX", *BPRS[1:]).drop("SEX")
    return rnd(wide.withColumnsRenamed({f"bprs{t}": f"o_B{t}" for t in V[1:]}), *[f"o_B{t}" for t in V[1:]])


@query
def select_by_pattern(spark, sf):
    out = reshape.columns_like(customer_panel(spark, sf), r"^PATID$|cdrsb\d+$")
    return rnd(out, *CDRSB)


@query
def baseline_copy(spark, sf):
    names = {"ab_base": "abpet0", "tau_base": "taupet0", "cdrsb_base": "cdrsb0", "bprs_base": "bprs0"}
    return rnd(reshape.add_baseline(customer_panel(spark, sf), names).select("PATID", *names), *names)


@query
def factor_code_adl(spark, sf):
    return reshape.factor_code(customer_panel(spark, sf), "ADL", "adl_num").select("PATID", "ADL", "adl_num")


@query
def class_design_columns(spark, sf):
    wide = customer_panel(spark, sf)
    d = Design(mains("EDU", "SEX"), reshape.class_levels(wide, ["EDU", "SEX"]), "first", intercept=False)
    return wide.select("PATID", *[e.alias(n.replace("[", "_").replace("]", "").lower()) for n, e in d.flat_columns()])


@query
def class_design_effect_coding(spark, sf):
    wide = customer_panel(spark, sf)
    d = Design(mains("EDU"), reshape.class_levels(wide, ["EDU"]), "last", "effect", intercept=False)
    return wide.select("PATID", *[e.alias(n.replace("[", "_").replace("]", "").lower()) for n, e in d.flat_columns()])


@query
def observed_visit_count(spark, sf):
    return reshape.add_observed_count(customer_panel(spark, sf), BPRS).select("PATID", "n_obs_data")


@query
def last_visit_rows(spark, sf):
    long = reshape.wide_to_long(customer_panel(spark, sf), keep=["PATID"])
    return rnd(long.filter(F.col("TIME") == 6), *FAMILIES)


@query
def delete_unobserved(spark, sf):
    rows = weights.response_rows(customer_panel(spark, sf)).filter(F.col("R") == 1)
    return rows.select("PATID", "TIME", "cdrsb_cat", "prev_resp")


def _region_params(spark, sf):
    """Least-squares slope and its error of every family on time, by region: a small parameter table."""
    long = reshape.model_panel(customer_panel(spark, sf))
    rows = F.array(*[F.struct(F.lit(f).alias("term"), F.col(f).alias("y")) for f in FAMILIES])
    x, y = F.col("TIME").cast("double"), F.col("y")
    sums = long.select((F.col("TRIAL") + 1).alias("imp"), "TIME", F.inline(rows)).groupBy("imp", "term").agg(
        F.regr_slope(y, x).alias("estimate"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"),
        F.regr_sxy(y, x).alias("sxy"), F.count("*").alias("n"))
    rss = F.col("syy") - F.col("estimate") * F.col("sxy")
    return sums.select("imp", "term", "estimate", F.sqrt(rss / (F.col("n") - 2) / F.col("sxx")).alias("std_error"))


@query
def parameters_transposed(spark, sf):
    p = _region_params(spark, sf)
    est = reshape.long_to_wide(p, ["imp"], "term", "estimate", FAMILIES)
    se = reshape.long_to_wide(p, ["imp"], "term", "std_error", FAMILIES, prefix="SE_")
    return rnd(est.join(se, "imp"), *FAMILIES, *[f"SE_{f}" for f in FAMILIES], d=6)


@query
def parameters_by_scenario(spark, sf):
    p = _region_params(spark, sf).withColumn("scenario", F.concat(F.lit("REGION_"), F.col("imp")))
    cells = p.select("term", "scenario", scalar.estimate_cell("estimate", "std_error").alias("cell"))
    return cells.groupBy("term").pivot("scenario").agg(F.first("cell"))


@query
def evaluation_grid(spark, sf):
    means = aggregates.mean_sd(customer_panel(spark, sf), ["bprs0"])
    grid = reshape.evaluation_grid(means)
    return rnd(grid.select("time_tenths", "TIME", (F.col("mean_bprs0") * F.col("TIME")).alias("line")), "TIME", "line")


@query
def expand_imputations(spark, sf):
    out = reshape.expand_imputations(customer_panel(spark, sf).select("PATID", "bprs0"), 3)
    return out.groupBy("imp").agg(F.count("*").alias("n"), F.round(F.avg("bprs0"), 6).alias("mean_bprs0"))


# ---- joins -----------------------------------------------------------------------------------


@query
def statistics_to_every_row(spark, sf):
    return rnd(aggregates.zscore(customer_panel(spark, sf), ["AGE", "BMI"]).select("PATID", "AGE_STD", "BMI_STD"),
               "AGE_STD", "BMI_STD")


@query
def statistics_by_group(spark, sf):
    wide = customer_panel(spark, sf)
    out = aggregates.zscore(wide, ["AGE", "BMI"], scope=["EDU"])
    return rnd(out.select("PATID", "EDU", "AGE_STD", "BMI_STD"), "AGE_STD", "BMI_STD")


@query
def zscore_scope_reference(spark, sf):
    """Complete-case visits standardised by the original wide rows, biomarkers by the visits themselves."""
    wide = customer_panel(spark, sf)
    long = reshape.model_panel(wide)
    out = aggregates.zscore(long, ["AGE", "BMI"], "reference", wide)
    out = aggregates.zscore(out, ["abpet", "taupet"])
    cols = ["AGE_STD", "BMI_STD", "abpet_STD", "taupet_STD"]
    return rnd(out.select("PATID", "TIME", *cols), *cols)


@query
def original_values_joined(spark, sf):
    wide = customer_panel(spark, sf).select("PATID", *BPRS)
    copies = reshape.expand_imputations(wide.fillna(0.0, BPRS), 2)
    out = joins.attach_originals(copies, wide, ["bprs1", "bprs2"])
    return rnd(out.select("imp", "PATID", "bprs1", "bprs2", "o_bprs1", "o_bprs2"), "bprs1", "bprs2", "o_bprs1", "o_bprs2")


@query
def pattern_label_joined(spark, sf):
    wide = customer_panel(spark, sf)
    label = wide.select("PATID", profile.dropout_time().alias("first_missing"))
    long = reshape.wide_to_long(wide, keep=["PATID"], families=("cdrsb",))
    return rnd(long.join(label, "PATID", "left"), "cdrsb")


@query
def membership_flag(spark, sf):
    out = profile.flag_completers(customer_panel(spark, sf))
    return out.select("PATID", "status")


@query
def keep_sampled_members(spark, sf):
    wide = customer_panel(spark, sf)
    return rnd(joins.keep_members(reshape.wide_to_long(wide, keep=["PATID"]), profile.completers(wide), "PATID"),
               *FAMILIES)


@query
def merge_curves_by_time(spark, sf):
    wide = customer_panel(spark, sf)
    observed = curves.at_visits(profile.observed_proportion(wide))
    grid = reshape.evaluation_grid(aggregates.mean_sd(wide, ["AGE"])).select(
        "time_tenths", (F.col("mean_AGE") + F.col("TIME")).alias("line"))
    return rnd(joins.merge_by_time(observed, grid), "prop_observed", "line")


@query
def merge_parameter_tables(spark, sf):
    p = _region_params(spark, sf)
    a = p.select("imp", "term", "estimate").filter("term = 'bprs'").drop("term")
    b = p.select("imp", "term", F.col("std_error")).filter("term = 'bprs'").drop("term")
    return rnd(a.join(b, "imp"), "estimate", "std_error", d=6)


# ---- aggregates and profiles -----------------------------------------------------------------


@query
def global_mean_sd(spark, sf):
    out = aggregates.mean_sd(customer_panel(spark, sf), ["AGE", "BMI"])
    return rnd(out, *out.columns)


@query
def grouped_mean_sd(spark, sf):
    out = aggregates.mean_sd(customer_panel(spark, sf), ["AGE", "BMI"], ["TRIAL"])
    return rnd(out, *out.columns[1:])


@query
def mean_variance_count_by_class(spark, sf):
    out = aggregates.mean_var_count(_region_params(spark, sf), ["term"], "estimate")
    return rnd(out, "mean", "variance", d=8)


@query
def missing_report(spark, sf):
    long = reshape.wide_to_long(customer_panel(spark, sf))
    return rnd(aggregates.missing_report(long, ["TIME", "SEX", "BMI", "ADL", "cdrsb", "bprs"]), "min")


@query
def frequency_of_response(spark, sf):
    long = reshape.response_indicator(reshape.wide_to_long(customer_panel(spark, sf)), "cdrsb")
    return aggregates.frequency(long, "R")


@query
def mean_by_visit(spark, sf):
    long = reshape.model_panel(customer_panel(spark, sf))
    return rnd(aggregates.group_mean(long, ["TIME"], "cdrsb_cat", "mean_cat"), "mean_cat")


@query
def dropout_by_visit(spark, sf):
    return profile.dropout_table(reshape.wide_to_long(customer_panel(spark, sf), keep=[], families=("cdrsb",)))


@query
def missing_by_variable(spark, sf):
    long = reshape.wide_to_long(customer_panel(spark, sf), keep=[])
    return rnd(profile.missing_by_variable(long, FAMILIES), "pct_missing")


@query
def missing_by_group(spark, sf):
    """Nine factors at once, numeric ones cut to whole values so that levels print alike everywhere."""
    wide = customer_panel(spark, sf).withColumns({c: F.floor(c) for c in ("AGE", "BMI", "INKOMEN")})
    return rnd(profile.missing_by_group(wide, list(PANEL.covariates), CDRSB), "pct_missing")


@query
def missing_cells(spark, sf):
    return profile.missing_flags(customer_panel(spark, sf), CDRSB)


@query
def missing_share(spark, sf):
    return rnd(profile.missing_share(customer_panel(spark, sf), PANEL.all_visit_columns()), "pct_missing")


@query
def subject_patterns(spark, sf):
    return profile.subject_patterns(customer_panel(spark, sf))


@query
def missing_patterns(spark, sf):
    return profile.missing_patterns(customer_panel(spark, sf))


@query
def monotone_check(spark, sf):
    a = profile.is_monotone(customer_panel(spark, sf)).withColumn("variant", F.lit("panel"))
    return a.unionByName(profile.is_monotone(customer_panel(spark, sf, True)).withColumn("variant", F.lit("monotone")))


@query
def dropout_and_last_visit(spark, sf):
    return customer_panel(spark, sf).select("PATID", profile.dropout_time().alias("first_missing"),
                                            profile.last_observed_visit().alias("last_observed"))


@query
def mean_profile_by_dropout(spark, sf):
    return rnd(profile.mean_profile(customer_panel(spark, sf, True)), *[f"mean_{f}" for f in FAMILIES])


@query
def baseline_compare(spark, sf):
    wide = reshape.factor_code(customer_panel(spark, sf), "ADL", "ADL_NUM")
    out = profile.baseline_compare(wide)
    return rnd(out, *out.columns[2:])


@query
def box_summary(spark, sf):
    rows = windows.next_missing_rows(customer_panel(spark, sf))
    out = profile.box_summary(rows, "bprs", ["TIME", "is_missing_next"])
    return rnd(out, "q1", "median", "q3", "whisker_low", "whisker_high")


@query
def box_summary_families(spark, sf):
    """All four outcomes in one pass over the visits."""
    rows = windows.next_missing_rows(customer_panel(spark, sf))
    long = rows.select("TIME", "is_missing_next", F.inline(F.array(*[F.struct(F.lit(f).alias("family"), F.col(f).alias("value")) for f in FAMILIES])))
    out = profile.box_summary(long, "value", ["family", "TIME", "is_missing_next"])
    return rnd(out, "q1", "median", "q3", "whisker_low", "whisker_high")


@query
def correlation_matrix(spark, sf):
    out = profile.correlation_matrix(customer_panel(spark, sf), BPRS)
    return rnd(out, "corr", d=2)


@query
def correlation_of_bins(spark, sf):
    wide = reshape.add_bins(customer_panel(spark, sf), "cdrsb", 10.0, closed="left")
    return rnd(profile.correlation_matrix(wide, [f"cdrsb_bin{t}" for t in V]), "corr", d=2)


@query
def bar_counts(spark, sf):
    long = reshape.wide_to_long(customer_panel(spark, sf), keep=[], families=("cdrsb",))
    return profile.bar_counts(long.withColumn("cdrsb_bin", scalar.binarize("cdrsb", 10.0, "left")), "cdrsb_bin")


@query
def histogram_by_visit(spark, sf):
    return profile.histogram(reshape.wide_to_long(customer_panel(spark, sf), keep=[], families=("bprs",)), "bprs")


@query
def sampled_mean_trend(spark, sf):
    long = reshape.wide_to_long(customer_panel(spark, sf), keep=["PATID"])
    return rnd(profile.mean_trend(sampling.sample_subjects(long, 30, 123), "cdrsb"), "mean_cdrsb")


@query
def observed_proportion(spark, sf):
    return rnd(profile.observed_proportion(customer_panel(spark, sf)), "prop_observed", d=6)


# ---- windows ---------------------------------------------------------------------------------


@query
def previous_values(spark, sf):
    long = reshape.wide_to_long(customer_panel(spark, sf), keep=["PATID"])
    out = windows.previous_values(long, FAMILIES).filter("TIME > 0")
    cols = [f"prev_{f}" for f in FAMILIES]
    return rnd(out.select("PATID", "TIME", *cols), *cols)


@query
def dropout_model_rows(spark, sf):
    out = windows.dropout_rows(customer_panel(spark, sf))
    cols = [f"prev_{f}" for f in FAMILIES]
    return rnd(out.select("PATID", "TIME", "is_missing", *cols), *cols)


@query
def previous_response(spark, sf):
    return weights.response_rows(customer_panel(spark, sf)).select("PATID", "TIME", "R", "prev_resp")


@query
def missing_at_next_visit(spark, sf):
    long = reshape.wide_to_long(customer_panel(spark, sf), keep=["PATID"], families=("cdrsb",))
    out = windows.drop_last_visit(windows.missing_next(long, "cdrsb"))
    return out.select("PATID", "TIME", "is_missing_next")


@query
def first_row_flag(spark, sf):
    long = reshape.model_panel(customer_panel(spark, sf))
    return windows.first_row_flag(long).select("PATID", "TIME", "is_first")


@query
def running_product(spark, sf):
    long = reshape.wide_to_long(customer_panel(spark, sf), keep=["PATID"], families=("abpet",))
    return rnd(windows.running_product(long, "abpet", "product").select("PATID", "TIME", "product"), "product")


@query
def person_period(spark, sf):
    out = windows.person_period(customer_panel(spark, sf), keep=["PATID"])
    return rnd(out, "CDRSB_PREV")


@query
def shift_time_and_rejoin(spark, sf):
    wide = customer_panel(spark, sf)
    moved = windows.shift_time(windows.person_period(wide, keep=["PATID"])).drop("R")
    long = reshape.model_panel(wide).select("PATID", "TIME", "cdrsb")
    return rnd(long.join(moved, ["PATID", "TIME"], "left"), "cdrsb", "CDRSB_PREV")


@query
def grouped_standardise(spark, sf):
    long = reshape.model_panel(customer_panel(spark, sf))
    out = aggregates.zscore(long, ["bprs"], scope=["TIME"], suffix="_std")
    return rnd(out.select("PATID", "TIME", "bprs_std"), "bprs_std")


# ---- sort, sample, stack ---------------------------------------------------------------------


@query
def sorted_first_rows(spark, sf):
    long = reshape.wide_to_long(customer_panel(spark, sf), keep=["PATID"])
    return rnd(long.orderBy("PATID", "TIME").limit(6), *FAMILIES)


@query
def sample_subjects(spark, sf):
    return sampling.sample_ids(customer_panel(spark, sf), 30, 123)


@query
def stacked_tables(spark, sf):
    wide = customer_panel(spark, sf)
    a = profile.observed_proportion(wide)
    b = aggregates.group_mean(reshape.model_panel(wide), ["TIME"], "bprs", "mean_bprs")
    return rnd(reshape.stack(observed=a, means=b), "prop_observed", "mean_bprs")


# ---- scalar functions ------------------------------------------------------------------------


@query
def scalar_text(spark, sf):
    p = _region_params(spark, sf).withColumn("effect", F.concat(F.lit("time *"), F.col("term")))
    return p.select("imp", "term", scalar.clean_name("effect").alias("var_name"),
                    F.concat_ws("", F.lit("STD_Shift_"), F.col("imp").cast("string")).alias("scenario"),
                    scalar.estimate_cell("estimate", "std_error").alias("cell"))


@query
def scalar_arithmetic(spark, sf):
    long = reshape.model_panel(customer_panel(spark, sf))
    p = scalar.logistic(F.col("bprs") / 10.0 - 2.0)
    out = long.select("PATID", "TIME", p.alias("p"), scalar.inverse_probability(p).alias("weight"),
                      scalar.binomial_variance(p).alias("variance"), F.pow("TIME", 2).alias("time_sq"),
                      F.exp(-F.col("abpet")).alias("decay"))
    return rnd(out, "p", "weight", "variance", "decay")


@query
def array_positions(spark, sf):
    """Visit arrays: an element by position and the elementwise gap between two families."""
    wide = customer_panel(spark, sf)
    a, b = F.array(*BPRS), F.array(*CDRSB)
    gap = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x - y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    out = wide.select("PATID", F.element_at(a, 3).alias("bprs_at_2"), gap.alias("total_gap"))
    return rnd(out, "bprs_at_2", "total_gap", d=3)


@query
def linear_predictor_on_grid(spark, sf):
    """A curve from coefficients estimated on the panel, at fixed covariates."""
    wide = customer_panel(spark, sf)
    b = wide.agg(F.avg("AGE").alias("b0"), F.regr_slope("bprs1", "bprs0").alias("b1"))
    grid = reshape.evaluation_grid(b)
    coefs = {("one",): F.col("b0") / 100.0, ("TIME",): F.col("b1"), ("TIME", "ADL"): 0.01}
    out = curves.prediction_curve_for(coefs, {"one": 1.0, "ADL": 10.0}, grid)
    return rnd(out.select("time_tenths", "pred_prob"), "pred_prob", d=6)
