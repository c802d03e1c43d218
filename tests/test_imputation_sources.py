"""One method at any size: pattern sums held or spread, copies from recipes or rows, fits on each of them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from visitframe.functions import noise
from visitframe.operators import aggregates, chains, gee, impute, impute_rows, linear, sensitivity
from visitframe.sources.panel import customer_panel, stage
from visitframe.spec import IMPUTATIONS, MODELS, ImputationSpec, ModelSpec, mains

BPRS = [f"bprs{t}" for t in range(7)]
LINE = ModelSpec("m", "lmm", "bprs", mains("TIME", "AGE"))


@pytest.fixture(scope="module")
def wide(spark, folder):
    return stage(customer_panel(spark, folder))


def stacked(filled, keep=("PATID", *BPRS)):
    out = filled.complete(list(keep), scenario=True).toPandas()
    return out.sort_values(["scenario", "imp", "PATID"]).reset_index(drop=True)


@pytest.mark.parametrize("name", ["fcs_bprs", "mice_ncmv", "fcs_bprs_mnar", "monotone_glmm", "mvn_cdrsb"])
def test_spread_sums_draw_what_held_ones_draw(spark, folder, monkeypatch, name):
    base = sensitivity.grid_base(customer_panel(spark, folder, name == "monotone_glmm"))
    spec = IMPUTATIONS[name].variant(m=2, iterations=3)
    fam = "cdrsb" if "cdrsb" in name or "glmm" in name else "bprs"
    cols = [f"{fam}{t}" for t in range(7)]
    # the last visits of the monotone panel have about as many rows as predictors, which magnifies the order of additions
    near = 1e-3 if name == "monotone_glmm" else 1e-8
    scen = {"A": spec, "B": spec.variant(delta={c: 4.0 for c in cols[2:]}, iterations=2)}
    held = impute.impute(base, spec, scen)
    monkeypatch.setattr(impute, "HELD_BYTES", 0)
    spread = impute.impute(base, spec, scen)
    assert held.keys == spread.keys
    for key in held.keys:
        for a, b in zip(held.params[key][1], spread.params[key][1]):
            for x, y in zip(a[3:], b[3:]) if held.params[key][0] == "chain" else [(a, b)]:
                assert np.allclose(x, y, rtol=near, atol=near)
    a, b = stacked(held, ["PATID", *cols]), stacked(spread, ["PATID", *cols])
    assert np.allclose(a[cols], b[cols], rtol=near, atol=near)
    model = LINE if fam == "bprs" else ModelSpec("m", "lmm", "cdrsb", mains("TIME", "AGE"))
    for key, f in linear.fit_lmm(held, model).fits.items():
        assert np.allclose(f["beta"], linear.fit_lmm(spread, model).fits[key]["beta"], rtol=max(near, 1e-5))


def test_closing_gaps_are_refused_held_and_spread(wide, monkeypatch):
    spec = ImputationSpec("m", "monotone", ("AGE", *BPRS), m=1)
    for size in (64 << 20, 0):
        monkeypatch.setattr(impute, "HELD_BYTES", size)
        with pytest.raises(ValueError, match="never close"):
            impute.impute(wide, spec)


def test_keyed_chi_squares():
    state = noise.subject_state(np.arange(60000))
    for df in (0.0, 1.0, 2.0, 7.0, 500.0):
        x = chains.keyed_chi(state, np.full(60000, df), 1, 2, 3)
        assert abs(x.mean() - df) < 0.03 * max(df, 1) and abs(x.var() - 2 * df) < 0.06 * max(2 * df, 1)


MIXED = ImputationSpec("mixed", "fcs", ("SEX", "AGE", "cdrsb0", "cdrsb1", *BPRS[:3]), m=2, iterations=2, ridge=0.001, categorical=("SEX",),
                       columns={"cdrsb0": "pmm", "cdrsb1": "pmm", "bprs0": "norm", "bprs1": "norm", "bprs2": "pmm"})


def test_donors_do_not_depend_on_ranges(wide):
    specs = {"S0": MIXED, "S5": MIXED.variant(delta={"bprs1": 5.0}, predictors={"bprs1": ("SEX", "AGE", "bprs0")}, m=1)}
    cols = ["PATID", "cdrsb0", "cdrsb1", *BPRS[:3]]
    a = stacked(impute_rows.impute_rows(wide, specs), cols)
    b = stacked(impute_rows.impute_rows(wide.repartition(3), specs, part_rows=40), cols)
    assert len(a) == 3 * wide.count() and not a.isna().any().any()
    assert np.allclose(a[cols], b[cols], rtol=1e-7, atol=1e-7)
    seen = set(wide.select("cdrsb1").dropna().toPandas()["cdrsb1"])
    assert set(a["cdrsb1"]) <= seen


def test_donors_are_the_nearest(spark):
    """Every taken value belongs to one of the five nearest predictions, by brute force over all donors, with many ties."""
    rng = np.random.default_rng(0)
    n = 500
    x = np.round(rng.normal(size=n), 1)
    y = 2 * x + rng.normal(size=n)
    gap = rng.random(n) < 0.5
    gap[np.argsort(x)[-60:]] = True
    pdf = pd.DataFrame({"PATID": np.arange(n), "x": x, "y": np.where(gap, np.nan, y)})
    df = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    spec = ImputationSpec("d", "fcs", ("x", "y"), m=1, iterations=1, columns={"y": "pmm"})
    coded = impute.Coded.build(df, spec)
    run = impute_rows._Run(df, coded, {"": spec}, impute.PANEL)
    impute_rows._begin(run, spec)
    drawn, point = np.array([0.3, 1.7]), np.array([0.0, 2.0])
    for parts in (10_000, 37, 7):
        got = {r["PATID"]: r["got"][0] for r in impute_rows.match_donors(run, 1, [(drawn, point)], [[0]], 1, part_rows=parts).collect()}
        assert set(got) == set(np.flatnonzero(gap))
        h = point[0] + point[1] * x[~gap]
        for i, v in got.items():
            d = np.abs(h - (drawn[0] + drawn[1] * x[i]))
            assert d[np.flatnonzero(np.isclose(y[~gap], v))].min() <= np.sort(d)[4] + 1e-9


def test_fits_on_rows_equal_fits_on_completed_tables(wide):
    filled = impute.impute(wide, MIXED, {"S0": MIXED, "S5": MIXED.variant(delta={"bprs1": 5.0})})
    done = filled.complete()
    a, b = linear.fit_lmm(filled, LINE), linear.fit_lmm(done, LINE, keys=("scenario", "imp"))
    assert a.fits.keys() == b.fits.keys() and len(a.fits) == 4
    for k in a.fits:
        assert np.allclose(a.fits[k]["beta"], b.fits[k]["beta"], rtol=1e-4)
    bin_ = ModelSpec("b", "gee", "cdrsb", mains("TIME", "AGE"), cut=10.0)
    a, b = gee.fit_gee(filled, bin_, independence=True), gee.fit_gee(done, bin_, keys=("scenario", "imp"), independence=True)
    for k in a.fits:
        assert np.allclose(a.fits[k]["beta"], b.fits[k]["beta"], atol=1e-6)


def test_gee_draws_copies_inside_its_passes(wide, monkeypatch):
    """Common z-scores and a class with gaps: fits that draw the copies equal those on their stack, and the query stores no stack."""
    from visitframe.operators.design import Design
    from visitframe.operators.reshape import class_levels
    from visitframe.plans import model_queries

    base = wide.withColumn("SEX", F.when(F.col("PATID") % 5 != 0, F.col("SEX"))).withColumn("AGE", F.when(F.col("PATID") % 7 != 0, F.col("AGE")))
    panel = impute.impute(stage(base), ImputationSpec("n", "mvn", ("SEX", "AGE", *[f"cdrsb{t}" for t in range(7)]), m=3, iterations=20, round_to=1.0))
    done = panel.complete()
    stats = done.agg(F.avg("AGE"), F.stddev("AGE")).first()
    z = ((F.col("AGE") - stats[0]) / stats[1]).alias("AGE_STD")
    model = ModelSpec("b", "gee", "cdrsb", mains("TIME", "SEX", "AGE_STD"), cut=10.0, categorical=("SEX",))
    a = gee.fit_gee(done.select("*", z), model, keys=("imp",))
    design = Design(model.terms, class_levels(done, ["SEX"]), model.reference)
    b = gee.fit_gee(panel.over(base.select("*", z)), model, design=design, scales={"AGE_STD": ("AGE", *stats)})
    assert a.design.names == b.design.names and len(b.fits) == 3
    for (_, i), fit in b.fits.items():
        assert np.allclose(fit["beta"], a.fits[i,]["beta"], atol=1e-8) and np.allclose(fit["cov_beta"], a.fits[i,]["cov_beta"], atol=1e-8)
        assert fit["n_obs"] == a.fits[i,]["n_obs"]

    kept = []
    monkeypatch.setattr(model_queries, "stage", lambda df: kept.append(df.columns) or stage(df))
    monkeypatch.setattr(model_queries, "customer_panel", lambda spark, sf: wide)
    model_queries._gee_imputed(wide.sparkSession, "", "gee_full_linear")
    assert kept and not any("imp" in columns for columns in kept)


def test_class_gaps_can_be_fitted(wide):
    base = stage(wide.withColumn("EDU", F.when(F.col("PATID") % 5 != 0, F.col("EDU"))).withColumn("JOB", F.when(F.col("PATID") % 7 != 0, F.col("JOB"))))
    spec = MIXED.variant(variables=("EDU", "JOB", "AGE", *BPRS[:2]), categorical=("EDU", "JOB"), columns={})
    filled = impute.impute(base, spec)
    done = filled.complete()
    check = done.join(base.select("PATID", F.col("EDU").alias("was"), F.col("JOB").alias("had")), "PATID").agg(
        F.count_if(F.col("EDU").isNull() | F.col("JOB").isNull()), F.count_if(F.col("EDU") != F.col("was")), F.count_if(F.col("JOB") != F.col("had"))).first()
    assert tuple(check) == (0, 0, 0)
    model = ModelSpec("m", "lmm", "bprs", mains("TIME", "EDU", "JOB"), categorical=("EDU", "JOB"))
    a, b = linear.fit_lmm(filled, model), linear.fit_lmm(done, model, keys=("imp",))
    for k in a.fits:
        assert np.allclose(a.fits[k]["beta"], b.fits[k[1:]]["beta"], rtol=1e-4, atol=1e-6)


def test_scores_of_each_copy(wide):
    base = stage(wide.withColumn("AGE", F.when(F.col("PATID") % 4 != 0, F.col("AGE"))).withColumn("AGE_STD", F.lit(0.0)))
    spec = IMPUTATIONS["fcs_bprs_mnar"].variant(m=2, iterations=2, round_to=None)
    model = ModelSpec("m", "lmm", "bprs", mains("TIME", "AGE_STD") + (("TIME", "AGE_STD"),))
    filled = impute.impute(base, spec)
    a = linear.fit_lmm(filled, model, standard={"AGE_STD": "AGE"})
    done = aggregates.zscore(filled.complete().drop("AGE_STD"), ["AGE"], ["imp"])
    b = linear.fit_lmm(done, model, keys=("imp",))
    for k in a.fits:
        assert np.allclose(a.fits[k]["beta"], b.fits[k[1:]]["beta"], rtol=1e-4)


def test_grid_with_donors(wide):
    """Shifts x methods where columns are matched on donors: one row-wise chain per method for all scenarios."""
    spec = IMPUTATIONS["mice_whole_frame"].variant(m=2, iterations=1, variables=("TRIAL", "SEX", "AGE", "EDU", "BMI", "JOB", "ADL", "WZC", "cdrsb0", "cdrsb1", *BPRS))
    pooled = sensitivity.sensitivity_grid(wide, (0, 6), standard=spec, pattern=None)
    rows = pooled.toPandas()
    assert set(rows["scenario"]) == {"STD_Shift_0", "STD_Shift_6"} and rows["estimate"].notna().all()
    time = rows[rows["term"] == "TIME"].set_index("scenario")["estimate"]
    assert time["STD_Shift_6"] > time["STD_Shift_0"]


def test_text_keys(wide):
    """Subjects may be named by text: sums, rows, fits and predictions take it, and draws follow the name."""
    named = stage(wide.withColumn("PATID", F.concat(F.lit("s"), F.col("PATID"))))
    spec = IMPUTATIONS["fcs_bprs_mnar"].variant(m=2, iterations=2)
    a, b = impute.impute(named, spec), impute.impute(named.repartition(3), spec)
    assert np.allclose(stacked(a)[BPRS], stacked(b)[BPRS], rtol=1e-6)
    rows = impute.impute(named, MIXED.variant(m=1, iterations=1))
    fit = linear.fit_lmm(rows, LINE)
    assert len(fit.fits) == 1 and rows.complete(["PATID", "cdrsb1"]).filter("cdrsb1 IS NULL").count() == 0
    one = linear.fit_lmm(named, LINE)
    assert linear.predict_lmm(named, one).schema["PATID"].dataType.simpleString() == "string" and linear.influence(named, one).count() == named.count()
    assert gee.predict_gee(named, gee.fit_gee(named, ModelSpec("b", "gee", "cdrsb", mains("TIME", "AGE"), cut=10.0))).count() > 0


def test_normal_copies_draw_gaps_only_and_solve_a_pattern_once(spark, folder, monkeypatch):
    filled = impute.impute(customer_panel(spark, folder), IMPUTATIONS["mvn_cdrsb"].variant(m=2, iterations=2))
    pdf = filled.base.select("PATID", *filled.columns()).toPandas()
    copies, drawn, solved = filled.copier(), [], []
    normals, condition = noise.normals, chains._condition
    monkeypatch.setattr(noise, "normals", lambda state, *keys: drawn.append(len(state[0])) or normals(state, *keys))
    monkeypatch.setattr(chains, "_condition", lambda *a: solved.append(1) or condition(*a))
    gone = pdf[filled.coded.names].isna().to_numpy()
    for part in (pdf, pdf, pdf.iloc[::-1]):
        raw, each = copies(part)
        found = {key: v for key, v in each}
        assert len(found) == 2 and not any(np.isnan(v).any() for v in found.values())
    assert sum(drawn) == 3 * 2 * gone.sum()
    assert len(solved) == 2 * (np.unique(gone, axis=0).any(1)).sum()


def test_matched_values_are_unpacked_once_per_batch():
    from visitframe.operators.impute_rows import Cells, _taking

    pdf = pd.DataFrame({"id": [1, 2, 3, 4], "a": [np.nan, 5.0, np.nan, np.nan], "got": [np.array([1.0, 2.0]), None, None, np.array([3.0, 4.0])]})
    cells = Cells(pdf, ["a"], "id", 2)
    change = _taking(0, [0.0, 10.0])(pdf, cells)
    assert change(0, np.zeros((4, 1)))[:, 0].tolist() == [1, 0, 0, 3] and change(1, np.zeros((4, 1)))[:, 0].tolist() == [12, 0, 0, 14]
