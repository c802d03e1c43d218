"""Model operators against dense numpy on small fixtures."""

import numpy as np
from pyspark.sql import functions as F

from visitframe.functions import dist, noise
from visitframe.operators import chains, gee, glmm, impute, linear, profile
from visitframe.operators.design import Design
from visitframe.sources.panel import customer_panel, read_panel, write_table
from visitframe.spec import IMPUTATIONS, ModelSpec, mains

LINE = ModelSpec("m", "lmm", "bprs", mains("TIME", "AGE"))
BIN = ModelSpec("b", "gee", "cdrsb", mains("TIME", "AGE"), cut=10.0)


def dense(pdf, cut=None):
    """(X, y, mask) of the two models above from a pandas copy of the wide table."""
    fam = "cdrsb" if cut else "bprs"
    y = pdf[[f"{fam}{t}" for t in range(7)]].to_numpy(float)
    ok = ~np.isnan(y)
    x = np.ones((len(pdf), 7, 3))
    x[:, :, 1] = np.arange(7)
    x[:, :, 2] = pdf["AGE"].to_numpy(float)[:, None]
    if cut:
        y = np.where(ok, y >= cut, 0.0).astype(float)
    return x, y, ok


def dense_reml(cov, x, y, ok):
    """-2 REML log-likelihood with explicit covariance matrices."""
    d, s2 = np.array([[cov[0], cov[1]], [cov[1], cov[2]]]), cov[3]
    z = np.column_stack([np.ones(7), np.arange(7)])
    xx, xy, yy, ld, n = np.zeros((3, 3)), np.zeros(3), 0.0, 0.0, 0
    for i in range(len(y)):
        o = ok[i]
        if o.any():
            v = z[o] @ d @ z[o].T + s2 * np.eye(o.sum())
            w = np.linalg.inv(v)
            xx += x[i][o].T @ w @ x[i][o]
            xy += x[i][o].T @ w @ y[i][o]
            yy += y[i][o] @ w @ y[i][o]
            ld += np.linalg.slogdet(v)[1]
            n += o.sum()
    beta = np.linalg.solve(xx, xy)
    return (n - 3) * np.log(2 * np.pi) + ld + np.linalg.slogdet(xx)[1] + yy - xy @ beta, beta, np.linalg.inv(xx)


def test_lmm_is_the_dense_reml_optimum(spark, folder):
    wide = customer_panel(spark, folder)
    fit = linear.fit_lmm(wide, LINE)
    f = fit.fits[()]
    x, y, ok = dense(wide.toPandas())
    y = np.where(ok, y, 0.0)
    value, beta, cov = dense_reml(f["cov"], x, y, ok)
    assert np.isclose(value, f["minus2"], rtol=1e-8)
    assert np.allclose(beta, f["beta"], rtol=1e-6)
    assert np.allclose(cov, f["cov_beta"], rtol=1e-5)
    for step in ([0.5, 0, 0, 0], [0, 0, 0.05, 0], [0, 0, 0, 1.0]):
        assert dense_reml(f["cov"] + np.array(step), x, y, ok)[0] >= value - 1e-6
    pred = linear.predict_lmm(wide, fit).toPandas()
    assert len(pred) == ok.sum()
    assert linear.influence(wide, fit).filter("cooks_distance < 0").count() == 0


def test_gee_independence_is_pooled_logistic_and_unit_weights_change_nothing(spark, folder):
    wide = customer_panel(spark, folder)
    x, y, ok = dense(wide.toPandas(), 10.0)
    xs, ys, beta = x[ok], y[ok], np.zeros(3)
    for _ in range(30):
        mu = 1 / (1 + np.exp(-xs @ beta))
        beta = beta + np.linalg.solve((xs * (mu * (1 - mu))[:, None]).T @ xs, xs.T @ (ys - mu))
    fit = gee.fit_gee(wide, BIN, independence=True).fits[()]
    assert np.allclose(fit["beta"], beta, atol=1e-5)
    ones = wide.withColumns({f"W{t}": F.lit(1.0) for t in range(7)})
    a, b = gee.fit_gee(wide, BIN).fits[()], gee.fit_gee(ones, BIN, weight="W").fits[()]
    assert np.allclose(a["beta"], b["beta"]) and a["converged"]


def test_quadrature_matches_a_fine_grid_integral(spark, folder):
    wide = customer_panel(spark, folder)
    x, y, ok = dense(wide.toPandas(), 10.0)
    z = np.column_stack([np.ones(7), np.arange(7)])
    theta = np.array([0.5, 0.02, 0.003, 0.8, 0.05, 0.2])
    node, weight = np.polynomial.hermite.hermgauss(10)
    a, b = [g.ravel() for g in np.meshgrid(range(10), range(10), indexing="ij")]
    nodes = np.column_stack([node[a], node[b]])
    logw = np.log(weight[a]) + np.log(weight[b]) + (nodes**2).sum(1)
    x0 = np.where(ok[:, :, None], x, 0.0)
    out = glmm._quad_chunk(x0, np.where(ok, y, 0.0), ok, z, theta, nodes, logw)
    g = np.linspace(-6, 6, 121)
    u = np.array([(p, q) for p in g for q in g])
    dens = np.exp(-0.5 * (u**2).sum(1)) / (2 * np.pi) * (g[1] - g[0]) ** 2
    root = np.array([[theta[3], 0], [theta[4], theta[5]]])
    total = 0.0
    for i in range(len(y)):
        eta = (x[i] @ theta[:3])[None, :] + u @ root.T @ z.T
        p = 1 / (1 + np.exp(-eta))
        like = np.where(ok[i], np.where(y[i] > 0.5, p, 1 - p), 1.0).prod(1)
        total += np.log(like @ dens)
    assert np.isclose(out[0], total, rtol=1e-5)
    h = 1e-4
    for k in range(6):
        e = np.eye(6)[k] * h
        up, down = (glmm._quad_chunk(x0, np.where(ok, y, 0.0), ok, z, theta + s * e, nodes, logw)[0] for s in (1, -1))
        assert np.isclose((up - down) / (2 * h), out[1 + k], rtol=2e-2, atol=2e-2)


def test_chain_moments_follow_the_rows(spark):
    """A regression drawn on sums has the mean and spread of one drawn on rows."""
    rng = np.random.default_rng(1)
    n = 400
    v = rng.normal(size=(n, 2))
    v[:, 1] += 2 * v[:, 0]
    gone = rng.random(n) < 0.4
    raw, miss = [], []
    for g in (False, True):
        part = np.column_stack([np.ones((gone == g).sum()), v[gone == g, 0], np.where(g, 0.0, v[gone == g, 1])])
        raw.append(part.T @ part)
        miss.append([False, g])
    problem = chains.standardise(np.array(raw), np.array(miss))
    draws = []
    for s in range(300):
        (_, _, _, coef, sd), = chains.chained(problem, {}, 0, 0.0, np.zeros(2), np.random.default_rng(s), s, 1)
        draws.append([coef[1] * problem.sd[1] / problem.sd[0], sd * problem.sd[1]])
    x = np.column_stack([np.ones((~gone).sum()), v[~gone, 0]])
    beta, rss, *_ = np.linalg.lstsq(x, v[~gone, 1], rcond=None)
    s2 = rss[0] / (len(x) - 2)
    se = np.sqrt(s2 * np.linalg.inv(x.T @ x)[1, 1])
    draws = np.array(draws)
    assert abs(draws[:, 0].mean() - beta[1]) < 4 * se / np.sqrt(300)
    assert 0.8 < draws[:, 0].std() / se < 1.25
    assert abs(draws[:, 1].mean() - np.sqrt(s2)) < 0.05 * np.sqrt(s2)


def test_imputation_properties(spark, folder):
    wide = customer_panel(spark, folder)
    cols = [f"bprs{t}" for t in range(7)]
    spec = IMPUTATIONS["fcs_bprs"].variant(m=2, iterations=3)
    done = impute.impute(wide, spec).complete()
    audit = impute.imputation_audit(done, wide, cols).toPandas()
    assert (audit["n_left"] == 0).all() and (audit["n_changed"] == 0).all()
    again = impute.impute(wide.repartition(3), spec).complete()
    a = done.select("imp", "PATID", "bprs3").toPandas().sort_values(["imp", "PATID"])["bprs3"].to_numpy()
    b = again.select("imp", "PATID", "bprs3").toPandas().sort_values(["imp", "PATID"])["bprs3"].to_numpy()
    assert np.allclose(a, b)
    zero = impute.impute(wide, spec.variant(delta={c: 0.0 for c in cols})).complete().toPandas()
    assert np.allclose(zero.sort_values(["imp", "PATID"])["bprs3"].to_numpy(), a)


def test_donor_matching_takes_a_near_observed_value(spark, folder):
    wide = customer_panel(spark, folder)
    spec = IMPUTATIONS["mice_whole_frame"].variant(m=2, iterations=1, variables=("SEX", "AGE", "cdrsb0", "cdrsb1"),
                                                   categorical=("SEX",))
    done = impute.impute(wide, spec).complete(["PATID", "cdrsb0", "cdrsb1"]).toPandas()
    seen = set(wide.select("cdrsb1").dropna().toPandas()["cdrsb1"])
    assert set(done["cdrsb1"]) <= seen and len(done) == 2 * wide.count()


def test_group_quantiles_with_a_narrow_band(spark):
    df = spark.range(20000).selectExpr("id % 3 AS g", "pmod(hash(id), 5000) / 7.0 AS v")
    got = {(r["g"], r["p"]): r["quantile"]
           for r in profile.group_quantiles(df, "v", ["g"], (0.25, 0.5, 0.75), accuracy=1000).collect()}
    pdf = df.toPandas()
    for (g, p), q in got.items():
        assert np.isclose(q, pdf[pdf.g == g].v.astype(float).quantile(p))
    assert len(got) == 9


def test_noise_is_standard_normal_and_independent():
    s = noise.subject_state(np.arange(200000))
    z, w = noise.normals(s, 1, 1, 0, 0), noise.normals(s, 1, 1, 1, 0)
    assert abs(z.mean()) < 0.01 and abs(z.std() - 1) < 0.01 and abs((z**4).mean() - 3) < 0.1
    assert abs(np.corrcoef(z, w)[0, 1]) < 0.01 and abs(np.corrcoef(z[1:], z[:-1])[0, 1]) < 0.01


def test_tails():
    assert np.allclose(dist.t_quantile(0.975, [1, 5, 30]), [12.706205, 2.570582, 2.042272], atol=1e-5)
    assert np.isclose(dist.chi2_sf(3.841459, 1), 0.05, atol=1e-6)
    assert np.isclose(dist.normal_sf2(1.959964), 0.05, atol=1e-6)


def test_write_and_read_back(spark, folder, tmp_path):
    wide = customer_panel(spark, folder)
    for fmt in ("parquet", "csv"):
        write_table(wide, str(tmp_path / fmt), fmt)
        assert read_panel(spark, str(tmp_path / fmt), format=fmt).count() == wide.count()


def test_design_names():
    d = Design((("EDU",), ("TIME", "EDU")), {"EDU": ["a", "b", "c"]})
    assert d.names == ["Intercept", "EDU[b]", "EDU[c]", "TIME*EDU[b]", "TIME*EDU[c]"]


def _binary_panel(n, p, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 7, p))
    ok = rng.random((n, 7)) > 0.25
    z = np.column_stack([np.ones(7), np.arange(7.0)])
    return np.where(ok[:, :, None], x, 0.0), np.where(ok, rng.random((n, 7)) > 0.5, 0.0), ok, z, rng.normal(size=p) * 0.3


def test_quadrature_costs_little_per_subject():
    """A subject of 100 nodes takes below 100 microseconds a pass (about 200 with derivatives by term at each node)."""
    import time

    x, y, ok, z, beta = _binary_panel(2000, 6, 1)
    node, weight = np.polynomial.hermite.hermgauss(10)
    a, b = (m.ravel() for m in np.meshgrid(np.arange(10), np.arange(10), indexing="ij"))
    nodes = np.column_stack([node[a], node[b]])
    logw = np.log(weight[a]) + np.log(weight[b]) + (nodes**2).sum(1)
    best = np.inf
    for _ in range(3):
        start = time.process_time()
        for i in range(0, 2000, 100):
            cut = slice(i, i + 100)
            glmm._quad_chunk(x[cut], y[cut], ok[cut], z, np.r_[beta, 0.7, 0.1, 0.2], nodes, logw)
        best = min(best, time.process_time() - start)
    assert best / 2000 < 1e-4


def test_quadrature_chunks_add_up():
    """Unused visits and huge predictors count as they should, in whatever chunks subjects come."""
    x, y, ok, z, beta = _binary_panel(60, 4, 2)
    x[0] *= 400
    x[0][~ok[0]] = 0.0
    ok[1] = False
    x[1], y[1] = 0.0, 0.0
    nodes, logw = np.array([[-1.0, 0.5], [0.0, 0.0], [1.0, -0.5]]), np.array([-1.0, 0.0, -1.0])
    theta = np.r_[beta, 0.7, 0.1, 0.2]
    whole = glmm._quad_chunk(x, y, ok, z, theta, nodes, logw)
    parts = sum(glmm._quad_chunk(x[i:i + 7], y[i:i + 7], ok[i:i + 7], z, theta, nodes, logw) for i in range(0, 60, 7))
    assert np.isfinite(whole).all() and np.allclose(whole, parts, rtol=1e-9, atol=1e-9)


def test_pseudo_likelihood_sums_against_loops():
    x, y, ok, z, beta = _binary_panel(40, 3, 3)
    root = np.array([[0.7, 0.0], [0.1, 0.3]])
    out = glmm._pql_batch(x, y, ok, z, beta, root)
    d, p = root @ root.T, 3
    xx, xy = np.zeros((p, p)), np.zeros(p)
    for xi, yi, oi in zip(x, y, ok):
        if not oi.any():
            continue
        xi, yi, zi = xi[oi], yi[oi], z[oi]
        effect = np.zeros(2)
        for _ in range(50):
            mu = 1 / (1 + np.exp(-(xi @ beta + zi @ effect)))
            w = mu * (1 - mu)
            effect += np.linalg.solve(zi.T @ (w[:, None] * zi) + np.linalg.inv(d), zi.T @ (yi - mu) - np.linalg.solve(d, effect))
        eta = xi @ beta + zi @ effect
        mu = 1 / (1 + np.exp(-eta))
        w = mu * (1 - mu)
        v = np.linalg.inv(np.diag(1 / w) + zi @ d @ zi.T)
        xx, xy = xx + xi.T @ v @ xi, xy + xi.T @ v @ (eta + (yi - mu) / w)
    assert np.allclose(out[:9].reshape(3, 3), xx, rtol=1e-7) and np.allclose(out[9:12], xy, rtol=1e-7)


def test_terms_by_block_are_the_same_and_quicker():
    """Terms laid out one by one are those of visit_arrays() and take less time."""
    import time

    import pandas as pd

    from visitframe.operators.design import term_arrays, visit_arrays
    from visitframe.spec import MODELS

    names = ["AGE_STD", "BMI_STD", "SEX", "ADL"]
    varying = ("ABPET_STD", "TAUPET_STD")
    design = Design(MODELS["glmm_full"].terms, varying=varying)
    rng = np.random.default_rng(4)
    columns = [f"_{c}" for c in names] + [f"_{f}{t}" for f in varying for t in range(7)] + [f"_y{t}" for t in range(7)]
    pdf = pd.DataFrame(rng.normal(size=(5000, len(columns))), columns=columns).mask(rng.random((5000, len(columns))) < 0.1)
    for a, b in zip(visit_arrays(pdf, design, 0.0), term_arrays(pdf, design, 0.0)):
        assert np.array_equal(a, b)
    slow, quick = [], []
    for _ in range(3):
        for f, out in ((visit_arrays, slow), (term_arrays, quick)):
            start = time.process_time()
            f(pdf, design, 0.0)
            out.append(time.process_time() - start)
    assert min(quick) < min(slow)


def test_packed_rows_are_the_prepared_batches(spark):
    """A pass reads one binary a row beside the keys; unpacked pieces hold the same numbers, in a core's cache."""
    rows = [(i % 3, i, None if i % 7 == 0 else i / 3, None if i % 5 == 0 else float(-i)) for i in range(2500)]
    table = spark.createDataFrame(rows, "imp int, PATID long, _x double, _y0 double").coalesce(1)
    packed, batches = glmm._packed(table, ("imp",))
    assert packed.columns == ["imp", "_packed"]
    got = {}
    for key, part in batches(packed.toPandas()):
        assert len(part) <= 1000 and part[["_y0", "_x"]].shape == (len(part), 2)
        got.setdefault(key, []).append(part[["_x", "_y0"]])
    want = table.toPandas()
    assert sorted(got) == [(0,), (1,), (2,)]
    for (k,), parts in got.items():
        np.testing.assert_array_equal(np.concatenate(parts), want.loc[want["imp"] == k, ["_x", "_y0"]].to_numpy(float))
