"""Linear models of a panel: least squares, and REML mixed models with random intercept and slope."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitframe.functions.dist import normal_sf2, t_quantile, t_sf2
from visitframe.operators.design import Design, mask_ints, prepare, visit_arrays
from visitframe.operators.impute import ImputedPanel
from visitframe.operators.moments import collect_sums, split_by, sum_arrays, symmetric, upper
from visitframe.spec import PANEL, ModelSpec, PanelSpec


def key_types(df: DataFrame, keys):
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [(k, kinds[k]) for k in keys]


def copy_scales(source: ImputedPanel, columns: dict) -> dict:
    """{key: {new name: (mean, sd)}} of completed columns, {new name: column}, over all subjects of each copy: one pass for all.

    Columns without gaps are the same in every copy and are summed as they stand.
    """
    if not source.gaps & set(columns.values()):
        one = source.base.agg(*[f(F.col(old).cast("double")).alias(f"{n}{i}") for i, old in enumerate(columns.values()) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
        same = {new: (one[f"m{i}"], one[f"s{i}"]) for i, new in enumerate(columns)}
        return {key: same for key in source.keys}
    at = {new: source.coded.of[old][0] for new, old in columns.items()}
    copies = source.copier()

    def kernel(pdf):
        for key, v in copies(pdf)[1]:
            x = v[:, list(at.values())]
            yield key, np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    table = source.base.select(source.panel.id, *source.columns())
    out = {}
    for key, s in collect_sums(table, kernel, [("scenario", "string"), ("imp", "int")]).items():
        n, one, two = s[0], *s[1:].reshape(2, -1)
        sd = np.sqrt(np.maximum(two - one**2 / n, 0.0) / max(n - 1, 1.0))
        out[key] = {new: (m, d) for new, m, d in zip(at, one / n, sd)}
    return out


def fit_input(source, design, model: ModelSpec, keys, spec: PanelSpec, weight=None, standard: dict | None = None, scales: dict | None = None):
    """(narrow table, batch splitter, key types) for stacked rows or for an imputation.

    With an imputation each batch is completed in memory once per (scenario, imp), so the
    stack of copies never exists as rows. `standard` {new name: column} makes z-scores of each copy's own mean and sd;
    `scales` {new name: (column, mean, sd)} takes one mean and sd for all copies, and the base holds the new columns for observed values; class variables
    drawn as numbers then take the drawn levels, which the design must have.
    """
    if not isinstance(source, ImputedPanel):
        table = prepare(source, design, model.outcome, keys, spec.id, weight=weight)
        return table, lambda pdf: split_by(pdf, list(keys)), key_types(source, keys)
    names, copies = source.coded.names, source.copier()
    outcome = [f"{model.outcome}{t}" for t in design.visits]
    target = {o: f"_y{t}" for o, t in zip(outcome, design.visits)}
    table = prepare(source.base, design, model.outcome, (), spec.id, extra=source.columns(), weight=weight)
    owners = [(i, o) for i, (n, o) in enumerate(zip(names, source.coded.owner)) if n == f"v__{o}"]
    own = copy_scales(source, standard) if standard else {}
    first = {new: source.coded.of[old][0] for new, old in (standard or {}).items()}
    shared = [(f"_{new}", source.coded.of[old][0], mean, sd) for new, (old, mean, sd) in (scales or {}).items()]
    numbers = [(i, o) for i, o in owners if scales and o in design.levels]
    classes = {o: (levels, at) for o, (levels, at) in source.class_columns().items() if o in design.levels and at}

    def batches(pdf):
        have = set(pdf.columns)
        raw, each = copies(pdf)
        gone = np.isnan(raw)
        some = gone.any(0)
        for key, v in each:
            out = pdf.copy(deep=False)
            for i, o in owners:
                if some[i]:
                    for c in (target.get(o), f"_{o}"):
                        if c in have:
                            out[c] = v[:, i]
            for new, (mean, sd) in own.get(key, {}).items():
                out[f"_{new}"] = (v[:, first[new]] - mean) / sd
            for new, i, mean, sd in shared:
                if some[i] and new in have:
                    out[new] = (v[:, i] - mean) / sd
            for i, o in numbers:
                if some[i]:
                    for name, value in design.class_values(o, v[:, i]):
                        out[name] = value
            for o, (levels, at) in classes.items():
                if some[at[0]]:
                    level = np.array(levels, object)[np.where(v[:, at].max(1) > 0.5, v[:, at].argmax(1) + 1, 0)]
                    for name, value in design.class_values(o, level):
                        out[name] = np.where(gone[:, at[0]], value, out[name].to_numpy(float))
            yield key, out

    return table, batches, [("scenario", "string"), ("imp", "int")]


def _visit_z(design):
    return np.column_stack([np.ones(len(design.visits)), np.asarray(design.visits, float)])


def lmm_sums(source, design: Design, model: ModelSpec, keys=(), spec: PanelSpec = PANEL, standard: dict | None = None) -> DataFrame:
    """Sums that determine the REML criterion, by key and visit mask (at most 2^visits - 1 masks)."""
    table, batches, kt = fit_input(source, design, model, keys, spec, standard=standard)
    z = _visit_z(design)

    def kernel(pdf):
        for key, part in batches(pdf):
            x, y, ok = visit_arrays(part, design)
            xy = np.concatenate([x, y[:, :, None]], axis=2)
            a = np.einsum("tz,ntq->nzq", z, xy).reshape(len(part), -1)
            masks = mask_ints(ok)
            for m in np.unique(masks):
                if m == 0:
                    continue
                at = masks == m
                rows = xy[at].reshape(-1, xy.shape[2])
                yield key + (int(m),), np.concatenate(
                    [[at.sum()], upper(a[at].T @ a[at]), upper(rows.T @ rows)])

    return sum_arrays(table, kernel, kt + [("mask", "bigint")])


class Reml:
    """REML criterion of one fit, evaluated on sums only."""

    def __init__(self, masks, values, n_columns, visits):
        q = n_columns + 1
        z = np.column_stack([np.ones(len(visits)), np.asarray(visits, float)])
        seen = ((np.asarray(masks)[:, None] >> np.arange(len(visits))) & 1).astype(bool)
        cut = 1 + (2 * q) * (2 * q + 1) // 2
        self.n = np.array([v[0] for v in values])
        self.outer = np.array([symmetric(v[1:cut], 2 * q).reshape(2, q, 2, q) for v in values])
        self.total = symmetric(np.sum([v[cut:] for v in values], axis=0), q)
        self.zz = np.array([z[s].T @ z[s] for s in seen])
        self.N = float((self.n * seen.sum(1)).sum())
        self.p = n_columns
        # Columns are rescaled so that the normal equations stay well conditioned.
        d = np.sqrt(np.maximum(np.diag(self.total), 1e-300))
        d[-1] = 1.0
        self.scale = d[:-1]
        self.log_scale = 2 * np.log(self.scale).sum()
        self.total = self.total / np.outer(d, d)
        self.outer = self.outer / (d[None, None, :, None, None] * d[None, None, None, None, :])
        self.outer = self.outer.transpose(0, 1, 3, 2, 4).reshape(-1, q * q)

    def normal_equations(self, delta):
        eye = np.eye(2)
        w = delta @ np.linalg.inv(eye + self.zz @ delta)
        q = self.total - (w.ravel() @ self.outer).reshape(self.total.shape)
        logdet = (self.n * np.linalg.slogdet(eye + self.zz @ delta)[1]).sum()
        return q, logdet

    def solve(self, delta):
        q, logdet = self.normal_equations(delta)
        xx, xy, yy = q[:-1, :-1], q[:-1, -1], q[-1, -1]
        lam, v = np.linalg.eigh(xx)
        keep = lam > 1e-11 * lam[-1]
        inv = (v[:, keep] / lam[keep]) @ v[:, keep].T
        beta = inv @ xy
        rss = yy - xy @ beta
        return beta, inv, rss, logdet, np.log(lam[keep]).sum(), int(keep.sum())

    def profile(self, theta):
        delta = _delta(theta)
        _, _, rss, logdet, logxx, rank = self.solve(delta)
        df = self.N - rank
        return df * np.log(max(rss, 1e-300) / df) + logdet + logxx + self.log_scale + df * (1 + np.log(2 * np.pi))

    def full(self, cov):
        """-2 REML log-likelihood at (d11, d12, d22, residual)."""
        s2 = cov[3]
        delta = np.array([[cov[0], cov[1]], [cov[1], cov[2]]]) / s2
        _, _, rss, logdet, logxx, rank = self.solve(delta)
        df = self.N - rank
        return df * np.log(2 * np.pi * s2) + logdet + logxx + self.log_scale + rss / s2


def _delta(theta):
    low = np.array([[theta[0], 0.0], [theta[1], theta[2]]])
    return low @ low.T


def minimise(f, start, max_iter=80, tol=1e-11):
    """Quasi-Newton descent with central differences, for the few covariance parameters of a fit: (x, f(x), steps, settled)."""
    x = np.array(start, float)
    k, fx, h = len(x), f(x), np.eye(len(x)) * 0.1

    def gradient(at):
        step = 1e-5 * np.maximum(np.abs(at), 0.1)
        e = np.eye(k)
        return np.array([(f(at + step[i] * e[i]) - f(at - step[i] * e[i])) / (2 * step[i]) for i in range(k)])

    g, settled, steps = gradient(x), False, 0
    for steps in range(1, max_iter + 1):
        d = -h @ g
        if d @ g >= 0:
            h, d = np.eye(k) * 0.1, -0.1 * g
        t = 1.0
        while t > 1e-12 and f(x + t * d) > fx + 1e-4 * t * (d @ g):
            t /= 2
        if t <= 1e-12:
            settled = True
            break
        new = x + t * d
        f_new, g_new = f(new), gradient(new)
        s, yv = new - x, g_new - g
        small = abs(fx - f_new) < tol * (1 + abs(fx))
        x, fx, g = new, f_new, g_new
        if small:
            settled = True
            break
        if s @ yv > 1e-12:
            r = 1.0 / (s @ yv)
            left = np.eye(k) - r * np.outer(s, yv)
            h = left @ h @ left.T + r * np.outer(s, s)
    return x, fx, steps, settled


def _hessian(f, x):
    k = len(x)
    step = 1e-3 * np.maximum(np.abs(x), 1e-3)
    out, e = np.zeros((k, k)), np.diag(step)
    for i in range(k):
        for j in range(i, k):
            v = (f(x + e[i] + e[j]) - f(x + e[i] - e[j]) - f(x - e[i] + e[j]) + f(x - e[i] - e[j]))
            out[i, j] = out[j, i] = v / (4 * step[i] * step[j])
    return out


COV_PARMS = ("UN(1,1)", "UN(2,1)", "UN(2,2)", "Residual")


def solve_lmm(masks, values, names, visits):
    """Estimates of one mixed model from its sums: fixed effects, covariance parameters, fit."""
    r = Reml(masks, values, len(names), visits)
    best = min((minimise(r.profile, s) for s in ([0.7, 0.0, 0.2], [0.1, 0.0, 0.05])), key=lambda o: o[1])
    delta = _delta(best[0])
    beta, inv, rss, _, _, rank = r.solve(delta)
    s2 = rss / (r.N - rank)
    cov = np.array([delta[0, 0], delta[0, 1], delta[1, 1], 1.0]) * s2
    d = r.scale
    with np.errstate(invalid="ignore", divide="ignore"):
        try:
            se = np.sqrt(np.diag(np.linalg.inv(_hessian(r.full, cov)) * 2))
        except np.linalg.LinAlgError:
            se = np.full(4, np.nan)
    return {"beta": beta / d, "cov_beta": s2 * inv / np.outer(d, d), "cov": cov, "cov_se": se,
            "minus2": best[1], "n_subjects": float(r.n.sum()), "n_obs": r.N, "rank": rank, "iterations": best[2], "converged": best[3]}


class PanelFit:
    """Fitted models as tables: one set of rows per key. All sizes are terms x keys."""

    def __init__(self, spark, design, model, keys, kt, fits, spec, link="identity"):
        self.spark, self.design, self.model, self.keys, self.kt = spark, design, model, tuple(keys), kt
        self.fits, self.spec, self.link = fits, spec, link

    def _table(self, rows, columns):
        schema = ", ".join(f"`{k}` {t}" for k, t in self.kt + columns)
        return self.spark.createDataFrame(rows, schema)

    def params(self, level=0.95) -> DataFrame:
        rows = []
        fits = list(self.fits.values())
        beta = np.array([f["beta"] for f in fits]).reshape(len(fits), -1)
        ses = np.sqrt(np.maximum([np.diag(f["cov_beta"]) for f in fits], 0.0)).reshape(beta.shape)
        dfs = np.array([min(f.get("df", np.inf), 1e9) for f in fits])
        with np.errstate(divide="ignore", invalid="ignore"):
            ts = beta / ses
        ps = t_sf2(ts, dfs[:, None])
        halves = t_quantile(0.5 + level / 2, dfs)[:, None] * ses
        for (key, f), se, t, p, half in zip(self.fits.items(), ses, ts, ps, halves):
            for i, n in enumerate(self.design.names):
                rows.append(key + (n, float(f["beta"][i]), float(se[i]), float(t[i]), float(p[i]),
                                   float(f["beta"][i] - half[i]), float(f["beta"][i] + half[i])))
        return self._table(rows, [("term", "string"), ("estimate", "double"), ("std_error", "double"),
                                  ("t_value", "double"), ("p_value", "double"), ("lcl", "double"), ("ucl", "double")])

    def covariance(self, which="cov_beta", value="value") -> DataFrame:
        rows = [key + (a, b, float(f[which][i, j])) for key, f in self.fits.items()
                for i, a in enumerate(self.design.names) for j, b in enumerate(self.design.names)]
        return self._table(rows, [("row_term", "string"), ("col_term", "string"), (value, "double")])

    def cov_params(self) -> DataFrame:
        rows = []
        for key, f in self.fits.items():
            for i, n in enumerate(COV_PARMS[: len(f["cov"])]):
                se = float(f["cov_se"][i])
                z = float(f["cov"][i]) / se if se and np.isfinite(se) else float("nan")
                rows.append(key + (n, float(f["cov"][i]), se, z, float(normal_sf2(z)) if np.isfinite(z) else z))
        return self._table(rows, [("cov_parm", "string"), ("estimate", "double"), ("std_error", "double"),
                                  ("z_value", "double"), ("p_value", "double")])

    def fit_statistics(self) -> DataFrame:
        """Size and fit, the steps taken, whether they settled, and the share by which a working correlation was drawn in to stay positive (0: not at all)."""
        rows = [key + (float(f["minus2"]), int(f["n_subjects"]), int(f["n_obs"]), int(f.get("iterations", 1)), bool(f.get("converged", True)), float(f.get("shrink", 0.0)))
                for key, f in self.fits.items()]
        return self._table(rows, [("minus2_loglik", "double"), ("n_subjects", "bigint"), ("n_obs", "bigint"), ("iterations", "int"), ("converged", "boolean"), ("shrink", "double")])


def fit_lmm(source, model: ModelSpec, keys=(), spec: PanelSpec = PANEL, design: Design | None = None, standard: dict | None = None) -> PanelFit:
    """Mixed model per key, all keys from one pass; each key's small optimisation is its own task. `standard` as in fit_input()."""
    base = source.base if isinstance(source, ImputedPanel) else source
    design = design or Design.of(base, model, spec)
    sums = lmm_sums(source, design, model, keys, spec, standard)
    kt = [(f.name, f.dataType.simpleString()) for f in sums.schema.fields if f.name not in ("mask", "values")]
    names, visits, knames = design.names, design.visits, [k for k, _ in kt]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        import pickle

        pdf = pdf.sort_values("mask")
        out = solve_lmm(pdf["mask"].to_numpy(), [np.asarray(v, float) for v in pdf["values"]], names, visits)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in knames}, "fit": [pickle.dumps(out)]})

    schema = T.StructType([sums.schema[k] for k in knames] + [T.StructField("fit", T.BinaryType())])
    import pickle

    if knames:
        # A fit is seconds of work on a few kilobytes, so the tasks are spread by count, not by size.
        sums = sums.repartition(base.sparkSession.sparkContext.defaultParallelism, *knames)
    group = sums.withColumn("_one", F.lit(1)).groupBy("_one", *knames)
    rows = group.applyInPandas(solve, schema).collect()
    fits = {tuple(r[k] for k in knames): pickle.loads(r["fit"]) for r in rows}
    for f in fits.values():
        f["df"] = f["n_obs"] - f["rank"]
    return PanelFit(base.sparkSession, design, model, knames, kt, dict(sorted(fits.items())), spec)


def _subject_effects(x, y, ok, z, f):
    """Random effects and residual of the fixed part, for a batch."""
    s2 = f["cov"][3]
    delta = np.array([[f["cov"][0], f["cov"][1]], [f["cov"][1], f["cov"][2]]]) / s2
    r = np.where(ok, y - x @ f["beta"], 0.0)
    zr = np.einsum("tz,nt->nz", z, r)
    zz = np.einsum("nt,ta,tb->nab", ok.astype(float), z, z)
    w = delta @ np.linalg.inv(np.eye(2) + zz @ delta)
    return np.einsum("nab,nb->na", w, zr), r, w, s2


def predict_lmm(df: DataFrame, fit: PanelFit) -> DataFrame:
    """Fixed part, subject effects and prediction per observed visit; a narrow map."""
    d, z, id = fit.design, _visit_z(fit.design), fit.spec.id
    table = prepare(df, d, fit.model.outcome, fit.keys, id)
    fits = df.sparkSession.sparkContext.broadcast(fit.fits)
    keys, visits, time = list(fit.keys), list(d.visits), fit.spec.time

    def run(batches):
        for pdf in batches:
            for key, part in split_by(pdf, keys):
                x, y, ok = visit_arrays(part, d)
                f = fits.value[key]
                b, r, _, _ = _subject_effects(x, y, ok, z, f)
                fixed = x @ f["beta"]
                i, t = np.nonzero(ok)
                out = {k: np.full(len(i), v) for k, v in zip(keys, key)}
                yield pd.DataFrame({
                    **out, id: part[id].to_numpy()[i], time: np.asarray(visits)[t],
                    "observed": y[i, t], "fixed": fixed[i, t], "intercept_effect": b[i, 0], "slope_effect": b[i, 1],
                    "predicted": fixed[i, t] + (b @ z.T)[i, t],
                })

    schema = T.StructType([table.schema[k] for k in keys] + [table.schema[id],
                          T.StructField(time, T.IntegerType())]
                          + [T.StructField(c, T.DoubleType()) for c in
                             ("observed", "fixed", "intercept_effect", "slope_effect", "predicted")])
    return table.mapInPandas(run, schema)


def influence(df: DataFrame, fit: PanelFit) -> DataFrame:
    """Cook's distance of deleting each subject, with the covariance parameters held fixed."""
    d, z, id = fit.design, _visit_z(fit.design), fit.spec.id
    table = prepare(df, d, fit.model.outcome, fit.keys, id)
    fits = df.sparkSession.sparkContext.broadcast(fit.fits)
    keys = list(fit.keys)

    def run(batches):
        for pdf in batches:
            for key, part in split_by(pdf, keys):
                x, y, ok = visit_arrays(part, d)
                f = fits.value[key]
                _, r, w, s2 = _subject_effects(x, y, ok, z, f)
                zx = np.einsum("tz,ntp->nzp", z, x)
                zr = np.einsum("tz,nt->nz", z, r)
                h = (np.einsum("ntp,ntq->npq", x, x) - np.einsum("nap,nab,nbq->npq", zx, w, zx)) / s2
                g = (np.einsum("ntp,nt->np", x, r) - np.einsum("nap,nab,nb->np", zx, w, zr)) / s2
                total = np.linalg.pinv(f["cov_beta"], hermitian=True)
                move = np.einsum("npq,nq->np", np.linalg.pinv(total[None] - h, hermitian=True), g)
                cook = np.einsum("np,pq,nq->n", move, total, move) / f["rank"]
                out = {k: np.full(len(part), v) for k, v in zip(keys, key)}
                yield pd.DataFrame({**out, id: part[id].to_numpy(), "n_visits": ok.sum(1).astype("int32"),
                                    "cooks_distance": cook})

    schema = T.StructType([table.schema[k] for k in keys] + [
        table.schema[id], T.StructField("n_visits", T.IntegerType()),
        T.StructField("cooks_distance", T.DoubleType())])
    return table.mapInPandas(run, schema)


def fit_ols(source, model: ModelSpec, keys=(), spec: PanelSpec = PANEL, design: Design | None = None) -> PanelFit:
    """Least squares over all usable visits, per key, from one pass."""
    base = source.base if isinstance(source, ImputedPanel) else source
    design = design or Design.of(base, model, spec)
    table, batches, kt = fit_input(source, design, model, keys, spec)

    def kernel(pdf):
        for key, part in batches(pdf):
            x, y, ok = visit_arrays(part, design)
            xy = np.concatenate([x, y[:, :, None]], axis=2)[ok]
            yield key, np.concatenate([[ok.any(1).sum(), ok.sum()], upper(xy.T @ xy)])

    names = [k for k, _ in kt]
    fits = {}
    for row in sum_arrays(table, kernel, kt).collect():
        v = np.array(row["values"])
        m = symmetric(v[2:], len(design.names) + 1)
        xx, xy, yy = m[:-1, :-1], m[:-1, -1], m[-1, -1]
        d = np.sqrt(np.maximum(np.diag(xx), 1e-300))
        inv = np.linalg.pinv(xx / np.outer(d, d), rcond=1e-11, hermitian=True) / np.outer(d, d)
        beta = inv @ xy
        rank = int(np.linalg.matrix_rank(xx / np.outer(d, d), tol=1e-9, hermitian=True))
        df = v[1] - rank
        s2 = max(yy - beta @ xy, 0.0) / df
        fits[tuple(row[k] for k in names)] = {
            "beta": beta, "cov_beta": s2 * inv, "cov": np.array([s2]), "cov_se": np.array([s2 * np.sqrt(2 / df)]),
            "minus2": float("nan"), "n_subjects": v[0], "n_obs": v[1], "rank": rank, "df": df}
    return PanelFit(base.sparkSession, design, model, names, kt, dict(sorted(fits.items())), spec)


def visit_residuals(wide: DataFrame, fit: PanelFit) -> DataFrame:
    """id, TIME, observed, residual of a fit at every usable visit of wide rows, baseline visits and varying factors included; a narrow map."""
    d, id, time = fit.design, fit.spec.id, fit.spec.time
    table = prepare(wide, d, fit.model.outcome, fit.keys, id)
    beta = wide.sparkSession.sparkContext.broadcast({k: f["beta"] for k, f in fit.fits.items()})
    keys, visits = list(fit.keys), np.asarray(d.visits)

    def run(batches):
        for pdf in batches:
            for key, part in split_by(pdf, keys):
                x, y, ok = visit_arrays(part, d)
                i, t = np.nonzero(ok)
                left = (y - x @ beta.value[key])[i, t]
                yield pd.DataFrame({**{k: np.full(len(i), v) for k, v in zip(keys, key)}, id: part[id].to_numpy()[i], time: visits[t], "observed": y[i, t], "residual": left})

    schema = T.StructType([table.schema[k] for k in keys] + [table.schema[id], T.StructField(time, T.IntegerType()),
                          T.StructField("observed", T.DoubleType()), T.StructField("residual", T.DoubleType())])
    return table.mapInPandas(run, schema)


def linear_residuals(long: DataFrame, fit: PanelFit, outcome: str, name: str = "residual") -> DataFrame:
    """Residual column of a single (unkeyed) fit on long rows, as a plain expression."""
    (f,) = fit.fits.values()
    eta = F.lit(0.0)
    for (_, e), b in zip(fit.design.flat_columns(), f["beta"]):
        eta = eta + F.lit(float(b)) * e
    return long.withColumn(name, F.col(outcome) - eta)
