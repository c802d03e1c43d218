"""Binary mixed models with random intercept and slope: pseudo-likelihood and adaptive quadrature."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from visitframe.operators.design import Design, prepare, term_arrays, visit_arrays
from visitframe.operators.gee import expit
from visitframe.operators.impute import ImputedPanel
from visitframe.operators.linear import PanelFit, _visit_z, fit_input
from visitframe.operators.moments import collect_sums, split_by
from visitframe.spec import PANEL, ModelSpec, PanelSpec

# Symmetric basis of a 2 x 2 covariance: d11, d12, d22.
BASIS = np.array([[[1.0, 0], [0, 0]], [[0, 1.0], [1.0, 0]], [[0, 0], [0, 1.0]]])


def _root2(d):
    """Lower-triangular root of a 2 x 2 covariance that may be singular."""
    a = np.sqrt(max(d[0, 0], 1e-12))
    b = d[0, 1] / a
    return np.array([[a, 0.0], [b, np.sqrt(max(d[1, 1] - b * b, 1e-12))]])


def _pairs(z):
    """Products of the two columns of z by row: first squared, first times second, second squared."""
    return np.column_stack([z[:, 0] ** 2, z[:, 0] * z[:, 1], z[:, 1] ** 2])


def _full2(v):
    """(n, 2, 2) symmetric matrices from their three entries by column."""
    return v[:, [0, 1, 1, 2]].reshape(-1, 2, 2)


def _inverse2(v):
    """Entries of the inverses of symmetric 2 x 2 matrices given by their three entries."""
    return np.column_stack([v[:, 2], -v[:, 1], v[:, 0]]) / (v[:, 0] * v[:, 2] - v[:, 1] ** 2)[:, None]


def _modes(fixed, y, ok, zl, sweeps=12):
    """Most likely standardised subject effects given the fixed part and D, by Newton steps on all subjects at once.

    The curvature comes as its three entries.
    """
    n = len(fixed)
    u, pairs, unit = np.zeros((n, 2)), _pairs(zl), np.array([1.0, 0.0, 1.0])
    for _ in range(sweeps):
        mu = expit(fixed + u @ zl.T)
        w = mu * (1 - mu) * ok
        g = ((y - mu) * ok) @ zl - u
        i = _inverse2(w @ pairs + unit)
        step = np.column_stack([i[:, 0] * g[:, 0] + i[:, 1] * g[:, 1], i[:, 1] * g[:, 0] + i[:, 2] * g[:, 1]])
        u += np.clip(step, -2, 2)
        if n == 0 or np.abs(step).max() < 1e-10:
            break
    eta = fixed + u @ zl.T
    mu = expit(eta)
    w = np.maximum(mu * (1 - mu), 1e-8) * ok
    return u, eta, mu, w, w @ pairs + unit


def _pql_batch(x, y, ok, z, beta, root):
    """Sums of the working linear mixed model at the current modes."""
    x = np.ascontiguousarray(x.transpose(2, 0, 1))
    p, n, _ = x.shape
    flat = x.reshape(p, -1)
    _, eta, mu, w, h = _modes((beta @ flat).reshape(n, -1), y, ok, z @ root)
    work = np.where(ok, eta + (y - mu) / np.maximum(mu * (1 - mu), 1e-8), 0.0)
    m = root @ _full2(_inverse2(h)) @ root.T
    wx = x * w
    zwx = np.moveaxis(wx @ z, 2, 0)
    zwz = _full2(w @ _pairs(z))
    zwy = (w * work) @ z
    left = np.eye(2) - zwz @ m
    s = (left @ zwz).reshape(n, 4)
    a = (left @ zwy[:, :, None])[:, :, 0]
    b = np.concatenate([left[:, i, 0] * zwx[0] + left[:, i, 1] * zwx[1] for i in (0, 1)])
    mb = np.stack([m[:, i, 0] * zwx[0] + m[:, i, 1] * zwx[1] for i in (0, 1)])
    wx = wx.reshape(p, -1)
    xx = wx @ flat.T - zwx[0] @ mb[0].T - zwx[1] @ mb[1].T
    xy = wx @ work.ravel() - mb[0] @ zwy[:, 0] - mb[1] @ zwy[:, 1]
    return np.concatenate([xx.ravel(), xy, s.sum(0), (a.T @ a).ravel(), (b @ a).T.ravel(), (b @ b.T).ravel(),
                           (s.T @ s).ravel(), [ok.any(1).sum(), ok.sum()]])


def _pql_step(v, d, p):
    """New (beta, D) from the sums: generalised least squares and one scoring step of REML."""
    sizes = [p * p, p, 4, 4, 4 * p, 4 * p * p, 16, 2]
    xx, xy, s, aa, ab, bb, ss, n = np.split(v, np.cumsum(sizes)[:-1])
    xx = xx.reshape(p, p)
    dg = np.sqrt(np.maximum(np.diag(xx), 1e-300))
    inv = np.linalg.pinv(xx / np.outer(dg, dg), rcond=1e-11, hermitian=True) / np.outer(dg, dg)
    beta = inv @ xy
    s, aa = s.reshape(2, 2), aa.reshape(2, 2)
    ab, bb, ss = ab.reshape(2, 2, p), bb.reshape(2, p, 2, p), ss.reshape(2, 2, 2, 2)
    abb = ab @ beta
    cc = aa - abb - abb.T + np.einsum("apbq,p,q->ab", bb, beta, beta)
    gain = cc - s + np.einsum("apbq,pq->ab", bb, inv)
    score = 0.5 * np.einsum("kab,ab->k", BASIS, gain)
    info = 0.5 * np.einsum("abcd,kbc,lda->kl", ss, BASIS, BASIS)
    step = np.linalg.lstsq(info, score, rcond=1e-12)[0]
    new = d + np.einsum("k,kab->ab", step, BASIS)
    lam, vec = np.linalg.eigh(new)
    new = (vec * np.clip(lam, 1e-8, None)) @ vec.T
    return beta, new, inv, info, n


class _Columns:
    """Rows of numbers whose columns are taken by name or names, as those of a batch are."""

    def __init__(self, rows: np.ndarray, place: dict):
        self.rows, self.place = rows, place

    def __len__(self):
        return len(self.rows)

    def __getitem__(self, name):
        return self.rows[:, [self.place[c] for c in name] if isinstance(name, list) else self.place[name]]


def _packed(table: DataFrame, keys, rows: int = 1000):
    """(table of the keys and one binary of all numbers a row, batch splitter): a pass then moves a column where it moved dozens.

    The splitter gives the prepared batches of `table` again, nulls as NaN, `rows` at a time, so that their terms stay in a core's cache.
    """
    names = [c for c in table.columns if c.startswith("_") and c not in keys]

    def pack(batches):
        for pdf in batches:
            data, width = pdf[names].to_numpy(float).tobytes(), 8 * len(names)
            out = pdf[list(keys)].copy()
            out["_packed"] = [data[at:at + width] for at in range(0, len(data), width)]
            yield out

    place = {c: i for i, c in enumerate(names)}

    def batches(pdf):
        for key, part in split_by(pdf, list(keys)):
            held = np.frombuffer(b"".join(part["_packed"])).reshape(len(part), -1)
            for at in range(0, len(held), rows):
                yield key, _Columns(held[at:at + rows], place)

    return table.mapInPandas(pack, T.StructType([table.schema[k] for k in keys] + [T.StructField("_packed", T.BinaryType())])), batches


def _passes(df, design, model, keys, spec, max_iter, start, batch_sums, update, finish, chunk=1000):
    """Iterate `batch_sums -> sum -> update` for every key until each settles; `chunk` subjects at a time stay in a core's cache."""
    source, df = df, df.base if isinstance(df, ImputedPanel) else df
    table, batches, kt = fit_input(source, design, model, keys, spec)
    keys = tuple(k for k, _ in kt)
    if not isinstance(source, ImputedPanel):
        table, batches = _packed(table, keys)
    table = table.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if isinstance(source, ImputedPanel):
            found = list(source.keys)
        else:
            found = [tuple(r) for r in table.select(*keys).distinct().collect()] if keys else [()]
        state, fits = {k: start(k) for k in found}, {}
        for it in range(max_iter):
            shared = df.sparkSession.sparkContext.broadcast(
                {k: s["at"] for k, s in state.items() if k not in fits})

            def kernel(pdf):
                live = shared.value
                for key, part in batches(pdf):
                    if key in live:
                        x, y, ok = term_arrays(part, design, model.cut)
                        for at in range(0, len(y), chunk):
                            cut = slice(at, at + chunk)
                            yield key, batch_sums(x[cut], y[cut], ok[cut], live[key])

            for k, v in collect_sums(table, kernel, kt).items():
                settled = update(state[k], v)
                if settled or it == max_iter - 1:
                    fits[k] = {**finish(state[k]), "iterations": it + 1, "converged": bool(settled)}
            shared.unpersist()
            if len(fits) == len(found):
                break
    finally:
        table.unpersist()
    return PanelFit(df.sparkSession, design, model, keys, kt, dict(sorted(fits.items())), spec, "logit")


def _cov_se(info):
    with np.errstate(invalid="ignore"):
        return np.concatenate([np.sqrt(np.diag(np.linalg.pinv(info, hermitian=True))), [np.nan]])


def fit_pql(df: DataFrame, model: ModelSpec, keys=(), spec: PanelSpec = PANEL, design: Design | None = None,
            max_iter: int = 40, tol: float = 1e-5) -> PanelFit:
    """Pseudo-likelihood: linearise at the modes, one REML scoring step, repeat. One pass per step, all keys."""
    design = design or Design.of(df.base if isinstance(df, ImputedPanel) else df, model, spec)
    z, p = _visit_z(design), len(design.names)

    def start(_):
        return {"at": (np.zeros(p), np.eye(2) * np.array([0.5, 0.02]))}

    def sums(x, y, ok, at):
        return _pql_batch(x, y, ok, z, at[0], _root2(at[1]))

    def update(st, v):
        beta, d = st["at"]
        new_beta, new_d, inv, info, n = _pql_step(v, d, p)
        gap = max(np.abs(new_beta - beta).max() / (1 + np.abs(beta).max()), np.abs(new_d - d).max())
        st.update(at=(new_beta, new_d), inv=inv, info=info, n=n)
        return gap < tol

    def finish(st):
        beta, d = st["at"]
        return {"beta": beta, "cov_beta": st["inv"], "D": d, "cov": np.array([d[0, 0], d[0, 1], d[1, 1]]),
                "cov_se": _cov_se(st["info"]), "minus2": float("nan"),
                "n_subjects": st["n"][0], "n_obs": st["n"][1]}

    return _passes(df, design, model, tuple(keys), spec, max_iter, start, sums, update, finish)


def _quad_chunk(x, y, ok, z, theta, nodes, logw):
    """Log-likelihood, score and observed information of a chunk by adaptive Gauss-Hermite.

    Given standardised effects u the linear predictor is linear in (beta, l11, l21, l22), so the
    complete-data model is a logistic regression and Louis' formula gives the information.
    Nodes are the last axis and meet the terms only after they are summed: per subject the residuals' second moments
    over nodes by pair of visits, and the weights' moments with 1, u and uu' by visit.
    """
    x = np.ascontiguousarray(x.transpose(2, 0, 1))
    p, n, t = x.shape
    flat = x.reshape(p, -1)
    beta, l11, l21, l22 = theta[:p], theta[p], theta[p + 1], theta[p + 2]
    zl = z @ np.array([[l11, 0.0], [l21, l22]])
    fixed = (beta @ flat).reshape(n, t)
    u0, _, _, _, h = _modes(fixed, y, ok, zl)
    # Lower root of the inverse curvature.
    det = h[:, 0] * h[:, 2] - h[:, 1] ** 2
    c11, c22 = np.sqrt(h[:, 2] / det), 1 / np.sqrt(h[:, 2])
    c21 = -h[:, 1] / det / c11
    u = np.ones((n, 3, len(nodes)))
    u[:, 1] = u0[:, 0:1] + np.sqrt(2.0) * c11[:, None] * nodes[:, 0]
    u[:, 2] = u0[:, 1:2] + np.sqrt(2.0) * (c21[:, None] * nodes[:, 0] + c22[:, None] * nodes[:, 1])
    # With the predictor's sign turned by the response, a residual is sign * miss and a likelihood 1 - miss; unused visits have sign 0.
    sign = np.where(ok, np.where(y > 0.5, 1.0, -1.0), 0.0)
    eta = np.stack([fixed * sign, zl[:, 0] * sign, zl[:, 1] * sign], axis=2) @ u
    e = np.exp(-np.abs(eta))
    over = 1 + e
    fit = np.minimum(eta, 0).sum(1) - np.log(over.prod(1)) + np.log(2.0) * (~ok).sum(1)[:, None]
    log_terms = fit - 0.5 * (u[:, 1] ** 2 + u[:, 2] ** 2) - np.log(2 * np.pi) + logw[None, :] + np.log(2.0) + np.log(c11 * c22)[:, None]
    top = log_terms.max(1, keepdims=True)
    omega = np.exp(log_terms - top)
    total = omega.sum(1, keepdims=True)
    loglik = (top + np.log(total)).sum()
    omega = omega / total
    # Residuals by visit, then their products with the predictor's derivatives by (l11, l21, l22), at each node.
    v = np.empty((n, t + 3, len(nodes)))
    miss = np.divide(np.where(eta < 0, 1.0, e), over, out=v[:, :t])
    rz = (sign[:, None, :] * z.T) @ miss
    v[:, t] = u[:, 1] * rz[:, 0]
    v[:, t + 1] = u[:, 1] * rz[:, 1]
    v[:, t + 2] = u[:, 2] * rz[:, 1]
    vo = v * omega[:, None, :]
    q = p + 3
    a = np.zeros((n, t + 3, q))
    a[:, :t, :p] = (x * sign).transpose(1, 2, 0)
    a[:, [t, t + 1, t + 2], [p, p + 1, p + 2]] = 1.0
    outer = a.reshape(-1, q).T @ (vo @ v.transpose(0, 2, 1) @ a).reshape(-1, q)
    mean = (vo.sum(2)[:, None, :] @ a)[:, 0]
    by = np.concatenate([u, u[:, 1:2] * u[:, 1:], u[:, 2:] ** 2], axis=1) * omega[:, None, :]
    w = (by @ (miss * (1 - miss)).transpose(0, 2, 1)) * ok[:, None, :]
    z0, z1 = z[:, 0], z[:, 1]
    hess = np.zeros((q, q))
    hess[:p, :p] = (x * w[:, 0]).reshape(p, -1) @ flat.T
    hess[:p, p:] = flat @ np.stack([w[:, 1] * z0, w[:, 1] * z1, w[:, 2] * z1], axis=2).reshape(-1, 3)
    hess[p:, :p] = hess[:p, p:].T
    (aa, ab, bb), pairs = w[:, 3:].sum(0), _pairs(z)
    hess[p:, p:] = [[aa @ pairs[:, 0], aa @ pairs[:, 1], ab @ pairs[:, 1]],
                    [aa @ pairs[:, 1], aa @ pairs[:, 2], ab @ pairs[:, 2]],
                    [ab @ pairs[:, 1], ab @ pairs[:, 2], bb @ pairs[:, 2]]]
    middle = mean.T @ mean
    return np.concatenate([[loglik], mean.sum(0), (hess - outer + middle).ravel(), middle.ravel(),
                           [ok.any(1).sum(), ok.sum()]])


def fit_quad(df: DataFrame, model: ModelSpec, keys=(), points: int = 10, spec: PanelSpec = PANEL,
             design: Design | None = None, start: PanelFit | None = None, max_iter: int = 40,
             tol: float = 1e-6, chunk: int = 100) -> PanelFit:
    """Maximum likelihood by adaptive Gauss-Hermite quadrature; one pass per Newton step.

    Starts at the pseudo-likelihood estimate. A step that lowers the likelihood is halved.
    """
    design = design or Design.of(df.base if isinstance(df, ImputedPanel) else df, model, spec)
    start = start or fit_pql(df, model, keys, spec, design)
    z, p = _visit_z(design), len(design.names)
    node, weight = np.polynomial.hermite.hermgauss(points)
    a, b = np.meshgrid(np.arange(points), np.arange(points), indexing="ij")
    nodes = np.column_stack([node[a.ravel()], node[b.ravel()]])
    logw = np.log(weight[a.ravel()]) + np.log(weight[b.ravel()]) + (nodes**2).sum(1)
    q = p + 3

    def begin(k):
        f = start.fits[k]
        root = _root2(f["D"] + np.diag([0.02, 0.002]))
        theta = np.concatenate([f["beta"], [root[0, 0], root[1, 0], root[1, 1]]])
        return {"at": theta, "best": None, "step": None}

    def sums(x, y, ok, theta):
        return _quad_chunk(x, y, ok, z, theta, nodes, logw)

    def update(st, v):
        loglik, score = v[0], v[1:1 + q]
        louis, outer = v[1 + q:1 + q + q * q].reshape(q, q), v[1 + q + q * q:1 + q + 2 * q * q].reshape(q, q)
        if st["best"] is not None and loglik < st["best"][0] - 1e-9 * abs(st["best"][0]):
            st["step"] = st["step"] / 2
            if np.abs(st["step"]).max() < 1e-8:
                st["at"] = st["best"][1]
                return True
            st["at"] = st["best"][1] + st["step"]
            return False
        lam = np.linalg.eigvalsh(louis)
        st["best"] = (loglik, st["at"], louis, v[-2:])
        use = louis if lam[0] > 1e-8 * lam[-1] else outer + 1e-6 * np.diag(np.diag(outer))
        step = np.linalg.lstsq(use, score, rcond=1e-12)[0]
        step[p:] = np.clip(step[p:], -0.5, 0.5)
        st["step"] = step
        decrement = float(score @ step)
        if decrement < tol:
            return True
        st["at"] = st["at"] + step
        return False

    def finish(st):
        loglik, theta, louis, n = st["best"]
        inv = np.linalg.pinv(louis, rcond=1e-12, hermitian=True)
        l11, l21, l22 = theta[p:]
        d = np.array([[l11 * l11, l11 * l21], [l11 * l21, l21 * l21 + l22 * l22]])
        jac = np.array([[2 * l11, 0, 0], [l21, l11, 0], [0, 2 * l21, 2 * l22]])
        with np.errstate(invalid="ignore"):
            se = np.sqrt(np.diag(jac @ inv[p:, p:] @ jac.T))
        return {"beta": theta[:p], "cov_beta": inv[:p, :p], "D": d, "cov": np.array([d[0, 0], d[0, 1], d[1, 1]]),
                "cov_se": np.concatenate([se, [np.nan]]), "minus2": -2 * loglik,
                "n_subjects": n[0], "n_obs": n[1]}

    return _passes(df, design, model, tuple(keys), spec, max_iter, begin, sums, update, finish, chunk)


def predict_glmm(df: DataFrame, fit: PanelFit, level_z: float = 1.959963984540054) -> DataFrame:
    """Subject effects and predicted probability with limits per usable visit; a narrow map.

    The variance of the predictor covers the fixed effects, the subject effects and their covariance.
    """
    d, id, time, z = fit.design, fit.spec.id, fit.spec.time, _visit_z(fit.design)
    table = prepare(df, d, fit.model.outcome, fit.keys, id)
    fits = df.sparkSession.sparkContext.broadcast(
        {k: (f["beta"], f["cov_beta"], f["D"]) for k, f in fit.fits.items()})
    keys, visits, cut = list(fit.keys), np.asarray(d.visits), fit.model.cut

    def run(batches):
        for pdf in batches:
            for key, part in split_by(pdf, keys):
                beta, cov, dd = fits.value[key]
                root = _root2(dd)
                x, y, ok = visit_arrays(part, d, cut)
                u, eta, _, w, h = _modes(x @ beta, y, ok, z @ root)
                m = root @ _full2(_inverse2(h)) @ root.T
                f = m @ (z.T @ (x * w[:, :, None]))
                g = x - z @ f
                var = (g @ cov * g).sum(2) + m[:, [0, 0, 1], [0, 1, 1]] @ (_pairs(z) * [1.0, 2.0, 1.0]).T
                half = level_z * np.sqrt(var)
                effect = u @ root.T
                i, t = np.nonzero(ok)
                out = {k: np.full(len(i), v) for k, v in zip(keys, key)}
                yield pd.DataFrame({
                    **out, id: part[id].to_numpy()[i], time: visits[t], "observed": y[i, t],
                    "intercept_effect": effect[i, 0], "slope_effect": effect[i, 1],
                    "pred_prob": expit(eta)[i, t], "lower_ci": expit(eta - half)[i, t],
                    "upper_ci": expit(eta + half)[i, t]})

    schema = T.StructType([table.schema[k] for k in keys] + [
        table.schema[id], T.StructField(time, T.IntegerType())] + [
        T.StructField(c, T.DoubleType()) for c in
        ("observed", "intercept_effect", "slope_effect", "pred_prob", "lower_ci", "upper_ci")])
    return table.mapInPandas(run, schema)
