"""Marginal logistic models with an unstructured working correlation (weighted or not)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from visitframe.operators.design import Design, mask_ints, prepare, term_arrays, visit_arrays
from visitframe.operators.impute import ImputedPanel
from visitframe.operators.linear import PanelFit, fit_input
from visitframe.operators.moments import collect_sums, split_by
from visitframe.spec import PANEL, ModelSpec, PanelSpec


def expit(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def _weights(part, design, weight, ok):
    if not weight:
        return ok.astype(float)
    w = part[[f"_w{t}" for t in design.visits]].to_numpy(float)
    return np.where(ok, np.nan_to_num(w, nan=0.0), 0.0)


def _inverses(masks, corr, t):
    """Inverses of the working correlation of observed visits, padded with zeros, by mask."""
    out = np.zeros((len(masks), t, t))
    for i, m in enumerate(masks):
        at = np.flatnonzero((m >> np.arange(t)) & 1)
        if len(at):
            out[i][np.ix_(at, at)] = np.linalg.inv(corr[np.ix_(at, at)])
    return out


def _sums(x, y, ok, w, beta, corr):
    """Score, information, sandwich middle and residual products of subjects; x term by term (p, n, t)."""
    x = np.ascontiguousarray(x)
    p, n, t = x.shape
    ok = ok & (w > 0)
    mu = expit((beta @ x.reshape(p, -1)).reshape(n, t))
    v = mu * (1 - mu)
    xs = x * np.sqrt(v * w * ok)
    e = np.where(ok, (y - mu) * np.sqrt(w / v), 0.0)
    kinds, where = np.unique(mask_ints(ok), return_inverse=True)
    inverse = _inverses(kinds, corr, t)
    if len(kinds) == 1:
        rx = xs.reshape(-1, t) @ inverse[0]
    else:
        rx = np.matmul(xs.transpose(1, 0, 2), inverse[where.ravel()]).transpose(1, 0, 2)
    rx = rx.reshape(p, n, t)
    u = np.einsum("pnt,nt->pn", rx, e)
    h = xs.reshape(p, -1) @ rx.reshape(p, -1).T
    o = ok.astype(float)
    return np.concatenate([u.sum(1), h.ravel(), (u @ u.T).ravel(), (e.T @ e).ravel(), (o.T @ o).ravel(), [ok.any(1).sum(), ok.sum()]])


def _pass(pdf, batches, design, cut, weight, state, chunk=1000):
    """_sums() of one batch per key, `chunk` subjects at a time, which bounds their arrays and keeps them in a core's cache."""
    for key, part in batches(pdf):
        x, y, ok = term_arrays(part, design, cut)
        x, w = x.transpose(2, 0, 1), _weights(part, design, weight, ok)
        for at in range(0, len(y), chunk):
            some = slice(at, at + chunk)
            yield key, _sums(x[:, some], y[some], ok[some], w[some], *state[key])


def _unpack(v, p, t):
    sizes = [p, p * p, p * p, t * t, t * t, 2]
    parts = np.split(v, np.cumsum(sizes)[:-1])
    return (parts[0], parts[1].reshape(p, p), parts[2].reshape(p, p), parts[3].reshape(t, t),
            parts[4].reshape(t, t), parts[5])


def _correlation(ee, oo, p, phi):
    """Unstructured correlation over available pairs, shrunk to the identity until positive definite."""
    spare = np.where(oo > p, oo - p, np.maximum(oo, 1.0))
    r = np.where(oo > 0, ee / (spare * phi), 0.0)
    np.fill_diagonal(r, 1.0)
    r = np.clip((r + r.T) / 2, -0.99, 0.99)
    np.fill_diagonal(r, 1.0)
    shrink = 0.0
    while np.linalg.eigvalsh(r)[0] < 1e-3 and shrink < 1.0:
        shrink = min(shrink + 0.05, 1.0)
        r = (1 - 0.05) * r + 0.05 * np.eye(len(r))
    return r, shrink


def _solve(h, u):
    d = np.sqrt(np.maximum(np.diag(h), 1e-300))
    inv = np.linalg.pinv(h / np.outer(d, d), rcond=1e-11, hermitian=True) / np.outer(d, d)
    return inv, inv @ u


class GeeFit(PanelFit):
    def working_correlation(self) -> DataFrame:
        vs = self.design.visits
        rows = [key + (int(a), int(b), float(f["corr"][i, j])) for key, f in self.fits.items()
                for i, a in enumerate(vs) for j, b in enumerate(vs)]
        return self._table(rows, [("row_visit", "int"), ("col_visit", "int"), ("corr", "double")])


def fit_gee(df: DataFrame, model: ModelSpec, keys=(), weight: str | None = None, spec: PanelSpec = PANEL,
            design: Design | None = None, max_iter: int = 40, tol: float = 1e-7,
            independence: bool = False, standard: dict | None = None, scales: dict | None = None) -> GeeFit:
    """Fit per key (imputation, scenario) of rows or of an imputation; every iteration is one pass for all keys together.

    `weight` names visit columns (W -> W0..W6). `standard` and `scales` as in linear.fit_input(). Rows of a subject stay in one wide row, so
    clusters never cross a partition and no pass shuffles more than a fixed-size sum.
    """
    source, df = df, df.base if isinstance(df, ImputedPanel) else df
    design = design or Design.of(df, model, spec)
    table, batches, kt = fit_input(source, design, model, keys, spec, weight, standard, scales)
    keys = tuple(k for k, _ in kt)
    table = table.persist(StorageLevel.MEMORY_AND_DISK)
    p, t = len(design.names), len(design.visits)
    try:
        if isinstance(source, ImputedPanel):
            found = list(source.keys)
        elif keys:
            found = [tuple(r) for r in table.select(*keys).distinct().collect()]
        else:
            found = [()]
        state = {k: (np.zeros(p), np.eye(t)) for k in found}
        done, fits, shrunk = {}, {}, {}
        for it in range(max_iter):
            live = {k: v for k, v in state.items() if k not in done}
            shared = df.sparkSession.sparkContext.broadcast(live)

            def kernel(pdf):
                cur = shared.value
                parts = (lambda q: ((k, g) for k, g in batches(q) if k in cur))
                return _pass(pdf, parts, design, model.cut, weight, cur)

            sums = collect_sums(table, kernel, kt)
            for k, v in sums.items():
                u, h, mid, ee, oo, (ns, no) = _unpack(v, p, t)
                inv, step = _solve(h, u)
                phi = max(np.trace(ee) / max(no - p, 1.0), 1e-12)
                beta, corr = state[k]
                size = np.abs(step).max() / (1 + np.abs(beta).max())
                settled = it >= 4 and size < tol
                if settled or it == max_iter - 1:
                    done[k] = True
                    fits[k] = {"beta": beta, "cov_beta": inv @ mid @ inv, "cov_model": phi * inv, "corr": corr,
                               "phi": phi, "shrink": shrunk.get(k, 0.0),
                               "cov": np.array([phi]), "cov_se": np.array([np.nan]), "minus2": float("nan"),
                               "n_subjects": ns, "n_obs": no, "iterations": it + 1, "converged": bool(settled)}
                    continue
                if not independence and it >= 2:
                    corr, shrunk[k] = _correlation(ee, oo, p, phi)
                state[k] = (beta + np.clip(step, -4, 4), corr)
            shared.unpersist()
            if len(done) == len(found):
                break
    finally:
        table.unpersist()
    return GeeFit(df.sparkSession, design, model, keys, kt, dict(sorted(fits.items())), spec)


def predict_gee(df: DataFrame, fit: PanelFit) -> DataFrame:
    """Predicted probability per usable visit; a narrow map with the coefficients broadcast."""
    d, id, time = fit.design, fit.spec.id, fit.spec.time
    table = prepare(df, d, fit.model.outcome, fit.keys, id)
    fits = df.sparkSession.sparkContext.broadcast({k: f["beta"] for k, f in fit.fits.items()})
    keys, visits, cut = list(fit.keys), np.asarray(d.visits), fit.model.cut

    def run(batches):
        for pdf in batches:
            for key, part in split_by(pdf, keys):
                x, y, ok = visit_arrays(part, d, cut)
                prob = expit(x @ fits.value[key])
                i, t = np.nonzero(ok)
                out = {k: np.full(len(i), v) for k, v in zip(keys, key)}
                yield pd.DataFrame({**out, id: part[id].to_numpy()[i], time: visits[t],
                                    "observed": y[i, t], "pred_prob": prob[i, t]})

    schema = T.StructType([table.schema[k] for k in keys] + [
        table.schema[id], T.StructField(time, T.IntegerType()),
        T.StructField("observed", T.DoubleType()), T.StructField("pred_prob", T.DoubleType())])
    return table.mapInPandas(run, schema)
