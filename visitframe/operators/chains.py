"""Imputation chains on per-pattern sums.

A linear-Gaussian chain only ever looks at the rows through the cross-products of each missing
pattern. Drawing a missing column for a whole pattern changes those cross-products in a known way,
so the chain runs on matrices of fixed size, and the rows are read twice in all: once to
sum them and once to draw their values.

Notation: `S[g]` is the cross-product matrix of (1, variables) of pattern g, `n[g]` its row count,
`miss[g, j]` whether variable j is missing there. Variables are standardised.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

from visitframe.functions import noise


@dataclass
class Problem:
    S: np.ndarray
    n: np.ndarray
    miss: np.ndarray
    mean: np.ndarray
    sd: np.ndarray


def observed_moments(raw: np.ndarray, miss: np.ndarray) -> np.ndarray:
    """Observed count, sum and sum of squares of each variable over patterns."""
    seen = ~miss
    return np.stack([(raw[:, 0, 0][:, None] * seen).sum(0), (raw[:, 0, 1:] * seen).sum(0),
                     (np.einsum("gjj->gj", raw[:, 1:, 1:]) * seen).sum(0)])


def scale_of(moments: np.ndarray):
    """Mean and sd of each variable."""
    count = np.maximum(moments[0], 1.0)
    mean = moments[1] / count
    sd = np.sqrt(np.maximum(moments[2] / count - mean**2, 0.0) * count / np.maximum(count - 1.0, 1.0))
    return mean, np.where(sd > 0, sd, 1.0)


def standardise(raw: np.ndarray, miss: np.ndarray, scale=None) -> Problem:
    """Per-pattern raw cross-products -> standardised ones, by the observed mean and sd of each variable."""
    seen = ~miss
    mean, sd = scale_of(observed_moments(raw, miss)) if scale is None else scale
    m, s = np.concatenate([[0.0], mean]), np.concatenate([[1.0], sd])
    r0, n = raw[:, 0, :], raw[:, 0, 0]
    S = raw - m[None, :, None] * r0[:, None, :] - m[None, None, :] * r0[:, :, None]
    S = (S + m[None, :, None] * m[None, None, :] * n[:, None, None]) / (s[:, None] * s[None, :])
    have = np.concatenate([np.ones((len(n), 1), bool), seen], axis=1)
    S = np.where(have[:, :, None] & have[:, None, :], S, 0.0)
    return Problem(S, n, miss, mean, sd)


def independent_columns(xtx, tol=1e-8):
    """Columns kept in order; one that the earlier ones determine is left out."""
    d = np.diag(xtx)
    scale = np.sqrt(np.where(d > 0, d, 1.0))
    a = xtx / np.outer(scale, scale)
    keep = []
    for k in range(len(d)):
        if a[k, k] > tol:
            keep.append(k)
            a = a - np.outer(a[:, k], a[k]) / a[k, k]
    return np.array(keep, int)


def posterior_draw(xtx, xty, yty, n, ridge, rng, proper=True):
    """Coefficients and residual sd of a Bayesian linear regression; dependent columns get 0."""
    at = independent_columns(xtx)
    a = xtx[np.ix_(at, at)]
    a = a + ridge * np.diag(np.diag(a))
    scale = np.sqrt(np.diag(a))
    low = np.linalg.cholesky(a / np.outer(scale, scale))
    root = np.linalg.inv(low).T / scale[:, None]
    beta = np.zeros(len(xty))
    beta[at] = root @ (root.T @ xty[at])
    rss = max(yty - 2 * beta @ xty + beta @ xtx @ beta, 0.0)
    df = max(n - len(at), 1.0)
    if not proper:
        return beta, np.sqrt(rss / df)
    sigma = np.sqrt(rss / rng.chisquare(df))
    beta[at] += sigma * (root @ rng.standard_normal(len(at)))
    return beta, sigma


def ordered_root(a, tol=1e-9):
    """L with L L' = a for a batch, column by column in order; a dependent column gets none.

    Unlike eigenvectors it moves little when the sums differ in their last bits, so draws do not
    depend on how the rows were partitioned.
    """
    a = np.array(a, float)
    k = a.shape[-1]
    floor = tol * np.einsum("gkk->gk", a) + 1e-300
    low, keep = np.zeros_like(a), np.zeros(a.shape[:2], bool)
    for i in range(k):
        keep[:, i] = a[:, i, i] > floor[:, i]
        col = np.where(keep[:, i, None], a[:, :, i] / np.sqrt(np.where(keep[:, i], a[:, i, i], 1.0))[:, None], 0.0)
        low[:, :, i] = col
        a -= col[:, :, None] * col[:, None, :]
    return low, keep


def pattern_noise(miss: np.ndarray):
    """Noise state of each pattern, from its gaps alone: the same wherever the pattern's sums are held."""
    marks = [hashlib.blake2b(np.packbits(m).tobytes(), digest_size=8).digest() for m in miss]
    return noise.subject_state(np.array([int.from_bytes(b, "big") >> 1 for b in marks], np.int64))


def keyed_chi(state, df: np.ndarray, *keys) -> np.ndarray:
    """One chi-square per pattern with `df` degrees (0 gives 0), keyed like noise.normals; gamma by rejection from normals."""
    out = np.zeros(len(df))
    left = np.flatnonzero(df > 0)
    shape = df[left] / 2
    small = shape < 1
    d = np.where(small, shape + 1, shape) - 1 / 3
    # a shape below one is drawn one higher and shrunk
    shrink = np.where(small, noise.uniforms([h[left] for h in state], *keys, 0)[0] ** (1 / shape), 1.0)
    turn = 0
    while len(left):
        turn += 1
        mine = [h[left] for h in state]
        x, u = noise.normals(mine, *keys, 2 * turn), noise.uniforms(mine, *keys, 2 * turn + 1)[0]
        v = np.maximum(1 + x / np.sqrt(9 * d), 0.0) ** 3
        with np.errstate(divide="ignore"):
            hit = (v > 0) & (np.log(u) < x * x / 2 + d - d * v + d * np.log(v))
        out[left[hit]] = 2 * d[hit] * v[hit] * shrink[hit]
        left, d, shrink = left[~hit], d[~hit], shrink[~hit]
    return out


def draw_column(S, n, rows, full, pi, j1, coef, sd, state, keys):
    """Redraw variable j1 in patterns `rows`: y = X coef + noise, seen only through its cross-products."""
    xx = S[np.ix_(rows, full, full)]
    at = [full.index(k) for k in pi]
    low, keep = ordered_root(xx)
    mine = [h[rows] for h in state]
    z = np.column_stack([noise.normals(mine, *keys, 1, k) for k in range(keep.shape[1])]) * keep
    xe = sd * np.einsum("gij,gj->gi", low, z)
    chi = keyed_chi(mine, np.maximum(n[rows] - keep.sum(1), 0.0), *keys, 2)
    ee = sd**2 * ((z**2).sum(1) + chi)
    xb = xx[:, :, at] @ coef
    bxb = xb[:, at] @ coef
    cross = xb + xe
    S[np.ix_(rows, full, [j1])] = cross[:, :, None]
    S[np.ix_(rows, [j1], full)] = cross[:, None, :]
    S[rows, j1, j1] = bxb + 2 * (xe[:, at] @ coef) + ee


def schedule(gaps: list, p: int, predictors: dict, sweeps: int) -> list:
    """(sweep, variable, columns it is regressed on, the intercept 0 first) of a chain: a filling round, then `sweeps` rounds."""
    out, filled = [], [0] + [j + 1 for j in range(p) if j not in gaps]
    for sweep in range(sweeps + 1):
        for j in gaps:
            allowed = predictors.get(j)
            ready = filled if sweep == 0 else range(p + 1)
            out.append((sweep, j, [k for k in range(p + 1) if k != j + 1 and k in ready and (k == 0 or allowed is None or k - 1 in allowed)]))
            if sweep == 0:
                filled.append(j + 1)
    return out


def regression_step(total, sweep, j, pi, ridge, shift, rng, proper=True):
    """A step (sweep, variable, predictors, coefficients with the intercept first, residual sd) from the sums of the rows that have the variable."""
    coef, sd = posterior_draw(total[np.ix_(pi, pi)], total[pi, j + 1], total[j + 1, j + 1], total[0, 0], ridge, rng, proper)
    coef = coef.copy()
    coef[0] += shift[j]
    return sweep, j, np.array([k - 1 for k in pi[1:]], int), coef, float(sd)


class Copy:
    """One copy of patterns' sums whose gaps are being filled in."""

    def __init__(self, S, n, miss, state):
        self.S, self.n, self.miss, self.state = S, n, miss, state

    def total(self, j):
        return self.S[~self.miss[:, j]].sum(0)

    def fill(self, step, seed, imp):
        sweep, j, pred, coef, sd = step
        rows = np.flatnonzero(self.miss[:, j])
        if len(rows):
            # Columns still empty in a pattern are zero in S and drop out of the draw by themselves.
            full = [k for k in range(self.S.shape[1]) if k != j + 1]
            draw_column(self.S, self.n, rows, full, [0, *(int(k) + 1 for k in pred)], j + 1, coef, sd, self.state, (seed, imp, j, sweep))


def chained(problem: Problem, predictors, sweeps, ridge, shift, rng, seed, imp, proper=True):
    """Fill in variable by variable, then `sweeps` rounds of chained regressions; returns the steps drawn.

    `sweeps=0` is the sequential method for monotone gaps. `shift[j]` is added to each draw. A pattern's draws depend on seed, imputation,
    variable, sweep and its gaps, so patterns may lie anywhere (impute.spread_chains).
    """
    p = problem.miss.shape[1]
    copy = Copy(problem.S.copy(), problem.n, problem.miss, pattern_noise(problem.miss))
    steps = []
    for sweep, j, pi in schedule([j for j in range(p) if problem.miss[:, j].any()], p, predictors, sweeps):
        steps.append(regression_step(copy.total(j), sweep, j, pi, ridge, shift, rng, proper))
        copy.fill(steps[-1], seed, imp)
    return steps


class Held:
    """Pattern sums in memory. Tables too large for that give the same totals as Spark jobs (impute.Spread)."""

    def __init__(self, problem: Problem):
        self.problem, self.factors = problem, {}

    def moments(self) -> np.ndarray:
        """Rows, and per variable the observed count, sum and sum of squares."""
        S, n, seen = self.problem.S, self.problem.n, ~self.problem.miss
        return np.concatenate([[n.sum()], (n[:, None] * seen).sum(0), (S[:, 0, 1:] * seen).sum(0),
                               (np.einsum("gjj->gj", S[:, 1:, 1:]) * seen).sum(0)])

    def expected(self, mu, sigma) -> np.ndarray:
        """Expected complete cross-products under (mu, sigma)."""
        S, n, miss = self.problem.S, self.problem.n, self.problem.miss
        return sum((_expected(S[g], n[g], miss[g], mu, sigma) for g in range(len(n))), np.zeros(S.shape[1:]))

    def expected_with_likelihood(self, mu, sigma):
        """expected() and the log-likelihood of the observed values but for its constant."""
        S, n, miss = self.problem.S, self.problem.n, self.problem.miss
        like = 0.0
        for g in range(len(n)):
            o = np.flatnonzero(~miss[g])
            if len(o):
                m, s = mu[o], S[g]
                inner = s[np.ix_(o + 1, o + 1)] - np.outer(s[0, o + 1], m) - np.outer(m, s[0, o + 1]) + n[g] * np.outer(m, m)
                like -= 0.5 * (n[g] * np.linalg.slogdet(sigma[np.ix_(o, o)])[1] + np.trace(np.linalg.solve(sigma[np.ix_(o, o)], inner)))
        return self.expected(mu, sigma), like

    def completed(self, thetas: dict, seed: int, sweep: int) -> dict:
        """Drawn complete cross-products per imputation; a pattern's draw depends on its gaps, not on where it is held."""
        S, n, miss = self.problem.S, self.problem.n, self.problem.miss
        out = {imp: np.zeros(S.shape[1:]) for imp in thetas}
        for g in range(len(n)):
            if not miss[g].any():
                for t in out.values():
                    t += S[g]
                continue
            if g not in self.factors:
                o1 = np.concatenate([[0], np.flatnonzero(~miss[g]) + 1])
                low, keep = ordered_root(S[g][np.ix_(o1, o1)][None])
                self.factors[g] = low[0][:, keep[0]]
            mark = [int(x) for x in np.packbits(miss[g])]
            for imp, (mu, sigma) in thetas.items():
                rng = np.random.Generator(np.random.PCG64([int(seed), int(imp), int(sweep), *mark]))
                out[imp] += _drawn(S[g], n[g], miss[g], self.factors[g], mu, sigma, rng)
        return out

    def distance(self, mu, sigma) -> np.ndarray:
        """Little's statistic, the observed variables summed over patterns, and the patterns."""
        S, n, miss = self.problem.S, self.problem.n, self.problem.miss
        out = np.zeros(3)
        for g in range(len(n)):
            o = np.flatnonzero(~miss[g])
            gap = S[g][0, o + 1] / n[g] - mu[o]
            out += n[g] * gap @ np.linalg.solve(sigma[np.ix_(o, o)], gap), len(o), 1
        return out


def _em_step(total, T):
    mu = T[0, 1:] / total
    sigma = T[1:, 1:] / total - np.outer(mu, mu)
    return mu, (sigma + sigma.T) / 2


def _flat(theta):
    return np.concatenate([theta[0], theta[1].ravel()])


def em_normal(source, iterations=500, tol=1e-9):
    """Maximum-likelihood mean and covariance from per-pattern sums, by EM steps extrapolated along their last two moves.

    Two plain steps give a move r and its change v; the next point is theta - 2 a r + a^2 v with a = -|r| / |v|. It is taken if
    its covariance is positive and its likelihood no lower, else the two plain steps stand. `iterations` bounds the plain steps.
    """
    start = source.moments()
    total, (count, first, second) = start[0], start[1:].reshape(3, -1)
    count = np.maximum(count, 1.0)
    mu = first / count
    p = len(mu)
    theta = (mu, np.diag(np.maximum(second / count - mu**2, 1e-12)))
    T, like = source.expected_with_likelihood(*theta)
    for _ in range(max(1, iterations // 2)):
        one = _em_step(total, T)
        r = _flat(one) - _flat(theta)
        if np.abs(r).max() < tol:
            return one
        T1, like1 = source.expected_with_likelihood(*one)
        two = _em_step(total, T1)
        v = _flat(two) - _flat(one) - r
        size = np.linalg.norm(v)
        jump = None
        if size > 0:
            a = -max(1.0, np.linalg.norm(r) / size)
            x = _flat(theta) - 2 * a * r + a * a * v
            jump = x[:p], x[p:].reshape(p, p)
            if np.linalg.eigvalsh(jump[1])[0] <= 1e-10 * np.diag(jump[1]).max():
                jump = None
        if jump is not None:
            Tj, likej = source.expected_with_likelihood(*jump)
            if likej >= like1 - 1e-10 * abs(like1):
                theta, T, like = jump, Tj, likej
                continue
        theta = two
        T, like = source.expected_with_likelihood(*theta)
    return theta


def _condition(miss_g, mu, sigma):
    """Regression of the missing on the observed variables: coefficient rows (1, observed) and covariance."""
    o, m = np.flatnonzero(~miss_g), np.flatnonzero(miss_g)
    if len(o) == 0:
        return o, m, mu[m][None, :], sigma[np.ix_(m, m)]
    b = np.linalg.solve(sigma[np.ix_(o, o)] + 1e-12 * np.eye(len(o)), sigma[np.ix_(o, m)])
    c = sigma[np.ix_(m, m)] - sigma[np.ix_(m, o)] @ b
    w = np.vstack([(mu[m] - mu[o] @ b)[None, :], b])
    return o, m, w, (c + c.T) / 2


def _place(T, o1, m1, xx, xy, yy):
    T[np.ix_(o1, o1)] = xx
    T[np.ix_(o1, m1)] = xy
    T[np.ix_(m1, o1)] = xy.T
    T[np.ix_(m1, m1)] = yy
    return T


def _expected(Sg, ng, miss_g, mu, sigma):
    if not miss_g.any():
        return Sg
    o, m, w, c = _condition(miss_g, mu, sigma)
    o1, m1 = np.concatenate([[0], o + 1]), m + 1
    xx = Sg[np.ix_(o1, o1)]
    xy = xx @ w
    return _place(np.zeros_like(Sg), o1, m1, xx, xy, w.T @ xy + ng * c)


def _root(c):
    return ordered_root(((c + c.T) / 2)[None])[0][0]


def _wishart(df, k, rng):
    """Wishart with identity scale; fewer degrees than dimensions gives a singular draw."""
    df = int(round(df))
    if df <= 0:
        return np.zeros((k, k))
    if df < k:
        a = rng.standard_normal((df, k))
        return a.T @ a
    low = np.tril(rng.standard_normal((k, k)), -1)
    low[np.arange(k), np.arange(k)] = np.sqrt(rng.chisquare(df - np.arange(k)))
    return low @ low.T


def _drawn(Sg, ng, miss_g, factor, mu, sigma, rng):
    o, m, w, c = _condition(miss_g, mu, sigma)
    o1, m1 = np.concatenate([[0], o + 1]), m + 1
    root = _root(c)
    z = rng.standard_normal((factor.shape[1], len(m)))
    xe = factor @ z @ root.T
    ee = root @ (z.T @ z + _wishart(ng - z.shape[0], len(m), rng)) @ root.T
    xx = Sg[np.ix_(o1, o1)]
    cross = w.T @ xe
    return _place(np.zeros_like(Sg), o1, m1, xx, xx @ w + xe, w.T @ xx @ w + cross + cross.T + ee)


def _posterior_normal(T, total, rng):
    p = T.shape[0] - 1
    mean = T[0, 1:] / total
    ss = T[1:, 1:] - total * np.outer(mean, mean)
    inv_root = np.linalg.inv(np.linalg.cholesky((ss + ss.T) / 2 + 1e-9 * np.diag(np.diag(ss)))).T
    precision = inv_root @ _wishart(total - 1, p, rng) @ inv_root.T
    sigma = np.linalg.inv((precision + precision.T) / 2)
    sigma = (sigma + sigma.T) / 2
    return mean + _root(sigma / total) @ rng.standard_normal(p), sigma


def augmented(source, sweeps: int, seed: int, rngs: dict) -> dict:
    """Data augmentation for a multivariate normal, started at the EM estimate: (mu, sigma) per imputation of `rngs`."""
    total = source.moments()[0]
    start = em_normal(source, 50, 1e-6)
    thetas = {imp: start for imp in rngs}
    for sweep in range(sweeps):
        sums = source.completed(thetas, seed, sweep)
        thetas = {imp: _posterior_normal(sums[imp], total, rng) for imp, rng in rngs.items()}
    return thetas
