"""Binomial regression by Newton steps on sums: each step is one pass for all models together."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitframe.functions.scalar import logistic
from visitframe.operators.design import Design
from visitframe.operators.moments import collect_sums, symmetric, upper
from visitframe.operators.reshape import class_levels
from visitframe.spec import PANEL, PanelSpec

MAX_STEPS = 50


class LogitFit:
    """Coefficients of a binomial model, what they were fitted on, and whether the steps settled."""

    def __init__(self, spark, design, estimate, std_error, n_rows, iterations, converged):
        self.spark, self.design, self.n_rows = spark, design, n_rows
        self.estimate, self.std_error, self.iterations, self.converged = estimate, std_error, iterations, converged

    def params(self) -> DataFrame:
        from visitframe.functions.dist import normal_sf2

        rows = []
        for name, b, s in zip(self.design.names, self.estimate, self.std_error):
            z = b / s if s > 0 else float("nan")
            rows.append((name, float(b), float(s), float(z), float(normal_sf2(z)), int(self.n_rows)))
        return self.spark.createDataFrame(
            rows, "term string, estimate double, std_error double, z_value double, p_value double, n_rows bigint")

    def probability(self, values: dict | None = None):
        """Predicted probability as an expression; `values` replaces factors by other columns."""
        eta = F.lit(0.0)
        for (_, e), b in zip(self.design.flat_columns(values), self.estimate):
            eta = eta + F.lit(float(b)) * e
        return logistic(eta)

    def score(self, rows: DataFrame, response: str) -> DataFrame:
        """term, score: sum of column x (response - probability) over rows of a long table; zero at the solution."""
        gap = F.col(response) - self.probability()
        sums = rows.agg(*[F.coalesce(F.sum(e * gap), F.lit(0.0)).alias(f"s{i}") for i, (_, e) in enumerate(self.design.flat_columns())])
        return sums.select(F.inline(F.array(*[F.struct(F.lit(n).alias("term"), F.col(f"s{i}").alias("score")) for i, n in enumerate(self.design.names)])))


@dataclass
class VisitLogit:
    """A binomial model of wide rows: a response and varying factors by visit (null: not a row), subject-level factors by name."""

    response: dict
    terms: tuple
    categorical: tuple = ()
    reference: str = "first"
    coding: str = "ref"
    varying: dict = field(default_factory=dict)


def _newton(table: DataFrame, arrays, sizes: dict) -> dict:
    """{model: (estimate, covariance, rows, steps, settled)}; `arrays(batch)` yields (model, X, y) of usable rows.

    A step that lowers the likelihood is halved. Columns that others determine get 0.
    """
    state = {m: {"at": np.zeros(p), "best": None, "step": None} for m, p in sizes.items()}
    done = {}
    for turn in range(1, MAX_STEPS + 1):
        live = {m: s["at"] for m, s in state.items() if m not in done}

        def kernel(pdf, live=live):
            for m, x, y in arrays(pdf):
                if m in live:
                    eta = np.clip(x @ live[m], -500, 500)
                    mu = 1.0 / (1.0 + np.exp(-eta))
                    w = mu * (1.0 - mu)
                    yield (m,), np.concatenate([[len(y), (y * eta - np.logaddexp(0.0, eta)).sum()], x.T @ (y - mu), upper((x * w[:, None]).T @ x)])

        sums = collect_sums(table, kernel, [("model", "string")])
        for m in live:
            s, p = state[m], sizes[m]
            v = sums.get((m,), np.zeros(2 + p + p * (p + 1) // 2))
            n, like, score, info = v[0], v[1], v[2:2 + p], symmetric(v[2 + p:], p)
            if s["best"] is not None and like < s["best"][0] - 1e-12 * abs(s["best"][0]):
                s["step"] = s["step"] / 2
                if np.abs(s["step"]).max() < 1e-12:
                    done[m] = (*s["best"][1:], turn, True)
                s["at"] = s["best"][1] + s["step"]
                continue
            scale = np.sqrt(np.maximum(np.diag(info), 1e-300))
            inv = np.linalg.pinv(info / np.outer(scale, scale), rcond=1e-11, hermitian=True) / np.outer(scale, scale)
            s["best"], s["step"] = (like, s["at"], inv, n), inv @ score
            if score @ s["step"] < 1e-18 * (1 + abs(like)) or np.abs(s["step"]).max() < 1e-11 * (1 + np.abs(s["at"]).max()):
                done[m] = (s["at"], inv, n, turn, True)
            s["at"] = s["at"] + s["step"]
        if len(done) == len(sizes):
            break
    return {m: done.get(m) or (*s["best"][1:], MAX_STEPS, False) for m, s in state.items()}


def _fit(spark, design, found) -> LogitFit:
    at, inv, n, turn, settled = found
    return LogitFit(spark, design, at, np.sqrt(np.maximum(np.diag(inv), 0.0)), int(n), turn, settled)


def fit_logit(rows: DataFrame, response: str, terms, categorical=(), reference="first", coding="ref") -> LogitFit:
    """Binomial model of long rows; rows with a missing response or predictor are left out."""
    used = {f for t in terms for f in t}
    design = Design(terms, class_levels(rows, [c for c in categorical if c in used]), reference, coding)
    cols = design.flat_columns()
    names = [f"x{i}" for i in range(len(cols))]
    table = rows.select(F.col(response).cast("double").alias("label"), *[e.alias(n) for n, (_, e) in zip(names, cols)]).persist(StorageLevel.MEMORY_AND_DISK)

    def arrays(pdf):
        full = pdf.to_numpy(float)
        full = full[~np.isnan(full).any(1)]
        yield "", full[:, 1:], full[:, 0]

    try:
        return _fit(rows.sparkSession, design, _newton(table, arrays, {"": len(names)})[""])
    finally:
        table.unpersist()


def fit_visit_logits(wide: DataFrame, models: dict, spec: PanelSpec = PANEL) -> dict:
    """Binomial models {name: VisitLogit} of all usable visits of wide rows, every step one pass for all of them.

    A subject stays one row: its visits are a second axis inside the kernel.
    """
    used = {f for m in models.values() for t in m.terms for f in t}
    classes = sorted({c for m in models.values() for c in m.categorical if c in used})
    levels = class_levels(wide, classes)
    designs, columns = {}, {}
    for i, (name, m) in enumerate(models.items()):
        visits = tuple(m.response)
        own = {f for t in m.terms for f in t}
        designs[name] = Design(m.terms, {c: levels[c] for c in m.categorical if c in own}, m.reference, m.coding, visits, [f for f in m.varying if f in own], time=spec.time)
        for t in visits:
            columns[f"{i}_y{t}"] = m.response[t].cast("double")
            columns.update({f"{i}_{f}{t}": m.varying[f][t].cast("double") for f in designs[name].varying})
        for n, e in designs[name].scalar_values():
            columns[f"{i}{n}"] = e
    table = wide.select(*[e.alias(n) for n, e in columns.items()]).persist(StorageLevel.MEMORY_AND_DISK)

    def arrays(pdf):
        for i, (name, d) in enumerate(designs.items()):
            mine = pdf[[c for c in pdf.columns if c.startswith(f"{i}_")]]
            mine.columns = [c[len(str(i)):] for c in mine.columns]
            x, y = d.tensor(mine), mine[[f"_y{t}" for t in d.visits]].to_numpy(float)
            ok = ~np.isnan(y) & ~np.isnan(x).any(axis=2)
            yield name, x[ok], y[ok]

    try:
        found = _newton(table, arrays, {n: len(d.names) for n, d in designs.items()})
    finally:
        table.unpersist()
    return {n: _fit(wide.sparkSession, designs[n], f) for n, f in found.items()}


def previous(family: str, visits) -> dict[int, Column]:
    """A family's value at the visit before, for each visit after the first."""
    return {t: F.col(f"{family}{s}") for s, t in zip(visits, visits[1:])}
