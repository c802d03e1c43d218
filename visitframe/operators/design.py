"""Model terms as arrays. Subjects are rows; their visits form the second axis."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitframe.operators.reshape import class_levels
from visitframe.spec import PANEL, ModelSpec, PanelSpec


class Design:
    """Expands terms to columns.

    `terms`: tuples of factors; TIME is the visit number, a class column becomes indicator (or
    effect-coded) columns, a name with visit columns (e.g. TAUPET_STD0..6) varies by visit, and
    any other name is a subject-level number.
    """

    def __init__(self, terms, levels=None, reference="first", coding="ref", visits=PANEL.visits,
                 varying=(), intercept=True, time="TIME"):
        self.terms = tuple(tuple(t) for t in terms)
        self.levels = dict(levels or {})
        self.reference = reference
        self.coding = coding
        self.visits = tuple(visits)
        self.varying = tuple(varying)
        self.intercept = intercept
        self.time = time
        self.columns = self._expand()
        self.names = [n for n, _ in self.columns]

    @classmethod
    def of(cls, df: DataFrame, model: ModelSpec, spec: PanelSpec = PANEL, coding="ref"):
        """Build for a table, looking up the class levels it holds."""
        used = {f for t in model.terms for f in t}
        levels = class_levels(df, [c for c in model.categorical if c in used])
        have = set(df.columns)
        varying = [f for f in used if f != spec.time and f not in have and f"{f}{spec.visits[0]}" in have]
        return cls(model.terms, levels, model.reference, coding, spec.visits, varying)

    def base_level(self, col):
        lv = self.levels[col]
        ref = self.reference.get(col, "first") if isinstance(self.reference, dict) else self.reference
        return lv[0] if ref == "first" else lv[-1] if ref == "last" else ref

    def shown_levels(self, col):
        return [x for x in self.levels[col] if x != self.base_level(col)]

    def _expand(self):
        out = [("Intercept", ())] if self.intercept else []
        for term in self.terms:
            combos = [((), ())]
            for f in term:
                if f in self.levels:
                    combos = [(n + (f"{f}[{lv}]",), c + (("level", f, lv),))
                              for n, c in combos for lv in self.shown_levels(f)]
                else:
                    combos = [(n + (f,), c + (("num", f, None),)) for n, c in combos]
            out += [("*".join(n), c) for n, c in combos]
        return out

    def _dummy(self, col, level):
        return f"_{col}_{self.levels[col].index(level)}"

    def scalar_values(self):
        """(name, expression) of the subject-level numbers the executors need, class columns already as indicators."""
        used = {f for t in self.terms for f in t}
        for f in sorted(used):
            if f != self.time and f not in self.levels and f not in self.varying:
                yield f"_{f}", F.col(f).cast("double")
        for c in sorted(used & set(self.levels)):
            base = self.base_level(c)
            for lv in self.shown_levels(c):
                other = F.when(F.col(c) == base, -1.0).otherwise(0.0) if self.coding == "effect" else F.lit(0.0)
                yield self._dummy(c, lv), F.when(F.col(c).isNotNull(), F.when(F.col(c) == lv, 1.0).otherwise(other))

    def scalar_columns(self):
        return [e.alias(n) for n, e in self.scalar_values()]

    def class_values(self, col, level: np.ndarray):
        """(name, values) of a class column's prepared columns for given levels, as scalar_columns() has them."""
        base = self.base_level(col)
        for lv in self.shown_levels(col):
            other = np.where(level == base, -1.0, 0.0) if self.coding == "effect" else 0.0
            yield self._dummy(col, lv), np.where(level == lv, 1.0, other)

    def visit_columns(self):
        return [F.col(f"{f}{t}").cast("double").alias(f"_{f}{t}") for f in self.varying for t in self.visits]

    def tensor(self, pdf) -> np.ndarray:
        """(subjects, visits, columns) array; NaN where an input is missing."""
        return self.by_term(pdf).transpose(1, 2, 0).copy()

    def by_term(self, pdf) -> np.ndarray:
        """The same as a (columns, subjects, visits) array."""
        n, t = len(pdf), len(self.visits)
        time = np.asarray(self.visits, float)
        x = np.ones((len(self.columns), n, t))
        cache = {}
        for k, (_, parts) in enumerate(self.columns):
            for kind, f, lv in parts:
                if f == self.time:
                    x[k] *= time
                    continue
                key = (f, lv)
                if key not in cache:
                    if f in self.varying:
                        cache[key] = np.asarray(pdf[[f"_{f}{s}" for s in self.visits]], float)
                    else:
                        name = self._dummy(f, lv) if kind == "level" else f"_{f}"
                        cache[key] = np.asarray(pdf[name], float)[:, None]
                x[k] *= cache[key]
        return x

    def flat_columns(self, values=None):
        """The same terms as SQL columns of a long table; `values` stands in for some factors."""
        values = values or {}
        exprs = []
        for name, parts in self.columns:
            e = F.lit(1.0)
            for kind, f, lv in parts:
                if kind == "level":
                    base = self.base_level(f)
                    other = F.when(F.col(f) == base, -1.0).otherwise(0.0) if self.coding == "effect" else F.lit(0.0)
                    v = F.when(F.col(f).isNotNull(), F.when(F.col(f) == lv, 1.0).otherwise(other))
                else:
                    v = values.get(f, F.col(f)).cast("double")
                e = e * v
            exprs.append((name, e))
        return exprs


def prepare(df: DataFrame, design: Design, outcome: str, keys=(), id: str = "PATID", extra=(), weight=None):
    """Narrow projection of a wide table to what a fit reads: keys, id, terms, y0..yT, weights."""
    ys = [F.col(f"{outcome}{t}").cast("double").alias(f"_y{t}") for t in design.visits]
    ws = [F.col(f"{weight}{t}").cast("double").alias(f"_w{t}") for t in design.visits] if weight else []
    return df.select(*keys, id, *extra, *design.scalar_columns(), *design.visit_columns(), *ys, *ws)


def visit_arrays(pdf, design: Design, cut=None):
    """X (n,T,p), y (n,T) and the mask of usable visits of a prepared batch."""
    x = design.tensor(pdf)
    y = pdf[[f"_y{t}" for t in design.visits]].to_numpy(float)
    ok = ~np.isnan(y) & ~np.isnan(x).any(axis=2)
    if cut is not None:
        y = (y >= cut).astype(float)
    return np.where(ok[:, :, None], x, 0.0), np.where(ok, y, 0.0), ok


def term_arrays(pdf, design: Design, cut=None):
    """visit_arrays() with X laid out term by term: a view of a (p,n,T) array."""
    x = design.by_term(pdf)
    y = np.asarray(pdf[[f"_y{t}" for t in design.visits]], float)
    gone = np.isnan(y)
    for term in x:
        gone |= np.isnan(term)
    ok = ~gone
    if cut is not None:
        y = (y >= cut).astype(float)
    if gone.any():
        x[:, gone] = 0.0
    return x.transpose(1, 2, 0), np.where(ok, y, 0.0), ok


def mask_ints(ok: np.ndarray) -> np.ndarray:
    return ok.astype(np.int64) @ (1 << np.arange(ok.shape[1], dtype=np.int64))
