"""Multiple imputation of a wide panel: many completed copies from two passes over the rows."""

from __future__ import annotations

import copy
import uuid
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitframe.functions import noise
from visitframe.operators import chains
from visitframe.functions.cluster import remove, settle, shared_path
from visitframe.operators.moments import collect_sums, sum_arrays, symmetric, upper
from visitframe.operators.reshape import class_levels
from visitframe.spec import PANEL, ImputationSpec, PanelSpec

# Pattern sums of up to this size are held in one place; larger tables stay spread and are summed by Spark jobs.
HELD_BYTES = 64 << 20
# A worker keeps the regressions of patterns and copies of one recipe for its next batches and tasks up to about this size.
KEPT_BYTES = 32 << 20
_SOLVED: dict = {}


@dataclass
class Coded:
    """Variables of an imputation as numeric columns; class variables become indicators."""

    names: list
    exprs: list
    owner: list
    of: dict = field(default_factory=dict)
    levels: dict = field(default_factory=dict)

    @classmethod
    def build(cls, df: DataFrame, spec: ImputationSpec):
        out = cls([], [], [])
        out.levels = class_levels(df, [v for v in spec.variables if v in spec.categorical])
        for v in spec.variables:
            if v in spec.categorical:
                _, *rest = out.levels[v]
                for i, lv in enumerate(rest):
                    hit = F.when(F.col(v).isNotNull(), F.when(F.col(v) == lv, 1.0).otherwise(0.0))
                    out._add(v, f"v__{v}_{i + 1}", hit)
            else:
                out._add(v, f"v__{v}", F.col(v).cast("double"))
        return out

    def _add(self, owner, name, expr):
        self.of.setdefault(owner, []).append(len(self.names))
        self.names.append(name)
        self.owner.append(owner)
        self.exprs.append(expr.alias(name))


def pattern_sums(df: DataFrame, coded: Coded) -> DataFrame:
    """Cross-products of (1, variables) per missing pattern, one pass."""
    names = coded.names
    p = len(names)

    def kernel(pdf):
        v = pdf[names].to_numpy(float)
        gone = np.isnan(v)
        z = np.concatenate([np.ones((len(v), 1)), np.where(gone, 0.0, v)], axis=1)
        packed = np.packbits(gone, axis=1)
        kinds, where = np.unique(packed, axis=0, return_inverse=True)
        where = where.ravel()
        for k in range(len(kinds)):
            part = z[where == k]
            yield (kinds[k].tobytes().hex(),), upper(part.T @ part)

    return sum_arrays(df.select(*coded.exprs), kernel, [("pattern", "string")])


def _unpacked(patterns, values, p: int):
    """Raw sums and gaps of patterns."""
    raw = np.array([symmetric(np.array(v), p + 1) for v in values])
    bits = [np.frombuffer(bytes.fromhex(b), np.uint8) for b in patterns]
    return raw, np.array([np.unpackbits(b)[:p] for b in bits]).astype(bool)


class Spread:
    """Pattern sums that stay a table in the shared folder: the totals of chains.Held, each as one Spark job over patterns.

    Draws are keyed by seed, imputation, sweep and pattern, so they are those that the held sums give.
    """

    def __init__(self, table: DataFrame, p: int):
        self.table, self.p = table, p
        raw = collect_sums(table, self._over(lambda raw, miss: {(0,): chains.observed_moments(raw, miss).ravel()}), [("k", "int")])
        self.mean, self.sd = self.scale = chains.scale_of(raw[(0,)].reshape(3, p))
        gaps = collect_sums(table, self._over(lambda raw, miss: {(0,): miss.any(0).astype(float)}), [("k", "int")])
        self.gaps = gaps[(0,)] > 0

    def _over(self, work):
        p = self.p

        def kernel(pdf):
            for at in range(0, len(pdf), 512):
                raw, miss = _unpacked(pdf["pattern"][at:at + 512], pdf["values"][at:at + 512], p)
                yield from work(raw, miss).items()

        return kernel

    def _totals(self, name: str, *args) -> dict:
        scale = self.scale

        def work(raw, miss):
            out = getattr(chains.Held(chains.standardise(raw, miss, scale)), name)(*args)
            out = np.concatenate([out[0].ravel(), [out[1]]]) if isinstance(out, tuple) else out
            out = out if isinstance(out, dict) else {0: out}
            return {(int(k),): np.asarray(v, float).ravel() for k, v in out.items()}

        return {k[0]: v for k, v in collect_sums(self.table, self._over(work), [("k", "int")]).items()}

    def moments(self):
        return self._totals("moments")[0]

    def expected_with_likelihood(self, mu, sigma):
        both = self._totals("expected_with_likelihood", mu, sigma)[0]
        return both[:-1].reshape(self.p + 1, self.p + 1), both[-1]

    def completed(self, thetas, seed, sweep):
        return {k: v.reshape(self.p + 1, self.p + 1) for k, v in self._totals("completed", thetas, seed, sweep).items()}

    def distance(self, mu, sigma):
        return self._totals("distance", mu, sigma)[0]


def load_sums(df: DataFrame, coded: Coded, drop_empty: bool = False):
    """chains.Held of the pattern sums, or Spread where they take more than HELD_BYTES; `drop_empty` leaves out rows without any value."""
    p = len(coded.names)
    table = pattern_sums(df, coded)
    if drop_empty:
        table = table.filter(F.col("pattern") != np.packbits(np.ones(p, bool)).tobytes().hex())
    table = settle(table)
    if table.count() * 8 * (p + 1) ** 2 > HELD_BYTES:
        return Spread(table, p)
    rows = sorted(table.collect(), key=lambda r: r["pattern"])
    return chains.Held(chains.standardise(*_unpacked([r["pattern"] for r in rows], [r["values"] for r in rows], p)))


def _index_predictors(spec: ImputationSpec, coded: Coded):
    out = {}
    for v, preds in spec.predictors.items():
        allowed = {k for q in preds for k in coded.of[q]}
        for j in coded.of.get(v, []):
            out[j] = allowed
    return out


def _shift(spec: ImputationSpec, coded: Coded, sd):
    return np.array([spec.delta.get(o, 0.0) for o in coded.owner]) / sd


def _closes(df: DataFrame, spec: ImputationSpec) -> bool:
    """Whether a gap closes again in the order of the variables that have gaps, asked of the rows."""
    gaps = [v for v, n in df.agg(*[F.count_if(F.col(v).isNull()).alias(v) for v in spec.variables]).head().asDict().items() if n]
    again = [F.col(a).isNull() & F.col(b).isNotNull() for a, b in zip(gaps, gaps[1:])]
    return bool(again) and not df.filter(reduce(lambda x, y: x | y, again)).isEmpty()


def _rows_of(df: DataFrame, specs: dict, spec: ImputationSpec, panel: PanelSpec):
    """The chained regressions of `specs` on rows; the monotone method is one round on the variables before."""
    from visitframe.operators.impute_rows import impute_rows

    if any(s.method == "mvn" for s in specs.values()):
        raise ValueError("the normal model has neither donors nor class variables with gaps")
    if spec.method == "monotone":
        if _closes(df, spec):
            raise ValueError("the monotone method needs gaps that never close in the given variable order")
        before = {v: tuple(spec.variables[:i]) for i, v in enumerate(spec.variables)}
        specs = {name: s.variant(iterations=1, predictors={v: tuple(q for q in s.predictors.get(v, before[v]) if q in before[v]) for v in before}) for name, s in specs.items()}
    return impute_rows(df, specs, panel)


def _check_monotone(problem, coded):
    later = np.cumsum(problem.miss, axis=1) > 0
    incomplete = problem.miss.any(0)
    if (later & ~problem.miss)[:, incomplete].any():
        raise ValueError("the monotone method needs gaps that never close in the given variable order")


class ImputedPanel:
    """A recipe for completed copies of `base`, keyed by (scenario, imp).

    Nothing is stored per copy: `complete()` draws the copies in a narrow pass, and fits
    draw them inside their own kernel (`columns()`, `copier()`). Draws depend on seed, subject, imputation and variable only.
    """

    def __init__(self, base, coded, params, mean, sd, spec: ImputationSpec, panel: PanelSpec = PANEL, specs: dict | None = None, gaps=()):
        """gaps: the variables that have any."""
        self.base, self.coded, self.params, self.gaps = base, coded, params, set(gaps)
        self.mean, self.sd, self.spec, self.panel = mean, sd, spec, panel
        self.settings = {name: (s.seed, s.round_to) for name, s in (specs or {"": spec}).items()}
        self.keys, self.name = sorted(params), uuid.uuid4().hex

    def over(self, base: DataFrame) -> ImputedPanel:
        """The same copies of a table that has more columns than `base` for the same subjects."""
        out = copy.copy(self)
        out.base = base
        return out

    @property
    def whole(self):
        """Positions of the variables whose column holds whole numbers; their draws are rounded."""
        kinds = {f.name: f.dataType for f in self.base.schema.fields}
        return [i for i, (n, o) in enumerate(zip(self.coded.names, self.coded.owner)) if n == f"v__{o}" and isinstance(kinds[o], T.IntegralType)]

    def columns(self) -> list:
        """What a pass must select from `base`, beside the id, for copier()."""
        return list(self.coded.exprs)

    def copier(self):
        """A picklable function: batch with columns() -> its values with gaps, iterator of (key, completed values)."""
        params = self.base.sparkSession.sparkContext.broadcast(self.params)
        mean, sd, settings, keys, whole = self.mean, self.sd, self.settings, self.keys, self.whole
        id, names = self.panel.id, self.coded.names
        normal, recipe = any(kind == "normal" for kind, _ in self.params.values()), self.name

        def copies(pdf):
            solved = _solved(recipe)
            raw = pdf[names].to_numpy(float)
            gone = np.isnan(raw)

            def each():
                start = (raw - mean) / sd
                state = noise.subject_state(pdf[id].to_numpy())
                at = [np.flatnonzero(g) for g in gone.T]
                held = [[h[i] for h in state] for i in at]
                groups = _pattern_rows(gone) if normal else None
                for key in keys:
                    kind, payload = params.value[key]
                    seed, rnd = settings[key[0]]
                    if kind == "chain":
                        v = _replay_chain(payload, start, gone, at, held, seed, key[1])
                    else:
                        v = _replay_normal(payload, start, gone, at, held, seed, key[1], groups, solved, key)
                    yield key, _finished(v * sd + mean, raw, gone, rnd, whole)

            return raw, each()

        return copies

    def class_columns(self) -> dict:
        """Class variables by name: (levels, positions of their indicators)."""
        return {o: (self.coded.levels[o], self.coded.of.get(o, [])) for o in self.spec.categorical if o in self.coded.levels}

    def complete(self, keep=None, scenario: bool | None = None) -> DataFrame:
        """Stacked completed rows with `imp` (and `scenario` when there is more than one)."""
        if scenario is None:
            scenario = any(s for s, _ in self.keys)
        columns = [c for c in (self.base.columns if keep is None else keep) if c != "fills" or keep is not None]
        kinds = {f.name: f.dataType for f in self.base.schema.fields}
        take = [(o, i) for i, (n, o) in enumerate(zip(self.coded.names, self.coded.owner)) if n == f"v__{o}" and o in columns and o not in self.spec.categorical]
        classes = {o: x for o, x in self.class_columns().items() if o in columns}
        lead = ([T.StructField("scenario", T.StringType())] if scenario else []) + [T.StructField("imp", T.IntegerType())]
        schema = T.StructType(lead + [T.StructField(c, kinds[c]) for c in columns])
        copies, whole = self.copier(), set(self.whole)
        text = {o for o in classes if isinstance(kinds[o], T.StringType)}

        def run(batches):
            for pdf in batches:
                if len(pdf) == 0:
                    continue
                raw, each = copies(pdf)
                gone = np.isnan(raw)
                some = gone.any(0)
                for (sc, imp), v in each:
                    out = pdf[columns].copy(deep=False)
                    for o, i in take:
                        if some[i]:
                            out[o] = pd.array(v[:, i], dtype="Int64") if i in whole else v[:, i]
                    for o, (levels, at) in classes.items():
                        if at and some[at[0]]:
                            picked = np.array(levels, object)[np.where(v[:, at].max(1) > 0.5, v[:, at].argmax(1) + 1, 0)]
                            new = np.where(gone[:, at[0]], picked, out[o].to_numpy(object))
                            out[o] = new if o in text else pd.array([int(x) for x in new], dtype="Int64")
                    out.insert(0, "imp", np.int32(imp))
                    if scenario:
                        out.insert(0, "scenario", sc)
                    yield out

        id = self.panel.id
        return self.base.select(*dict.fromkeys([*columns, id]), *self.columns()).mapInPandas(run, schema)


class FilledPanel(ImputedPanel):
    """The same for copies whose filled cells lie beside the subject (impute_rows): fits and `complete()` read them there."""

    def __init__(self, df, coded, fills: DataFrame, specs: dict, panel: PanelSpec = PANEL, gaps=()):
        first = next(iter(specs.values()))
        order = [(name, i) for name, s in specs.items() for i in range(1, s.m + 1)]
        super().__init__(df.join(fills, panel.id), coded, {key: k for k, key in enumerate(order)}, 0.0, 1.0, first, panel, specs, gaps)

    def columns(self) -> list:
        return [*self.coded.exprs, F.col("fills")]

    def copier(self):
        from visitframe.operators.impute_rows import Cells

        number, settings, keys, whole, id, names = self.params, self.settings, self.keys, self.whole, self.panel.id, self.coded.names

        def copies(pdf):
            cells = Cells(pdf, names, id, len(number))
            return cells.raw, ((key, _finished(cells.values(number[key]), cells.raw, cells.gone, settings[key[0]][1], whole)) for key in keys)

        return copies


def _finished(v, raw, gone, round_to, whole):
    """Drawn values rounded as asked, observed ones as they were."""
    if round_to:
        v = np.round(v / round_to) * round_to
    v[:, whole] = np.rint(v[:, whole])
    return np.where(gone, v, raw)


def _pattern_rows(gone) -> list:
    """(pattern, its rows) of each missing pattern of a batch that has gaps."""
    packed = np.packbits(gone, axis=1)
    packed = np.ascontiguousarray(packed).view(f"V{packed.shape[1]}").ravel()
    order = np.argsort(packed, kind="stable")
    cuts = np.flatnonzero(packed[order][1:] != packed[order][:-1]) + 1
    return [(packed[rows[0]].tobytes(), rows) for rows in np.split(order, cuts) if len(rows) and gone[rows[0]].any()]


def _replay_chain(steps, start, gone, at, state, seed, imp):
    """Rows with the chain's draws; `at`, `state`: the rows without each variable and their noise states."""
    v = np.where(gone, 0.0, start)
    for sweep, j, pred, coef, sd in steps:
        if len(at[j]):
            z = noise.normals(state[j], seed, imp, j, sweep)
            v[at[j], j] = coef[0] + v[np.ix_(at[j], pred)] @ coef[1:] + sd * z
    return v


def _replay_normal(theta, start, gone, at, state, seed, imp, groups, solved, key):
    """Rows with the normal model's draws; `groups`: _pattern_rows(), `solved`: what (copy, pattern) came to in earlier batches."""
    mu, sigma, shift = theta
    v, z = np.where(gone, 0.0, start), np.zeros(gone.shape)
    for j, rows in enumerate(at):
        if len(rows):
            z[rows, j] = noise.normals(state[j], seed, imp, j, 0)
    for bits, rows in groups:
        rule = solved.get((key, bits))
        if rule is None:
            o, m, w, c = chains._condition(gone[rows[0]], mu, sigma)
            # Cells of the pattern from (1, observed, noise) in one product.
            rule = o, m, np.vstack([w[1:], chains._root(c).T]), w[0] + shift[m]
            if len(solved) * 8 * len(mu) ** 2 < KEPT_BYTES:
                solved[key, bits] = rule
        o, m, w, first = rule
        v[np.ix_(rows, m)] = first + np.hstack([v[np.ix_(rows, o)], z[np.ix_(rows, m)]]) @ w
    return v


def _solved(recipe: str) -> dict:
    """Solved regressions of a recipe; a worker keeps those of one, from task to task."""
    if recipe not in _SOLVED:
        _SOLVED.clear()
        _SOLVED[recipe] = {}
    return _SOLVED[recipe]


def _run_chains(spark, problem, coded, specs: dict, keys):
    """Draw the parameters of every (scenario, imp); each chain is an independent task."""
    import pickle

    ready = {
        name: (s.method, s.seed, s.iterations, s.ridge, s.proper, _index_predictors(s, coded),
               _shift(s, coded, problem.sd))
        for name, s in specs.items()
    }
    plain = (problem.S, problem.n, problem.miss, problem.mean, problem.sd)
    shared = spark.sparkContext.broadcast((plain, ready))

    def run(batches):
        plain, ready = shared.value
        problem = chains.Problem(*plain)
        held = chains.Held(problem)
        for pdf in batches:
            for sc, imp in zip(pdf["scenario"], pdf["imp"]):
                method, seed, sweeps, ridge, proper, preds, shift = ready[sc]
                rng = noise.generator(seed, imp)
                if method == "mvn":
                    out = ("normal", (*chains.augmented(held, sweeps, seed, {imp: rng})[imp], shift))
                else:
                    n = 0 if method == "monotone" else sweeps
                    out = ("chain", chains.chained(problem, preds, n, ridge, shift, rng, seed, imp, proper))
                yield pd.DataFrame({"scenario": [sc], "imp": [imp], "payload": [pickle.dumps(out)]})

    todo = spark.createDataFrame(keys, "scenario string, imp int").repartition(len(keys))
    rows = todo.mapInPandas(run, "scenario string, imp int, payload binary").collect()
    return {(r["scenario"], r["imp"]): pickle.loads(r["payload"]) for r in rows}


def _states(pdf, p: int, scale, fresh: bool, keys):
    """(key number, chains.Copy) of a batch of pattern rows; `fresh` rows are raw sums that every key starts from."""
    for at in range(0, len(pdf), 512):
        part = pdf.iloc[at:at + 512]
        if fresh:
            made = chains.standardise(*_unpacked(part["pattern"], part["values"], p), scale)
            state = chains.pattern_noise(made.miss)
            for k in keys:
                yield k, part["pattern"], chains.Copy(made.S.copy(), made.n, made.miss, state)
            continue
        for k, mine in part.groupby("k"):
            S, miss = _unpacked(mine["pattern"], mine["values"], p)
            yield int(k), mine["pattern"], chains.Copy(S, S[:, 0, 0], miss, chains.pattern_noise(miss))


def spread_chains(sums: Spread, coded: Coded, specs: dict) -> dict:
    """The steps that chains.chained draws on held sums, for all scenarios and imputations together over a table of patterns.

    A regression is one Spark job that adds up every key's sums over the patterns that have the variable; its draw goes back to
    the next job, which redraws the variable pattern by pattern first. After each round the copies' sums are written anew in
    the shared folder and the round before is removed, so a pattern redraws one round at most.
    """
    p, scale = sums.p, sums.scale
    keys = [(name, i) for name, s in specs.items() for i in range(1, s.m + 1)]
    gaps = [int(j) for j in np.flatnonzero(sums.gaps)]
    rngs = {key: noise.generator(specs[key[0]].seed, key[1]) for key in keys}
    shift = {name: _shift(s, coded, sums.sd) for name, s in specs.items()}
    plans = {name: chains.schedule(gaps, p, _index_predictors(s, coded), 0 if s.method == "monotone" else s.iterations) for name, s in specs.items()}
    steps = {key: [] for key in keys}
    table, fresh, path, pending = sums.table, True, None, 0
    for at in range(max(map(len, plans.values()), default=0)):
        live = [k for k, (name, _) in enumerate(keys) if at < len(plans[name])]
        want = {k: plans[keys[k][0]][at][1] for k in live}
        todo = {k: (specs[keys[k][0]].seed, keys[k][1], steps[keys[k]][pending:]) for k in live}

        def kernel(pdf, fresh=fresh, want=want, todo=todo):
            for k, _, copy in _states(pdf, p, scale, fresh, todo):
                if k in todo:
                    seed, imp, new = todo[k]
                    for step in new:
                        copy.fill(step, seed, imp)
                    yield (k,), copy.total(want[k]).ravel()

        totals = collect_sums(table, kernel, [("k", "int")])
        for k in live:
            key, spec = keys[k], specs[keys[k][0]]
            total = totals.get((k,), np.zeros((p + 1) ** 2)).reshape(p + 1, p + 1)
            steps[key].append(chains.regression_step(total, *plans[key[0]][at], spec.ridge, shift[key[0]], rngs[key], spec.proper))
        done = at + 1
        if gaps and done % len(gaps) == 0 and any(done < len(plan) for plan in plans.values()):
            going = {k: (specs[keys[k][0]].seed, keys[k][1], steps[keys[k]][pending:]) for k in live if done < len(plans[keys[k][0]])}

            def redraw(batches, fresh=fresh, going=going):
                for pdf in batches:
                    for k, patterns, copy in _states(pdf, p, scale, fresh, going):
                        if k in going:
                            seed, imp, new = going[k]
                            for step in new:
                                copy.fill(step, seed, imp)
                            yield pd.DataFrame({"pattern": patterns.to_numpy(), "k": np.int32(k), "values": [upper(S) for S in copy.S]})

            before, path = path, shared_path(sums.table.sparkSession)
            table.mapInPandas(redraw, "pattern string, k int, values array<double>").write.parquet(path)
            table, fresh, pending = sums.table.sparkSession.read.parquet(path), False, done
            if before:
                remove(sums.table.sparkSession, before)
    if path:
        remove(sums.table.sparkSession, path)
    return {key: ("chain", s) for key, s in steps.items()}


def _closing_gap(sums: Spread, coded: Coded) -> bool:
    def work(raw, miss):
        later = np.cumsum(miss, axis=1) > 0
        return {(0,): (later & ~miss).any(0).astype(float)}

    closed = collect_sums(sums.table, sums._over(work), [("k", "int")])
    return bool((closed[(0,)][sums.gaps] > 0).any())


def impute(df: DataFrame, spec: ImputationSpec, scenarios: dict | None = None,
           panel: PanelSpec = PANEL) -> ImputedPanel:
    """Impute `df` under one spec, or under several that share the same variables.

    `scenarios` maps a name to a variant (shift, predictors, ...); all of them share the one pass
    that sums the rows. Pattern sums of any size give the same numbers. Chains with matching on donors or class gaps run row-wise instead.
    """
    specs = scenarios or {"": spec}
    coded = Coded.build(df, spec)
    donor = any(m == "pmm" for s in specs.values() for m in s.columns.values())
    sums = None if donor else load_sums(df, coded)
    if sums is not None:
        gaps = {coded.owner[j] for j in np.flatnonzero(sums.gaps if isinstance(sums, Spread) else sums.problem.miss.any(0))}
        if gaps & set(spec.categorical):
            sums = None
    if sums is None:
        return _rows_of(df, specs, spec, panel)
    monotone = any(s.method == "monotone" for s in specs.values())
    if isinstance(sums, Spread):
        if monotone and _closing_gap(sums, coded):
            raise ValueError("the monotone method needs gaps that never close in the given variable order")
        params = spread_chains(sums, coded, {name: s for name, s in specs.items() if s.method != "mvn"})
        for name, s in specs.items():
            if s.method == "mvn":
                thetas = chains.augmented(sums, s.iterations, s.seed, {i: noise.generator(s.seed, i) for i in range(1, s.m + 1)})
                params |= {(name, i): ("normal", (*t, _shift(s, coded, sums.sd))) for i, t in thetas.items()}
        return ImputedPanel(df, coded, params, sums.mean, sums.sd, spec, panel, specs, gaps)
    problem = sums.problem
    if monotone:
        _check_monotone(problem, coded)
    keys = [(name, i) for name, s in specs.items() for i in range(1, s.m + 1)]
    params = _run_chains(df.sparkSession, problem, coded, specs, keys)
    return ImputedPanel(df, coded, params, problem.mean, problem.sd, spec, panel, specs, gaps)


def delta_adjust(imputed: DataFrame, original: DataFrame, cols, shift: float, id: str = "PATID") -> DataFrame:
    """Add `shift` to the cells that were missing before imputation."""
    from visitframe.operators.joins import attach_originals

    both = attach_originals(imputed, original, cols, id)
    moved = {c: F.when(F.col(f"o_{c}").isNull(), F.col(c) + shift).otherwise(F.col(c)) for c in cols}
    return both.withColumns(moved).drop(*[f"o_{c}" for c in cols])


def imputation_audit(imputed: DataFrame, original: DataFrame, cols, id: str = "PATID") -> DataFrame:
    """Per imputation and column: rows, filled cells, cells left empty, observed cells changed, observed mean."""
    from visitframe.operators.joins import attach_originals

    both = attach_originals(imputed, original, cols, id)
    rows = F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).alias("now"), F.col(f"o_{c}").alias("was")) for c in cols
    ])
    was, now = F.col("was"), F.col("now")
    return both.select("imp", F.inline(rows)).groupBy("imp", "variable").agg(
        F.count("*").alias("n"), F.count_if(was.isNull() & now.isNotNull()).alias("n_imputed"),
        F.count_if(now.isNull()).alias("n_left"),
        F.count_if(was.isNotNull() & (now != was)).alias("n_changed"),
        F.round(F.avg(was), 6).alias("mean_observed"))
