"""Chained imputation row by row, for what pattern sums cannot express: donor matching (pmm) and class variables with gaps.

A subject stays one row: its values once, and in `fills` the filled cells of every copy, copy after copy, for all scenarios and
imputations together. A regression or class draw is a rule that the next pass replays; rows are written anew once a round
and after each matching, in the shared folder, and the table before is removed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitframe.functions import noise
from visitframe.functions.cluster import remove, settle, shared_path
from visitframe.operators.chains import _root, _wishart, posterior_draw
from visitframe.operators.moments import collect_sums, symmetric, upper
from visitframe.spec import PANEL, ImputationSpec, PanelSpec

DONORS = 5
PART_ROWS = 200_000


class Cells:
    """The copies of a batch of subjects."""

    def __init__(self, pdf, names, id, copies):
        self.raw = pdf[names].to_numpy(float)
        self.gone, self.ids, self.copies = np.isnan(self.raw), pdf[id].to_numpy(), copies
        self.n_gaps = self.gone.sum(1)
        self.state = noise.subject_state(self.ids)
        start = np.cumsum(self.n_gaps * copies) - self.n_gaps * copies
        within = np.arange(self.n_gaps.sum()) - np.repeat(np.cumsum(self.n_gaps) - self.n_gaps, self.n_gaps)
        self.at, self.step = np.repeat(start, self.n_gaps) + within, np.repeat(self.n_gaps, self.n_gaps)
        self.flat = np.frombuffer(b"".join(pdf["fills"]), float) if "fills" in pdf else np.zeros(int((self.n_gaps * copies).sum()))

    def values(self, k):
        v = self.raw.copy()
        v[self.gone] = self.flat[self.at + k * self.step]
        return v

    def packed(self, copies) -> list:
        """`fills` of each subject from the completed values of every copy in order."""
        out = np.empty(len(self.flat))
        for k, v in enumerate(copies):
            out[self.at + k * self.step] = v[self.gone]
        ends = np.cumsum(self.n_gaps * self.copies) * 8
        data = out.tobytes()
        return [data[a:b] for a, b in zip(np.r_[0, ends[:-1]], ends)]

    def replay(self, v, steps, seed, imp):
        for kind, sweep, cols, pred, rule in steps:
            at = np.flatnonzero(self.gone[:, cols[0]])
            if not len(at):
                continue
            mine = [h[at] for h in self.state]
            if kind == "class":
                score = rule[:, 0] + v[np.ix_(at, pred)] @ rule[:, 1:].T
                prob = np.exp(score - score.max(1, keepdims=True))
                edge = np.cumsum(prob / prob.sum(1, keepdims=True), axis=1)
                pick = np.minimum((noise.uniforms(mine, seed, imp, cols[0], sweep)[0][:, None] > edge).sum(1), len(cols))
                v[np.ix_(at, cols)] = (pick[:, None] == np.arange(1, len(cols) + 1)).astype(float)
            else:
                coef, sd, shift = rule
                v[at, cols[0]] = coef[0] + v[np.ix_(at, pred)] @ coef[1:] + sd * noise.normals(mine, seed, imp, cols[0], sweep) + shift
        return v


class _Run:
    """Subjects' rows under way: the table, what is still to be replayed, and how to go over all copies."""

    def __init__(self, df, coded, specs, panel):
        self.spark, self.coded, self.names, self.id = df.sparkSession, coded, coded.names, panel.id
        self.specs = specs
        self.keys = [(name, i) for name, s in specs.items() for i in range(1, s.m + 1)]
        self.steps, self.path, self.done = [[] for _ in self.keys], None, 0
        self.table = df.select(panel.id, *coded.exprs)

    def over(self):
        """A picklable function: batch -> Cells and an iterator of (copy number, completed values)."""
        names, id, n = self.names, self.id, len(self.keys)
        todo = [(self.specs[name].seed, imp, s[self.done:]) for (name, imp), s in zip(self.keys, self.steps)]

        def copies(pdf):
            cells = Cells(pdf, names, id, n)
            return cells, ((k, cells.replay(cells.values(k), new, seed, imp)) for k, (seed, imp, new) in enumerate(todo))

        return copies

    def write(self, extra=None, put=None):
        """Rows with all that was drawn; `extra` brings columns by id; `put` makes of a batch what is done to each of its copies."""
        names, id, over = self.names, self.id, self.over()

        def run(batches):
            for pdf in batches:
                if len(pdf) == 0:
                    continue
                cells, copies = over(pdf)
                change = put(pdf, cells) if put else lambda k, v: v
                done = (change(k, v) for k, v in copies)
                yield pdf[[id, *names]].assign(fills=cells.packed(done))

        schema = T.StructType([self.table.schema[id], *[T.StructField(n, T.DoubleType()) for n in names], T.StructField("fills", T.BinaryType())])
        rows = self.table if extra is None else self.table.join(extra, id, "left")
        before, self.path = self.path, shared_path(self.spark)
        rows.mapInPandas(run, schema).write.parquet(self.path)
        self.table = self.spark.read.parquet(self.path)
        self.done = len(self.steps[0])
        if before:
            remove(self.spark, before)

    def sums(self, pred, cols, by_class=False) -> dict:
        """Cross-products of (1, predictors, target) over the rows that have the target, per copy (and class, without the target)."""
        over, j = self.over(), cols[0]

        def kernel(pdf):
            cells, copies = over(pdf)
            seen = ~cells.gone[:, j]
            for k, v in copies:
                if by_class:
                    own = v[:, cols]
                    label = np.where(own.max(1) > 0.5, own.argmax(1) + 1, 0)
                    for c in np.unique(label[seen]):
                        z = np.column_stack([np.ones((seen & (label == c)).sum()), v[seen & (label == c)][:, pred[k]]])
                        yield (k, int(c)), upper(z.T @ z)
                else:
                    z = np.column_stack([np.ones(seen.sum()), v[seen][:, [*pred[k], j]]])
                    yield (k, 0), upper(z.T @ z)

        return collect_sums(self.table, kernel, [("k", "int"), ("c", "int")])


def _begin(run: _Run, spec: ImputationSpec):
    """The gaps in order, filled by mean and noise (class variables: by the commonest class)."""
    names, coded = run.names, run.coded
    stats = run.table.agg(*[F.avg(n).alias(f"m{i}") for i, n in enumerate(names)], *[F.stddev_samp(n).alias(f"s{i}") for i, n in enumerate(names)],
                          *[F.count_if(F.col(n).isNull()).alias(f"g{i}") for i, n in enumerate(names)], F.count("*").alias("rows")).first()
    run.rows = stats["rows"]
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(len(names))])
    sd = np.array([stats[f"s{i}"] or 0.0 for i in range(len(names))])
    units = []
    for owner in dict.fromkeys(coded.owner[i] for i in range(len(names)) if stats[f"g{i}"] > 0):
        cols = coded.of[owner]
        units.append(("class" if owner in spec.categorical else spec.columns.get(owner, "reg"), owner, cols))
    common = {cols[0]: int(np.argmax([1 - mean[cols].sum(), *mean[cols]])) for kind, _, cols in units if kind == "class"}
    seeds = [(run.specs[name].seed, imp) for name, imp in run.keys]

    def put(pdf, cells):
        def change(k, v):
            for kind, _, cols in units:
                at = cells.gone[:, cols[0]]
                if kind == "class":
                    v[np.ix_(at, cols)] = (np.arange(1, len(cols) + 1) == common[cols[0]]).astype(float)
                else:
                    z = noise.normals([h[at] for h in cells.state], *seeds[k], cols[0], 0)
                    v[at, cols[0]] = mean[cols[0]] + sd[cols[0]] * z
            return v

        return change

    run.write(put=put)
    return units


def _class_rule(per: dict, n_class: int, rng) -> np.ndarray:
    """A discriminant rule with class means, shared covariance and shares drawn from their posterior."""
    q = next(iter(per.values())).shape[0]
    total = sum(s[0, 0] for s in per.values())
    within = sum(s[1:, 1:] - np.outer(s[0, 1:], s[0, 1:]) / s[0, 0] for s in per.values())
    within = within + np.diag(np.maximum(np.diag(within), 1.0) * 1e-8)
    root = _root(np.linalg.inv(within))
    precision = root @ _wishart(total - len(per), q - 1, rng) @ root.T
    cov = np.linalg.pinv(precision, hermitian=True)
    share = rng.dirichlet([per[c][0, 0] if c in per else 1e-9 for c in range(n_class)])
    rule = np.zeros((n_class, q))
    rule[:, 0] = -np.inf
    for c, s in sorted(per.items()):
        mean = s[0, 1:] / s[0, 0] + _root(cov / s[0, 0]) @ rng.standard_normal(q - 1)
        w = precision @ mean
        rule[c] = np.concatenate([[np.log(max(share[c], 1e-300)) - 0.5 * mean @ w], w])
    return rule


def _nearest_values(h, value, donor, need, before, after, donors, u):
    """Value of one of the `donors` nearest donors of each row of `need`; `before`, `after`: (prediction, value) of donors beyond the rows."""
    own = np.flatnonzero(donor)
    place = np.concatenate([before[0], h[own], after[0]])
    held = np.concatenate([before[1], value[own], after[1]])
    upto = np.cumsum(donor)[need] + len(before[0])
    cand = upto[:, None] + np.arange(-donors, donors)[None, :]
    inside = (cand >= 0) & (cand < len(held))
    cand = np.clip(cand, 0, max(len(held) - 1, 0))
    gap = np.where(inside, np.abs(place[cand] - h[need][:, None]), np.inf)
    rank = np.argsort(gap, axis=1, kind="stable")
    choice = rank[np.arange(len(need)), np.floor(u * np.minimum(inside.sum(1), donors)).astype(int)]
    return held[cand[np.arange(len(need)), choice]]


def match_donors(run: _Run, j: int, params: list, pred: list, sweep: int, donors: int = DONORS, part_rows: int = PART_ROWS) -> DataFrame:
    """id, got array<double>: for each subject without variable j the value of a near donor in every copy.

    Only (copy, prediction, tie, value, id) are sorted, in as many ranges as there are `part_rows` of them, so a range is a bounded number of
    rows; ties stand in the order of a hash of the id and never part a range from its size. Predictions just outside a range can
    only be the last or first few of its neighbours, which are shared as ranges x donors rows. A range is gone through chunk by
    chunk: a row is settled once `donors` donors have passed it, with the last `donors` before the chunk carried along.
    """
    kind = run.table.schema[run.id].dataType.simpleString()
    over, id, seeds, n = run.over(), run.id, [(run.specs[name].seed, imp) for name, imp in run.keys], len(run.keys)

    def predict(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            cells, copies = over(pdf)
            gap = cells.gone[:, j]
            tie = noise.subject_state(cells.ids)[0]
            for k, v in copies:
                drawn, point = params[k]
                x = np.column_stack([np.ones(len(v)), v[:, pred[k]]])
                yield pd.DataFrame({"k": np.full(len(v), k, np.int32), "h": np.where(gap, x @ drawn, x @ point), "tie": tie, "y": cells.raw[:, j], "donor": ~gap, "id": cells.ids})

    rows = run.table.mapInPandas(predict, f"k int, h double, tie long, y double, donor boolean, id {kind}")
    parts = max(1, -(-run.rows * n // part_rows))
    order = ["k", "h", "tie", "id"]
    if parts > 1:
        ranged = settle(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    else:
        ranged = rows.repartition(1).sortWithinPartitions(*order)

    def borders(batches):
        pid = TaskContext.get().partitionId()
        first, last = {}, {}
        for pdf in batches:
            part = pdf[pdf["donor"]]
            for k, g in part.groupby("k"):
                ends = [list(zip(e["h"], e["y"])) for e in (g.iloc[:donors], g.iloc[-donors:])]
                f = first.setdefault(k, [])
                f.extend(ends[0][: donors - len(f)])
                last[k] = (last.get(k, []) + ends[1])[-donors:]
        rows = [(pid, int(k), side, i, float(h), float(y)) for side, held in ((0, first), (1, last)) for k, items in held.items() for i, (h, y) in enumerate(items)]
        yield pd.DataFrame(rows, columns=["pid", "k", "side", "i", "h", "y"])

    edges = {}
    if parts > 1:
        edge = ranged.select("k", "h", "y", "donor").mapInPandas(borders, "pid int, k int, side int, i int, h double, y double").toPandas()
        edges = {(int(k), int(side)): (g["pid"].to_numpy(), g["h"].to_numpy(), g["y"].to_numpy()) for (k, side), g in edge.sort_values(["pid", "i"]).groupby(["k", "side"])}
    shared = run.spark.sparkContext.broadcast(edges)

    def beyond(k, side, pid):
        at, h, y = shared.value.get((k, side), (np.array([]),) * 3)
        keep = at < pid if side else at > pid
        return (h[keep][-donors:], y[keep][-donors:]) if side else (h[keep][:donors], y[keep][:donors])

    def settle_rows(k, block, before, after):
        h, donor = block["h"].to_numpy(), block["donor"].to_numpy(bool)
        need = np.flatnonzero(~donor)
        if not len(need) or not donor.any() and not len(before[0]) and not len(after[0]):
            return None
        ids = block["id"].to_numpy()[need]
        u = noise.uniforms(noise.subject_state(ids), *seeds[k], j, sweep)[0]
        return pd.DataFrame({"id": ids, "k": np.int32(k), "v": _nearest_values(h, block["y"].to_numpy(), donor, need, before, after, donors, u)})

    def match(batches):
        pid = TaskContext.get().partitionId()
        now, held, before = None, None, None
        for pdf in batches:
            for k, part in pdf.groupby("k", sort=True):
                k = int(k)
                if k != now:
                    if now is not None and len(held):
                        out = settle_rows(now, held, before, beyond(now, 0, pid))
                        if out is not None:
                            yield out
                    now, held, before = k, part.iloc[:0], beyond(k, 1, pid)
                held = pd.concat([held, part], ignore_index=True) if len(held) else part.reset_index(drop=True)
                donor = np.flatnonzero(held["donor"].to_numpy(bool))
                if len(donor) <= donors:
                    continue
                # rows up to the donor that has `donors` behind it are settled
                cut = int(donor[-donors])
                ready, rest = held.iloc[:cut], held.iloc[cut:]
                tail = rest[rest["donor"]]
                out = settle_rows(k, ready, before, (tail["h"].to_numpy(), tail["y"].to_numpy()))
                if out is not None:
                    yield out
                seen = ready[ready["donor"]].iloc[-donors:]
                before = tuple(np.concatenate([b, seen[c].to_numpy()])[-donors:] for b, c in zip(before, ("h", "y")))
                held = rest
        if now is not None and len(held):
            out = settle_rows(now, held, before, beyond(now, 0, pid))
            if out is not None:
                yield out

    found = ranged.mapInPandas(match, f"id {kind}, k int, v double")
    packed = F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: x["v"])
    return found.groupBy(F.col("id").alias(id)).agg(packed.alias("got")).filter(F.size("got") == n)


def _taking(j: int, shift: list):
    """For _Run.write(): the donors' values of variable j, unpacked once for all copies of a batch."""

    def put(pdf, cells):
        have = np.flatnonzero(cells.gone[:, j] & pdf["got"].notna().to_numpy())
        got = np.stack(pdf["got"].to_numpy()[have]) if len(have) else None

        def change(k, v):
            if len(have):
                v[have, j] = got[:, k] + shift[k]
            return v

        return change

    return put


def impute_rows(df: DataFrame, specs: dict, panel: PanelSpec = PANEL, part_rows: int = PART_ROWS):
    """Chained equations on rows for all scenarios of `specs` together; `columns` picks reg, norm or pmm per variable.

    Scenarios share variables, methods and rounds; predictors, shifts, seeds and m may differ.
    """
    from visitframe.operators.impute import Coded, FilledPanel, _index_predictors

    spec = next(iter(specs.values()))
    if any((s.variables, s.categorical, s.columns, s.iterations) != (spec.variables, spec.categorical, spec.columns, spec.iterations) for s in specs.values()):
        raise ValueError("scenarios of the row-wise chain share variables, methods and rounds")
    coded = Coded.build(df, spec)
    run = _Run(df, coded, specs, panel)
    units = _begin(run, spec)
    allowed = {name: _index_predictors(s, coded) for name, s in specs.items()}
    every = range(len(run.names))
    for sweep in range(1, max(spec.iterations, 1) + 1):
        for kind, owner, cols in units:
            j = cols[0]
            pred = [[i for i in every if i not in cols and (j not in allowed[name] or i in allowed[name][j])] for name, _ in run.keys]
            sums = run.sums(pred, cols, kind == "class")
            if kind == "class":
                for k, (name, imp) in enumerate(run.keys):
                    per = {c: symmetric(v, len(pred[k]) + 1) for (i, c), v in sums.items() if i == k}
                    rule = _class_rule(per, len(cols) + 1, noise.generator(specs[name].seed, imp, j, sweep))
                    run.steps[k].append(("class", sweep, cols, pred[k], rule))
                continue
            params = []
            for k, (name, imp) in enumerate(run.keys):
                s, t = specs[name], symmetric(sums[k, 0], len(pred[k]) + 2)
                rng = noise.generator(s.seed, imp, j, sweep)
                xx, xy, yy, n = t[:-1, :-1], t[:-1, -1], t[-1, -1], t[0, 0]
                point, _ = posterior_draw(xx, xy, yy, n, s.ridge, rng, proper=False)
                drawn, sd = posterior_draw(xx, xy, yy, n, s.ridge, rng, s.proper)
                params.append((drawn, sd, point))
            shift = [specs[name].delta.get(owner, 0.0) for name, _ in run.keys]
            if kind == "pmm":
                got = match_donors(run, j, [(d, p) for d, _, p in params], pred, sweep, part_rows=part_rows)

                run.write(got, _taking(j, shift))
            else:
                for k, (drawn, sd, _) in enumerate(params):
                    run.steps[k].append(("reg", sweep, cols, pred[k], (drawn, sd, shift[k])))
        if run.done < len(run.steps[0]):
            run.write()
    return FilledPanel(df, coded, run.table.select(panel.id, "fills"), specs, panel, [owner for _, owner, _ in units])
