"""Near-duplicate embeddings by a robust-pruned flat graph.

Vectors of one label are split around pivots into overlapping shards, such that the ends of every link share one. Each shard builds a graph: the near
neighbours of a node, pruned so that none is kept that a kept one is clearly nearer to. A node's lists of all its shards are
united. In each shard every vector then searches the united graph: a beam walks greedily from the medoid, and from what it
found the search spreads over all nodes above a looser cosine until nothing new appears. The shard's full matrix audits the search
and adds what it missed. What is reported is verified on the
original vectors in double precision. A pair met in several shards counts in the first they share.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitframe.functions.cluster import attach, settle
from visitframe.llm.ann import usable
from visitframe.llm.components import components

DEGREE, POOL, ALPHA, BEAM, NEAREST = 16, 48, 1.2, 12, 4
CELLS = 4 << 20  # cosines held at once
SHARD_NUMBERS = 4 << 20  # components of a shard's vectors


def _blocks(n: int) -> list[np.ndarray]:
    """Positions in blocks whose cosines with all n take up to about CELLS numbers, 256 positions at most."""
    return np.array_split(np.arange(n), -(-n // max(16, min(256, CELLS // max(n, 1)))))


def pruned_graph(unit: np.ndarray) -> np.ndarray:
    """(n, DEGREE) neighbours by position, -1 where there are fewer: greedy nearest, dropping what a kept one covers."""
    n = len(unit)
    pool = min(POOL, n - 1)
    if pool < 1:
        return np.full((n, 1), -1)
    unit = unit.astype(np.float32)
    links, nearest = np.full((n, DEGREE), -1), np.empty((n, min(NEAREST, pool)), np.int64)
    for block in _blocks(n):
        near, row = unit[block] @ unit.T, np.arange(len(block))
        near[row, block] = -2
        cand = np.argpartition(-near, pool - 1, axis=1)[:, :pool]
        far = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(near, cand, axis=1), 0))
        rows, open_, out = unit[cand], np.ones_like(cand, bool), np.full((len(block), DEGREE), -1)
        for i in range(DEGREE):
            best = np.where(open_, far, np.inf).argmin(axis=1)
            alive = open_[row, best]
            if not alive.any():
                break
            pick = cand[row, best]
            out[alive, i] = pick[alive]
            between = np.sqrt(np.maximum(2 - 2 * np.matmul(rows, unit[pick][:, :, None])[:, :, 0], 0))
            open_ &= ALPHA * between > far
            open_[row, best] = False
        links[block] = out
        # the very nearest stay whatever covers them, which holds groups of near copies together
        nearest[block] = np.take_along_axis(cand, np.argsort(far, axis=1)[:, :NEAREST], axis=1)
    return np.concatenate([links, nearest], axis=1)


def _cosines(unit: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    pieces = len(a) // 50_000 + 1
    return np.concatenate([(unit[x] * unit[y]).sum(axis=1) for x, y in zip(np.array_split(a, pieces), np.array_split(b, pieces))])


def _padded(a: np.ndarray, b: np.ndarray, unit: np.ndarray, most: int = 4 * DEGREE) -> np.ndarray:
    """Neighbours as (n, at most `most`) positions, -1 for none, of links from a to b: a node's own first, then the nearest of those that list it."""
    n = len(unit)
    own = np.unique(a * n + b)
    back = np.setdiff1d(b * n + a, own)
    pairs = np.concatenate([own, back])
    a, b = pairs // n, pairs % n
    order = np.lexsort((-_cosines(unit, a, b), np.arange(len(pairs)) >= len(own), a))
    a, b = a[order], b[order]
    count = np.bincount(a, minlength=n)
    place = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
    out = np.full((n, max(1, min(most, count.max(initial=0)))), -1)
    out[a[place < most], place[place < most]] = b[place < most]
    return out


def range_search(near: np.ndarray, graph: np.ndarray, medoid: int, asked: np.ndarray, least: float, loose: float):
    """Pairs (position in asked, node) with rough cosine >= least, by greedy beams from the medoid and range expansion; near: rough cosines of the asked with all nodes."""
    q, n = near.shape
    near, row = np.concatenate([near, np.full((q, 1), -3.0)], axis=1), np.arange(q)
    seen = np.zeros((q, n + 1), bool)
    seen[:, medoid] = seen[:, n] = True
    beam = np.full((q, BEAM), n)
    score = np.full((q, BEAM), -3.0)
    done = np.ones((q, BEAM), bool)
    beam[:, 0], score[:, 0], done[:, 0] = medoid, near[:, medoid], False
    while not done.all():
        best = np.where(done, -4, score).argmax(axis=1)
        live = np.flatnonzero(~done[row, best])
        node = beam[live, best[live]]
        done[live, best[live]] = True
        nbr = graph[node]
        nbr = np.where((nbr < 0) | seen[live[:, None], nbr], n, nbr)
        seen[live[:, None], nbr] = True
        all_node, all_score = np.concatenate([beam[live], nbr], axis=1), np.concatenate([score[live], near[live[:, None], nbr]], axis=1)
        all_done = np.concatenate([done[live], nbr == n], axis=1)
        keep = np.argpartition(-all_score, BEAM - 1, axis=1)[:, :BEAM]
        beam[live], score[live], done[live] = (np.take_along_axis(x, keep, axis=1) for x in (all_node, all_score, all_done))
    # spread from the beams and the vector itself over everything above the looser cosine
    who, at = np.nonzero(score >= loose)
    who, node = np.concatenate([who, row]), np.concatenate([beam[who, at], asked])
    pairs = np.unique(who * n + node)
    found = pairs
    fresh = np.zeros((q, n + 1), bool)
    fresh[:, n] = True
    fresh[pairs // n, pairs % n] = True
    while len(pairs):
        who, nbr = np.repeat(pairs // n, graph.shape[1]), graph[pairs % n].ravel()
        ok = nbr >= 0
        who, nbr = who[ok], nbr[ok]
        new = ~fresh[who, nbr]
        pairs = np.unique(who[new] * n + nbr[new])
        fresh[pairs // n, pairs % n] = True
        pairs = pairs[near[pairs // n, pairs % n] >= loose]
        found = np.concatenate([found, pairs])
    who, node = found // n, found % n
    pick = near[who, node] >= least - 1e-9
    return who[pick], node[pick]


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    rows = np.stack(frame["vector"].to_numpy()).astype(np.float64)
    graph = pruned_graph(rows / np.sqrt((rows * rows).sum(axis=1))[:, None])
    ids = frame["node"].to_numpy()
    return pd.DataFrame({"node": ids, "links": [np.unique(ids[g[g >= 0]]) for g in graph]})


def _find(threshold: float, loose: float):
    def work(frame: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        ids, copies = frame["node"].to_numpy(), frame["copies"].to_numpy()
        rows, n = np.stack(frame["vector"].to_numpy()).astype(np.float64), len(frame)
        size = np.sqrt((rows * rows).sum(axis=1))
        unit = rows / size[:, None]
        medoid = int((unit @ unit.mean(axis=0)).argmax())
        a, b = np.repeat(np.searchsorted(ids, lists["node"].to_numpy()), lists["links"].map(len)), np.concatenate(lists["links"].to_numpy())
        at = np.minimum(np.searchsorted(ids, b), n - 1)
        here = ids[at] == b
        graph = _padded(a[here], at[here], unit)
        many = frame["homes"].map(len).to_numpy()
        homes = np.full((n, many.max()), -1)
        homes[np.arange(many.max()) < many[:, None]] = np.concatenate(frame["homes"].to_numpy())
        here, links, label = int(frame["shard"].iloc[0]), np.zeros(n, np.int64), np.arange(n)
        ends = []
        for block in _blocks(n):
            # a block's cosines are found once: the walk and the audit look them up
            near = unit[block] @ unit.T
            who, node = range_search(near, graph, medoid, block, threshold, loose)
            # what the search left out of the shard's full matrix is added
            missed = near >= threshold - 1e-9
            missed[who, node] = False
            who, node = (np.concatenate(x) for x in zip((who, node), np.nonzero(missed)))
            who = block[who]
            real = np.concatenate([(rows[w] * rows[m]).sum(axis=1) / (size[w] * size[m]) for w, m in
                                   zip(np.array_split(who, len(who) // 50_000 + 1), np.array_split(node, len(who) // 50_000 + 1))])
            ok = (real >= threshold) & (who != node)
            who, node = who[ok], node[ok]
            ends.append(np.minimum(who, node) * n + np.maximum(who, node))
        # a link found from one end only is a link of both
        pairs = np.unique(np.concatenate(ends))
        a, b = pairs // n, pairs % n
        pieces = len(a) * homes.shape[1] ** 2 // 2_000_000 + 1
        for w, m in zip(np.array_split(a, pieces), np.array_split(b, pieces)):
            shared = (homes[w][:, :, None] == homes[m][:, None, :]) & (homes[w][:, :, None] >= 0)
            first = np.where(shared.any(axis=2), homes[w], np.iinfo(np.int64).max).min(axis=1) == here
            np.add.at(links, w[first], copies[m[first]])
            np.add.at(links, m[first], copies[w[first]])
        while True:
            before = label.copy()
            np.minimum.at(label, a, label[b])
            np.minimum.at(label, b, label[a])
            label = label[label]
            if (label == before).all():
                break
        return pd.DataFrame({"node": ids, "links": links, "root": ids[label]})

    return work


def shards_of(nodes: DataFrame, most: int = 65_536, fan: int = 24, seed: int = 3) -> DataFrame:
    """node, homes: the overlapping shards of each of nodes (node, label, vector, reach), sorted; two nodes of a label within `reach` share one at least.

    A group of more than `most` nodes (fewer where their vectors have more than SHARD_NUMBERS components, 3,072 at least) draws about min(fan, 4 * rows / most) pivots by hash. A node joins the group of its nearest pivot p and of
    each pivot q whose half-space (nearer to q than to p) begins within its reach, so the nearest pivot's group of one end of a pair holds
    the other end too. A split that saves less than a third of the comparisons is not made: such a group, as random vectors
    make it, is dealt by hash to parts of about half of `most`, and each two parts are a shard.
    """
    groups = nodes.select("node", "label", "vector", "reach", F.shiftrightunsigned(F.xxhash64("label"), 1).alias("shard"))
    held = F.least(F.lit(most), F.greatest(F.lit(3072), F.floor(SHARD_NUMBERS / F.max(F.size("vector")))))
    thin = ["node", "label", "vector", "shard"]
    home = ["node", "shard"]
    done, firm = [], []
    for level in range(12):
        sizes = settle(groups.groupBy("shard").agg(F.count("*").alias("rows"), held.cast("long").alias("most")).filter("rows > most"))
        if sizes.isEmpty():
            break
        sized = attach(groups, sizes, ["shard"])
        done.append(sized.filter(F.col("rows").isNull()).select(*home))
        big = sized.filter(F.col("rows").isNotNull())
        chance = F.least(F.lit(float(fan)), F.ceil(F.col("rows") / F.col("most")) * 4.0) / F.col("rows")
        draw = F.pmod(F.xxhash64("node", F.lit(seed + level)), F.lit(1 << 30)) / float(1 << 30)
        pivots = settle(big.filter(draw < chance).groupBy("shard").agg(F.collect_list(F.struct("node", "vector")).alias("at")))

        def deal(frames):
            for frame in frames:
                out = []
                for shard, g in frame.groupby("shard"):
                    at = g["at"].iloc[0]
                    if at is None:
                        out.append(g.drop(columns="at").assign(homes=[[shard]] * len(g)))
                        continue
                    order = np.argsort(names := np.array([x["node"] for x in at], np.int64))
                    piv = np.stack([np.asarray(at[i]["vector"], np.float64) for i in order])
                    piv /= np.sqrt((piv * piv).sum(axis=1))[:, None]
                    rows = np.stack(g["vector"].to_numpy()).astype(np.float64)
                    near = (rows / np.sqrt((rows * rows).sum(axis=1))[:, None]) @ piv.T
                    first = near.argmax(axis=1)
                    apart = np.sqrt(((piv[:, None] - piv) ** 2).sum(axis=2))
                    joins = near.max(axis=1)[:, None] - near <= g["reach"].to_numpy()[:, None] * apart[first] + 1e-9
                    # a group's name is that of its parent and pivot together
                    homes = ((names[order] ^ np.int64(shard)) * np.int64(6364136223846793005)) & np.int64((1 << 63) - 1)
                    out.append(g.drop(columns="at").assign(homes=[homes[j] for j in joins]))
                yield pd.concat(out)[[*thin, "reach", "rows", "most", "homes"]] if out else pd.DataFrame({c: [] for c in [*thin, "reach", "rows", "most", "homes"]})

        dealt = attach(big, pivots, ["shard"]).select(*thin, "reach", "rows", "most", "at")
        dealt = settle(dealt.mapInPandas(deal, "node long, label " + groups.schema["label"].dataType.simpleString() + ", vector " + groups.schema["vector"].dataType.simpleString() + ", shard long, reach double, rows long, most long, homes array<long>"))
        inner = dealt.select("shard", "rows", F.explode("homes").alias("home")).groupBy("shard", "rows", "home").agg(F.count("*").cast("double").alias("n"))
        kept = settle(inner.groupBy("shard", "rows").agg(F.sum(F.col("n") * F.col("n")).alias("work"))
                      .filter(F.col("work") * 3 <= F.col("rows").cast("double") * F.col("rows") * 2).select("shard", F.lit(True).alias("split")))
        dealt = attach(dealt, kept, ["shard"])
        firm.append(dealt.filter(F.col("split").isNull()).select(*home, "rows", "most"))
        groups = settle(dealt.filter("split").select("node", "label", "vector", "reach", F.explode("homes").alias("shard")))
    sized = attach(groups, settle(groups.groupBy("shard").agg(F.count("*").alias("rows"), held.cast("long").alias("most")).filter("rows > most")), ["shard"])
    done.append(sized.filter(F.col("rows").isNull()).select(*home))
    firm.append(sized.filter(F.col("rows").isNotNull()).select(*home, "rows", "most"))
    parts = F.ceil(2 * F.col("rows") / F.col("most")).cast("long")
    for rows in firm:
        rows = rows.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("node", "shard"), F.col("parts")))
        rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).filter("j <> own")
        pair = F.shiftrightunsigned(F.xxhash64("shard", F.least("own", "j"), F.greatest("own", "j")), 1)
        done.append(rows.select("node", pair.alias("shard")))
    return settle(reduce(DataFrame.unionByName, done).groupBy("node").agg(F.sort_array(F.collect_set("shard")).alias("homes")))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, loose: float = 0.8) -> DataFrame:
    """vec_id, n_links, component_id, kept per row of vectors (vec_id, vector, label).

    Copies of one label meet as one node with a count. Rows whose label or vec_id is null or whose vector is unusable link with
    nothing and are components of their own. A row repeated with its vec_id counts as another vector.
    Vectors of different lengths are never compared.
    """
    # single precision stays so in tables and shuffles; tasks compute in double
    kind = "array<float>" if vectors.schema["vector"].dataType.simpleString() == "array<float>" else "array<double>"
    base = vectors.select(F.col("vec_id").cast("long"), "label", F.col("vector").cast(kind).alias("vector"))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))
    # a zero has one sign, so that equal vectors have one hash
    base = base.withColumn("node", F.when(ok, F.xxhash64(F.struct("label", F.size("vector").alias("dim")), F.transform("vector", lambda x: F.when(x == 0, F.lit(0).cast(kind[6:-1])).otherwise(x)))))
    nodes = settle(base.filter(ok).groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("node").alias("node"))
                   .withColumn("label", F.struct("label", F.size("vector").alias("dim"))).withColumn("reach", F.lit(max(0.0, 2 - 2 * threshold) ** 0.5)))
    # a node's vector goes to its shards twice, for the graph and for the search; lists, counts and names travel without it
    homes = shards_of(nodes)
    placed = settle(nodes.select("node", "vector", "copies").join(homes, "node"))
    lists = placed.select("node", "vector", F.explode("homes").alias("shard")).groupBy("shard").applyInPandas(_build, "node long, links array<long>")
    graph = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("links"))).alias("links"))
    links = graph.join(homes, "node").select("node", "links", F.explode("homes").alias("place"))
    full = placed.withColumn("shard", F.explode("homes"))
    found = settle(full.groupBy("shard").cogroup(links.groupBy("place")).applyInPandas(_find(threshold, loose), "node long, links long, root long"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "first", "copies").join(counts, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "root").select("node", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = base.filter(ok).select("vec_id", "node").join(named, "node").select("vec_id", "n_links", "component_id")
    alone = base.filter(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def audit_recall(vectors: DataFrame, result: DataFrame, threshold: float = 0.93, sample: int = 256) -> float:
    """Found links over true ones of `sample` rows (those of least hash), by brute force of the sample against all rows in blocks."""
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    few = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec_id", "label", "vector").collect()
    ids, labels = np.array([r[0] for r in few]), [r[1] for r in few]
    want = [np.asarray(r[2], np.float64) for r in few]

    def work(frames):
        for f in frames:
            n = np.zeros(len(ids), np.int64)
            for i, w in enumerate(want):
                same = f[(f["label"] == labels[i]) & (f["vec_id"] != ids[i]) & (f["vector"].map(len) == len(w))]
                if len(same):
                    x = np.stack(same["vector"].to_numpy()).astype(np.float64)
                    n[i] = ((x * w).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (w * w).sum()) >= threshold).sum()
            yield pd.DataFrame({"vec_id": ids, "n": n})

    true = rows.select("vec_id", "label", "vector").mapInPandas(work, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    got = true.join(result, "vec_id").agg(F.sum("n_links"), F.sum("n")).head()
    return 1.0 if not got[1] else got[0] / got[1]


def op5_graph_near_duplicates(spark, folder) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "label", F.col("embedding").alias("vector")))
