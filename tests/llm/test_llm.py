"""The pipeline operators beside brute force on small fixtures: nulls, empties, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import re
import zlib
from collections import Counter

import compare
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from visitframe.llm import (ann, chat, embedding_dedup, kneser_ney, license_scan, line_dedup, mixing, packing, prefix_free, queries, simhash, stages)

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = ["The cat sat on the mat. " * 30, "The cat sat on the mat. " * 30, "The cat sat on the mat. " * 29 + "A dog came by.", "", None, "MIT License", "a b", "é ü ñ",
         "licensed undr the MIT licence now", "General Public\nLicense apache license", "x" * 5000, " ".join(f"w{i}" for i in range(3000))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None][i % 3], 7, 1) for i, t in enumerate(TEXTS)]
    rows += [(0, TEXTS[0], "en", "s1", 7, 1), (None, "The cat sat on the mat. " * 30, "en", "s1", 7, 1), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, key int").repartition(3)


def empty(docs):
    return docs.limit(0)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equal_to_sql(spark, folder, name):
    con = compare.connect(folder)
    assert compare.difference(queries.QUERIES[name](spark, folder), con, queries.SQL[name]) is None


# mixing

def targets(sizes, weights=(5, 2, 1), cap=3):
    total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = {s for s in sizes if sizes[s] == 0}
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        level = left / max(1e-300, sum(w[s] for s in sizes if s not in full))
        new = {s for s in sizes if s not in full and level * w[s] > cap * sizes[s]}
        if not new:
            return {s: cap * sizes[s] if s in full else level * w[s] for s in sizes}
        full |= new


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, None: 700}, {"a": 1, "B": 1, "é": 1}, {"z": 0, "y": 9}, {None: 4}):
        got = {r[0]: r[2] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix(spark, docs, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    rows = mixing.mix(table).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(table.repartition(5)).collect()))
    by, texts = {}, dict(table.select("doc_id", "text").collect())
    for r in rows:
        by.setdefault(r["source"], []).append(r)
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]]))
    want = targets({s: sum(r["size"] for r in g) for s, g in by.items()})
    for s, g in by.items():
        whole = int(np.floor(g[0]["ratio"]))
        ranked = sorted((r for r in g if r["rank_odds"] is not None), key=lambda r: (r["rank_odds"], r["doc_id"], r["size"]))
        owed, run, head = want[s] - whole * sum(r["size"] for r in g), 0, set()
        for r in ranked:
            if run + r["size"] / 2 > owed - 1e-9:
                break
            run += r["size"]
            head.add(r["doc_id"])
        assert {r["doc_id"] for r in g if r["copies"] > whole} == head
        assert max(r["copies"] for r in g) <= 3
        assert abs(sum(r["copies"] * r["size"] for r in g) - want[s]) <= max(r["size"] for r in g)
    again = mixing.mixed_documents(table).groupBy("doc_id").count().collect()
    assert dict(map(tuple, again)) == {r["doc_id"]: max(r["copies"], 1 if r["size"] == 0 else 0) for r in rows if r["copies"] or r["size"] == 0}
    assert mixing.mix(docs).count() == docs.count() and mixing.mix(empty(docs)).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns and mixing.mixed_documents(empty(docs)).count() == 0


# SimHash

def brute_fingerprint(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + size]).encode(), 42) for i in range(max(1, len(w) - size + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(keys, linked):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(a, b) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in keys}


def test_masks():
    rng = np.random.default_rng(0)
    for radius, bits in ((1, 64), (2, 64), (4, 28), (3, 20)):
        masks = simhash.covering_masks(radius, bits)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(300):
            flip = sum(1 << int(b) for b in rng.choice(bits, radius, replace=False))
            assert any(m & flip == 0 for m in masks)


def test_simhash(spark, docs):
    got = [tuple(r) for r in simhash.simhash_components(docs).collect()]
    rows = docs.select("doc_id", "text").collect()
    want = {r["doc_id"]: brute_fingerprint(r["text"]) for r in rows if r["doc_id"] is not None}
    assert len(got) == len(rows)
    assert all(f % (1 << 64) == want[d] for d, f, _ in got if d is not None)
    comp = groups_of(sorted(want), lambda a, b: (want[a] ^ want[b]).bit_count() <= 2)
    assert all(c == comp[d] for d, _, c in got if d is not None)
    assert sorted(c for d, _, c in got if d is None) == sorted([comp[0], comp[3]])
    assert simhash.simhash_components(empty(docs)).count() == 0


def test_one_of_each_group_stays(spark, docs):
    more = [(20, TEXTS[0], "en", "s1", 7, 1), (21, TEXTS[-1] + " w3000", "en", "s1", 7, 1), (22, "quite another text of nine words in all here", "en", "s1", 7, 1), (22, TEXTS[0], "en", "s1", 7, 1)]
    table = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumnsRenamed({"size": "component_id", "key": "gone"})
    kept = simhash.keep_first(table)
    assert kept.columns == table.columns
    rows = table.select("doc_id", "text").collect()
    prints = [(r["doc_id"], brute_fingerprint(r["text"])) for r in rows if r["doc_id"] is not None]
    comp = groups_of(sorted({f for _, f in prints}), lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for d, f in prints:
        first[comp[f]] = min(first.get(comp[f], d), d)
    stay = {d for d, f in prints if first[comp[f]] == d}
    want = sorted(str(r["doc_id"]) for r in rows if r["doc_id"] is None or r["doc_id"] in stay)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want and 1 not in stay and 20 not in stay and 22 in stay
    assert simhash.keep_first(empty(docs)).count() == 0


def test_crowded_buckets(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in (0, 1, 2, 3, 4) for _ in range(30)})
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = groups_of(fps, lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 2)
    for small in (4, 256):
        edges = simhash.near_edges(spark.createDataFrame([(f,) for f in fps], "fp long"), small=small)
        got = dict(map(tuple, simhash.components(edges).collect()))
        assert {f: got.get(f, f) for f in fps} == want


# neighbours and embedding near-duplicates

@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(30, 16))
    rows = [(i, (centre[i % 30] + rng.normal(size=16) * 0.12).tolist(), int(i % 30 % 4)) for i in range(600)]
    rows += [(600 + i, rows[5][1], 1) for i in range(40)]
    rows += [(700, None, 1), (701, [0.0] * 16, 1), (702, [float("nan")] * 16, 1), (703, [1.0, None] * 8, 1), (704, [float("inf")] * 16, 1), (705, rows[5][1], None),
             (None, rows[5][1], 1), (706, [], 1), (707, [1.0, 2.0], 1)]
    return spark.createDataFrame(rows, "vec_id long, vector array<double>, label int").repartition(4)


def clean(vectors):
    rows = [r for r in vectors.collect() if r[0] is not None and r[1] and len(r[1]) == 16 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    return rows, np.array([r[1] for r in rows])


def test_neighbours(spark, vectors):
    rows, x = clean(vectors)
    ids, size = np.array([r[0] for r in rows]), np.sqrt((x * x).sum(axis=1))
    got = {}
    for r in ann.search(vectors, vectors.filter("vec_id % 50 = 0"), shard_rows=200, block_rows=5).collect():
        got.setdefault(r["query_id"], []).append(r)
    asked = [i for i in ids if i % 50 == 0]
    assert sorted(got) == sorted(asked)
    hits = total = 0
    for q in asked:
        at = int(np.flatnonzero(ids == q)[0])
        true = sorted(((-(x[j] * x[at]).sum() / (size[j] * size[at]), ids[j]) for j in range(len(ids)) if j != at))[:5]
        mine = sorted(got[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        hits, total = hits + sum(-r["score"] <= true[-1][0] + 1e-12 for r in mine), total + 5
    assert hits >= 0.9 * total
    few = vectors.filter("vec_id in (0, 1, 2, 700)")
    assert ann.search(few, few.filter("vec_id = 0")).count() == 2
    assert ann.search(vectors.limit(0), vectors.limit(0)).count() == 0


@pytest.mark.parametrize("most", [2560, 120])
def test_embedding_duplicates(spark, vectors, monkeypatch, most):
    shards = embedding_dedup.shards_of
    monkeypatch.setattr(embedding_dedup, "shards_of", lambda nodes: shards(nodes, most=most))
    result = embedding_dedup.near_duplicates(vectors)
    got = {r["vec_id"]: r for r in result.collect() if r["vec_id"] is not None}
    rows, x = clean(vectors)
    ids, labels = np.array([r[0] for r in rows]), np.array([-1 if r[2] is None else r[2] for r in rows])
    size = np.sqrt((x * x).sum(axis=1))
    near = ((x @ x.T) / np.outer(size, size) >= 0.93) & (labels[:, None] == labels[None, :]) & (labels >= 0)[:, None]
    np.fill_diagonal(near, False)
    if most > 1000:
        assert all(got[i]["n_links"] == n for i, n in zip(ids, near.sum(axis=1)))
        comp = groups_of(ids.tolist(), lambda a, b: near[np.flatnonzero(ids == a)[0], np.flatnonzero(ids == b)[0]])
        assert all(got[i]["component_id"] == c and got[i]["kept"] == (i == c) for i, c in comp.items())
        assert embedding_dedup.audit_recall(vectors, result) == 1.0
    else:
        assert sum(got[i]["n_links"] for i in ids) >= 0.9 * near.sum() and all(got[i]["n_links"] <= n for i, n in zip(ids, near.sum(axis=1)))
    for i in (700, 701, 702, 703, 704, 705, 706, 707):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert result.count() == vectors.count() and embedding_dedup.near_duplicates(vectors.limit(0)).count() == 0


def brute_links(x, least=0.93):
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    return (unit @ unit.T >= least).sum(axis=1) - 1


def test_tight_subgroups_linked_across(spark):
    """Three groups of over POOL noisy copies whose only links to each other are at about 0.95; the medoid lies in one."""
    rng = np.random.default_rng(9)
    basis = np.linalg.qr(rng.normal(size=(64, 4)))[0].T
    centres = [np.sqrt(0.95) * basis[0] + np.sqrt(0.05) * basis[i] for i in (1, 2, 3)]
    x = np.concatenate([c + rng.normal(size=(100, 64)) * 0.001 for c in centres] + [rng.normal(size=(700, 64))])
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, vector array<double>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(rows).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == brute_links(x).tolist()
    assert {got[i]["component_id"] for i in range(300)} == {0}


def test_links_across_shards(spark, monkeypatch):
    """A group of near copies larger than many shards, and vectors that pivots do not part: every link is found."""
    shards = embedding_dedup.shards_of
    monkeypatch.setattr(embedding_dedup, "shards_of", lambda nodes: shards(nodes, most=120))
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(12, 32))
    x = np.concatenate([centres[0] + rng.normal(size=(600, 32)) * 0.2, centres[rng.integers(12, size=600)] + rng.normal(size=(600, 32)) * 0.2])
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, vector array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(rows).collect()}
    assert [got[i] for i in range(len(x))] == brute_links(x).tolist()


def test_vectors_that_pivots_do_not_part_meet_in_few_shards(spark):
    """3,000 random vectors of one label: a row per node with its shards, and no pair meets twice."""
    x = np.random.default_rng(11).normal(size=(3000, 64))
    nodes = spark.createDataFrame([(i, 1, v.tolist(), 0.374) for i, v in enumerate(x)], "node long, label int, vector array<double>, reach double")
    homes = embedding_dedup.shards_of(nodes).collect()
    assert sorted(r["node"] for r in homes) == list(range(3000)) and {len(r["homes"]) for r in homes} == {1}


def test_shards_are_large_and_vectors_travel_little(spark, monkeypatch):
    """7,000 random vectors of a label lie in one shard, fewer of many components in several; blocks of any size find the same graph and links."""
    x = np.random.default_rng(5).normal(size=(7000, 8)).astype(np.float32)
    nodes = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "node long, vector array<float>").selectExpr("node", "1 AS label", "vector", "0.374D AS reach")
    assert {len(r["homes"]) for r in embedding_dedup.shards_of(nodes).collect()} == {1}
    monkeypatch.setattr(embedding_dedup, "SHARD_NUMBERS", 8 * 3072)
    assert {len(r["homes"]) for r in embedding_dedup.shards_of(nodes).collect()} != {1}
    rows = np.repeat(np.random.default_rng(6).normal(size=(60, 16)), 5, axis=0) + np.random.default_rng(7).normal(size=(300, 16)) * 0.1
    rows[0] = 0.0, *([1.0] * 15)
    table = [(i, v.tolist(), 1) for i, v in enumerate(rows)] + [(300, [-0.0, *([1.0] * 15)], 1)]
    kinds = "vec_id long, vector array<{}>, label int"
    found = {}
    for kind, cells in (("float", 4 << 20), ("float", 700), ("double", 700)):
        monkeypatch.setattr(embedding_dedup, "CELLS", cells)
        result = embedding_dedup.near_duplicates(spark.createDataFrame(table, kinds.format(kind)))
        found[kind, cells] = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in result.collect())
    assert found["float", 4 << 20] == found["float", 700] == found["double", 700] and len(found["float", 700]) == 301
    assert found["float", 700][0][1] >= 1 and found["float", 700][300][2] == 0
    unit = rows / np.sqrt((rows * rows).sum(axis=1))[:, None]
    monkeypatch.setattr(embedding_dedup, "CELLS", 1)
    one = embedding_dedup.pruned_graph(unit)
    monkeypatch.setattr(embedding_dedup, "CELLS", 1 << 20)
    assert [set(r) for r in one.tolist()] == [set(r) for r in embedding_dedup.pruned_graph(unit).tolist()]


def test_range_search_looks_cosines_up():
    """The walk reads cosines from the rows it is given: a node they hide is not found."""
    rng = np.random.default_rng(12)
    x = np.repeat(rng.normal(size=(20, 32)), 10, axis=0) + rng.normal(size=(200, 32)) * 0.05
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    near, graph = unit @ unit.T, embedding_dedup.pruned_graph(unit)
    asked = np.arange(0, 200, 3)
    medoid = int((unit @ unit.mean(axis=0)).argmax())
    found = set(zip(*(v.tolist() for v in embedding_dedup.range_search(near[asked], graph, medoid, asked, 0.93, 0.8))))
    assert found == {(i, int(j)) for i, a in enumerate(asked) for j in np.flatnonzero(near[a] >= 0.93)}
    near[0, 1:10] = 0.0
    found = embedding_dedup.range_search(near[asked], graph, medoid, asked, 0.93, 0.8)
    assert found[1][found[0] == 0].tolist() == [0]


def test_merged_grams_take_little_memory():
    """Merging adds up equal grams, keeps the first of each, and holds about a column at a time beside its input."""
    import tracemalloc

    rng = np.random.default_rng(13)
    names = np.array([f"g{i:04d}" for i in range(5000)])
    parts = []
    for _ in range(8):
        at = np.unique(rng.integers(5000, size=3000))
        parts.append((at.astype(np.uint64), names[at], rng.integers(9, size=len(at))))
    want = Counter()
    for _, grams, n in parts:
        want.update(dict(zip(grams.tolist(), n.tolist())))
    keys, grams, n = kneser_ney._merged(parts)
    assert dict(zip(grams.tolist(), n.tolist())) == dict(want) and n.dtype == np.int64
    assert (np.diff(keys.astype(np.int64)) > 0).all() and grams.tolist() == names[keys.astype(np.int64)].tolist()
    size = 400_000
    large = [(np.arange(i, i + size, dtype=np.uint64), np.repeat(names[:1], size), np.ones(size, np.int64)) for i in (0, size // 2)]
    tracemalloc.start()
    kneser_ney._merged(large)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 75 * 2 * size


# chat and lines

def test_whole_texts_go_in_small_batches(spark, docs, monkeypatch):
    """Texts reach Python in batches bounded by bytes, in every operator that reads whole texts there; the session's own bound comes back."""
    from visitframe.functions import cluster

    name, before, seen = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"), []
    monkeypatch.setattr(cluster, "BATCH_BYTES", 1 << 16)
    for module, writer in ((kneser_ney, "settle_table"), (simhash, "settle"), (packing, "settle")):
        def noted(df, write=getattr(module, writer), at=module.__name__):
            if any("Map" in x or "Eval" in x for x in df._jdf.queryExecution().toString().split()):
                seen.append((at, spark.conf.get(name)))
            return write(df)

        monkeypatch.setattr(module, writer, noted)
    kneser_ney.keep_good(docs, docs.select("doc_id")).count()
    kneser_ney.classify(docs, docs.select("doc_id")).count()
    simhash.keep_first(docs).count()
    packing.pack_documents(docs).count()
    assert {at for at, _ in seen} == {m.__name__ for m in (kneser_ney, simhash, packing)}
    assert {n for at, n in seen if at != simhash.__name__} == {str(1 << 16)} and (simhash.__name__, str(1 << 16)) in seen
    assert spark.conf.get(name) == before

    def sizes(frames):
        for frame in frames:
            yield pd.DataFrame({"n": [frame["text"].str.len().sum()]})

    texts = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("ab"), 1000).alias("text"))
    with cluster.small_batches(spark):
        some = [r["n"] for r in texts.mapInPandas(sizes, "n long").collect()]
    assert sum(some) == 800_000 and max(some) <= 1 << 17
    with pytest.raises(ValueError):
        with cluster.small_batches(spark):
            raise ValueError
    assert spark.conf.get(name) == before


def test_sorted_logs_are_not_copied():
    """Every worker holds the resolved grams; in order already, they take no second copy."""
    keys = np.sort(np.random.default_rng(3).integers(1 << 63, size=1000, dtype=np.uint64) * np.uint64(2))
    logp, mixed = np.linspace(-3, -1, 1000, dtype=np.float32), np.random.default_rng(4).permutation(1000)
    known, other = kneser_ney.Known(keys.view(np.int64), logp), kneser_ney.Known(keys[mixed].view(np.int64), logp[mixed])
    assert np.shares_memory(known.keys, keys) and np.shares_memory(known.logp, logp)
    assert known.total(keys[5:50]) == other.total(keys[5:50]) == float(logp[5:50].sum(dtype=np.float64))


def test_idle_tokenizer_keeps_one_generation():
    import public_tokenizers

    ids = packing.WordIds(public_tokenizers.path(packing.VOCABULARY), 2)
    texts = ["one two three", "four five six", "one seven"]
    first = [ids([t])[0] for t in texts]
    assert ids.old_words and ids.old_pieces
    ids.rest()
    assert not ids.old_words and not ids.old_pieces and [ids([t])[0] for t in texts] == first


def test_chat_cases(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 600, "ann", "late"), (2, None, None, "x"), (2, None, None, "x"), (None, 0, "ann", "y"), (3, 0, "system", "z")]
    table = spark.createDataFrame([(*t, 7, 8) for t in turns], "conv_id long, turn long, role string, text string, part int, speaker int")
    out = {(r["conv_id"], r["part"], r["speaker"]): r for r in chat.rotate(table).collect()}
    assert sorted(out) == [(1, 0, "ann"), (1, 0, "bob"), (2, 0, "unknown")]
    ann_view = out[1, 0, "ann"]
    assert ann_view["text"] == ("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n"
                                "<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>assistant\nlate<|im_end|>\n")
    assert [ann_view["text"][a:b] for a, b in ann_view["spans"]] == ["hi<|im_end|>", "hi<|im_end|>", "late<|im_end|>"]
    assert [out[1, 0, "bob"]["text"][a:b] for a, b in out[1, 0, "bob"]["spans"]] == ["<|im_end|>"]
    assert out[2, 0, "unknown"]["n_turns"] == 2 and chat.rotate(table.limit(0)).count() == 0


def test_long_dialogues(spark):
    """2,000 turns, a speaker heard once, sparse numbers, null numbers and a text of a million characters: parts joined are the whole view of everyone."""
    rng = np.random.default_rng(8)
    turns = [(1, i, ["ann", "bob"][i % 2] if i % 300 else "system", f"t{i}") for i in range(2000)] + [(1, 1300, "cy", "once")]
    turns += [(2, int(t), "ann" if t % 3 else "dee", "x" * int(t % 7)) for t in rng.integers(0, 10 ** 12, 700)]
    turns += [(3, None, "ann", f"n{i % 200}") for i in range(900)] + [(4, 0, "ann", "y" * 1_000_000), (4, 1, "bob", "ok")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(7)
    views = {}
    for r in chat.rotate(table).collect():
        views.setdefault((r["conv_id"], r["speaker"]), []).append(r)
    for conv in (1, 2, 3, 4):
        rows = sorted((t or 0, r, x) for c, t, r, x in turns if c == conv)
        assert {s for c, s in views if c == conv} == {r for _, r, _ in rows} - {"system"}
        for speaker in {r for _, r, _ in rows} - {"system"}:
            parts = sorted(views[conv, speaker], key=lambda r: r["part"])
            heads = [f"<|im_start|>{'assistant' if r == speaker else 'system' if r == 'system' else 'user name=' + r}\n{x}<|im_end|>\n" for _, r, x in rows]
            assert "".join(p["text"] for p in parts) == "".join(heads)
            assert [p["n_turns"] for p in parts] == [min(512, len(rows) - i) for i in range(0, len(rows), 512)]
            assert [p["char_start"] for p in parts] == [len("".join(heads[:i])) for i in range(0, len(rows), 512)]
            systems = [next((x for _, r, x in reversed(rows[:i]) if r == "system"), None) for i in range(0, len(rows), 512)]
            assert [p["system"] for p in parts] == systems
            assert [p["text"][a:b] for p in parts for a, b in p["spans"]] == [x + "<|im_end|>" for _, r, x in rows if r == speaker]


def test_lines(spark):
    rows = [(i, "a", f"head\nbody {i}\n head \n\n", 1) for i in range(10)] + [(10, None, "head\nx", 1), (11, "b", "head", 1), (12, "a", None, 1), (13, "a", "", 1), (13, "a", "", 1)]
    table = spark.createDataFrame(rows, "id long, site string, text string, n_pages int")
    out = {r["id"]: r for r in line_dedup.drop_site_lines(table, "site", "text", 0.5, 3).collect()}
    assert (out[0]["text"], out[0]["n_lines"], out[0]["n_dropped"]) == ("body 0\n\n", 3, 2)
    assert out[10]["text"] == "head\nx" and out[11]["text"] == "head" and out[12]["text"] is None and out[13]["text"] == ""
    assert line_dedup.drop_site_lines(table.limit(0), "site", "text", 0.5, 3).count() == 0


# quality

def brute_model(texts):
    """Interpolated modified Kneser-Ney by dictionaries over strings."""
    from collections import Counter

    level = {5: Counter()}
    for t in texts:
        s = "\n" * 4 + t
        level[5].update(s[i:i + 5] for i in range(len(t)))
    for k in (4, 3, 2, 1):
        level[k] = Counter(g[1:] for g in level[k + 1])
    disc = {}
    for k, c in level.items():
        n = [sum(v == i for v in c.values()) for i in range(1, 5)]
        if all(n):
            y = n[0] / (n[0] + 2 * n[1])
            disc[k] = [min(i - 0.05, max(0.05, i - (i + 1) * y * n[i] / n[i - 1])) for i in (1, 2, 3)]
        else:
            disc[k] = [0.5, 1, 1.5]
    total, lost = {}, {}
    for k, c in level.items():
        for g, v in c.items():
            total[g[:-1], k] = total.get((g[:-1], k), 0) + v
            lost[g[:-1], k] = lost.get((g[:-1], k), 0) + disc[k][min(v, 3) - 1]

    def p(g):
        k = len(g)
        low = p(g[1:]) if k > 1 else 1 / 4096
        if (g[:-1], k) not in total:
            return low
        v = level[k].get(g, 0)
        own = (v - disc[k][min(v, 3) - 1]) / total[g[:-1], k] if v else 0
        return own + lost[g[:-1], k] / total[g[:-1], k] * low

    return p


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_kneser_ney(spark, folder, few, monkeypatch):
    """Held-in and held-out documents in two languages, one without a model, beside the dictionaries; long and odd texts."""
    for name, bound in (("_CHUNK", 1000), ("_LOOSE", 3000), ("_HELD", 9000)):
        monkeypatch.setattr(kneser_ney, name, bound)
    rows = [r for r in spark.read.parquet(f"{folder}/documents.parquet").filter("lang = 'en'").select("doc_id", "text", "lang").limit(40).collect()]
    rows = [(r["doc_id"], r["text"], "en") for r in rows]
    rows += [(9001, "the \U0001f600 \x00 new\x00", "en"), (9002, "of the and " * 9000, "en"), (9003, "der Text", "de"), (9004, "", "en"), (9005, None, "en"),
             (None, "the and of", "en"), (9006, "the and of", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    fit = [r[0] for r in rows[:25]]
    marked = kneser_ney.marked(table, spark.createDataFrame([(i,) for i in fit], "doc_id long"), 2)
    folds = {r["doc_id"]: r["_kn_fold"] for r in marked.collect()}
    assert {folds[i] for i in fit} == {1, 2} and all(folds[r[0]] is None for r in rows[25:])
    p = brute_model([t for i, t, _ in rows if folds[i] == 1])
    scored = kneser_ney.perplexity(marked, few).collect()
    assert len(scored) == len(rows)
    scored = {r["doc_id"]: r for r in scored}
    for i, t, lang in rows:
        if not t or lang != "en":
            assert scored[i]["log_ppl"] is None
            continue
        s = "\n" * 4 + t.replace("\x00", "\ufffd")
        want = -np.mean([np.log(p(s[j:j + 5])) for j in range(len(t))])
        assert abs(scored[i]["log_ppl"] - want) < 1e-4


def test_kneser_ney_driver_holds_little(spark, docs, monkeypatch):
    """Resolved grams come to the driver a range at a time, and trusted ids go out once, only those of the model, as whole numbers."""
    monkeypatch.setattr(kneser_ney, "RANGE", 50)
    kind, parts, sent = type(docs), [], []
    whole, broadcast = kind.toArrow, F.broadcast
    monkeypatch.setattr(kind, "toArrow", lambda self: parts.append(whole(self)) or parts[-1])
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df) or broadcast(df))
    some = docs.filter("doc_id is not null").select("doc_id").distinct()
    marks = {r["doc_id"]: r["_kn_fold"] for r in kneser_ney.folds(some, 2).collect()}
    assert kneser_ney.classify(docs, some).count() == docs.count()
    total = sum(map(len, parts))
    assert total > 1000 and max(map(len, parts)) < total / 8
    ids = [sorted(r["_k0"] for r in df.collect()) for df in sent if df.columns == ["_k0", "_kn_fold"]]
    assert ids == [sorted(i for i, fold in marks.items() if fold == 1)]
    # ranges together are all rows in the order of unsigned keys
    key = np.arange(-2000, 2000, dtype=np.int64) * np.int64(4_000_000_000_000_037)
    logs = spark.createDataFrame(pd.DataFrame({"key": key[np.random.default_rng(1).permutation(4000)]})).withColumn("logp", F.col("key").cast("float"))
    found, logp = kneser_ney.collected(logs, 4000)
    assert (found.view(np.uint64) == np.sort(key.view(np.uint64))).all() and (logp == found.astype(np.float32)).all()


def test_attach_without_nulls(spark):
    """Null keys match nothing, broadcast or salted; keys may repeat in the large table."""
    from visitframe.functions.cluster import attach

    big = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k long, t string")
    small = spark.createDataFrame([(1, 10), (3, 30)], "k long, v int")
    for rows in (50, 0):
        found = attach(big, small, ["k"], rows=rows, nulls=False)
        assert sorted((r["t"], r["v"]) for r in found.collect()) == [("a", 10), ("b", 10), ("c", None), ("d", None)]


def test_long_texts_in_pieces(monkeypatch):
    """Counts and scores do not depend on where texts are cut."""
    texts, seed = ["abcab " * 70, "x", "\u00e9t\u00e9 " * 41, "abcab"], kneser_ney.seed_of("en")
    results = []
    for bound in (1 << 18, 7, 64):
        monkeypatch.setattr(kneser_ney, "_CHUNK", bound)
        keys, grams, n = kneser_ney._merged(list(kneser_ney._counted(texts, seed)))
        results.append((dict(zip(grams.tolist(), n.tolist())), kneser_ney._means(texts + ["zz", "", None], ["en"] * 7, kneser_ney.Known(keys.view(np.int64), np.linspace(-3, -1, len(keys))))))
    want = {}
    for t in texts:
        for i in range(len(t)):
            g = ("\n" * 4 + t)[i:i + 5]
            want[g] = want.get(g, 0) + 1
    for counts, means in results:
        assert counts == want and means[4:] == [None] * 3 and np.allclose(means[:4], results[0][1][:4])


def test_kneser_ney_is_a_distribution(spark):
    counts = spark.createDataFrame([("en", "abcde", 3), ("en", "abcdf", 1), ("en", "xbcde", 2), ("fr", "abcde", 1)], "lang string, gram string, n long")
    model = kneser_ney.smoothed(counts)
    asked = spark.createDataFrame([(lang, "abcd" + chr(c)) for lang in ("en", "fr", "de") for c in range(32, 32 + kneser_ney.ALPHABET)], "lang string, gram string")
    sums = {}
    for r in kneser_ney.resolved(asked, model).collect():
        sums[r["lang"]] = sums.get(r["lang"], 0) + r["p"]
    assert set(sums) == {"en", "fr"} and all(abs(v - 1) < 1e-9 for v in sums.values())


def test_kneser_ney_meets_by_shard(spark, monkeypatch):
    """Grams spread over many shards, each resolved in its own for all orders above two, score as the dictionaries do."""
    monkeypatch.setattr(kneser_ney, "SHARD_GRAMS", 60)
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abc \u00e9\U0001f600"), 120)) for _ in range(12)]
    count = lambda some: Counter(("\n" * 4 + t)[i:i + 5] for t in some for i in range(len(t)))
    p, known = brute_model(texts[:8]), count(texts[:8])
    counts = spark.createDataFrame([("en", g, n) for g, n in known.items()] + [("fr", "abcab", 2)], "lang string, gram string, n long")
    model = kneser_ney.smoothed(counts)
    assert model["shards"] > 4
    asked = spark.createDataFrame([(i, lang, g) for lang in ("en", "de") for i, g in enumerate(count(texts))], "id long, lang string, gram string")
    found = kneser_ney.resolved(asked, model)
    got = {(r["lang"], r["gram"]): r["p"] for r in found.collect()}
    assert set(got) == {("en", g) for g in count(texts)} and len(known) < len(got)
    assert all(abs(v - p(g)) < 1e-9 for (_, g), v in got.items())


def brute_cut(held, lang, n, level, spread, least):
    """held: (lang, n_symbols, log_ppl). The cut of a text of n characters by the rules of cuts_of_classes()."""
    cls = lambda n: max(5, min(13, int(np.floor(np.log2(max(n, 1))))))
    mine = cls(n)
    for group in ([h for h in held if h[0] == lang], held):
        by = {c: [h for h in group if cls(h[1]) == c] for c in range(5, 14)}
        by = {c: v for c, v in by.items() if len(v) >= least}
        if by:
            usual = min(by, key=lambda c: (abs(c - mine), -c))
            some = by[usual]
        elif len(group) >= least:
            some, usual = group, int(np.median([cls(h[1]) for h in group]))
        else:
            continue
        bins = np.sort([np.floor(h[2] / 0.001 + 0.5) for h in some])
        at = lambda q: bins[int(np.ceil(q * len(bins) - 1e-9)) - 1] * 0.001
        cut = at(level) + spread * (at(level) - at(0.5))
        return at(0.5) + (cut - at(0.5)) * 2 ** (max(usual - mine, 0) / 2)
    return None


def test_every_scored_document_is_judged(spark):
    rng = np.random.default_rng(4)
    held = [(lang, int(n), float(rng.normal(3, 0.3))) for lang, sizes in (("en", [300] * 60 + [1500] * 25 + [90] * 5), ("fr", [600] * 12), (None, [40] * 3 + [9000] * 30)) for n in sizes]
    asked = [(lang, n, 3.0) for lang in ("en", "fr", None, "de") for n in (1, 40, 90, 300, 700, 1500, 50_000)]
    for least in (20, 1000):
        rows = spark.createDataFrame([(*h, 2) for h in held] + [(*a, None) for a in asked] + [("en", 0, None, None)], "lang string, n_symbols long, log_ppl double, _kn_fold int")
        cuts = {(r["lang"], r["n_symbols"]): r["cut"] for r in kneser_ney._judged(rows, 0.95, 4.0, least).collect()}
        for lang, n, _ in asked:
            want = brute_cut([(h[0] or "", *h[1:]) for h in held], lang or "", n, 0.95, 4.0, least)
            assert (cuts[lang, n] is None) == (want is None) and (want is None or abs(cuts[lang, n] - want) < 1e-9), (lang, n)
        assert cuts["en", 0] is None


def test_quality(spark, folder, docs):
    table, labels = (spark.read.parquet(f"{folder.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = kneser_ney.classify(table, kneser_ney.trusted_of(labels)).collect()
    assert all((r["cut"] is None) == (r["n_symbols"] == 0) and r["kept"] == (r["cut"] is None or r["log_ppl"] <= r["cut"]) for r in rows)
    kept = {r["doc_id"]: r["kept"] for r in rows}
    good = [kept[r["doc_id"]] for r in labels.collect() if r["quality"] == 1 and r["toxic"] == 0]
    bad = [kept[r["doc_id"]] for r in labels.collect() if r["quality"] == 0]
    print(np.mean(good), np.mean(bad))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.5
    some = spark.createDataFrame([(0,), (1,), (None,), (0,)], "doc_id long")
    clash = docs.withColumnsRenamed({"size": "cut", "key": "kept"}).limit(3)
    assert kneser_ney.keep_good(clash, some).columns == clash.columns
    assert kneser_ney.classify(docs, some).count() == docs.count()
    assert kneser_ney.keep_good(docs, some).columns == docs.columns
    assert kneser_ney.classify(empty(docs), some).count() == 0 and kneser_ney.keep_good(docs, some.limit(0)).count() == docs.count()


# licenses, packing, passages

def test_license_scan(spark, docs):
    out = {r["doc_id"]: r for r in license_scan.scan(docs).collect() if r["doc_id"] is not None}
    for i, text in enumerate(TEXTS):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        at, labels = [], set()
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            here = [j for j in range(len(words)) if words[j:j + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        r = out[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert "mit" in out[8]["labels"] and out[8]["base_labels"] == "" and out[8]["spans"][0]["edits"] <= 2
    assert license_scan.scan(empty(docs)).count() == 0


def test_fuzzy_spans():
    import regex

    rng, words = np.random.default_rng(4), "alpha beta gamma delta omega".split()
    for notice, _, edits in license_scan.NOTICES:
        assert len(license_scan.seeds(notice, edits)) == edits + 1
        for _ in range(5):
            s = list(notice)
            for j in rng.choice(len(s), edits, replace=False):
                s[j] = "q"
            text = " " + " ".join(rng.choice(words, 40)) + " " + "".join(s) + " " + " ".join(rng.choice(words, 40)) + " "
            i = [n for n, _, _ in license_scan.NOTICES].index(notice)
            got = [x for x in license_scan.fuzzy_spans(text) if x[0] == i]
            assert got and bool(regex.search(f"(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}", text))
            assert all(x[3] <= edits for x in got)


def test_fuzzy_spans_are_those_of_the_whole_text():
    """Seeds and windows find what the bounded-error pattern finds when it searches everything."""
    import regex

    rng, words = np.random.default_rng(7), "alpha beta gamma delta omega all rights the software is under".split()
    for _ in range(30):
        parts = []
        for _ in range(4):
            parts.append(" ".join(rng.choice(words, rng.integers(5, 30))))
            notice, _, edits = license_scan.NOTICES[rng.integers(len(license_scan.NOTICES))]
            s = list(notice)
            for j in rng.choice(len(s), rng.integers(0, edits + 2), replace=False):
                s[j] = rng.choice(["", "q", s[j] + "z"])
            parts.append("".join(s))
        text = " " + " ".join(parts) + " "
        want = []
        for i, (notice, _, edits) in enumerate(license_scan.NOTICES):
            pattern, left = regex.compile(f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}"), [[0, len(text)]]
            while left:
                a, b = left.pop()
                m = pattern.search(text, a, b) if a < b else None
                if m and m.end() > m.start():
                    want.append((i, m.start(), m.end(), sum(m.fuzzy_counts)))
                    left += [[a, m.start()], [m.end(), b]]
        got = license_scan.fuzzy_spans(text)
        assert sorted((i, e) for i, _, _, e in got) == sorted((i, e) for i, _, _, e in want)
        assert all(any(i == j and a < d and c < b for j, c, d, _ in want) for i, a, b, _ in got)


def test_names_of_users_columns(spark, docs):
    """Columns with names that operators use inside come back as they were."""
    inner = ["_site", "_common", "_kept", "n_lines", "n_dropped", "_ratio", "_size", "_copies", "_inclusion", "_k0", "_salt", "_s", "_marks", "SIZE"]
    table = docs.drop("size", "key").limit(6)
    for i, c in enumerate(inner):
        table = table.withColumn(c, F.lit(i))
    for out in (line_dedup.drop_site_lines(table, "source", "text", 0.5, 2), mixing.mixed_documents(table)):
        assert out.columns[:len(table.columns)] == table.columns
        assert all(tuple(r[c] for c in inner) == tuple(range(len(inner))) for r in out.select(*inner).collect()) and out.count() > 0
    extra = line_dedup.drop_site_lines(table, "source", "text", 0.5, 2)
    assert extra.columns[-2:] == ["_n_lines", "_n_dropped"]
    for scan in (license_scan.scan(table), simhash.simhash_components(table), packing.pack_documents(table), prefix_free.repeated_passages(table)):
        assert scan.count() >= 6


def test_worse_match_before_the_best():
    text = " foo all rights reservd all rights reserved bar "
    assert [text[a:b].strip() for i, a, b, _ in license_scan.fuzzy_spans(text) if license_scan.NOTICES[i][1] == "reserved"] == ["all rights reservd", "all rights reserved"]


def test_best_fit():
    rng = np.random.default_rng(5)
    for lengths in ([], [7], [10] * 25, rng.integers(1, 11, 300).tolist(), rng.integers(1, 2048, 500).tolist()):
        window = 10 if max(lengths, default=0) <= 10 else 2048
        rooms, want = [], []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fits = [r for r in rooms if r >= lengths[i]]
            room = min(fits) if fits else window
            if fits:
                rooms.remove(room)
            rooms.append(room - lengths[i])
            want.append(room)
        sequence, offset = packing.best_fit_decreasing(lengths, window)
        order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
        assert [window - offset[i] for i in order] == want
        for s in set(sequence):
            mine = sorted((offset[i], lengths[i]) for i in range(len(lengths)) if sequence[i] == s)
            assert [a for a, _ in mine] == np.cumsum([0, *[n for _, n in mine]])[:-1].tolist()


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["it's DON'T 'S İstanbul ΣΑΣ é <|startoftext|>x naïve\xa0b a\x1cb ²½x 日本語 ﬁ", "\n\n a.b!!. x_y-z 12a3", "ǅ ĳ ŉ ſ Œ K", "́ ́a ö", "\t a b"]
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(extra)
    texts = dict(map(tuple, table.filter("doc_id is not null").collect()))
    got, spans = {}, {}
    for r in packing.pack_documents(table, window=64).collect():
        got.setdefault(r["doc_id"], []).append(r)
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, text in texts.items():
        ids = [*tool.encode(text or "", add_special_tokens=False).ids, 1]
        copies = 2 if d == 0 else 1
        assert sum(r["length"] for r in got[d]) == copies * len(ids)
        for r in got[d]:
            assert bytes(r["ids"]) == np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes() and r["doc_tokens"] == len(ids)
    for s in spans.values():
        at = 0
        for a, n in sorted(s):
            assert a == at
            at += n
        assert at <= 64
    assert packing.pack_documents(empty(docs)).count() == 0


@pytest.mark.parametrize("sizes", [(8 << 20, 8 << 20), (3000, 2000)])
def test_passages(spark, docs, sizes):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(60)]
    shared = [" ".join(rng.choice(words, 40)) for _ in range(4)]
    more = [(200 + i, " ".join(rng.choice(words, rng.integers(0, 60))) + shared[i % 4][: rng.integers(0, 200)] + "é" * (i % 3)) for i in range(60)] + [(300, "ab" * 200), (301, "ba" * 90)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in table.collect()]
    first = {}
    rank = lambda d: float("inf") if d is None else d
    for d, b in rows:
        for p in range(len(b) - 49):
            first[b[p:p + 50]] = min(first.get(b[p:p + 50], float("inf")), rank(d))
    want = []
    for d, b in rows:
        hit = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < rank(d):
                hit[p:p + 50] = True
        kept = np.frombuffer(b, np.uint8)[~hit].tobytes()
        want.append((d, len(b), int(hit.sum()), int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    found = prefix_free.repeated_passages(table, block_bytes=sizes[0], shard_bytes=sizes[1])
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in found.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert prefix_free.repeated_passages(empty(docs)).count() == 0


def test_passage_messages_are_gaps():
    """Entries come back as they went, in far fewer bytes than a key, a rank and a count of 20 bytes for each document."""
    rng = np.random.default_rng(5)
    place, n = np.repeat(np.arange(400), 3), 1200
    start = np.sort(rng.integers(0, 3000, (400, 3)), axis=1).ravel()
    rank = np.where(place == 399, np.iinfo(np.int64).max, place * 97 - 5000)
    marks, strings = rng.integers(0, 1 << 64, n, np.uint64), rng.integers(1, 31, n)
    sent = prefix_free._pack(marks % np.uint64(2), 2, 3, place, rank, start, [marks, strings])
    assert sum(map(len, sent["body"])) < 13 * n
    row, ranks, starts, cols = (prefix_free._unpack(sent, 7))
    want = sorted(zip((place * 7 + 3).tolist(), rank.tolist(), start.tolist(), marks.tolist(), strings.tolist()))
    assert sorted(zip(row.tolist(), ranks.tolist(), starts.tolist(), cols[0].tolist(), cols[1].tolist())) == want


# pipeline

def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in stages.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        nulls = docs.limit(3).unionByName(spark.createDataFrame([(None,) * 5], docs.schema))
        assert stage(spark, nulls, folder).columns == docs.columns


def test_pipeline(spark, folder):
    out = stages.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in stages.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
    ids = {r["doc_id"] for r in docs.collect()}
    assert {r["doc_id"] for r in out} == ids
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == len(out)
    assert sum(zlib.crc32(bytes(r["ids"])) > 0 for r in out) == len(out)
