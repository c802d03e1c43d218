"""Source divergences and vector codes beside brute force: nulls, empties, ties, repeated rows, clashing columns, empty tables, long texts."""

import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from visitframe.llm import divergence, vector_codes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_divergences(rows, least=3, best=200):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for text, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        seen = Counter(t for _, _, ts in mine for t in set(ts))
        kept = sorted(t for t in seen if seen[t] >= least)
        count = {s: Counter(t for _, x, ts in mine if x == s for t in ts if seen[t] >= least) for s in {r[1] for r in mine}}
        whole = sum(count.values(), Counter())
        p = {s: {t: 1 + 10 ** 9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in [*count.items(), (None, whole)]}
        f = lambda a, b: (a - b) ** 2 // b
        for s in count:
            pairs = [(h, sum(f(p[s][t], p[h][t]) for t in kept)) for h in count if h != s]
            terms = [(t, f(p[s][t], p[None][t])) for t in kept if count[s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(found) if part == "pair" or i < best]
    return sorted(out)


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(0)
    words = ["The", "cat", "Été", "naïve", "ﬀ", "x2y", "DOG", "İi", "ß", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 30))), ["en", "fr", None, ""][i % 4], ["b", "a", None, "é", "Z"][i % 5]) for i in range(120)]
    rows += [(None, "en", "silent"), ("", "xx", "only"), (None, None, None), ("cat cat\x00cat", "en", "a"), ("lone words", "yy", "s1"), ("other text", "yy", "s2")]
    rows += rows[:7]
    return rows


def test_divergences(spark, texts):
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in texts], "text string, lang string, source string, term int, shard int, value int").repartition(5)
    for best, shard in ((200, 200_000), (3, 7)):
        got = sorted(tuple(r) for r in divergence.divergences(table, best=best, shard_counts=shard).collect())
        assert got == brute_divergences(texts, best=best)
    assert divergence.divergences(table.limit(0)).count() == 0


def test_long_texts_and_task_bounds(monkeypatch, texts):
    monkeypatch.setattr(divergence, "_BYTES", 50)
    rows = [*texts, (" ".join(t for t, _, _ in texts if t), "en", "a"), ("q" * 300, "en", "a")]
    column = lambda i: pa.array([r[i] or "" for r in rows])
    parts = list(divergence._slices(column(0)))
    assert parts[0][0] == 0 and parts[-1][1] == len(rows) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    got = divergence._merged([divergence._counts(*(column(i).slice(a, b - a) for i in (1, 2, 0))) for a, b in parts]).to_pylist()
    n, docs = Counter(), Counter()
    for text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        n.update((lang or "", source or "", t) for t in found)
        docs.update((lang or "", source or "", t) for t in set(found))
    assert {(r["lang"], r["source"], r["term"]): (r["n"], r["docs"]) for r in got} == {k: (n[k], docs[k]) for k in n}


def test_shares_are_exact():
    rng = np.random.default_rng(1)
    total = rng.integers(1, 9 * 10 ** 15, 200)
    count = (total * rng.random(200)).astype(np.int64)
    got = divergence.shares(count, total - 7, 7)
    assert [int(g) for g in got] == [1 + 10 ** 9 * (int(c) + 1) // int(t) for c, t in zip(count, total)]


# vector codes

def brute_codes(rows, rounds=6, entries=16):
    """rows: (vec_id, label, vector); rows in the order of their place in the codebooks."""
    kept = [r for r in rows if r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    dim = max(1, -(-max((len(r[2]) for r in kept), default=0) // 8)) * 8
    whole = [[int(Fraction(float(np.float32(x))) * 4096 // 1) for x in r[2]] + [0] * (dim - len(r[2])) for r in kept]
    w = dim // 8
    parts = [[v[p * w:(p + 1) * w] for v in whole] for p in range(8)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    books = [[list(x) for x in column[:entries]] for column in parts]
    for _ in range(rounds):
        for p in range(8):
            of = [near(x, books[p])[1] for x in parts[p]]
            for e in set(of):
                mine = [x for x, o in zip(parts[p], of) if o == e]
                books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [[near(x, books[p]) for x in parts[p]] for p in range(8)]
    return books, [(r[0], r[1], bytes(found[p][i][1] for p in range(8)), sum(found[p][i][0] for p in range(8))) for i, r in enumerate(kept)]


def vectors(seed, n, dim, scale=1.0):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [None, 1, 2][i % 3], [float(np.float32(x)) for x in rng.normal(size=dim) * scale]) for i in range(n)]
    rows += [(3, 1, rows[3][2]), (None, 2, rows[4][2]), (900, 1, None), (901, 1, [float("nan")] * dim), (902, 1, [1.0, None] + [0.0] * (dim - 2)), (903, 1, [float("inf")] + [0.0] * (dim - 1)),
             (904, 5, []), (905, 5, [0.5] * (dim - 3)), (906, 5, [0.0] * dim)]
    return rows


@pytest.mark.parametrize("n,dim,scale", [(60, 32, 0.2), (5, 20, 1.0), (40, 8, 1e-6), (30, 48, 1e12), (30, 16, 1e30)])
def test_codes(spark, n, dim, scale):
    rows = vectors(n, n, dim, scale)
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, label int, embedding array<float>, error int, s0 int").repartition(4)
    coded, books = vector_codes.compress(table)
    want_books, want = brute_codes(rows)
    assert books == want_books
    got = [(r["vec_id"], r["label"], bytes(r["codes"]), r["error"]) for r in coded.collect()]
    want = [(*r[:3], r[3] if r[3] < 1 << 63 else None) for r in want]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_code_query(spark, folder):
    out = vector_codes.op12_walsh_vector_codes(spark, folder)
    rows = out.collect()
    assert len({r["codebooks_sha256"] for r in rows}) == 1 and all(len(r["code"]) == 16 for r in rows)
    coded, books = vector_codes.compress(spark.createDataFrame([], "vec_id long, label int, embedding array<float>"))
    assert coded.count() == 0 and books == [[] for _ in range(8)]


def test_sequency_and_elimination():
    for n in (1, 2, 4, 8, 16, 64):
        rows = vector_codes.hadamard(np.eye(n, dtype=np.int64))
        assert [(np.diff(c) != 0).sum() for c in rows.T] == list(range(n))
    rng = np.random.default_rng(3)
    for width in (1, 3, 8, 13, 200):
        x, c = rng.integers(-9, 9, (500, width)), rng.integers(-9, 9, (16, width))
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        entry, best = vector_codes.nearest(x, c)
        assert (entry == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
