"""Elias-Fano sequences, the trie and language-model scores beside dictionaries: nulls, empties, repeated rows, long texts, parted contexts, empty tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from visitframe.llm import elias_fano, lm_scoring

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))] + [b" "]


class Model:
    """The model by its definition, in dictionaries."""

    def __init__(self, texts, order, split):
        self.order, self.split = order, split
        tokens = [words_of(t) for t in texts]
        self.count = Counter(w for ws in tokens for w in ws)
        self.total, self.kinds = sum(self.count.values()), len(self.count)
        self.near = self.count + Counter({None: len(tokens)})
        self.step = math.log10(2 * self.total + 2) / 255
        self.after = defaultdict(Counter)
        for ws in tokens:
            for context, w in self.grams(ws):
                for m in range(1, order):
                    self.after[context[:m]][w] += 1

    def grams(self, words):
        """(contexts from the nearest word on, word); the nearest comes with its class."""
        padded = [None] * (self.order - 1) + words
        for i, w in enumerate(words):
            back = [padded[i + self.order - 2 - m] for m in range(self.order - 1)]
            salt = (0 if back[1] is None else xxhash.xxh64_intdigest(back[1]) & 0xFFFF) if self.order > 2 else 0
            yield ((back[0], salt % (1 + self.near[back[0]] // self.split) if self.order > 2 else 0), *back[1:]), w

    def code(self, p):
        return min(255, max(0, int(np.rint(-math.log10(p) / self.step))))

    def base(self, w):
        return (self.count[w] + 1) / (self.total + self.kinds + 1)

    def p(self, context, w, m):
        """The unrounded probability after m words, of a gram that was learned."""
        if m == 0:
            return 10.0 ** (-self.step * self.code(self.base(w)))
        seen = self.after[context[:m]]
        total, kinds = sum(seen.values()), len(seen)
        return (seen[w] + kinds * self.p(context, w, m - 1)) / (total + kinds)

    def units(self, context, w):
        out = self.code(self.base(w))
        for m in range(1, self.order):
            seen = self.after.get(context[:m])
            if not seen:
                break
            out = self.code(self.p(context, w, m)) if w in seen else out + self.code(len(seen) / (sum(seen.values()) + len(seen)))
        return out

    def score(self, text):
        words = words_of(text)
        return (len(words), sum(self.count[w] > 0 for w in words), self.total, sum(math.log10(self.base(w)) for w in words), -self.step * sum(self.units(c, w) for c, w in self.grams(words)))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(0)
    words = np.array(["the", "The", "cat", "Été", "a\x00b", "x.", "dog y", *(f"w{i}" for i in range(40))])
    share = 1 / np.arange(1, len(words) + 1)
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 60), p=share / share.sum())), 1) for i in range(150)]
    rows += [(200, None, 1), (201, "", 1), (202, "  \t\n", 1), (203, "the " * 300, 1), (204, "unheard words only", 1), (None, "the cat", 1), (None, None, 1), (5, rows[5][1], 1), (5, rows[5][1], 1), (205, "w1 " * 3000, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, units int").repartition(5)


def learned_row(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 != 2


LEARNED = "crc32(coalesce(cast(doc_id AS string), '')) % 7 != 2"


@pytest.mark.parametrize("order,split,sizes", [(3, 1 << 20, {}), (3, 20, {"block_tokens": 100, "shard_grams": 200, "shard_words": 10}), (2, 20, {"block_tokens": 1000, "shard_grams": 50}), (4, 50, {"shard_grams": 300})])
def test_scores(spark, corpus, monkeypatch, order, split, sizes):
    rows = corpus.select("doc_id", "text").collect()
    model = Model([r["text"] for r in rows if learned_row(r["doc_id"])], order, split)
    want = sorted(((r["doc_id"] is None, r["doc_id"] or 0, learned_row(r["doc_id"])), model.score(r["text"])) for r in rows)
    found = lm_scoring.lm_scores(corpus, F.expr(LEARNED), order=order, split=split, **sizes).collect()
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["learned"]), (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])) for r in found)
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1][:3] for g in got] == [w[1][:3] for w in want]
    assert np.allclose([g[1][3:] for g in got], [w[1][3:] for w in want], rtol=1e-9, atol=1e-9)


def test_long_texts_go_on_in_the_next_block(spark, corpus):
    """Parts of 7 words give what whole texts give; workers see the smaller part through a function of their own."""
    docs = corpus.withColumn("learned", F.expr(LEARNED)).withColumn("text", F.col("text").cast("binary"))
    import pyarrow as pa

    def rows(part):
        block, out = lm_scoring._Block(2), []
        for doc_id, learned, text in docs.select("doc_id", "learned", "text").collect():
            words = [*(bytes(text) if text is not None else b"").lower().split(), lm_scoring.END]
            first, before = None, []
            for a in range(0, len(words), part):
                mine = len(block.parts)
                block.add(words[a:a + part], before, first, doc_id, learned)
                first = mine if first is None else first
                before = words[max(0, a + part - 2):a + part]
        return block.row(0)

    whole, cut = rows(10 ** 9), rows(7)
    assert whole["n_starts"] == cut["n_starts"] and whole["n_learned"] == cut["n_learned"] and whole["hashes"] == cut["hashes"] and whole["counts"] == cut["counts"]
    sums = []
    for row in (whole, cut):
        block = lm_scoring._table([row], lm_scoring._BLOCK_KINDS)
        counts = lm_scoring.unpack(row["counts"])[0]
        reply = pa.table({"shard": [0], "words": [lm_scoring.pack([np.where(counts > 0, 2 + np.arange(len(counts)), 1), counts, np.arange(len(counts))])]})
        sent = lm_scoring._messages(block, reply, 3, (row["n_learned"], int((counts > 0).sum()), row["n_starts"]), 0.02, 30, 4)
        answers = [lm_scoring._answers(mine, 3, 0.02) for s in range(-4, 4) if (mine := sent.filter(pa.compute.equal(sent["shard"], s))).num_rows]
        by = Counter()
        for r in lm_scoring._parts(pa.concat_tables(answers)).to_pylist():
            by[r["start"]] += r["units"]
        sums.append([by[s] for s in sorted(by)])
    assert sums[0] == sums[1]


def test_empty_and_unlearned(spark, corpus):
    assert lm_scoring.lm_scores(corpus.limit(0), F.expr(LEARNED)).count() == 0
    rows = lm_scoring.lm_scores(corpus, F.lit(False)).collect()
    assert len(rows) == corpus.count() and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and r["score"] == 0 for r in rows)


def test_words_are_cut_anywhere(monkeypatch):
    monkeypatch.setattr(lm_scoring, "_TEXT", 3)
    for text in (b"", b"  ", b"Aa bb", b"abcdefgh i\x0bj  k\t", "é É x".encode()):
        assert [w for some in lm_scoring._words(text) for w in some] == text.lower().split()


def test_probabilities_sum_to_one(corpus):
    rows = corpus.select("doc_id", "text").collect()
    model = Model([r["text"] for r in rows], 3, 1 << 20)
    for context in list(model.after)[:40]:
        total = sum(10 ** (-model.step * model.units(context, w)) for w in [*model.count, b"never seen"])
        assert abs(total - 1) < 0.05


def test_held_out_text_is_read_better_than_by_word_shares(spark, folder):
    out = lm_scoring.op13_elias_fano_scores(spark, folder).agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert out[1] > out[0]


def test_sequences():
    rng = np.random.default_rng(2)
    for n, universe in ((0, 1), (1, 1), (1, 1 << 50), (500, 600), (3000, 10 ** 9), (2000, 3 * 10 ** 15), (700, 700)):
        values = np.sort(rng.choice(universe, n, replace=False)) if universe < 10 ** 6 else np.unique(rng.integers(0, universe, n))
        made = elias_fano.EliasFano(values, universe)
        elias_fano.map_arrays([made])
        assert (made.access(np.arange(len(values))) == values).all()
        assert (made.find(values) == np.arange(len(values))).all()
        ask = np.r_[rng.integers(-5, universe + 5, 500), values + 1]
        at = {int(v): i for i, v in enumerate(values)}
        assert made.find(ask).tolist() == [at.get(int(x), -1) for x in ask]
        bits = 8 * (made.low.nbytes + made.high.nbytes)
        assert bits <= len(values) * (math.log2(max(2, universe / max(1, len(values)))) + 3) + 400
    equal = np.sort(rng.integers(0, 50, 300))
    assert (elias_fano.EliasFano(equal, 50).access(np.arange(300)) == equal).all()
