"""A quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model holds every gram of ORDER characters that trusted text has, so it grows with that text. Each task counts the different grams of its
texts, far fewer than their characters; the counts are summed per (language, gram) and meet by the grams' third and fourth character, where
all their contexts and lower orders down to three characters lie together; every gram that some document holds is resolved there once, against a
table of the two lowest orders. At most FEW resolved grams, counted first, are
broadcast and the texts scored where they lie. More go by a join to the shards of up to 32 MB of text that hold them, with the
same scores. A document's perplexity is held against quantiles of its language and length class, taken from trusted documents that
the model has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitframe.functions.cluster import attach, release, settle, settle_table, small_batches

ORDER = 5
ALPHABET = 4096  # below single characters all are equally likely
ROWS, SHORT = 13, 2048  # a shard has 2^ROWS texts of up to 2 x SHORT bytes, half as many with each doubling
_CHUNK, _LOOSE, _HELD = 1 << 18, 1 << 18, 1 << 20
FEW = 4_000_000  # of 12 bytes each
RANGE = 500_000  # of them brought to the driver at once
TASK_TEXT = 8 << 20
SHARD_GRAMS = 200_000  # different trusted grams of a shard


def codes_of(text: str) -> np.ndarray:
    """Characters as numbers; a text starts after line ends, and the character zero counts as unreadable."""
    codes = np.frombuffer(("\n" * (ORDER - 1) + text).encode("utf-32-le", "replace"), "<u4")
    return np.where(codes == 0, 0xFFFD, codes).astype(np.uint32)


def seed_of(lang: str) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(lang))


def keys_of(codes: np.ndarray, seed: np.uint64) -> np.ndarray:
    """A 64-bit hash of language and gram for each window of ORDER characters."""
    n = len(codes) - ORDER + 1
    h = np.full(n, seed, np.uint64)
    for j in range(ORDER):
        h ^= codes[j:j + n]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def folds(trusted_ids: DataFrame, held: int) -> DataFrame:
    """doc_id, _kn_fold of trusted documents: 1 for the model, 2 for the cuts (one in `held`)."""
    ids = trusted_ids.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct()
    fold = F.when(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(held)) == 0, 2).otherwise(1)
    return settle(ids.select("doc_id", fold.alias("_kn_fold")))


def _with_folds(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return attach(docs, ids, ["doc_id"], rows=1_000_000, nulls=False)


def marked(docs: DataFrame, trusted_ids: DataFrame, held: int) -> DataFrame:
    """docs with _kn_fold: that of folds(), null for others."""
    return _with_folds(docs, folds(trusted_ids, held))


def sharded(docs: DataFrame) -> DataFrame:
    """docs as a table with _kn_row and _kn_shard.

    A shard takes rows that lie together and are about equally long, so its bytes are bounded but for a single longer text.
    """
    table = settle_table(docs.withColumn("_kn_row", F.monotonically_increasing_id()))
    doubled = F.floor(F.log2(F.greatest(F.octet_length("text"), F.lit(SHORT)) / SHORT))
    doubled = F.coalesce(F.least(doubled, F.lit(ROWS)), F.lit(0)).cast("int")
    return table.withColumn("_kn_shard", F.call_function("shiftright", F.col("_kn_row"), ROWS - doubled) * 16 + doubled)


def _pieces(text: str) -> Iterator[np.ndarray]:
    """The codes of a text, _CHUNK windows at a time."""
    codes = codes_of(text)
    for i in range(0, len(text), _CHUNK):
        yield codes[i:i + _CHUNK + ORDER - 1]


def _counted(texts: list[str], seed: np.uint64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, grams and counts of texts, from _CHUNK to twice as many windows at a time."""
    some, size = [], 0
    for codes in (c for t in texts for c in _pieces(t)):
        some.append(codes)
        size += len(codes)
        if size >= _CHUNK:
            yield _distinct(some, seed)
            some, size = [], 0
    if some:
        yield _distinct(some, seed)


def _distinct(some: list[np.ndarray], seed: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.concatenate(some)
    keys = keys_of(codes, seed)
    starts = np.cumsum([len(c) for c in some[:-1]], dtype=np.int64)
    inside = np.ones(len(keys), bool)
    # windows that end in the line ends before the next text
    inside[(starts[:, None] - np.arange(1, ORDER)).ravel()] = False
    place = np.flatnonzero(inside)
    keys, first, n = np.unique(keys[place], return_index=True, return_counts=True)
    grams = np.ascontiguousarray(codes[place[first][:, None] + np.arange(ORDER)]).view(f"<U{ORDER}")[:, 0]
    return keys, grams, n


def _merged(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    # a column at a time, which takes about half the memory of all at once
    keys, grams, n = zip(*parts)
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    keys, n = keys[first], np.add.reduceat(np.concatenate(n)[order], first)
    return keys, np.concatenate(grams)[order[first]], n


def grams_seen(docs: DataFrame, shard: Column) -> DataFrame:
    """shard, lang, key, gram, n: the different grams of each shard, n counted over marked documents of the model (0 if only others hold it).

    A task sends what it holds when that passes a bound, and at its end, so a gram may come in several rows.
    """

    def rows_of(held: dict) -> Iterator[pd.DataFrame]:
        for shard, lang in list(held):
            keys, grams, n = _merged(held.pop((shard, lang)))
            for i in range(0, len(keys), 50_000):
                j = slice(i, i + 50_000)
                yield pd.DataFrame({"shard": shard, "lang": lang, "key": keys[j].view(np.int64), "gram": grams[j].astype(object), "n": n[j]})

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = {}, lambda parts: sum(len(k) for k, _, _ in parts)
        for frame in frames:
            for (shard, lang), part in frame.groupby(["shard", "lang"]):
                mine, ours = held.setdefault((shard, lang), []), (part["fold"] == 1).to_numpy()
                for flag in (True, False):
                    for keys, grams, n in _counted([t for t in part["text"][ours == flag] if t], seed_of(lang)):
                        mine.append((keys, grams, n * flag))
                        if size(mine[1:]) > _LOOSE:
                            mine[:] = [_merged(mine)]
                if not mine:
                    del held[shard, lang]
            if sum(map(size, held.values())) > _HELD:
                for parts in held.values():
                    parts[:] = [_merged(parts)]
                if sum(map(size, held.values())) > _HELD:
                    yield from rows_of(held)
        yield from rows_of(held)
        release()

    rows = docs.select(shard.alias("shard"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("_kn_fold", F.lit(0)).alias("fold"), "text")
    return rows.mapInPandas(work, "shard long, lang string, key long, gram string, n long")


def _placed(grams: DataFrame, shards: int) -> DataFrame:
    """Grams by their third and fourth character, which their suffixes and contexts of orders 3 to 5 hold too: each of these lies in one shard."""
    return grams.withColumn("shard", F.pmod(F.xxhash64("lang", F.substring("gram", ORDER - 2, 2)), F.lit(shards)))


def _letters(grams: pa.ChunkedArray, k: int) -> np.ndarray:
    return np.array(grams.to_pylist(), f"<U{k}").view("<u4").reshape(-1, k)


class _Shard:
    """The different suffixes and contexts of a shard's grams, numbered by order, and the suffixes' counts in trusted text."""

    def __init__(self, table: pa.Table):
        lang = pa.chunked_array(table["lang"]).combine_chunks().dictionary_encode()
        self.langs, self.lang = lang.dictionary, lang.indices.to_numpy().astype(np.int64)
        self.letters = _letters(table["gram"], ORDER)
        each, letter = np.unique(self.letters, return_inverse=True)
        letter = letter.reshape(-1, ORDER)

        def named(at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
            """Numbers of `at` with the k-th letter from the end, and the first row of each."""
            return np.unique(at * len(each) + letter[:, ORDER - k], return_index=True, return_inverse=True)[:0:-1]

        context = named(named(self.lang, 3)[0], 2)[0]
        suffix, self.context, self.suffix, self.first, self.n = context, {}, {}, {}, {}
        for k in range(3, ORDER + 1):
            self.context[k] = context = context if k == 3 else named(context, k)[0]
            suffix, self.first[k] = named(suffix, 1 if k == 3 else k)
            self.suffix[k] = suffix
        n = np.bincount(suffix, weights=table["n"].to_numpy())
        for k in range(ORDER, 2, -1):
            self.n[k] = n
            if k > 3:
                n = np.bincount(self.suffix[k - 1][self.first[k]][n > 0], minlength=len(self.first[k - 1]))


def _shard_counts(table: pa.Table) -> pa.Table:
    """Counts of counts of orders 3 to 5 by language, and for order 2 how many different letters of this shard stand before a gram."""
    shard, out = _Shard(table), []
    for k in range(3, ORDER + 1):
        lang = shard.lang[shard.first[k]]
        counts = [np.bincount(lang[shard.n[k] == i], minlength=len(shard.langs)) for i in range(1, 5)]
        out += [(shard.langs[i].as_py(), k, None, *(int(c[i]) for c in counts)) for i in range(len(shard.langs))]
    some = shard.first[3][shard.n[3] > 0]
    two = (shard.lang[some] << 42) | (shard.letters[some, ORDER - 2].astype(np.int64) << 21) | shard.letters[some, ORDER - 1]
    for two, n in zip(*(x.tolist() for x in np.unique(two, return_counts=True))):
        out.append((shard.langs[two >> 42].as_py(), 2, chr(two >> 21 & 0x1FFFFF) + chr(two & 0x1FFFFF), n, 0, 0, 0))
    kinds = [pa.string(), pa.int32(), pa.string(), *[pa.int64()] * 4]
    return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(zip(("lang", "order", "gram", "n1", "n2", "n3", "n4"), kinds))})


def _discounts(stats: DataFrame) -> DataFrame:
    """lang, order, d1, d2, d3 from counts of counts n1 to n4."""
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    enough = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
    d = [F.when(enough, F.greatest(F.lit(0.05), F.lit(float(i)) - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"))).otherwise(0.5 * i) for i in (1, 2, 3)]
    return stats.select("lang", "order", *[F.least(x, F.lit(i - 0.05)).alias(f"d{i}") for i, x in zip((1, 2, 3), d)])


def smoothed(counts: DataFrame) -> dict:
    """Interpolated modified Kneser-Ney from counts (lang, gram, n) of the longest grams, one row each.

    "counts" holds these, "shards" their number of shards, "discounts" the discounts of orders 3 to 5; 1 and 2 hold the rows lang, gram, context, p, back of those orders.
    p is the probability of a gram's last character after the k - 1 before it (the context), back the mass that the context leaves to the next
    lower order. Discounts follow from the counts of counts of each order and language; where those are too few, the discount is
    0.5, 1 and 1.5. Lower orders count the different characters before a gram.
    """
    shards = max(1, -(-counts.count() // SHARD_GRAMS))
    parts = _placed(counts.select("lang", "gram", "n"), shards).groupBy("shard").applyInArrow(
        _shard_counts, "lang string, order int, gram string, n1 long, n2 long, n3 long, n4 long")
    parts = settle(parts.groupBy("lang", "order", "gram").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(1, 5)]))
    levels = {2: parts.filter("order = 2").select("lang", "gram", F.col("n1").alias("n"))}
    levels[1] = levels[2].groupBy("lang", F.substring("gram", 2, 1).alias("gram")).agg(F.count("*").alias("n"))
    out, lower = {"counts": counts, "shards": shards, "discounts": settle(_discounts(parts.filter("order > 2")))}, None
    for k in (1, 2):
        c = [F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in range(1, 5)]
        stats = settle(_discounts(levels[k].groupBy("lang", F.lit(k).alias("order")).agg(*c)).drop("order"))
        disc = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = attach(levels[k].withColumn("context", F.substring("gram", 1, k - 1)), stats, ["lang"]).withColumn("disc", disc)
        contexts = rows.groupBy("lang", "context").agg((F.sum("disc") / F.sum("n")).alias("back"), F.sum("n").alias("total"))
        rows = rows.join(contexts, ["lang", "context"])
        own = (F.col("n") - F.col("disc")) / F.col("total")
        if lower is None:
            rows = rows.withColumn("p", own + F.col("back") / ALPHABET)
        else:
            rows = rows.withColumn("tail", F.substring("gram", 2, k - 1)).join(lower, ["lang", "tail"]).withColumn("p", own + F.col("back") * F.col("q"))
        out[k] = settle(rows.select("lang", "gram", "context", "p", "back"))
        lower = out[k].select("lang", F.col("gram").alias("tail"), F.col("p").alias("q"))
    return out


def _pairs_resolved(pairs: DataFrame, model: dict) -> DataFrame:
    """pairs (lang, gram of two, distinct) with p, backed off where trusted text lacks them; those of languages without a model go."""
    wants = {2: pairs, 1: pairs.select("lang", F.substring("gram", 2, 1).alias("gram")).distinct()}
    lower = None
    for k in (1, 2):
        left = model[k].groupBy("lang", "context").agg(F.first("back").alias("back"))
        rows = wants[k].withColumn("context", F.substring("gram", 1, k - 1)).join(model[k].select("lang", "gram", "p"), ["lang", "gram"], "left")
        if lower is None:
            rows = attach(rows, settle(left.select("lang", "back")), ["lang"]).filter(F.col("back").isNotNull()).withColumn("q", F.lit(1 / ALPHABET))
        else:
            rows = rows.join(left, ["lang", "context"], "left").withColumn("tail", F.substring("gram", 2, k - 1)).join(lower, ["lang", "tail"])
        rows = rows.withColumn("p", F.coalesce("p", F.coalesce("back", F.lit(1.0)) * F.col("q"))).drop("context", "back", "q", "tail")
        lower = rows.select("lang", F.col("gram").alias("tail"), F.col("p").alias("q"))
    return rows


def _shard_logs(table: pa.Table, aids: pa.Table, keep: list[str]) -> pa.Table:
    """The `keep` columns and p of a shard's asked grams; aids: probabilities of order 2 (order, lang, gram, p) and discounts of higher ones."""
    if not len(table):
        return table.select(keep).append_column("p", pa.array([], pa.float64()))
    shard = _Shard(table)
    lang, order = pc.index_in(aids["lang"], value_set=shard.langs).to_numpy(), aids["order"].to_numpy()
    lower = aids.filter(pa.array(order == 2))
    letters = _letters(lower["gram"], 2).astype(np.int64)
    known = (lang[order == 2].astype(np.int64) << 42) | (letters[:, 0] << 21) | letters[:, 1]
    by = np.argsort(known)
    known, q = np.append(known[by], -1), np.append(lower["p"].to_numpy()[by], np.nan)
    mine = (shard.lang << 42) | (shard.letters[:, ORDER - 2].astype(np.int64) << 21) | shard.letters[:, ORDER - 1]
    at = np.searchsorted(known[:-1], mine)
    p = np.where(known[at] == mine, q[at], np.nan)
    d = np.zeros((ORDER + 1, len(shard.langs), 4))
    d[order, lang, 1:] = np.column_stack([aids[c].to_numpy() for c in ("d1", "d2", "d3")])
    for k in range(3, ORDER + 1):
        n, first, context = shard.n[k], shard.first[k], shard.context[k]
        less = d[k, shard.lang[first], np.minimum(n, 3).astype(np.int64)]
        total = np.bincount(context[first], weights=n)
        back = np.where(total > 0, np.bincount(context[first], weights=less) / np.maximum(total, 1), 1.0)
        own = (n - less) / np.maximum(total, 1)[context[first]]
        p = own[shard.suffix[k]] + back[context] * p
    asked = table["asked"].to_numpy() & ~np.isnan(p)
    return table.select(keep).append_column("p", pa.array(p)).filter(pa.array(asked))


def _resolved(rows: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """The `keep` columns and p of asked rows (lang, gram, n, asked, ...), n in trusted text; the model's grams are all among the rows."""
    rows = _placed(rows, model["shards"])
    two = settle(rows.select("shard", "lang", F.substring("gram", ORDER - 1, 2).alias("gram")).distinct())
    lower = _pairs_resolved(two.select("lang", "gram").distinct(), model)
    none = [F.lit(None).cast("double").alias(f"d{i}") for i in (1, 2, 3)]
    aids = two.join(lower, ["lang", "gram"]).select("shard", "lang", F.lit(2).alias("order"), "gram", "p", *none)
    steps = two.select("shard", "lang").distinct().join(model["discounts"], "lang")
    aids = aids.unionByName(steps.select("shard", "lang", "order", F.lit("").alias("gram"), F.lit(None).cast("double").alias("p"), "d1", "d2", "d3"))
    aids = aids.toDF("place", *aids.columns[1:])

    def work(table: pa.Table, aids: pa.Table) -> pa.Table:
        out = _shard_logs(table, aids, keep)
        release()
        return out

    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("p", T.DoubleType())])
    return rows.groupBy("shard").cogroup(aids.groupBy("place")).applyInArrow(work, schema)


def resolved(grams: DataFrame, model: dict) -> DataFrame:
    """grams (lang, gram, distinct) with p, backed off where trusted text lacks them; those of languages without a model go."""
    asked = grams.withColumn("n", F.lit(0).cast("long")).withColumn("asked", F.lit(True))
    rows = asked.unionByName(model["counts"].select("lang", "gram", "n", F.lit(False).alias("asked")), allowMissingColumns=True)
    return _resolved(rows, model, grams.columns)


def gram_logs(docs: DataFrame, plain: DataFrame | None = None) -> DataFrame:
    """key, logp of every gram of marked docs whose language has a model; plain: the same rows, which need no join with marks to be read."""
    # small input partitions are read together, since a task sends each gram once
    size = (docs if plain is None else plain).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    docs = docs.coalesce(max(1, -(-size // TASK_TEXT)))
    seen = settle_table(grams_seen(docs, F.lit(0).cast("long")).groupBy("key", "lang", "gram").agg(F.sum("n").alias("n")))
    model = smoothed(seen.filter("n > 0").select("lang", "gram", "n"))
    wanted = _resolved(seen.withColumn("asked", F.lit(True)), model, ["key"])
    return settle_table(wanted.select("key", F.log("p").cast("float").alias("logp")))


class Known:
    """Log probabilities by key, looked up for whole arrays: sorted keys, and where those with the same first bits begin.

    Arrays that are in order of their keys as unsigned numbers are used as they are.
    """

    def __init__(self, key: np.ndarray, logp: np.ndarray):
        keys = key.view(np.uint64)
        if (keys[1:] < keys[:-1]).any():
            order = np.argsort(keys)
            keys, logp = keys[order], logp[order]
        self.keys, self.logp = keys, logp
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def total(self, mine: np.ndarray) -> float | None:
        """The sum over all keys; None if one is not known."""
        at = self.starts[mine >> self.shift]
        if not len(self.keys) or at.max() == len(self.keys):
            return None
        left = np.flatnonzero(self.keys[at] != mine)
        while len(left):
            at[left] += 1
            if at[left].max() == len(self.keys):
                return None
            here, want = self.keys[at[left]], mine[left]
            if (here > want).any():
                return None
            left = left[here != want]
        return float(self.logp[at].sum(dtype=np.float64))


def _means(texts, langs, known: Known) -> list[float | None]:
    """The mean negative log probability of each text's characters; None without text or model."""
    out = []
    for text, lang in zip(texts, langs):
        total = 0.0 if text else None
        for codes in _pieces(text or ""):
            some = known.total(keys_of(codes, seed_of(lang)))
            if some is None:
                total = None
                break
            total -= some
        out.append(None if total is None else total / len(text))
    return out


def collected(logs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and logp of the n rows in the order of the keys as unsigned numbers, brought here a range of about RANGE keys at a time.

    Sorted here, so that no worker needs a sorted copy; the driver holds the result and copies of one range, not of all.
    """
    key, logp, at = np.empty(n, np.int64), np.empty(n, np.float32), 0
    bits = (n // RANGE).bit_length()
    for i in range(1 << bits):
        table = (logs.filter(F.shiftrightunsigned("key", 64 - bits) == i) if bits else logs).select("key", "logp").toArrow()
        to, some = at + len(table), table["key"].to_numpy()
        order = np.argsort(some.view(np.uint64))
        key[at:to], logp[at:to], at = some[order], table["logp"].to_numpy()[order], to
    return key, logp


def perplexity(docs: DataFrame, few: int = FEW, fitted: DataFrame | None = None) -> DataFrame:
    """Docs with log_ppl, the mean negative log probability of a text's characters; null without text or model. fitted: the same rows marked, if docs are not."""
    logs, lang = gram_logs(docs if fitted is None else fitted, docs), F.coalesce("lang", F.lit(""))
    if (n := logs.limit(few + 1).count()) <= few:
        shared = docs.sparkSession.sparkContext.broadcast(collected(logs, n))

        @F.pandas_udf("double")
        def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            known = Known(*shared.value)
            for text, lang in parts:
                yield pd.Series(_means(text, lang, known), dtype="Float64")
            del known
            release()

        return docs.withColumn("log_ppl", score("text", lang))
    table = sharded(docs)
    shard = F.col("_kn_shard")
    entries = grams_seen(table.withColumn("_kn_fold", F.lit(None).cast("int")), shard).select("shard", "key").join(logs, "key").select("shard", "key", "logp")

    def score_shard(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = Known(known["key"].to_numpy(), known["logp"].to_numpy())
        return pd.DataFrame({"_kn_row": texts["row"], "log_ppl": pd.array(_means(texts["text"], texts["lang"], known), "Float64")})

    rows = table.select(shard.alias("shard"), F.col("_kn_row").alias("row"), lang.alias("lang"), "text")
    scored = rows.groupBy("shard").cogroup(entries.groupBy("shard")).applyInPandas(score_shard, "_kn_row long, log_ppl double")
    return table.join(settle(scored), "_kn_row").drop("_kn_row", "_kn_shard")


def length_class(n: Column) -> Column:
    """Texts of about equal length: the whole part of log2 of the characters, from 32 to 2^13."""
    return F.greatest(F.lit(5), F.least(F.lit(13), F.floor(F.log2(F.greatest(n, F.lit(1)))))).cast("int")


def thresholds(scored: DataFrame, level: float, spread: float, least: int, step: float = 0.001) -> DataFrame:
    """lang, class, middle, cut, usual from held-out scores (lang, n_symbols, log_ppl): the `level` quantile plus `spread` times its way from the median, middle.

    Class 0 holds a language's texts of all lengths and lang null those of all languages; usual is the class that the texts are of, the
    median one for class 0. Scores are counted in steps, so a quantile is exact to one step and the same in every run. A class of
    fewer than `least` texts has no row.
    """
    own = length_class(F.col("n_symbols"))
    held = scored.filter(F.col("log_ppl").isNotNull()).select(F.coalesce("lang", F.lit("")).alias("lang"), own.alias("own"), F.round(F.col("log_ppl") / step).cast("long").alias("bin"))
    binned = held.select(F.explode(F.array(F.col("lang"), F.lit(None).cast("string"))).alias("lang"), "own", "bin")
    counts = binned.select("lang", "own", F.explode(F.array(F.lit(0), F.col("own"))).alias("class"), "bin").groupBy("lang", "class", "bin", "own").agg(F.count("*").alias("n"))
    by = Window.partitionBy("lang", "class")
    placed = counts.withColumn("upto", F.sum("n").over(by.orderBy("bin"))).withColumn("all", F.sum("n").over(by))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))) * step
    cuts = placed.groupBy("lang", "class").agg(at(0.5).alias("middle"), at(level).alias("high"), F.first("all").alias("all"),
                                               F.expr("percentile(own, 0.5, n)").cast("int").alias("usual"))
    cuts = cuts.filter(F.col("all") >= least)
    return cuts.select("lang", "class", "middle", (F.col("high") + spread * (F.col("high") - F.col("middle"))).alias("cut"), "usual")


def cuts_of_classes(wanted: DataFrame, cuts: DataFrame) -> DataFrame:
    """lang, class, cut for each wanted (lang, class): the row of its class in thresholds(), else of the nearest class (the longer of two) of its language,
    else of all its lengths, else the same of all languages together.

    A mean over half as many characters strays from its median by the root of two more, so a cut taken from longer texts lies that
    much further from their median for each class between; one taken from shorter texts stays as it is.
    """
    other = cuts.select(F.col("lang").alias("of"), F.col("class").alias("from"), "middle", "cut", "usual")
    key = F.explode(F.array(F.col("lang"), F.lit(None).cast("string"))).alias("of")
    pairs = wanted.select("lang", "class", key).join(other.withColumnRenamed("of", "at"), F.col("of").eqNullSafe(F.col("at")))
    far = F.when(F.col("from") == 0, F.lit(100)).otherwise(F.abs(F.col("class") - F.col("from")))
    rank = F.struct(F.col("of").isNull().alias("foreign"), far.alias("far"), (-F.col("from")).alias("shorter"))
    wide = F.col("middle") + (F.col("cut") - F.col("middle")) * F.pow(F.lit(2.0), F.greatest(F.col("usual") - F.col("class"), F.lit(0)) / 2)
    return pairs.groupBy("lang", "class").agg(F.min_by(wide, rank).alias("cut"))


def _judged(scored: DataFrame, level: float, spread: float, least: int, ids: DataFrame | None = None) -> DataFrame:
    """Scored rows (lang, n_symbols, log_ppl) with cut, kept; those of fold 2 by _kn_fold, or by ids of folds(), make the cuts. They are read twice, so they should be a table."""
    held = scored.filter("_kn_fold = 2") if ids is None else scored.join(ids.filter("_kn_fold = 2"), "doc_id", "left_semi")
    cuts = settle(thresholds(held.select("lang", "n_symbols", "log_ppl"), level, spread, least))
    placed = scored.withColumn("_kn_lang", F.coalesce("lang", F.lit(""))).withColumn("_kn_class", length_class(F.col("n_symbols")))
    wanted = placed.select(F.col("_kn_lang").alias("lang"), F.col("_kn_class").alias("class")).distinct()
    found = settle(cuts_of_classes(wanted, cuts).select(F.col("lang").alias("_kn_lang"), F.col("class").alias("_kn_class"), "cut"))
    judged = attach(placed, found, ["_kn_lang", "_kn_class"]).withColumn("cut", F.when(F.col("log_ppl").isNotNull(), F.col("cut")))
    return judged.withColumn("kept", F.coalesce(F.col("log_ppl") <= F.col("cut"), F.lit(True)))


def _scored(docs: DataFrame, ids: DataFrame, few: int) -> DataFrame:
    # the ids go to all tasks once, when grams are counted, and only those of the model
    return perplexity(docs, few, _with_folds(docs, ids.filter("_kn_fold = 1"))).withColumn("n_symbols", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def classify(docs: DataFrame, trusted_ids: DataFrame, level: float = 0.95, spread: float = 4.0, least: int = 20, held: int = 2, few: int = FEW) -> DataFrame:
    """doc_id, lang, n_symbols, log_ppl, cut, kept per document (doc_id, text, lang); trusted_ids (doc_id) name the trusted ones.

    A document is rejected when its perplexity is above the cut for its language and length (cuts_of_classes()). Every text is scored once. Without
    text or a model of its language it has no score and is kept; without `least` held-out texts at all there is no cut. Null doc_ids
    are never trusted; repeated rows are judged alike and counted each; trusted_ids may repeat. Texts of any length count whole.
    """
    ids = folds(trusted_ids, held)
    with small_batches(docs.sparkSession):
        scored = _scored(docs.select("doc_id", "text", "lang"), ids, few)
        table = settle_table(scored.select("doc_id", "lang", "n_symbols", "log_ppl"))
    return _judged(table, level, spread, least, ids).select("doc_id", "lang", "n_symbols", "log_ppl", "cut", "kept")


def keep_good(docs: DataFrame, trusted_ids: DataFrame, level: float = 0.95, spread: float = 4.0, least: int = 20, held: int = 2, few: int = FEW) -> DataFrame:
    """The documents that classify() keeps, all columns."""
    others = {c: f"_kn_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "lang")}
    ids = folds(trusted_ids, held)
    with small_batches(docs.sparkSession):
        table = settle_table(_scored(docs.withColumnsRenamed(others), ids, few))
    return _judged(table, level, spread, least, ids).filter("kept").select(*[F.col(others.get(c, c)).alias(c) for c in docs.columns])


def trusted_of(labels: DataFrame) -> DataFrame:
    return labels.filter((F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id")


def op7_kneser_ney_quality(spark, folder) -> DataFrame:
    return classify(spark.read.parquet(f"{folder}/documents.parquet"), trusted_of(spark.read.parquet(f"{folder}/labels.parquet")))
