"""Audit of how far a language's sources diverge from each other and from the language, term by term, in exact integers.

Tasks count terms with Arrow's own functions: lower-casing of A-Z, a split by a pattern, dictionary encoding and hash grouping. Their partial
counts meet by (language, term) and the kept terms go to columnar shards, each with its language's list of sources, where
all pairs of sources are summed in blocks of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitframe.functions.cluster import attach, settle, settle_table

#: What parts terms: every ASCII character but letters.
APART = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_APART = re.compile(APART.encode())
UNIT = 1_000_000_000
_BYTES, _LOOSE, _HELD, _CELLS = 4 << 20, 600_000, 300_000, 1 << 20


def _terms(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row numbers and terms of lower-cased texts."""
    split = pc.split_pattern_regex(pc.ascii_lower(text), APART)
    rows, flat = pc.list_parent_indices(split), pc.list_flatten(split)
    some = pc.not_equal(flat, "")
    return pc.filter(rows, some).to_numpy(zero_copy_only=False), pc.filter(flat, some)


def _slices(text: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of up to _BYTES of text, a longer text alone."""
    sizes = pc.binary_length(text).to_numpy(zero_copy_only=False)
    a, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > _BYTES:
            yield a, i
            a, held = i, 0
        held += n
    if len(sizes) > a:
        yield a, len(sizes)


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text cut between terms."""
    a = 0
    while a < len(text):
        cut = _APART.search(text, a + _BYTES)
        b = cut.end() if cut else len(text)
        yield text[a:b]
        a = b


def _counts(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """lang, source, term, n, docs of a slice of rows."""
    if len(text) == 1 and pc.binary_length(text)[0].as_py() > _BYTES:
        parts = []
        for piece in _pieces(text.cast(pa.binary())[0].as_py()):
            terms = pa.table({"term": _terms(pa.array([piece], pa.binary()).cast(pa.string()))[1]})
            parts.append(terms.group_by("term").aggregate([([], "count_all")]))
        whole = pa.concat_tables(parts).group_by("term").aggregate([("count_all", "sum")])
        n = whole.num_rows
        return pa.table({"lang": pa.repeat(lang[0], n), "source": pa.repeat(source[0], n), "term": whole["term"], "n": whole["count_all_sum"], "docs": pa.array(np.ones(n, np.int64))})
    row, terms = _terms(text)
    coded = terms.dictionary_encode()
    wide = max(1, len(coded.dictionary))
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    group = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy(zero_copy_only=False)
    pair = pa.table({"pair": row.astype(np.int64) * wide + coded.indices.to_numpy(zero_copy_only=False)}).group_by("pair").aggregate([([], "count_all")])
    at = pair["pair"].to_numpy()
    keyed = pa.table({"key": group[at // wide] * wide + at % wide, "n": pair["count_all"]})
    keyed = keyed.group_by("key").aggregate([("n", "sum"), ([], "count_all")])
    key = keyed["key"].to_numpy()
    of, term = key // wide, key % wide
    return pa.table({"lang": langs.dictionary.take(pa.array(of // max(1, len(sources.dictionary)))), "source": sources.dictionary.take(pa.array(of % max(1, len(sources.dictionary)))),
                     "term": coded.dictionary.take(pa.array(term)), "n": keyed["n_sum"], "docs": keyed["count_all"]})


def _merged(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return out.rename_columns(["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """Partial rows lang, source, term, n, docs (documents with the term) of docs (text, lang, source); a task holds a bounded number of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            lang, source, text = (batch.column(c) for c in ("lang", "source", "text"))
            for a, b in _slices(text):
                held.append(_counts(*(x.slice(a, b - a) for x in (lang, source, text))))
                size += held[-1].num_rows
                if size > _LOOSE:
                    held = [_merged(held)]
                    size = held[0].num_rows
                    if size > _HELD:
                        yield from held[0].to_batches(50_000)
                        held, size = [], 0
        if held:
            yield from _merged(held).to_batches(50_000)

    return docs.mapInArrow(work, "lang string, source string, term string, n long, docs long")


def shares(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / (total + terms)), exact up to 9 x 10^15 words: the quotient in steps of three decimal places."""
    left, below = np.broadcast_arrays(count + 1, total + terms)
    out, left = left // below, left % below
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // below, left % below
    return out + 1


def _divergences(terms: pa.Table, sources: pa.Table, best: int) -> pa.Table:
    """Of one shard of a language's kept terms (term, sources, counts): sums over them per pair of sources, and each source's `best` terms."""
    names = sources["source"].to_pylist()
    at, totals = {s: i for i, s in enumerate(names)}, sources["total"].to_numpy()
    kept, whole = sources["terms"][0].as_py(), int(totals.sum())
    lists, counts = terms["sources"].combine_chunks(), terms["counts"].combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(size)), size)
    coded = lists.flatten().dictionary_encode()
    column = np.array([at[s] for s in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
    count = counts.flatten().to_numpy()
    pairs, step = np.zeros((len(names), len(names)), np.int64), max(1, _CELLS // len(names))
    value = np.zeros(len(row), np.int64)
    for a in range(0, len(size), step):
        b = min(a + step, len(size))
        i, j = np.searchsorted(row, [a, b])
        table = np.zeros((b - a, len(names)), np.int64)
        table[row[i:j] - a, column[i:j]] = count[i:j]
        p, q = shares(table, totals[None, :], kept), shares(table.sum(axis=1), np.int64(whole), kept)
        for h in range(len(names)):
            pairs[:, h] += ((p - p[:, h:h + 1]) ** 2 // p[:, h:h + 1]).sum(axis=0)
        mine, base = p[row[i:j] - a, column[i:j]], q[row[i:j] - a]
        value[i:j] = np.where(mine > base, (mine - base) ** 2 // base, -1)
    g, h = np.nonzero(~np.eye(len(names), dtype=bool))
    places = np.empty(len(size), np.int64)
    places[pc.sort_indices(terms["term"]).to_numpy()] = np.arange(len(size))
    some = np.flatnonzero(value >= 0)
    some = some[np.lexsort((places[row[some]], -value[some], column[some]))]
    first = np.searchsorted(column[some], np.arange(len(names)))
    top = some[np.arange(len(some)) - first[column[some]] < best]
    name, words = pa.array(names, pa.string()), terms["term"].combine_chunks()
    return pa.table({
        "lang": pa.repeat(sources["lang"][0], len(g) + len(top)), "source": pa.concat_arrays([name.take(pa.array(g)), name.take(pa.array(column[top]))]),
        "part": pa.concat_arrays([pa.repeat("pair", len(g)), pa.repeat("term", len(top))]),
        "item": pa.concat_arrays([name.take(pa.array(h)), words.take(pa.array(row[top]))]), "value": pa.array(np.concatenate([pairs[g, h], value[top]]))})


def divergences(docs: DataFrame, least: int = 3, best: int = 200, shard_counts: int = 200_000) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source's terms lie from other sources' (part pair) and its most peculiar terms (part term).

    Terms that fewer than `least` documents of a language hold are left out. Null texts, languages and sources are empty ones, every row is a
    document (repeated ones count again), and texts of any length count whole. A source alone in its language has no pairs; a language
    without kept terms has pairs of value 0. An empty table gives no rows. Other columns are ignored.

    Partial counts meet by (language, term), so a source with a third of all rows spreads over all shards. A shard takes about
    `shard_counts` counts of one language and that language's sources; the pairs of a shard are as many rows as the result's.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    met = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = met.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list("source").alias("sources"), F.collect_list("n").alias("counts"))
    kept = settle_table(kept.filter(F.col("docs") >= least).select("lang", "term", "sources", "counts"))
    sums = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("total"), F.count("*").alias("entries"))
    each = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(each, "lang", "left")
    groups = settle(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "entries", "terms")]))
    shards = groups.groupBy("lang").agg(F.ceil(F.sum("entries") / shard_counts).cast("long").alias("shards"))
    sent = attach(kept, settle(shards), ["lang"]).withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards"))).drop("shards")
    lists = groups.join(shards.filter("shards > 0"), "lang").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).drop("shards")

    schema = "lang string, source string, part string, item string, value long"

    def work(terms: pa.Table, sources: pa.Table) -> pa.Table:
        if not terms.num_rows:
            return _EMPTY
        return _divergences(terms, sources, best)

    found = settle(sent.groupBy("lang", "shard").cogroup(lists.groupBy("lang", "shard")).applyInArrow(work, schema))
    summed = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(other, "lang").filter("source <> item").join(summed, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = found.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)


_EMPTY = pa.table({c: pa.array([], t) for c, t in [("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())]})


def op11_source_divergences(spark, folder) -> DataFrame:
    return divergences(spark.read.parquet(f"{folder}/documents.parquet"))


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
words AS (SELECT r, lang, source, unnest(ts) AS term FROM docs),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS c FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM docs),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY ALL),
p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(x.c, 0) AS c,
    1 + (1000000000::HUGEINT * (coalesce(x.c, 0) + 1)) // (coalesce(s.n, 0) + l.v) AS p, 1 + (1000000000::HUGEINT * (k.c + 1)) // (l.n + l.v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang LEFT JOIN sizes s ON g.lang = s.lang AND g.source = s.source
  LEFT JOIN counts x ON g.lang = x.lang AND g.source = x.source AND k.term = x.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM rows)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200"""
