"""Vector compression by product codes, in whole numbers from the components to the distances.

A vector is cut into parts and each part is coded by the nearest entry of its position's codebook. Parts and entries, zero-padded to a
power of two, go through a Walsh-Hadamard transform, which multiplies every squared distance by the padded length. Its first
coefficients in sequency order (by sign changes) hold most of a smooth part's energy, so most entries have passed the
best distance after a few of them and are summed no further. Nothing is rounded: sums that a 64-bit number may not hold
are taken in Python's integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitframe.functions.cluster import attach, settle, settle_table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LIMB, LIMBS = 30, 6  # sums go between tasks in limbs of 30 bits, so no size of a component breaks them


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the last axis, whose length is a power of two, in sequency order."""
    n = x.shape[-1]
    out, half = x, 1
    while half < n:
        pairs = out.reshape(*x.shape[:-1], n // (2 * half), 2, half)
        out = np.stack([pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]], axis=-2).reshape(x.shape)
        half *= 2
    return out[..., sequency(n)]


def sequency(n: int) -> np.ndarray:
    """The places of the n Walsh functions in the order of their sign changes."""
    i = np.arange(n)
    signs = np.bitwise_count(i[:, None] & i[None, :]) & 1
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(axis=1))


def _padded(x: np.ndarray) -> np.ndarray:
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    return np.concatenate([x, np.zeros((len(x), width - x.shape[1]), x.dtype)], axis=1)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part (the lower index of equal ones) and the squared distance, both exact."""
    x, c = _padded(parts), _padded(entries)
    width = x.shape[1]
    largest = max((int(abs(a).max()) for a in (x, c) if a.size), default=0)
    if 4 * width ** 3 * largest ** 2 >= 1 << 62:
        x, c = x.astype(object), c.astype(object)
    elif x.dtype == object or c.dtype == object:
        x, c = x.astype(np.int64), c.astype(np.int64)
    x, c = hadamard(x), hadamard(c)
    ends = [e for e in (1, 2, 4, 8, 16, 32, 64, 128) if e < width] + [width]
    first = ends[min(1, len(ends) - 1)]
    found, best = np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype)
    for at in range(0, len(x), 8192):
        y = x[at:at + 8192]
        head = ((y[:, None, :first] - c[None, :, :first]) ** 2).sum(axis=2)
        bound = ((y - c[head.argmin(axis=1)]) ** 2).sum(axis=1)
        row, entry = np.nonzero(head <= bound[:, None])
        run = head[row, entry]
        for a, b in zip(ends, ends[1:]):
            if b <= first:
                continue
            run = run + ((y[row, a:b] - c[entry, a:b]) ** 2).sum(axis=1)
            left = run <= bound[row]
            row, entry, run = row[left], entry[left], run[left]
        low = np.full(len(y), None) if run.dtype == object else np.full(len(y), np.iinfo(np.int64).max)
        if run.dtype == object:
            for r, v in zip(row.tolist(), run):
                low[r] = v if low[r] is None else min(low[r], v)
        else:
            np.minimum.at(low, row, run)
        tied = run == low[row]
        row, entry = row[tied], entry[tied]
        place, where = np.unique(row, return_index=True)  # entries of a row stand in rising order
        found[at + place], best[at + place] = entry[where], low // width
    return found, best


def whole(batch: pa.Table | pa.RecordBatch, dim: int) -> np.ndarray:
    """floor(4096 x) of the vectors in column v, continued with zeros to `dim`; Python integers where 64 bits may not do."""
    vectors = batch.column("v")
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.zeros((len(sizes), dim))
    x[np.arange(dim)[None, :] < sizes[:, None]] = flat
    x = np.floor(x * SCALE)
    return x.astype(np.int64) if not x.size or np.abs(x).max() < 1 << 62 else np.vectorize(int, otypes=[object])(x)


def _assigned(x: np.ndarray, books: list) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    width = x.shape[1] // PARTS
    for p, book in enumerate(books):
        part = x[:, p * width:(p + 1) * width]
        yield (p, part, *nearest(part, np.array(book, dtype=object)))


def _limbs(v: int) -> list[int]:
    return [(v >> (LIMB * i)) & ((1 << LIMB) - 1) for i in range(LIMBS - 1)] + [v >> (LIMB * (LIMBS - 1))]


def train(vectors: DataFrame, dim: int, rounds: int = ROUNDS, entries: int = ENTRIES) -> list[list[list[int]]]:
    """Codebooks [part][entry][position] of `vectors` (vec_id, v) of up to `dim` components, a multiple of PARTS.

    They start as the parts of the smallest vec_ids (null ones last, equal ones by their vectors); each round is one pass, whose tasks
    return at most PARTS x entries sums of theirs. What reaches the driver depends on dim and entries only.
    """
    width = dim // PARTS
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()
    start = whole(first, dim)
    books = [[[int(v) for v in row] for row in start[:, p * width:(p + 1) * width]] for p in range(PARTS)]
    for _ in range(rounds):
        def work(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
            n = np.zeros((PARTS, entries), np.int64)
            sums = np.zeros((PARTS, entries, width), object)
            for batch in (b for b in batches if b.num_rows):
                for p, part, entry, _ in _assigned(whole(batch, dim), books):
                    n[p] += np.bincount(entry, minlength=entries)
                    for e in np.unique(entry):
                        mine = part[entry == e]
                        small = mine.dtype != object and int(np.abs(mine).max()) * len(mine) < 1 << 62
                        sums[p, e] += (mine if small else mine.astype(object)).sum(axis=0)
            place = [(p, e, j) for p, e in zip(*np.nonzero(n)) for j in range(width)]
            yield pa.RecordBatch.from_pydict({
                "at": pa.array([(p * entries + e) * width + j for p, e, j in place], pa.int64()), "n": pa.array([n[p, e] for p, e, _ in place], pa.int64()),
                "s": pa.array([_limbs(int(sums[x])) for x in place], pa.list_(pa.int64()))})

        parts = vectors.select("v").mapInArrow(work, "at long, n long, s array<long>")
        total = parts.groupBy("at").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(LIMBS)]).collect()
        books = [[list(e) for e in book] for book in books]
        for row in total:
            p, e, j = row["at"] // width // entries, row["at"] // width % entries, row["at"] % width
            books[p][e][j] = sum(row[f"s{i}"] << (LIMB * i) for i in range(LIMBS)) // row["n"]
    return books


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, label, v of the rows whose vector is not null and holds neither nulls nor non-finite components."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col(column).isNotNull() & ~bad).select(F.col("vec_id").cast("long"), "label", F.col(column).alias("v"))


def compress(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, list]:
    """(vec_id, label, codes binary, error) of each usable row of `vectors` (vec_id, embedding, label), and the codebooks.

    Repeated rows and vec_ids are vectors like others; vectors shorter than the longest, or than the next multiple of PARTS, go on with
    zeros, an empty one is all zeros. An error beyond 64 bits is null. An empty table gives no rows and empty codebooks.
    """
    if entries > 256:
        raise ValueError("a code is one byte")
    table = settle_table(usable(vectors))
    longest = table.agg(F.max(F.size("v"))).first()[0] or 0
    dim = max(1, -(-longest // PARTS)) * PARTS
    books = train(table, dim, rounds, entries)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            codes, error = np.zeros((batch.num_rows, PARTS), np.uint8), np.zeros(batch.num_rows, object)
            for p, _, entry, distance in _assigned(whole(batch, dim), books):
                codes[:, p], error = entry, error + distance.astype(object)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes() for c in codes], pa.binary()),
                                              pa.array([int(e) if e < 1 << 63 else None for e in error], pa.int64())], ["vec_id", "label", "codes", "error"])

    return settle_table(table.mapInArrow(work, f"vec_id long, label {table.schema['label'].dataType.simpleString()}, codes binary, error long")), books


def op12_walsh_vector_codes(spark, folder) -> DataFrame:
    """The codes with the error of each label (nulls together; null beyond 64 bits) and the digest of all codebooks."""
    coded, books = compress(spark.read.parquet(f"{folder}/embeddings.parquet"))
    digest = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    label_error = F.when(F.count("*") == F.count("error"), F.try_sum("error")).alias("label_error")
    found = attach(coded, settle(coded.groupBy("label").agg(label_error)), ["label"])
    return found.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """The same by joins, the rounds written out."""
    near = """near{k} AS MATERIALIZED (
  SELECT r, part, arg_min(entry, dist * 16 + entry) AS entry, min(dist) AS dist FROM (
    SELECT a.r, a.part, c.entry, sum((a.v - c.v) * (a.v - c.v)) AS dist FROM cells a JOIN book{k} c ON a.part = c.part AND a.pos = c.pos GROUP BY ALL) GROUP BY ALL)"""
    book = """book{n} AS MATERIALIZED (
  SELECT c.part, c.entry, c.pos, coalesce(m.v, c.v) AS v FROM book{k} c LEFT JOIN (
    SELECT part, entry, pos, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS v FROM (
      SELECT x.part, x.entry, a.pos, sum(a.v) AS s, count(*) AS n FROM cells a JOIN near{k} x ON a.r = x.r AND a.part = x.part GROUP BY ALL)) m
  ON c.part = m.part AND c.entry = m.entry AND c.pos = m.pos)"""
    rounds = ",\n".join(near.format(k=k) + ",\n" + book.format(k=k, n=k + 1) for k in range(ROUNDS))
    return f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS MATERIALIZED (
  SELECT r, i // (n // {PARTS}) AS part, i % (n // {PARTS}) AS pos, CAST(floor({SCALE} * CAST(embedding[i + 1] AS DOUBLE)) AS BIGINT) AS v
  FROM (SELECT r, embedding, len(embedding) AS n, unnest(range(len(embedding))) AS i FROM kept)),
book0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, v FROM cells WHERE r <= {ENTRIES}),
{rounds},
{near.format(k=ROUNDS)},
coded AS (
  SELECT k.vec_id, k.label, string_agg(printf('%02x', x.entry), '' ORDER BY x.part) AS code, CAST(sum(x.dist) AS BIGINT) AS error
  FROM kept k JOIN near{ROUNDS} x ON k.r = x.r GROUP BY k.r, k.vec_id, k.label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book{ROUNDS}) AS codebooks_sha256 FROM coded"""


OP12_SQL = _sql()
