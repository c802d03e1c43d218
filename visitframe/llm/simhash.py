"""SimHash near-duplicates found by covering locality-sensitive hashing.

Bit i of a fingerprint is given a nonzero vector m(i) of radius + 1 bits. For each nonzero vector v there is one
table, whose mask keeps the bits with odd <m(i), v>. At most `radius` differing bits leave some v orthogonal
to all their vectors, and in that table the two masked fingerprints are equal: no pair is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitframe.functions.cluster import attach, filter_by, release, settle, small_batches
from visitframe.llm.components import components


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """2^(radius + 1) - 1 masks over the lowest `bits` bits; as signed 64 bit numbers."""
    n = (1 << (radius + 1)) - 1
    vectors = [i % n + 1 for i in range(bits)]
    masks = (sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, n + 1))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def words_of(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the A-Z-lower-cased text."""
    return (text or b"").lower().split()


def shingle_hashes(words: list[bytes], size: int) -> list[int]:
    """XXH64 with seed 42 of each run of `size` words joined by blanks; of all words if there are fewer."""
    import xxhash

    if not words:
        return []
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends.tolist()[size - 1:] or [len(joined)]
    return [h(joined[a:b], 42) for a, b in zip(starts, last)]


def fingerprint(hashes: list[int]) -> int:
    """The bits set in over half the hashes."""
    if not hashes:
        return 0
    rows = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    most = np.zeros(64, np.int64)
    for i in range(0, len(rows), 65536):
        most += np.unpackbits(rows[i:i + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * most > len(rows), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp (signed 64 bit) per document (doc_id, text). A text without words, null included, has 0."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fp = [fingerprint(shingle_hashes(words_of(t), size)) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "fp": np.array(fp, np.uint64).view(np.int64)})
        release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInPandas(work, "doc_id long, fp long")


def _near_in_buckets(radius: int):
    """Star edges of the components of each bucket's graph of pairs within the radius; buckets of one size at a time."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes = frame["fps"].map(len).to_numpy()
            for k in np.unique(sizes):
                group = np.sort(np.array(frame["fps"][sizes == k].tolist(), np.int64), axis=1)
                step = max(1, (1 << 22) // int(k) ** 2)
                for at in range(0, len(group), step):
                    x = group[at:at + step]
                    near = np.bitwise_count((x[:, :, None] ^ x[:, None, :]).view(np.uint64)) <= radius
                    label = np.broadcast_to(np.arange(k), x.shape).copy()
                    while True:
                        less = np.where(near, label[:, None, :], k).min(axis=2)
                        if (less == label).all():
                            break
                        label = less
                    root = np.take_along_axis(x, label, axis=1)
                    moved = root != x
                    yield pd.DataFrame({"a": root[moved], "b": x[moved]})

    return work


def near_edges(fps: DataFrame, radius: int = 2, small: int = 256) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of the distinct fingerprints `fp` within the radius.

    A bucket of up to `small` fingerprints is compared inside one row. Those of larger buckets are linked
    through the values one flip away (radius 2 or less): two fingerprints within two bits share such a value,
    and a value has at most 65 fingerprints around it, so those groups are bounded whatever the data.
    """
    if radius > 2:
        raise ValueError("large buckets are linked through single flips, which reach two bits")
    masks = F.array(*[F.struct(F.lit(i).cast("short").alias("t"), F.lit(m).cast("long").alias("m")) for i, m in enumerate(covering_masks(radius))])
    rows = fps.select("fp", F.explode(masks).alias("x")).select("fp", F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"))
    crowded = settle(rows.groupBy("t", "key").count().filter(F.col("count") > small))
    if crowded.isEmpty():
        calm, hot = rows, None
    else:
        flagged = attach(rows, crowded, ["t", "key"])
        calm = flagged.filter(F.col("count").isNull())
        hot = flagged.filter(F.col("count").isNotNull()).select("fp").distinct()
    buckets = calm.groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")
    edges = buckets.mapInPandas(_near_in_buckets(radius), "a long, b long")
    if hot is not None:
        flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
        around = hot.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
        stars = around.groupBy("value").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
        edges = edges.unionByName(stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b"))
    return edges


def simhash_components(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp, component_id per document: the smallest doc_id reachable by fingerprints within the radius.

    Copies meet as one fingerprint before any bucket is made. Null doc_ids are documents too; a component of null
    doc_ids alone has a null component_id. Repeated rows and doc_ids give repeated rows.
    """
    with small_batches(docs.sparkSession):
        marks = settle(fingerprints(docs, size))
    first = settle(marks.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(near_edges(first.select("fp"), radius)).withColumnRenamed("node", "fp")
    joined = first.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.join(smallest, "root").select("fp", "component_id")
    return marks.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """docs without all but the smallest doc_id of each component, all columns as they were.

    A null doc_id names no document, so its rows stay. Rows with one doc_id stay together: they go if none of them is the first of its component.
    """
    found = simhash_components(docs.select("doc_id", "text"), size, radius)
    gone = found.groupBy("doc_id").agg(F.min(F.col("doc_id") != F.col("component_id")).alias("gone")).filter("gone")
    return filter_by(docs, gone, "doc_id", "left_anti").select(*docs.columns)


def op2_simhash_components(spark, folder) -> DataFrame:
    found = simhash_components(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
