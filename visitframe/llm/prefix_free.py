"""Repeated passages by prefix-free parsing.

A rolling hash over short byte windows sets triggers: the window of least hash among the short windows of each
`span` bytes. Text is parsed into phrases, the maximal runs of span-byte strings that share their trigger, so every
span-byte string lies in exactly one phrase of its document, and equal strings lie in phrases of equal trigger. The
dictionary of distinct phrases is sorted by trigger in shards (the role of the suffix array of the dictionary); the
parse, a document's phrases, is kept as (start, number of strings). Between tasks documents go by their place in their block, and
numbers as compressed gaps. Combining both needs no text:
  * a phrase that also occurs in a smaller document is removed as a whole;
  * the first occurrences of distinct phrases of one trigger can share strings in part; for these alone all
    their strings are hashed and sorted against each other, which is the order of the dictionary's suffixes
    cut at `span` bytes.
Everything else, which in highly repetitive text is nearly everything, is settled phrase by phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitframe.functions.cluster import settle
from visitframe.llm.lm_scoring import pack, unpack

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLES: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _powers(name: str, base: int, n: int) -> np.ndarray:
    if name not in _TABLES or len(_TABLES[name]) < n:
        out = np.full(1 << max(16, n.bit_length()), base, np.uint64)
        out[0] = 1
        _TABLES[name] = np.multiply.accumulate(out)
    return _TABLES[name][:n]


class Rolled:
    """Hashes of all windows of a run of bytes: polynomial sums, shifted to position zero and mixed."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers("up", _BASE, n), out=self.sums[1:])
        self.down = _powers("down", _INVERSE, n + 1)

    def at(self, start: np.ndarray, length) -> np.ndarray:
        return _mix((self.sums[start + length] - self.sums[start]) * self.down[start])

    def all(self, length: int) -> np.ndarray:
        return _mix((self.sums[length:] - self.sums[:-length]) * self.down[: len(self.sums) - length])


def phrases(data: bytes, lengths: list[int], span: int, trigger: int):
    """Phrases of documents laid end to end: (document, start in it, strings, trigger hash, phrase hash), and Rolled, document starts."""
    rolled = Rolled(np.frombuffer(data, np.uint8))
    ends = np.cumsum(lengths)
    begins = ends - lengths
    none = np.zeros(0, np.int64)
    if len(data) < span:
        return (none, none, none, none.astype(np.uint64), none.astype(np.uint64)), rolled, begins
    least, width, want = rolled.all(trigger), 1, span - trigger + 1
    while width < want:
        step = min(width, want - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    # strings that begin in a document and end in it
    doc = np.repeat(np.arange(len(lengths)), lengths)[: len(least)]
    inside = np.arange(len(least)) + span <= ends[doc]
    new = inside.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    new[1:] |= inside[1:] & (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    if not len(start):
        return (none, none, none, none.astype(np.uint64), none.astype(np.uint64)), rolled, begins
    total = np.concatenate([[0], np.cumsum(inside)])
    upto = np.append(start[1:], len(least))
    strings = total[upto] - total[start]
    whole = rolled.at(start, strings + span - 1) ^ strings.astype(np.uint64)
    return (doc[start], start - begins[doc[start]], strings, _mix(least[start]), whole), rolled, begins


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys, and the group number of each row in that order."""
    order = np.lexsort(keys[::-1])
    change = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        change[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(change)


def _first(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The least value of each row's group; groups are numbered in row order."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, int)
    return np.repeat(np.minimum.reduceat(value, starts), np.diff(np.r_[starts, len(group)])) if len(group) else value


def _blocks(frame: pd.DataFrame, most: int = 1 << 22) -> Iterator[tuple[list, bytes, list[int]]]:
    """Runs of a frame's documents of about `most` bytes: their rows, texts end to end, lengths."""
    rows, size = [], 0
    for row in frame.itertuples(index=False):
        rows.append(row)
        size += len(row.text)
        if size >= most:
            yield rows, b"".join(r.text for r in rows), [len(r.text) for r in rows]
            rows, size = [], 0
    if rows:
        yield rows, b"".join(r.text for r in rows), [len(r.text) for r in rows]


def _gaps(x: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Differences to the number before (modulo 2^64), whole numbers where `at` holds."""
    x = x.astype(np.uint64)
    gaps = np.diff(x, prepend=np.uint64(0))
    return gaps if at is None else np.where(at, x, gaps)


def _summed(gaps: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """The inverse of _gaps."""
    x = np.cumsum(gaps.astype(np.int64).view(np.uint64), dtype=np.uint64)
    if at is not None and len(x):
        heads = np.flatnonzero(at)
        before = x[heads] - gaps[heads].astype(np.int64).view(np.uint64)
        x -= np.repeat(before, np.diff(np.r_[heads, len(x)]))
    return x.view(np.int64)


def _heads(place: np.ndarray) -> np.ndarray:
    return np.r_[True, place[1:] != place[:-1]][:len(place)]


def _pack(shard: np.ndarray, shards: int, block: int, place: np.ndarray, rank: np.ndarray, start: np.ndarray, cols: list[np.ndarray]) -> pd.DataFrame:
    """One record per shard: its entries' documents by place in the block, starts and columns, as small numbers; a document's rank goes once."""
    order = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(shards + 1))
    out = []
    for s in np.flatnonzero(np.diff(bounds)):
        at = order[bounds[s]:bounds[s + 1]]
        new = _heads(place[at])
        out.append((int(s), block, pack([_gaps(place[at]), _gaps(rank[at][new]), _gaps(start[at], new), *[c[at] for c in cols]])))
    return pd.DataFrame(out, columns=["shard", "block", "body"])


def _unpack(frame: pd.DataFrame, blocks: int):
    """Row numbers (place times blocks plus block), ranks, starts and columns of all entries of a shard."""
    parts = []
    for block, body in zip(frame["block"], frame["body"]):
        place, rank, start, *cols = unpack(body)
        place = _summed(place)
        new = _heads(place)
        parts.append((place * blocks + block, _summed(rank)[np.cumsum(new) - 1], _summed(start, new), *[c.astype(np.int64).view(np.uint64) for c in cols]))
    row, rank, start, *cols = (np.concatenate(x) for x in zip(*parts))
    return row, rank, start, cols


def _runs(row: np.ndarray, start: np.ndarray, strings: np.ndarray, kind: np.ndarray, blocks: int) -> pd.DataFrame:
    """Findings as one record per block of documents."""
    block = row % blocks
    order = np.lexsort((start, row, block))
    bounds = np.searchsorted(block[order], np.arange(blocks + 1))
    out = []
    for b in np.flatnonzero(np.diff(bounds)):
        at = order[bounds[b]:bounds[b + 1]]
        place = row[at] // blocks
        out.append((int(b), pack([_gaps(place), _gaps(start[at], _heads(place)), strings[at], kind[at]])))
    return pd.DataFrame(out, columns=["block", "body"])


def _placed(frame: pd.DataFrame) -> pd.DataFrame:
    """A block's documents in the order of their ranks, each with its place; rows of one key share it."""
    frame = frame.sort_values(["rank", "key"], kind="stable")
    return frame.assign(place=np.cumsum(_heads(frame["key"].to_numpy())) - 1)


PACKED = "shard long, block long, body binary"
FOUND = "block long, body binary"
LAST = np.iinfo(np.int64).max


def repeated_passages(docs: DataFrame, span: int = 50, trigger: int = 20, block_bytes: int = 8 << 20, shard_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans, kept for documents (doc_id, text), text as UTF-8 bytes.

    A byte goes if a string of `span` bytes over it also starts in a document of smaller doc_id, as the input stands.
    Null and empty texts have no bytes. Documents of equal doc_id are not smaller than each other; one without a
    doc_id counts as larger than all others. Hashes have 64 bits beside the trigger's 32. The numbers of blocks and shards follow
    the bytes of the table, which bounds a task's memory; a document is never split.
    """
    spark = docs.sparkSession
    raw = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    size = raw.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    shards = max(1, -(-size // shard_bytes))
    key = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)
    keyed = raw.withColumn("key", key).withColumn("block", F.pmod("key", F.lit(blocks)))

    def squeeze(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        tool = zstandard.ZstdCompressor(level=1)
        for frame in frames:
            yield frame.assign(n=frame["text"].map(len), text=frame["text"].map(tool.compress))

    # text moves once, compressed; later passes find each block's documents where they are
    moved = keyed.select("block", "key", F.coalesce("doc_id", F.lit(LAST)).alias("rank"), "doc_id", "text").mapInPandas(
        squeeze, "block long, key long, rank long, doc_id long, text binary, n long")
    held = moved.repartition(int(blocks), "block").persist()

    def plain(frame: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        tool = zstandard.ZstdDecompressor()
        return frame.assign(text=[tool.decompress(t, max_output_size=int(n)) if n else b"" for t, n in zip(frame["text"], frame["n"])])

    def entries_of(frame: pd.DataFrame):
        """A block's phrases, and which of them repeat one of a smaller document of the same block."""
        parts = []
        for rows, data, lengths in _blocks(plain(_placed(frame))):
            (doc, start, strings, mark, whole), _, _ = phrases(data, lengths, span, trigger)
            parts.append((np.array([r.place for r in rows], np.int64)[doc], np.array([r.rank for r in rows], np.int64)[doc], start, strings, mark, whole))
        cols = [np.concatenate(x) for x in zip(*parts)]
        order, group = _groups(cols[4], cols[5])
        known = np.zeros(len(order), bool)
        known[order] = cols[1][order] > _first(group, cols[1][order])
        return cols, known

    def parse(frame: pd.DataFrame) -> pd.DataFrame:
        cols, known = entries_of(frame)
        place, rank, start, strings, mark, whole = (c[~known] for c in cols)  # a widespread phrase leaves a block once
        return _pack((mark >> np.uint64(32)) % np.uint64(shards), shards, int(frame["block"].iloc[0]), place, rank, start, [mark & np.uint64(0xFFFFFFFF), whole, strings])

    def settle_phrases(frame: pd.DataFrame) -> pd.DataFrame:
        row, rank, start, (mark, whole, strings) = _unpack(frame, blocks)
        order, group = _groups(mark, whole)
        row, rank, mark, whole, start, strings = (x[order] for x in (row, rank, mark, whole, start, strings))
        least = _first(group, rank)
        repeat = rank > least
        head = np.r_[True, group[1:] != group[:-1]]
        trig = np.cumsum(np.r_[True, mark[1:] != mark[:-1]]) - 1
        several = np.bincount(trig, weights=head)[trig] > 1
        several &= _first(trig, rank) < np.maximum.reduceat(rank, np.flatnonzero(np.r_[True, trig[1:] != trig[:-1]]))[trig]
        look = several & ~repeat
        pick = repeat | look
        return _runs(row[pick], start[pick], strings[pick], look[pick], blocks)

    entries = held.groupBy("block").applyInPandas(parse, PACKED)
    first = settle(entries.groupBy("shard").applyInPandas(settle_phrases, FOUND))

    def findings(frame: pd.DataFrame, kind: int | None):
        """place -> (starts, strings)"""
        parts = []
        for body in frame["body"]:
            place, start, strings, kinds = unpack(body)
            place = _summed(place)
            pick = kinds == kind
            parts.append((place[pick], _summed(start, _heads(place))[pick], strings[pick].astype(np.int64)))
        if not parts:
            return {}
        place, start, strings = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((start, place))
        place, start, strings = place[order], start[order], strings[order]
        edge = np.flatnonzero(_heads(place))
        return {int(place[a]): (start[a:b], strings[a:b]) for a, b in zip(edge, [*edge[1:], len(place)])}

    def strings_of(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        look, parts = findings(found, 1), []
        texts = _placed(texts)
        texts = texts[texts["place"].isin(list(look))]
        for rows, data, lengths in _blocks(plain(texts)):
            rolled = Rolled(np.frombuffer(data, np.uint8))
            for r, begin in zip(rows, np.cumsum(lengths) - lengths):
                starts, strings = look[r.place]
                at = np.repeat(starts - np.cumsum(strings) + strings, strings) + np.arange(strings.sum())
                parts.append((np.full(len(at), r.place), np.full(len(at), r.rank), at, rolled.at(at + begin, span)))
        if not parts:
            return pd.DataFrame(columns=["shard", "block", "body"])
        place, rank, at, mark = (np.concatenate(x) for x in zip(*parts))
        return _pack((mark >> np.uint64(32)) % np.uint64(shards), shards, int(texts["block"].iloc[0]), place, rank, at, [mark])

    def settle_strings(frame: pd.DataFrame) -> pd.DataFrame:
        row, rank, at, (mark,) = _unpack(frame, blocks)
        order, group = _groups(mark)
        row, rank, at = row[order], rank[order], at[order]
        gone = rank > _first(group, rank)
        return _runs(row[gone], at[gone], np.ones(gone.sum(), np.uint32), np.zeros(gone.sum(), bool), blocks)

    texts = held.groupBy("block")
    part = texts.cogroup(first.groupBy("block")).applyInPandas(strings_of, PACKED)
    second = settle(part.groupBy("shard").applyInPandas(settle_strings, FOUND))

    def remove(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        gone, out = findings(found, 0), []
        if len(texts):
            texts = _placed(texts)
            (place, _, start, strings, _, _), known = entries_of(texts)
            own = findings(_runs(place[known], start[known], strings[known], np.zeros(known.sum(), bool), 1), 0)
            for k, pair in own.items():
                gone[k] = tuple(np.concatenate(x) for x in zip(gone[k], pair)) if k in gone else pair
        for r in plain(texts).itertuples(index=False):
            spans, kept, removed = [], r.text, 0
            if r.place in gone:
                starts, strings = gone[r.place]
                cover = np.zeros(len(r.text) + 1, np.int32)
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + strings - 1 + span, -1)
                hit = np.cumsum(cover)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.r_[False, hit, False]))
                spans = edge.reshape(-1, 2).tolist()
                removed = int(hit.sum())
                kept = np.frombuffer(r.text, np.uint8)[~hit].tobytes()
            out.append((None if pd.isna(r.doc_id) else int(r.doc_id), len(r.text), removed, len(spans), spans, kept))
        frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])
        return frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    both = first.unionByName(second)
    return texts.cogroup(both.groupBy("block")).applyInPandas(
        remove, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept binary")


def op10_repeated_passages(spark, folder) -> DataFrame:
    found = repeated_passages(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
