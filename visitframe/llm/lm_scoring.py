"""Language-model scores of texts under a trie of the corpus' own n-grams.

Words become 64-bit hashes, blocks of documents carry their different words to shards of the vocabulary and get back numbers and counts. Each
block then sends every different gram once to the shard of its nearest context word, with the documents it stands in. A shard sums the
grams learned from, builds their trie and answers with sums per document. Nothing passes through the driver but two totals, a shard
holds a bounded number of grams of a bounded number of contexts, and a context word seen over `split` times is parted.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitframe.functions.cluster import settle_table
from visitframe.llm.elias_fano import Trie

ORDER = 3
START, UNKNOWN = 0, 1  # words' numbers from 2 on
END = b" "  # no word holds a blank
_TEXT, _PART = 1 << 20, 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pack(arrays: list[np.ndarray]) -> bytes:
    """Whole numbers from 0 on; each of their bytes is a plane of its own, compressed alone as its values are spread alike."""
    import zstandard

    out, squeeze = [], zstandard.ZstdCompressor(level=1, write_checksum=False, write_content_size=True).compress
    for a in arrays:
        a = np.ascontiguousarray(a).astype("<u8", copy=False)
        width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        planes = a.view(np.uint8).reshape(-1, 8)
        out.append(struct.pack("<QB", len(a), width))
        for i in range(width):
            plane = np.ascontiguousarray(planes[:, i])
            if len(plane) and not plane.any():
                out.append(struct.pack("<I", 0))
                continue
            data = squeeze(plane.tobytes())
            out += [struct.pack("<I", len(data)), data]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays, as 32-bit numbers where three bytes hold them."""
    import zstandard

    out, at, loosen = [], 0, zstandard.ZstdDecompressor().decompress
    while at < len(data):
        n, width = struct.unpack_from("<QB", data, at)
        at += 9
        octets = np.zeros((n, 4 if width <= 3 else 8), np.uint8)
        for i in range(width):
            (size,) = struct.unpack_from("<I", data, at)
            at += 4
            if size:
                octets[:, i] = np.frombuffer(loosen(data[at:at + size]), np.uint8)
                at += size
        out.append(octets.view("<i4" if width <= 3 else "<i8")[:, 0])
    return out


def pack_hashes(hashes: np.ndarray) -> bytes:
    """Rising 64-bit hashes by their gaps."""
    return pack([np.diff(hashes, prepend=np.uint64(0))]) if len(hashes) else b""


def unpack_hashes(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data)[0].astype(np.int64).view(np.uint64), dtype=np.uint64) if data else np.zeros(0, np.uint64)


def _words(text: bytes) -> Iterator[list[bytes]]:
    """A-Z lower-cased words [^\\x20\\x09-\\x0D]+, those of about _TEXT bytes at a time."""
    a = 0
    while a < len(text):
        cut = _SPACE.search(text, a + _TEXT)
        b = cut.end() if cut else len(text)
        yield text[a:b].lower().split()
        a = b


class _Block:
    """Documents in a task until they have enough words: a stream of local word numbers, each part of a document after the `lead` words before it."""

    def __init__(self, lead: int):
        self.lead, self.size, self.stream, self.parts = lead, 0, [], []
        self.numbers: dict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__

    def add(self, words: list[bytes], before: list[bytes], first: int | None, doc_id: int | None, learned: bool) -> None:
        """first: number of the document's first part in this task, None for that part itself."""
        numbers = self.numbers
        lead = [-1] * (self.lead - len(before)) + [numbers[w] for w in before]
        self.stream.append(np.array(lead + [numbers[w] for w in words], np.int64))
        self.parts.append((first, doc_id, learned, len(words)))
        self.size += len(words)

    def row(self, block: int) -> dict:
        import xxhash

        hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.numbers], np.uint64)
        order = np.argsort(hashes)
        number = np.empty(len(order) + 1, np.int64)
        number[order], number[-1] = np.arange(1, len(order) + 1), 0
        lengths, learned = np.array([p[3] for p in self.parts], np.int64), np.array([p[2] for p in self.parts])
        tokens = number[np.concatenate(self.stream)]
        ends = np.cumsum(lengths + self.lead)
        own = np.ones(len(tokens), bool)
        own[(ends - lengths)[:, None] - np.arange(1, self.lead + 1)] = False
        counts = np.bincount(tokens[own & np.repeat(learned, lengths + self.lead)], minlength=len(hashes) + 1)[1:]
        starts = [(block << 24) + i if first is None else first for i, (first, *_) in enumerate(self.parts)]
        return {"block": block, "starts": starts, "ids": [p[1] for p in self.parts], "learned": learned.tolist(), "lengths": lengths.tolist(), "hashes": pack_hashes(hashes[order]),
                "counts": pack([counts]), "tokens": pack([tokens]), "n_words": len(hashes), "n_tokens": int(lengths.sum()),
                "n_learned": int(lengths[learned].sum()), "n_starts": sum(p[2] and p[0] is None for p in self.parts)}


_BLOCK = ("block long, starts array<long>, ids array<long>, learned array<boolean>, lengths array<long>, hashes binary, counts binary, tokens binary, "
          "n_words long, n_tokens long, n_learned long, n_starts long")


def _table(rows: list[dict], kinds: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.table({c: pa.array([r[c] for r in rows], t) for c, t in kinds})


_BLOCK_KINDS = [("block", pa.int64()), ("starts", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("learned", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())),
                *[(c, pa.binary()) for c in ("hashes", "counts", "tokens")], *[(c, pa.int64()) for c in ("n_words", "n_tokens", "n_learned", "n_starts")]]


def blocks_of(docs: DataFrame, order: int, block_tokens: int) -> DataFrame:
    """Blocks of about `block_tokens` tokens of docs (doc_id long, learned boolean, text binary); a longer text goes on in the next block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, number = _Block(order - 1), TaskContext.get().partitionId() << 20

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal block, number
            yield from _table([block.row(number)], _BLOCK_KINDS).to_batches()
            block, number = _Block(order - 1), number + 1

        for batch in batches:
            for doc_id, learned, text in zip(*(batch.column(c) for c in ("doc_id", "learned", "text"))):
                doc_id, learned, text = doc_id.as_py(), learned.as_py(), text.as_py() or b""
                first, held, before = None, [], []
                for words in _words(text):
                    held += words
                    while len(held) >= _PART:
                        mine = (number << 24) + len(block.parts)
                        block.add(held[:_PART], before, first, doc_id, learned)
                        first = mine if first is None else first
                        before, held = held[_PART - order + 1:_PART], held[_PART:]
                        if block.size >= block_tokens:
                            yield from close()
                block.add([*held, END], before, first, doc_id, learned)
                if block.size >= block_tokens:
                    yield from close()
        if block.parts:
            yield from close()

    return docs.mapInArrow(work, _BLOCK)


def vocabulary(blocks: DataFrame, bits: int) -> DataFrame:
    """block, shard, known, words: for a block's hashes in one of 2^bits ranges the words' numbers, learned counts and 16 bits of hash; known: words learned in the range.

    Numbers rise as counts fall, so frequent words have small ones; all words never learned share one.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, hashes, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "hashes", "counts"))):
                hashes, counts = unpack_hashes(hashes), unpack(counts)[0]
                cuts = np.searchsorted(hashes, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
                cuts = [0, *map(int, cuts), len(hashes)]
                rows = [{"shard": s, "block": block, "hashes": pack_hashes(hashes[a:b]), "counts": pack([counts[a:b]])} for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                yield from _table(rows, [("shard", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())]).to_batches()

    def number(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        hashes = [unpack_hashes(h) for h in table["hashes"].to_pylist()]
        counts = np.concatenate([unpack(c)[0] for c in table["counts"].to_pylist()])
        each, where = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(where, weights=counts, minlength=len(each)).astype(np.int64)
        rank = np.empty(len(each), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(each))
        numbers = np.where(total > 0, 2 + (rank << bits) + shard, UNKNOWN)
        salt, rows, a = (each & np.uint64(0xFFFF)).astype(np.int64), [], 0
        known = int((total > 0).sum())
        for block, h in zip(table["block"].to_pylist(), hashes):
            mine = where[a:a + len(h)]
            a += len(h)
            rows.append({"block": block, "shard": shard, "known": known, "words": pack([numbers[mine], total[mine], salt[mine]])})
        return _table(rows, [("block", pa.int64()), ("shard", pa.int64()), ("known", pa.int64()), ("words", pa.binary())])

    sent = blocks.select("block", "hashes", "counts").mapInArrow(send, "shard long, block long, hashes binary, counts binary")
    return sent.groupBy("shard").applyInArrow(number, "block long, shard long, known long, words binary")


def _mixed(x: np.ndarray) -> np.ndarray:
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)


def _combined(columns: list[np.ndarray]) -> np.ndarray:
    """One number for each different row of columns, in their order."""
    out = columns[0].astype(np.int64)
    size = int(out.max()) + 1 if len(out) else 1
    for c in columns[1:]:
        wide = int(c.max()) + 1 if len(c) else 1
        if size * wide >= 1 << 62:
            out = np.unique(out, return_inverse=True)[1].astype(np.int64)
            size = int(out.max()) + 1
        out *= wide
        out += c
        size *= wide
    return out


def base_probability(count: np.ndarray, learned: int, known: int) -> np.ndarray:
    return (count + 1) / (learned + known + 1)


def _messages(block: pa.Table, words: pa.Table, order: int, totals: tuple[int, int, int], step: float, split: int, shards: int) -> pa.Table:
    """A block's grams by shard; what it knows of its documents goes as a message to a shard below 0."""
    learned_all, known, starts_all = totals
    row = block.to_pylist()[0]
    numbers, counts, salts = (np.concatenate(x) for x in zip(*(unpack(w) for _, w in sorted(zip(words["shard"].to_pylist(), words["words"].to_pylist())))))
    numbers, counts, salts = np.r_[START, numbers], np.r_[starts_all, counts].astype(np.int64), np.r_[0, salts]
    tokens, lengths, lead = unpack(row["tokens"])[0], np.array(row["lengths"]), order - 1
    learned = np.array(row["learned"])
    base = base_probability(counts, learned_all, known)
    code = np.clip(np.rint(-np.log10(base) / step), 0, 255).astype(np.uint8)
    own = np.ones(len(tokens), bool)
    own[(np.cumsum(lengths + lead) - lengths)[:, None] - np.arange(1, lead + 1)] = False
    at = np.flatnonzero(own).astype(np.int32)
    del own
    part = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    word = tokens[at]
    n_known = np.bincount(part, weights=counts[word] > 0, minlength=len(lengths)).astype(np.int64)
    base_score = np.bincount(part, weights=np.log10(base)[word], minlength=len(lengths))
    alone = counts[tokens[at - 1]] == 0
    units = np.bincount(part[alone], weights=code[word[alone]], minlength=len(lengths)).astype(np.int64)
    ids = row["ids"]
    about = pack([np.array(row["starts"]), np.array([i is None for i in ids]), np.array([0 if i is None else i for i in ids], np.int64).view(np.uint64), learned, lengths, n_known, base_score.view(np.uint64), units])
    rows = [{"shard": -1 - row["block"] % shards, "block": row["block"], "body": about}]

    at, part = at[~alone], part[~alone]
    del word, alone
    key = _combined([*[tokens[at - m] for m in range(1, order)], tokens[at]])
    by = np.argsort(key, kind="stable")
    key = key[by]
    at, part = at[by], part[by]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
    del key, by
    if len(at):
        times = np.diff(np.r_[first, len(at)])
        taught = np.add.reduceat(learned[part].astype(np.int64), first)
        gram = at[first]
        near = tokens[gram - 1]
        piece = salts[tokens[gram - 2]] % (1 + counts[near] // split) if order > 2 else np.zeros(len(gram), np.int64)
        shard = (_mixed(numbers[near].astype(np.int64) * 65537 + piece) % np.uint64(shards)).astype(np.int64)
        by = np.argsort(shard.astype(np.uint16) if shards <= 65536 else shard, kind="stable")
        # documents of each gram in the grams' new order
        start = np.repeat(first[by] - np.r_[0, np.cumsum(times[by])[:-1]], times[by])
        part = part[start + np.arange(len(start))]
        cuts, ends = np.searchsorted(shard[by], np.arange(shards + 1)), np.r_[0, np.cumsum(times[by])]
        gram, near, piece, times, taught = gram[by], near[by], piece[by], times[by], taught[by]
        del shard, by, start, first, at
        for s in np.flatnonzero(cuts[1:] > cuts[:-1]):
            a, b = cuts[s], cuts[s + 1]
            # codes go once a word, in the order of the words' numbers, in which they hardly ever fall
            words_, here = np.unique(numbers[tokens[gram[a:b]]], return_index=True)
            rows.append({"shard": int(s), "block": row["block"], "body": pack([
                numbers[near[a:b]], piece[a:b], *[numbers[tokens[gram[a:b] - m]] for m in range(2, order)], numbers[tokens[gram[a:b]]],
                times[a:b], taught[a:b], code[tokens[gram[a:b][here]]], part[ends[a]:ends[b]]])})
    return _table(rows, _MESSAGE)


def _answers(table: pa.Table, order: int, step: float) -> pa.Table:
    """block, shard, body: for each message of a shard the sums of its grams over the block's documents, those that have any; what blocks know passes as it is."""
    out, bodies = [], table["body"].to_pylist()
    if table["shard"][0].as_py() < 0:
        return table
    # different grams of the shard, then of each message
    parsed = []
    for body in bodies:
        *columns, times, taught, code, _ = unpack(body)
        parsed.append((*columns, code[np.unique(columns[-1], return_inverse=True)[1]], taught))
    near, piece, *others, word, code, taught = (np.concatenate(x) for x in zip(*parsed))
    sizes = np.cumsum([0] + [len(p[0]) for p in parsed])
    del parsed
    key = _combined([near, piece, *others, word])
    _, first, where = np.unique(key, return_index=True, return_inverse=True)
    where = where.astype(np.int32)
    del key
    count = np.bincount(where, weights=taught, minlength=len(first))
    context = [near[first].astype(np.int64) << 16 | piece[first], *[c[first].astype(np.int64) for c in others]]
    word, code = word[first].astype(np.int64), code[first]
    del near, piece, others, taught
    seen = count > 0
    words = int(max((c[seen].max() for c in [word, *context[1:]] if seen.any()), default=0)) + 1
    trie = Trie([c[seen] for c in context], word[seen], count[seen], code[seen], step, words)
    units = trie.units(context, word, code)
    for i, (block, body) in enumerate(zip(table["block"].to_pylist(), bodies)):
        *_, times, _, _, part = unpack(body)
        total = np.bincount(part, weights=np.repeat(units[where[sizes[i]:sizes[i + 1]]], times)).astype(np.int64)
        some = np.flatnonzero(total)
        out.append({"block": block, "shard": table["shard"][0].as_py(), "body": pack([np.diff(some, prepend=0), total[some]])})
    return _table(out, _MESSAGE)


_MESSAGE = [("shard", pa.int64()), ("block", pa.int64()), ("body", pa.binary())]
_PARTS = "start long, doc_id long, learned boolean, n_tokens long, n_known long, base double, units long"


def _parts(table: pa.Table) -> pa.Table:
    """The parts of a block's documents with their sums over all shards."""
    units = None
    for shard, body in sorted(zip(table["shard"].to_pylist(), table["body"].to_pylist())):
        if shard < 0:
            start, none, ids, learned, n, known, base, units = (a.astype(np.int64) for a in unpack(body))
        else:
            at, sums = unpack(body)
            units[np.cumsum(at)] += sums
    return pa.table({"start": start, "doc_id": pa.array(ids, mask=none.astype(bool)), "learned": learned.astype(bool), "n_tokens": n, "n_known": known, "base": base.view(np.float64), "units": units})


def lm_scores(docs: DataFrame, learned: Column, order: int = ORDER, split: int = 1 << 20, block_tokens: int = 1 << 21, shard_grams: int = 800_000, shard_words: int = 2_000_000) -> DataFrame:
    """doc_id, learned, n_tokens, n_known, train_tokens, base_score, score per row of docs (doc_id, text).

    The model learns from the rows where `learned` holds (null: not). Tokens are the text's A-Z lower-cased words and one end; before a text stand
    start marks. base_score sums log10 of the add-one share of each token, score the trie's log10 probabilities of grams of
    `order` words, smoothed down to those shares and kept in 255 steps up to that of 1 / (2 N + 2). The model's second-nearest
    context word chooses a class of its nearest one where that was learned over `split` times, a list of its own for each.

    A null text is empty and has its end alone; null and repeated doc_ids are documents like others, and repeated rows count again. Texts of
    any length count whole. An empty table gives no rows. Results do not depend on partitions, blocks or shards; with larger
    blocks and shards fewer messages pass, one for each pair of a block and a shard at most.
    """
    if order < 2:
        raise ValueError("grams have two words at least")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(learned, F.lit(False)).alias("learned"), F.col("text").cast("binary").alias("text"))
    blocks = settle_table(blocks_of(rows, order, block_tokens))
    sums = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "n_tokens", "n_learned", "n_starts")]).first()
    words = settle_table(vocabulary(blocks, max(0, (-(-sums["n_words"] // shard_words) - 1).bit_length())))
    known = words.groupBy("shard").agg(F.max("known").alias("known")).agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    totals, shards = (sums["n_learned"], known, sums["n_starts"]), max(1, -(-sums["n_tokens"] // shard_grams))
    step = float(np.log10(2 * sums["n_learned"] + 2)) / 255

    def send(block: pa.Table, reply: pa.Table) -> pa.Table:
        return _messages(block, reply, order, totals, step, split, shards)

    def answer(table: pa.Table) -> pa.Table:
        return _answers(table, order, step)

    left = blocks.select("block", "starts", "ids", "learned", "lengths", "tokens").groupBy("block")
    sent = left.cogroup(words.select("block", "shard", "words").groupBy("block")).applyInArrow(send, "shard long, block long, body binary")
    found = sent.groupBy("shard").applyInArrow(answer, "shard long, block long, body binary")
    parts = found.groupBy("block").applyInArrow(_parts, _PARTS)
    add = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "units")]
    whole = parts.groupBy("start").agg(F.max("doc_id").alias("doc_id"), F.max("learned").alias("learned"), *add)
    return whole.select("doc_id", "learned", "n_tokens", "n_known", F.lit(sums["n_learned"]).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("units") * -step).alias("score"))


def op13_elias_fano_scores(spark, folder) -> DataFrame:
    """A null doc_id counts as an empty one here: its remainder is 0, so it is learned from."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    found = lm_scores(docs, ~held)
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
