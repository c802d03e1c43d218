"""Packing of tokenized documents into fixed windows by best-fit decreasing.

Documents longer than a window are first cut into full windows. The remainders are dealt at random to shards of
bounded size; in a shard they are placed in order of falling length, each into the open window with
the least room that still holds it. A segment tree over remaining room finds that window in log2(window)
steps. Every length is decided inside one task, and tasks share nothing.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitframe.functions.cluster import release, settle, small_batches

VOCABULARY = "word_bpe_49k.json"


class RoomTree:
    """Counts of open windows by remaining room, as a segment tree: the tightest room of at least n in log steps."""

    def __init__(self, window: int):
        self.base = 1 << int(window).bit_length()
        self.count = [0] * (2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.base
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, sequence) of an open window with the least room >= need, removed from the tree."""
        at = need + self.base
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.base:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.base
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(lengths, window: int) -> tuple[list[int], list[int]]:
    """(sequence, offset) of each length, lengths at most `window`."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    sequence, offset, rooms, used = [0] * len(lengths), [0] * len(lengths), RoomTree(window), 0
    for i in order:
        need = int(lengths[i])
        got = rooms.take(need)
        if got is None:
            got = (window, used)
            used += 1
        room, s = got
        sequence[i], offset[i] = s, window - room
        if room > need:
            rooms.put(room - need, s)
    return sequence, offset


class WordIds:
    """Token ids of texts by words between blanks and line ends, which this vocabulary never joins.

    Ids of words and of their pieces are kept in two generations of `keep` entries each. Words of plain
    characters are cut into pieces here and given to the merges directly; any other word takes the tokenizer's whole way.
    """

    PLAIN = regex.compile("[!-~À-ÖØ-öø-įı-ɏ]*")
    PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str, keep: int):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.model = self.tokenizer.model
        self.words, self.old_words, self.pieces, self.old_pieces = {}, {}, {}, {}
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        plain = [chr(c) for c in [*range(0x21, 0x7F), *range(0xC0, 0x250)]]
        self.letters = {b: x for c in plain for b, x in zip(c.encode(), as_bytes.pre_tokenize_str(c)[0][0])}

    def _piece(self, piece: str) -> bytes:
        got = self.old_pieces.get(piece)
        if got is None:
            shown = piece.encode().decode("latin-1").translate(self.letters)
            got = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        self.pieces[piece] = got
        return got

    def _learn(self, new: list[str]) -> None:
        if len(self.pieces) > self.keep:
            self.old_pieces, self.pieces = self.pieces, {}
        get, piece, words, whole = self.pieces.get, self._piece, self.words, []
        for w in new:
            core, tail = (w[:-1], w[-1]) if w[-1:] in (".", ",") else (w, "")
            if core.isalpha() and (w.isascii() or self.PLAIN.fullmatch(w)):
                core = core.lower()
                got = get(core) or piece(core)
                words[w] = got + (get(tail) or piece(tail)) if tail else got
            elif self.PLAIN.fullmatch(w) and "<|" not in w:
                words[w] = b"".join([get(p) or piece(p) for p in self.PIECE.findall(w.lower())])
            else:
                whole.append(w)
        for w, e in zip(whole, self.tokenizer.encode_batch(whole, add_special_tokens=False)):
            words[w] = array("I", e.ids).tobytes()

    def rest(self) -> None:
        """Lets the older generation go, which would stay with an idle worker."""
        self.old_words, self.old_pieces = {}, {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.words) > self.keep:
            self.old_words, self.words = self.words, {}
        new = set().union(*split).difference(self.words)
        for w in [w for w in new if w in self.old_words]:
            self.words[w] = self.old_words[w]
            new.discard(w)
        self._learn(list(new))
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in split]


_IDS: dict[tuple[str, int], WordIds] = {}


def tokenize(docs: DataFrame, path: str, end_id: int = 1, window: int = 2048, keep: int = 250_000, step: int = 1_000) -> DataFrame:
    """Pieces of each document (doc_id, text): doc_id, start, length, doc_tokens, ids (little-endian unsigned 32 bit).

    A task holds up to 2 x `keep` words and as many pieces with their ids, and the words of `step` texts; they decide its memory, not the result.

    A null text is an empty one and gives the end id alone; null and repeated doc_ids are documents like others. `path` is a word-end BPE vocabulary in the tokenizers format that drops white space.
    """
    schema = "doc_id long, start long, length long, doc_tokens long, ids binary"

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if (path, keep) not in _IDS:
            _IDS[path, keep] = WordIds(path, keep)
        ids = _IDS[path, keep]
        end = np.asarray([end_id], "<u4").tobytes()
        for frame in frames:
            texts = list(frame["text"])
            for i in range(0, len(texts), step):
                rows = []
                for doc_id, tokens in zip(frame["doc_id"][i:i + step], ids(["" if t is None else t for t in texts[i:i + step]])):
                    tokens += end
                    n = len(tokens) // 4
                    doc_id = None if pd.isna(doc_id) else int(doc_id)
                    rows += [(doc_id, a, min(window, n - a), n, tokens[4 * a:4 * (a + window)]) for a in range(0, n, window)]
                out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "ids"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out
        ids.rest()
        release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(work, schema)


def pack(pieces: DataFrame, window: int = 2048, shard_rows: int = 8_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ..., ids) of at most `window` tokens.

    Full windows are sequences of their own and are not moved. Others go to shards of about `shard_rows` pieces by
    a hash of their row, so the number of shards follows the data and no key decides where a piece goes.
    sequence_id is unique: full windows have negative ids from a row number per task, packed ones shard * 2^32 + number.
    """
    with small_batches(pieces.sparkSession):
        pieces = settle(pieces)
    full = pieces.filter(F.col("length") == window)
    rest = pieces.filter(F.col("length") < window)
    shards = max(1, -(-rest.count() // shard_rows))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "length"], kind="stable")
        sequence, offset = best_fit_decreasing(frame["length"].tolist(), window)
        frame["sequence_id"] = (frame.pop("_shard").to_numpy("int64") << 32) + np.asarray(sequence, "int64")
        frame["offset"] = np.asarray(offset, "int64")
        return frame

    deal = F.pmod(F.xxhash64("doc_id", "start", "length", F.crc32("ids")), F.lit(shards)).cast("long")
    packed = rest.withColumn("_shard", deal).groupBy("_shard").applyInPandas(work, f"{fields}, sequence_id long, offset long")
    alone = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = 1, window: int = 2048, keep: int = 250_000, step: int = 1_000, shard_rows: int = 8_000) -> DataFrame:
    """Tokenize and pack documents (doc_id, text); see tokenize() and pack()."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return pack(tokenize(docs, path, end_id, window, keep, step), window, shard_rows)


def op9_best_fit_packing(spark, folder) -> DataFrame:
    packed = pack_documents(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
