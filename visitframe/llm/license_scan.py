"""License scans: exact phrases, and short notices found with a bounded number of edits.

A notice with at most k edits, cut into k + 1 pieces, keeps one piece unchanged (pigeonhole). The pieces of all
notices are the exact seeds of one automaton over a text's words; each hit gives a window in which the
regex library's bounded-error matching looks for the whole notice and reports its span and edits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrase and label of the exact scan.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Short notices of common licenses in normal form (lower case words, one blank between), label, most edits.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("the software is provided as is without warranty of any kind", "mit", 4),
    ("licensed under the mit license", "mit", 2),
    ("licensed under the apache license version 2 0", "apache", 4),
    ("this program is free software you can redistribute it and or modify it", "gpl", 6),
    ("under the terms of the gnu general public license", "gpl", 4),
    ("under the terms of the gnu lesser general public license", "lgpl", 4),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 6),
    ("neither the name of the copyright holder nor the names of its contributors", "bsd", 6),
    ("subject to the terms of the mozilla public license v 2 0", "mpl", 4),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 6),
    ("licensed under a creative commons attribution", "cc", 3),
    ("licensed under cc by", "cc", 1),
    ("all rights reserved", "reserved", 1),
)
#: Bytes outside words become blanks, A-Z become a-z.
_NORMAL = bytes(c + 32 if 0x41 <= c <= 0x5A else 32 if c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))


def normal(text: bytes) -> bytes:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the A-Z-lower-cased text, one blank around each."""
    return b" " + b" ".join(text.translate(_NORMAL).split()) + b" "


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces of nearly equal length with their offsets."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=4)
def _scanner(notices):
    import ahocorasick
    import regex

    found = ahocorasick.Automaton()
    by_seed: dict[str, list] = {}
    for i, (notice, _, edits) in enumerate(notices):
        for at, seed in seeds(notice, edits):
            by_seed.setdefault(seed, []).append((i, at))
    for seed, uses in by_seed.items():
        found.add_word(seed, (len(seed), uses))
    found.make_automaton()
    return found, [regex.compile(f"(?b)(?:{regex.escape(n, literal_spaces=True)}){{e<={e}}}") for n, _, e in notices]


def fuzzy_spans(text: str, notices=NOTICES) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, edits) in the normal text: per run of candidate windows the best match of each notice.

    Windows of one notice that touch are searched as one piece, again before and after each match, so no match that holds a
    seed is missed and none is searched twice.
    """
    found, patterns = _scanner(notices)
    windows: dict[int, list[list[int]]] = {}
    for end, (length, uses) in found.iter(text):
        for i, at in uses:
            notice, _, edits = notices[i]
            start = end - length + 1 - at
            a, b = max(0, start - edits), min(len(text), start + len(notice) + edits)
            own = windows.setdefault(i, [])
            if own and a <= own[-1][1]:
                own[-1] = [min(a, own[-1][0]), max(b, own[-1][1])]
            else:
                own.append([a, b])
    out = []
    for i, own in windows.items():
        while own:
            a, b = own.pop()
            m = patterns[i].search(text, a, b) if a < b else None
            if m and m.end() > m.start():
                out.append((i, m.start(), m.end(), sum(m.fuzzy_counts)))
                own += [[a, m.start()], [m.end(), b]]
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def _places(words: bytes, phrase: bytes) -> list[int]:
    """Word indexes at which the phrase's words stand one after another."""
    out, at, index, last = [], words.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        index += words.count(b" ", last, at)
        out.append(index)
        last = at
        at = words.find(b" " + phrase + b" ", at + 1)
    return out


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row per document (doc_id, text) with base and fuzzy findings; nothing is shuffled.

    spans lists the fuzzy matches (label, start, end in characters of the normal text, edits, matched text).
    score is 1 when a base phrase is found, else the best match's share of unedited characters, else 0.
    Null and empty texts give zero words and no findings; repeated rows give repeated results.
    """
    schema = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
              "score double, spans array<struct<label:string,start:int,end:int,edits:int,text:string>>")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        exact = [(p.encode(), label) for p, label in phrases]
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                words = normal(text or b"")
                n_words = words.count(b" ") - 1 if len(words) > 2 else 0
                base, where = set(), []
                for phrase, label in exact:
                    if got := _places(words, phrase):
                        where += got
                        base.add(label)
                said = words.decode("utf-8", "replace")
                near = fuzzy_spans(said, notices)
                spans = [(notices[i][1], a, b, edits, said[a:b]) for i, a, b, edits in near]
                best = max((1 - edits / len(notices[i][0]) for i, _, _, edits in near), default=0.0)
                rows.append((None if pd.isna(doc_id) else int(doc_id), n_words, len(where), min(where, default=None), max(where, default=None),
                             ",".join(sorted(base)), ",".join(sorted(base | {x[0] for x in spans})), 1.0 if where else best, spans))
            out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
            for c in ("doc_id", "first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            yield out

    thin = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return thin.mapInPandas(work, schema)


def op8_license_scan(spark, folder) -> DataFrame:
    found = scan(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
                        F.size("spans").alias("n_spans"), "spans")
