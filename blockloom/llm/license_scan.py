"""License scans: exact phrases, and short notices with a bounded number of edits."""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from blockloom.llm.common import first_columns, steady

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: (label, notice, edits allowed): characters inserted, deleted or replaced in lower-cased words joined by a space.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 5),
    ("mit", "released under the mit license", 2),
    ("mit", "licensed under the mit license", 2),
    ("apache", "licensed under the apache license version 2 0", 3),
    ("bsd", "redistribution and use in source and binary forms with or without modification", 5),
    ("gpl", "gnu general public license", 2),
    ("gpl", "this program is free software you can redistribute it and or modify it", 5),
    ("lgpl", "gnu lesser general public license", 2),
    ("agpl", "gnu affero general public license", 2),
    ("mpl", "mozilla public license version 2 0", 3),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 5),
    ("unlicense", "this is free and unencumbered software released into the public domain", 5),
    ("cc-by", "licensed under a creative commons attribution", 3),
    ("cc-by", "creative commons attribution license", 3),
    ("reserved", "all rights reserved", 1),
)
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_BLANK = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_UPPER = {c: c + 32 for c in range(65, 91)}


@functools.lru_cache(1)
def _search() -> tuple:
    """The automaton of all seeds and each notice's fuzzy pattern. With k edits one of k + 1 parts stays whole."""
    seeds: dict[str, list[tuple[int, int]]] = {}
    for n, (_, notice, k) in enumerate(NOTICES):
        for j in range(k + 1):
            a, b = len(notice) * j // (k + 1), len(notice) * (j + 1) // (k + 1)
            seeds.setdefault(notice[a:b], []).append((n, a))
    automaton = ahocorasick.Automaton()
    for seed, uses in seeds.items():
        automaton.add_word(seed, (len(seed), uses))
    automaton.make_automaton()
    # (?b): the fewest edits, not merely the first that fit
    return automaton, [regex.compile(rf"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}") for _, notice, k in NOTICES]


def _edges(words: str, lo: int, hi: int, first: bool) -> list[int]:
    """Where a run of letters and digits begins (or ends) from lo to hi."""
    inner = lambda k: 0 <= k < len(words) and words[k].isalnum()
    return [k for k in range(max(0, lo), min(len(words), hi) + 1) if (inner(k) and not inner(k - 1) if first else inner(k - 1) and not inner(k))]


def candidates(words: str) -> dict[int, dict[tuple[int, int], int]]:
    """Of each notice, all places (start, end) in the normalized text within its edits, and their edits.

    A place begins and ends with runs of letters and digits. One of its parts stands there unchanged, at most k characters
    away from where the place's start puts it, so each hit of a seed has k + 1 starts and ends to verify at most.
    """
    automaton, patterns = _search()
    starts: dict[int, set[int]] = {}
    for end, (size, uses) in automaton.iter(words):
        for n, offset in uses:
            starts.setdefault(n, set()).add(end + 1 - size - offset)
    out: dict[int, dict[tuple[int, int], int]] = {}
    for n, own in starts.items():
        notice, k = NOTICES[n][1:]
        tried: set[tuple[int, int]] = set()
        for start in own:
            ends = None
            for a in _edges(words, start - k, start + k, True):
                ends = _edges(words, start + len(notice) - k, start + len(notice) + k, False) if ends is None else ends
                for b in ends:
                    if (a, b) not in tried and abs(b - a - len(notice)) <= k:
                        tried.add((a, b))
                        if m := patterns[n].fullmatch(words, a, b):
                            out.setdefault(n, {})[a, b] = sum(m.fuzzy_counts)
    return out


def fuzzy(words: str) -> list[tuple[int, int, int, int]]:
    """(start, end, notice, edits) in the normalized text: each notice's places, none overlapping another of that notice.

    Of places that overlap, that with the fewest edits stays, of equals the first, then the shortest.
    """
    out = []
    for n, places in candidates(words).items():
        begins: list[int] = []
        taken: list[tuple[int, int]] = []
        for edits, a, b in sorted((e, a, b) for (a, b), e in places.items()):
            at = bisect.bisect_right(begins, a)
            if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b):
                begins.insert(at, a)
                taken.insert(at, (a, b))
                out.append((a, b, n, edits))
    return sorted(out)


def _spans(text: str, wanted: list[int]) -> dict[int, tuple[int, int]]:
    """The spans of the wanted words (by number) in the text."""
    found, need, at = {}, sorted(set(wanted)), 0
    for k, m in enumerate(_WORD.finditer(text.translate(_UPPER))):
        if at == len(need):
            break
        if k == need[at]:
            found[k] = m.span()
            at += 1
    return found


def matches_of(text: str) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, int]]]:
    """(words, (first word, label) of each exact phrase, (start, end, label, edits) of each notice in code points)."""
    words = text.encode("utf-8", "surrogatepass").translate(_BLANK).split()
    joined = b" " + b" ".join(words) + b" "
    exact = []
    for phrase, label in PHRASES.items():
        seek, at, word, counted = f" {phrase} ".encode(), -1, 0, 0
        while (at := joined.find(seek, at + 1)) >= 0:
            word, counted = word + joined.count(b" ", counted, at), at
            exact.append((word, label))
    n_words = len(words)
    del words
    body = joined[1:-1].decode("utf-8", "surrogatepass")
    del joined
    places, first, counted = [], 0, 0
    for a, b, n, edits in fuzzy(body):
        first, counted = first + body.count(" ", counted, a), a
        places.append((first, first + body.count(" ", a, b), n, edits))
    if not places:
        return n_words, sorted(exact), []
    spans = _spans(text, [k for x in places for k in x[:2]])
    return n_words, sorted(exact), [(spans[x][0], spans[y][1], NOTICES[n][0], edits) for x, y, n, edits in places]


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of each row, in one pass without a shuffle.

    Exact phrases give the base; notices within their number of edits add labels and spans (start, end, label, edits; code
    points of the text, whole words), one for every place of every notice; see fuzzy() for places that overlap. score: 1
    with an exact phrase, else 1 - edits / (allowed + 1) of the best notice, 0 without any. Time is in proportion to a
    text's length and seeds, however often a notice is repeated; a long text takes about twelve bytes a character. Null and empty texts have no words and no labels, which are then empty strings. Repeated rows and null
    ids give their own rows, other columns are not read, an empty table gives an empty result.
    """
    long, text = T.LongType(), T.StringType()
    span = T.StructType([T.StructField("start", long), T.StructField("end", long), T.StructField("label", text), T.StructField("edits", long)])
    fields = [(id_col, docs.schema[id_col].dataType), ("n_words", long), ("n_base", long), ("first_word", long), ("last_word", long), ("base_labels", text), ("labels", text), ("score", T.DoubleType()), ("spans", T.ArrayType(span))]
    schema = T.StructType([T.StructField(*f) for f in fields])
    allowed = {label: max(k for x, _, k in NOTICES if x == label) for label, _, _ in NOTICES}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steady(batches):
            rows = []
            for cell in batch.column(1):
                n, exact, notices = matches_of(cell.as_py() or "")
                own = {label for _, label in exact}
                score = 1.0 if exact else max([0.0, *(1 - e / (allowed[label] + 1) for _, _, label, e in notices)])
                rows.append((n, len(exact), exact[0][0] if exact else None, exact[-1][0] if exact else None, ",".join(sorted(own)), ",".join(sorted(own | {x[2] for x in notices})), score, [dict(zip(("start", "end", "label", "edits"), x, strict=True)) for x in notices]))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], names=schema.names)

    return first_columns(docs, id=id_col, text=text_col).mapInArrow(run, schema)
