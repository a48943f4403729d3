"""License scans: fuzzy search for short notices, by exact seeds and bounded-error matching.

A text is lower-cased (A-Z) and cut into words; words joined by single spaces
are what is searched.  Exact phrases are looked up in it (``PHRASES``).  A
notice may be found with ``errors`` wrong, missing or surplus characters: cut
into errors + 1 pieces, one piece at least stands unharmed in every such place
(pigeonhole), so an automaton over all pieces of all notices yields every
candidate.  Around each the regex library's bounded-error matching decides, in
a window that holds every place the piece can belong to; touching windows of a
notice are one, and a window met before isn't matched again.

What is found is what the same matching would find in the whole text, leftmost
first and not overlapping for each notice, as every place lies inside a window.

Null and empty texts have no words and no spans.  No length ends a text.
Repeated rows get equal results each; an empty table gives an empty result.
Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .textops import release

# Phrases of the base labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Words by which well-known licenses give notice, lower case, without punctuation.
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "the software is provided as is without warranty of any kind"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc", "licensed under a creative commons attribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

#: One error a so many characters of a notice, and no more than MOST.
PER_ERROR, MOST = 12, 4
#: Windows whose outcome a task remembers; then it starts anew.
SEEN = 20_000

# A-Z become a-z, and what is no part of a word a space.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SPAN = "struct<label:string,first_word:long,last_word:long,errors:int,text:string>"


@dataclass(frozen=True)
class Notice:
    label: str
    words: str
    errors: int

    @property
    def pattern(self) -> str:
        # whole words only; (?e) goes on from the first fit to the best one there
        return rf"(?e)(?<![^ ])(?:{regex.escape(self.words, special_only=True)}){{e<={self.errors}}}(?![^ ])"

    def pieces(self) -> list[tuple[int, str]]:
        """(position, piece): errors + 1 pieces of about one length."""
        cuts = [k * len(self.words) // (self.errors + 1) for k in range(self.errors + 2)]
        return [(a, self.words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def notices(listed=NOTICES, per_error: int = PER_ERROR, most: int = MOST) -> tuple[Notice, ...]:
    return tuple(Notice(label, words, min(most, len(words) // per_error)) for label, words in listed)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_BYTES).split()


class Scanner:
    def __init__(self, given: tuple[Notice, ...], phrases: dict[str, str] = PHRASES):
        import ahocorasick

        self.notices, self.phrases = given, {p.encode(): label for p, label in phrases.items()}
        self.compiled = [regex.compile(n.pattern) for n in given]
        self.automaton, held = ahocorasick.Automaton(), {}
        for k, n in enumerate(given):
            for at, piece in n.pieces():
                held.setdefault(piece, []).append((k, at))
        for piece, places in held.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()
        self._seen: dict[tuple[int, str], list] = {}

    def exact(self, joined: bytes) -> list[tuple[int, str]]:
        """(byte position, label) of all places of the phrases."""
        out, fenced = [], b" " + joined + b" "
        for phrase, label in self.phrases.items():
            whole = b" " + phrase + b" "
            at = fenced.find(whole)
            while at >= 0:
                out.append((at, label))
                at = fenced.find(whole, at + 1)
        return sorted(out)

    def windows(self, line: str) -> dict[int, list[tuple[int, int]]]:
        """Windows of each notice that has a candidate, in order and apart."""
        out: dict[int, list[tuple[int, int]]] = {}
        for end, (size, places) in self.automaton.iter(line):
            for k, at in places:
                n = self.notices[k]
                start = end + 1 - size - at - n.errors
                lo, hi = max(0, start), min(len(line), start + len(n.words) + 3 * n.errors)
                own = out.setdefault(k, [])
                # pieces come by their ends, so a later window may begin before an earlier one
                while own and own[-1][1] >= lo:
                    a, b = own.pop()
                    lo, hi = min(lo, a), max(hi, b)
                own.append((lo, hi))
        return out

    def fuzzy(self, line: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, errors) of every notice in a line of words."""
        out = []
        for k, windows in self.windows(line).items():
            for lo, hi in windows:
                # the characters beside a window say whether a word ends there; no place reaches them
                lo = max(0, lo - 1)
                key = (k, line[lo : hi + 1])
                if key not in self._seen:
                    if len(self._seen) >= SEEN:
                        self._seen.clear()
                    self._seen[key] = [(*m.span(), sum(m.fuzzy_counts)) for m in self.compiled[k].finditer(key[1])]
                out += [(lo + a, lo + b, k, e) for a, b, e in self._seen[key]]
        return sorted(out)

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        joined = b" ".join(words)
        base = self.exact(joined)
        spans = []
        line = joined.decode()
        found = self.fuzzy(line)
        if found or base:
            starts = [0, *(m.end() for m in re.finditer(" ", line))]
            byte_starts = [0, *(m.end() for m in re.finditer(b" ", joined))]
            places = [bisect_right(byte_starts, at) - 1 for at, _ in base]
            for a, b, k, e in found:
                spans.append({"label": self.notices[k].label, "first_word": bisect_right(starts, a) - 1, "last_word": bisect_right(starts, b - 1) - 1, "errors": e, "text": line[a:b]})
        else:
            places = []
        base_labels = {label for _, label in base}
        # an exact phrase is sure; a notice is less so the more of its errors it uses up
        sure = [1.0] * bool(base) + [1 - s["errors"] / (2 * (self.notices[k].errors + 1)) for s, (_, _, k, _) in zip(spans, found, strict=True)]
        return {
            "n_words": len(words),
            "n_base": len(base),
            "first_word": min(places, default=None),
            "last_word": max(places, default=None),
            "base_labels": sorted(base_labels),
            "labels": sorted(base_labels | {s["label"] for s in spans}),
            "score": max(sure, default=0.0),
            "spans": spans,
        }


@lru_cache(maxsize=4)
def scanner(given: tuple[Notice, ...]) -> Scanner:
    return Scanner(given)


def _scan(given: tuple[Notice, ...], id_field: pa.Field):
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int32()), ("text", pa.string())])
    strings = pa.list_(pa.string())
    schema = pa.schema([id_field, ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", strings), ("labels", strings), ("score", pa.float64()), ("spans", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(given)
        for batch in batches:
            rows = [own.scan(x.as_py()) for x in batch.column(1)]
            columns = [pa.array([r[f.name] for r in rows], f.type) for f in list(schema)[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=schema)
        release()

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", given: tuple[Notice, ...] | None = None) -> DataFrame:
    """Id, ``n_words, n_base, first_word, last_word, base_labels, labels, score`` and ``spans`` (label, words from and to, errors, the words) of every document.

    ``first_word`` and ``last_word`` are starts of exact phrases.  ``score``: 1
    with an exact phrase or a faultless notice, less by the share of allowed
    errors of the best notice otherwise, 0 without any.
    """
    kind = docs.schema[id_col].dataType
    out = f"`{id_col}` {kind.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, spans array<{SPAN}>"
    return docs.select(id_col, F.col(text_col)).mapInArrow(_scan(given or notices(), pa.field(id_col, to_arrow_type(kind))), out)
