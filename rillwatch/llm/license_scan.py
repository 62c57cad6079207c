"""License scans: exact phrases, and fuzzy search for short notices.

A text becomes its words with one blank between, in lower case. A notice of n characters may differ in n / 15 edits. It is split
into one piece more than it may have edits, so whatever matches it holds at least one piece unchanged. One automaton finds the
pieces of all notices in one walk over the text; each hit says where its notice would start. There the regex library matches
the whole notice with bounded errors, on whole words, and reports the span and its edits.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import folded_words, two_columns

#: Characters of a notice for each edit that it may have.
CHARACTERS_AN_EDIT = 15

# The phrases of the base scan and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Openings of well-known notices, as words in lower case, and their labels.
NOTICES = [
    ("agpl", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "released under the bsd license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

SPANS = "array<struct<label:string,notice:string,first_word:bigint,words:bigint,edits:bigint,base:boolean>>"


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): the notice in ``edits + 1`` parts of nearly one length."""
    cuts = [len(notice) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, notices: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None,
                 characters_an_edit: int = CHARACTERS_AN_EDIT):
        self.phrases = PHRASES if phrases is None else phrases
        self.notices, at = [], defaultdict(list)
        for label, text in NOTICES if notices is None else notices:
            edits = len(text) // characters_an_edit
            pattern = regex.compile(rf"(?e)(?<= )(?:{regex.escape(text, literal_spaces=True)}){{e<={edits}}}(?= )")
            for offset, piece in pieces(text, edits):
                at[piece].append((len(self.notices), offset))
            self.notices.append((label, text, edits, pattern))
        self.seeds = ahocorasick.Automaton()
        for piece, found in at.items():
            self.seeds.add_word(piece, (len(piece), found))
        self.seeds.make_automaton()

    def exact(self, text: str) -> list[tuple[int, str]]:
        """(offset, phrase) of every place where a phrase's words stand one after the other; ``text`` has a blank at both ends."""
        found = []
        for phrase in self.phrases:
            at = text.find(f" {phrase} ")
            while at >= 0:
                found.append((at + 1, phrase))
                at = text.find(f" {phrase} ", at + 1)
        return found

    def fuzzy(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, stop, edits, notice) of every notice; of matches that overlap, the one with fewer edits, then the first."""
        starts = defaultdict(set)
        if self.notices:
            for last, (size, found) in self.seeds.iter(text):
                for notice, offset in found:
                    starts[notice].add(last + 1 - size - offset)
        matches = []
        for notice, expected in starts.items():
            _, wanted, edits, pattern = self.notices[notice]
            own, reach, done = [], edits + 1, None
            for start in sorted(expected):
                if done is not None and start - done <= reach:
                    last = start
                else:
                    if done is not None:
                        own += self._verified(text, first, last, notice)
                    first = last = start
                done = start
            own += self._verified(text, first, last, notice)
            matches += own
        kept: dict[int, list] = defaultdict(list)
        for start, stop, edits, notice in sorted(matches, key=lambda m: (m[2], m[0])):
            if all(stop <= a or b <= start for a, b, _, _ in kept[notice]):
                kept[notice].append((start, stop, edits, notice))
        return sorted(m for own in kept.values() for m in own)

    def _verified(self, text: str, first: int, last: int, notice: int) -> list[tuple[int, int, int, int]]:
        """Matches that start where a seed says, up to the notice's edits away."""
        _, wanted, edits, pattern = self.notices[notice]
        begin = max(0, first - edits - 1)
        window = text[begin:last + len(wanted) + edits + 1]
        return [(begin + m.start(), begin + m.end(), sum(m.fuzzy_counts), notice) for m in pattern.finditer(window)]

    def spans(self, text: str) -> tuple[int, list[dict]]:
        """The number of words, and the spans of phrases and notices in words: from where, how many, with how many edits."""
        words = folded_words(text.encode())
        joined = " " + b" ".join(words).decode() + " "
        exact, fuzzy = self.exact(joined), self.fuzzy(joined)
        if not exact and not fuzzy:
            return len(words), []
        blanks = [k for k, c in enumerate(joined) if c == " "]
        word = lambda offset: bisect_right(blanks, offset) - 1
        spans = [{"label": self.phrases[p], "notice": p, "first_word": word(at), "words": p.count(" ") + 1, "edits": 0, "base": True} for at, p in exact]
        for start, stop, edits, notice in fuzzy:
            label, wanted, *_ = self.notices[notice]
            spans.append({"label": label, "notice": wanted, "first_word": word(start), "words": word(stop - 1) - word(start) + 1,
                          "edits": edits, "base": False})
        return len(words), sorted(spans, key=lambda s: (s["first_word"], s["label"], s["notice"], not s["base"]))


_OPEN: dict[tuple, Scanner] = {}


def _scanner(notices: tuple | None, phrases: tuple | None) -> Scanner:
    """One scanner per worker and list of notices."""
    if (notices, phrases) not in _OPEN:
        _OPEN[notices, phrases] = Scanner(None if notices is None else list(notices), None if phrases is None else dict(phrases))
    return _OPEN[notices, phrases]


def scan(df: DataFrame, notices: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, spans (label, notice, first_word, words, edits, base) in the order of the text.

    ``phrases`` are found exactly (``base``), ``notices``, pairs of label and words, with bounded edits. Null text counts as
    empty and has no words; repeated rows give repeated results; an empty table gives no rows; further columns are not read. No
    shuffle; a task holds one text at a time and its spans.
    """
    given = None if notices is None else tuple(notices), None if phrases is None else tuple(phrases.items())
    kind = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()),
                               ("edits", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(*given)
        for batch in batches:
            n, spans = zip(*map(scanner.spans, batch.column("text").to_pylist())) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(spans, kind)], ["doc_id", "n_words", "spans"])

    return two_columns(df, id_col, text_col).mapInArrow(run, f"doc_id long, n_words long, spans {SPANS}")


def summary(scanned: DataFrame) -> DataFrame:
    """One row per scanned document: n_base (places of phrases), their first and last word, labels, and the score of its best span.

    The score of a span is one minus its edits over its notice's characters; of a document without spans it is 0.
    """
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    firsts = F.transform(base, lambda s: s["first_word"])
    score = F.array_max(F.transform("spans", lambda s: 1 - s["edits"] / F.length(s["notice"])))
    return scanned.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(firsts).alias("first_word"),
                          F.array_max(firsts).alias("last_word"), listed(base).alias("base_labels"), listed(F.col("spans")).alias("labels"),
                          F.coalesce(score, F.lit(0.0)).alias("score"))
