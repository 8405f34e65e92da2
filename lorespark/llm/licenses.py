"""License scans: exact seeds by the pigeonhole rule find candidates, bounded-error matching verifies them."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import session_of, ship_code, text_of

# Phrases whose places are counted exactly, and short notices that are searched with errors.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = (
    ("mit", "mit license", 1),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    ("apache", "apache license", 1),
    ("apache", "licensed under the apache license version 2 0", 4),
    ("gpl", "general public license", 2),
    ("gpl", "this program is free software you can redistribute it and or modify it", 6),
    ("bsd", "redistribution and use in source and binary forms with or without modification", 6),
    ("cc", "licensed under cc by", 1),
    ("cc", "creative commons attribution", 2),
    ("mpl", "mozilla public license", 2),
    ("spdx", "spdx license identifier", 2),
    ("reserved", "all rights reserved", 1),
)
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Rows of one output batch.
ROWS = 256


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces with their offsets: with at most so many errors, one piece stands unchanged."""
    cuts = [round(i * len(notice) / (errors + 1)) for i in range(errors + 2)]
    return [(i, notice[i:j]) for i, j in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, notices=NOTICES, base=BASE):
        import ahocorasick
        import regex

        self.notices, self.base = notices, base
        self.seeds = ahocorasick.Automaton()
        starts: dict[str, list[tuple[int, int]]] = {}
        for k, (_, notice, errors) in enumerate(notices):
            for at, piece in pieces(notice, errors):
                starts.setdefault(piece, []).append((k, at))
        for piece, places in starts.items():
            self.seeds.add_word(piece, (len(piece), places))
        self.seeds.make_automaton()
        self.verify = [regex.compile(f"(?b)(?<![^ ])(?:{regex.escape(n, literal_spaces=True)}){{e<={e}}}(?![^ ])") for _, n, e in notices]

    def words(self, text: str) -> list[str]:
        """Words with A-Z lower-cased and other letters as they are."""
        return _WORD.findall(text if text.islower() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))

    def base_places(self, line: str, word_at: Callable[[int], int]) -> list[tuple[int, str]]:
        """(word position, label) of each exact phrase in line, which has a space before each word and at the end."""
        found = []
        for phrase, label in self.base.items():
            at = line.find(f" {phrase} ")
            while at >= 0:
                found.append((word_at(at), label))
                at = line.find(f" {phrase} ", at + 1)
        return found

    def spans(self, line: str) -> list[tuple[int, int, str, int]]:
        """(start, end, label, errors) of each notice found in line, in characters, without those that overlap a better span of the same notice."""
        windows: dict[int, set[tuple[int, int]]] = {}
        for end, (length, places) in self.seeds.iter(line):
            for k, at in places:
                _, notice, errors = self.notices[k]
                start = end - length + 1 - at - 2 * errors
                windows.setdefault(k, set()).add((max(0, start - 1), start + len(notice) + 4 * errors + 1))
        return sorted((a, b, self.notices[k][0], n) for k, ranges in windows.items() for n, a, b in self._best_first(k, line, ranges))

    def _best_first(self, k: int, line: str, ranges: set[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
        """(errors, start, end) of the notice's best match in any range, then of the best in what found ones leave of the ranges, and so on."""
        _, notice, errors = self.notices[k]
        waiting: list[tuple[int, int, int, int, int]] = []
        taken: list[tuple[int, int]] = []

        def search(start: int, stop: int) -> None:
            # a range ends before a space, as its end counts as one; a match that reaches further would take more errors
            if stop - start >= len(notice) - errors and (m := self.verify[k].search(line, start, stop, concurrent=False)):
                heappush(waiting, (sum(m.fuzzy_counts), m.start(), m.end(), start, stop))

        for start, stop in ranges:
            search(start, line.rfind(" ", start, stop + 1))
        while waiting:
            n, a, b, start, stop = heappop(waiting)
            i = bisect_left(taken, (b, 0)) - 1
            if i < 0 or taken[i][1] <= a:
                insort(taken, (a, b))
                yield n, a, b
            else:
                search(start, taken[i][0] - 1)
                search(taken[i][1], stop)

    def scan(self, text: str) -> dict:
        words = self.words(text)
        line = " " + " ".join(words) + " "
        spaces: list[int] = []

        def word_at(place: int) -> int:
            """The number of spaces before a place; all spaces are listed when the first is asked for."""
            if not spaces:
                spaces.extend(accumulate((len(w) + 1 for w in words), initial=0))
            return bisect_left(spaces, place)

        base, spans = self.base_places(line, word_at), self.spans(line)
        starts = [p for p, _ in base]
        at = [(word_at(s) - 1, word_at(e) - 1, label, errors) for s, e, label, errors in spans]
        best = max((1 - errors / (e - s) for s, e, _, errors in spans), default=0.0)
        return {
            "n_words": len(words), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted({x for _, x in base})), "labels": ",".join(sorted({x for _, x in base} | {x for *_, x, _ in spans})),
            "score": 1.0 if base else max(0.0, best), "spans": [{"first_word": a, "last_word": b, "label": x, "errors": n} for a, b, x, n in at],
        }


@lru_cache(maxsize=4)
def scanner(notices=NOTICES) -> Scanner:
    return Scanner(notices)


SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<first_word:bigint,last_word:bigint,label:string,errors:bigint>>"
)
_ARROW = [
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("label", pa.string()), ("errors", pa.int64())]))),
]


def scan_licenses(docs: DataFrame, notices=NOTICES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts the exact places of the base phrases as consecutive words. spans are the notices found with bounded
    errors (characters put in, left out or changed; word positions; of one notice's spans that overlap the best stays). score is 1 with a
    base phrase, else 1 less the errors of the best span in proportion, else 0. A null or empty text has no words, null
    positions, empty labels and a score of 0. Texts are read whole; repeated rows give equal rows; an empty table gives no
    rows. Other columns are ignored.
    """
    ship_code(session_of(docs))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lorespark.llm.common import only
        from lorespark.llm.licenses import _ARROW, ROWS, scanner

        only("licenses")
        find = scanner(notices)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = [find.scan(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[k] for r in rows], t) for k, t in _ARROW]], ["doc_id", *[k for k, _ in _ARROW]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(scan, f"doc_id {kind}, {SCHEMA}")
