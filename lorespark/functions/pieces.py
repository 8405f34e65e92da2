"""Subword pieces of texts for embedding models: greedy longest match (WordPiece) and best-scored segmentation (Unigram).

Vocabularies are given, as lists or one-column or two-column tables; nothing is trained. A model is small and goes to every task; words
are segmented once for each task that meets them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters that count as spaces besides control characters from tab to carriage return; ranges of ideographs that stand alone.
_SPACES = frozenset(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_ALONE = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))
# Letters of a word that is still cut into pieces; what an unknown character scores below the worst piece; the mark of a word's start.
LONGEST, UNKNOWN, START = 100, 10.0, "▁"
#: Pieces of a model, and words that a task remembers.
MOST_PIECES, MEMO = 1 << 20, 1 << 16


def _stands_alone(c: str) -> bool:
    """Punctuation and ideographs are words of their own."""
    return (c.isascii() and c.isprintable() and not c.isalnum() and c != " ") or unicodedata.category(c)[0] == "P" or any(a <= ord(c) <= b for a, b in _ALONE)


def split_spaces(text: str) -> list[str]:
    return "".join(" " if c in _SPACES else c for c in text).split(" ")


def plain_words(chunk: str) -> list[str]:
    """Words of a run of characters without spaces: lower-cased, without accents and control characters."""
    words = [""]
    for c in unicodedata.normalize("NFD", chunk.lower()):
        if c == "�" or unicodedata.category(c) in ("Cc", "Mn"):
            continue
        if _stands_alone(c):
            words += [c, ""]
        else:
            words[-1] += c
    return [w for w in words if w]


class WordPiece:
    """ids of texts by longest pieces from the left; pieces inside a word begin with ##. A word that can't be cut is one unknown piece."""

    def __init__(self, vocabulary: list[str], longest: int = LONGEST):
        self.ids = {p: i for i, p in enumerate(vocabulary)}
        self.unknown, self.first, self.last = (self.ids[p] for p in ("[UNK]", "[CLS]", "[SEP]"))
        self.reach, self.longest = max(map(len, vocabulary)), longest
        self.chunk = lru_cache(MEMO)(lambda chunk: [i for w in plain_words(chunk) for i in self.word(w)])

    def word(self, word: str) -> list[int]:
        if len(word) > self.longest:
            return [self.unknown]
        out, at = [], 0
        while at < len(word):
            mark = "##" if at else ""
            for end in range(min(len(word), at + self.reach), at, -1):
                if (i := self.ids.get(mark + word[at:end])) is not None:
                    out.append(i)
                    at = end
                    break
            else:
                return [self.unknown]
        return out

    def text(self, text: str) -> list[int]:
        return [i for chunk in split_spaces(text) if chunk for i in self.chunk(chunk)]


class Unigram:
    """ids of texts by the segmentation with the highest sum of scores; of equal ones that whose last pieces start earlier. Neighbouring unknown characters are one piece."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int, first: int, last: int):
        self.ids = {p: i for i, (p, _) in enumerate(pieces)}
        self.scores = dict(pieces)
        self.unknown, self.first, self.last = unknown, first, last
        self.reach = max(map(len, self.scores))
        self.worst = min(0.0, *self.scores.values()) - UNKNOWN
        # words can be cut by themselves unless a piece goes on into the next one
        self.by_word = not any(START in p[1:] for p in self.scores)
        self.chunk = lru_cache(MEMO)(self.best)

    def best(self, run: str) -> list[int]:
        n = len(run)
        score, back = [0.0] + [float("-inf")] * n, [(0, False)] * (n + 1)
        for i in range(n):
            known = [(end, self.scores[run[i:end]]) for end in range(i + 1, min(n, i + self.reach) + 1) if run[i:end] in self.scores]
            for end, s in known or [(i + 1, self.worst)]:
                if score[i] + s > score[end]:
                    score[end], back[end] = score[i] + s, (i, not known)
        out, at, after = [], n, False
        while at:
            start, strange = back[at]
            if not (strange and after):
                out.append(self.unknown if strange else self.ids[run[start:at]])
            at, after = start, strange
        return out[::-1]

    def text(self, text: str) -> list[int]:
        clean = "".join(" " if c in _SPACES else c for c in unicodedata.normalize("NFKC", text) if c in _SPACES or unicodedata.category(c) not in ("Cc", "Cf"))
        words = [START + w for w in clean.split(" ") if w]
        return [i for w in words for i in self.chunk(w)] if self.by_word else self.best("".join(words))


def wordpiece(vocabulary: DataFrame, longest: int = LONGEST) -> WordPiece:
    """A model of a table (id, piece), in the order of id from 0."""
    return WordPiece([r.piece for r in _bounded(vocabulary.select("id", "piece")).orderBy("id").collect()], longest)


def unigram(vocabulary: DataFrame, unknown: str = "<unk>", first: str = "<s>", last: str = "</s>") -> Unigram:
    """A model of a table (id, piece, score), in the order of id from 0."""
    pieces = [(r.piece, float(r.score)) for r in _bounded(vocabulary.select("id", "piece", "score")).orderBy("id").collect()]
    at = {p: i for i, (p, _) in enumerate(pieces)}
    return Unigram(pieces, at[unknown], at[first], at[last])


def _bounded(vocabulary: DataFrame) -> DataFrame:
    if vocabulary.limit(MOST_PIECES + 1).count() > MOST_PIECES:
        raise ValueError(f"a model of more than {MOST_PIECES} pieces is none")
    return vocabulary


def encode(rows: DataFrame, key: str, text: str, model: WordPiece | Unigram, most: int | None = None) -> DataFrame:
    """key, ids: of each text, between the model's first and last piece, at most `most` ids with these. A null text is an empty one."""
    shared = rows.sparkSession.sparkContext.broadcast((type(model), model.__dict__ | {"chunk": None}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, values = shared.value
        own = object.__new__(kind)
        own.__dict__ |= values
        own.chunk = lru_cache(MEMO)(own.best if kind.__name__ == "Unigram" else lambda chunk: [i for w in plain_words(chunk) for i in own.word(w)])
        for batch in batches:
            ids = [own.text(t or "") for t in batch.column(1).to_pylist()]
            cut = [i if most is None else i[: max(0, most - 2)] for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[own.first, *i, own.last] for i in cut], pa.list_(pa.int32()))], [key, "ids"])

    return rows.select(key, F.col(text).alias("text")).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, ids array<int>")
