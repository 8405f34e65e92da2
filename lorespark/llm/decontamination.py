"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows, one scan of each text.

Letters of the automaton are words, numbered by a dictionary of the benchmark's words; a word of a text that is in no
benchmark item ends every match. Word places are mapped back to offsets in the original text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import materialize, session_of, ship_code, text_of, word_blocks

#: Words of a window.
WINDOW = 10
#: Words of the benchmark in one automaton (about 100 MB of it); a larger benchmark is scanned in several passes.
WORDS = 1 << 17
#: Words of one piece of an item: longer items are cut into pieces that share WINDOW - 1 words.
PIECE = 1 << 13
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: Between passes, and in the end.
_STATE = [("runs", "array<struct<first:bigint,last:bigint>>"), ("items", "array<string>")]
_RESULT = [("n_words", "long"), ("n_hit", "long"), ("items", "array<string>"), ("spans", "array<struct<start:bigint,end:bigint>>")]
_ARROW = {
    "n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "runs": pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])),
    "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
}


class Windows:
    """items: (id as text or None, words) of each piece of an item."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]]):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for name, words in items:
            numbers = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            for i in range(max(1, len(numbers) - WINDOW + 1)):
                owners = found.setdefault(tuple(numbers[i : i + WINDOW]), set())
                if name is not None:
                    owners.add(name)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k, window in enumerate(found):
            self.automaton.add_word(window, k)
        self.automaton.make_automaton()
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.owners = list(found.values())

    def scan(self, text: bytes) -> tuple[int, np.ndarray, set[str]]:
        """(words, maximal runs of hit words as rows (first, last), ids of the items found)."""
        total, last, runs, items = 0, [], [np.empty((0, 2), np.int64)], set()
        for words in word_blocks(text):
            # windows that reach over from the block before
            letters = last + [self.numbers.get(w, 0) for w in words]
            hits = list(self.automaton.iter(tuple(letters))) if self.owners else []
            if hits:
                ends, which = np.array(hits, np.int64).T
                items.update(*(self.owners[k] for k in np.unique(which).tolist()))
                ends = ends + total - len(last)
                runs.append(np.stack([ends - self.lengths[which] + 1, ends], 1))
            total += len(words)
            last = letters[-(WINDOW - 1) :]
        return total, merged(np.concatenate(runs)), items


def merged(runs: np.ndarray) -> np.ndarray:
    """Runs (first, last) in order, those that overlap or touch as one."""
    if not len(runs):
        return runs
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(runs[:, 1])
    new = np.flatnonzero(np.append(True, runs[1:, 0] > reach[:-1] + 1))
    return np.stack([runs[new, 0], reach[np.append(new[1:], len(runs)) - 1]], 1)


#: The automaton of this Python worker, by the key of the job that it was built for.
_built: dict[str, Windows] = {}


def windows_of(key: str, shared) -> Windows:
    if key not in _built:
        _built.clear()
        _built[key] = Windows(shared.value)
    return _built[key]


def original_spans(text: str, runs: np.ndarray) -> list[dict[str, int]]:
    """Start and end of each run of words in the original text, in code points."""
    edges = [m.span() for m in islice(_WORD.finditer(text), int(runs[-1, 1]) + 1)] if len(runs) else []
    return [{"start": edges[a][0], "end": edges[b][1]} for a, b in runs.tolist()]


def item_pieces(benchmark: DataFrame, size: int = PIECE) -> DataFrame:
    """item, words (in UTF-8) of each piece of each item that has words; equal ones once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lorespark.llm import decontamination as D

        step = size - D.WINDOW + 1
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                rest: list[bytes] = []
                for words in D.word_blocks(text.as_py()):
                    rest += words
                    while len(rest) > size:
                        yield piece(name, rest[:size])
                        rest = rest[step:]
                if rest:
                    yield piece(name, rest)

    def piece(name: pa.Scalar, words: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name.as_py()], pa.string()), pa.array([words], pa.list_(pa.binary()))], ["item", "words"])

    return benchmark.select(F.col("item_id").cast("string").alias("item"), text_of().cast("binary").alias("text")).mapInArrow(run, "item string, words array<binary>").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, most: int = WORDS, piece: int = PIECE) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, items (ids found, as sorted texts), spans (start, end in the original text's code points).

    docs: doc_id, text; benchmark: item_id, text. A word of a text is hit when it stands in an occurrence of WINDOW
    consecutive words of an item, or of a whole item of fewer words. spans are the maximal runs of hit words. Null and empty
    texts have no words; items without words match nothing. An item without an id hits words and is not among the items;
    rows that repeat an item_id are one item. Repeated rows of docs give equal rows. Texts are scanned whole, block by block.
    Empty tables give no rows, or no hits. Other columns are ignored.

    A benchmark of up to `most` words is one automaton and one pass without a shuffle; each further `most` words take another pass,
    so what is broadcast is bounded.
    """
    spark = session_of(docs)
    ship_code(spark)
    pieces = materialize(item_pieces(benchmark, piece))
    words = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    passes = max(1, -(-words // most))
    nothing = (F.lit(None).cast(kind).alias(name) for name, kind in _STATE)
    state = docs.select("doc_id", text_of().cast("binary").alias("text"), *nothing)
    for k in range(passes):
        # about `most` words of the benchmark at a time
        part = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(passes)) == k).toArrow()
        items = list(zip(part.column("item").to_pylist(), part.column("words").to_pylist()))
        state = _pass(state, spark.sparkContext.broadcast(items), k + 1 == passes)
        if k + 1 < passes:
            state = materialize(state)
    return state


def _pass(state: DataFrame, shared, final: bool) -> DataFrame:
    """The state (doc_id, text, runs, items) with what these items add, or the result."""
    key = uuid.uuid4().hex
    columns = _RESULT if final else _STATE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lorespark.llm import decontamination as D
        from lorespark.llm.common import only

        only("decontamination")
        windows = D.windows_of(key, shared)
        for batch in batches:
            rows = []
            for text, runs, items in zip(batch.column(1), batch.column(2), batch.column(3)):
                text = text.as_py()
                n, found, names = windows.scan(text)
                if runs.is_valid:
                    found = D.merged(np.concatenate([found, np.array([(r["first"], r["last"]) for r in runs.as_py()], np.int64).reshape(-1, 2)]))
                    names = names.union(items.as_py())
                if final:
                    spans = D.original_spans(text.decode("utf-8", "replace"), found) if len(found) else []
                    rows.append({"n_words": n, "n_hit": int((found[:, 1] - found[:, 0] + 1).sum()), "items": sorted(names), "spans": spans})
                else:
                    rows.append({"runs": [{"first": a, "last": b} for a, b in found.tolist()], "items": sorted(names)})
            kept = batch.columns[: 1 if final else 2]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array([r[c] for r in rows], _ARROW[c]) for c, _ in columns)], [*batch.schema.names[: len(kept)], *(c for c, _ in columns)])

    kind = state.schema["doc_id"].dataType.simpleString()
    return state.mapInArrow(run, f"doc_id {kind}, " + "text binary, " * (not final) + ", ".join(map(" ".join, columns)))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP12_SQL = r"""
WITH texts AS (
  SELECT 0 AS part, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), words AS (
  SELECT part, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), windows AS (
  SELECT id AS item, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i, w FROM words WHERE part = 1 AND len(w) > 0
), patterns AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM windows
), places AS (
  SELECT id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM words, (SELECT DISTINCT n FROM patterns) WHERE part = 0
), hits AS (
  SELECT places.id, i, places.n, item FROM places JOIN patterns ON patterns.n = places.n AND array_to_string(w[i:i + places.n - 1], ' ') = p
), hit AS (
  SELECT id, count(DISTINCT j) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT id, i, n FROM hits)) GROUP BY id
), items AS (
  SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT id, CAST(item AS VARCHAR) AS item FROM hits WHERE item IS NOT NULL) GROUP BY id
)
SELECT d.id AS doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM words AS d LEFT JOIN hit ON hit.id = d.id LEFT JOIN items ON items.id = d.id WHERE d.part = 0
"""
