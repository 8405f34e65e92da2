"""Which documents name others: names in one automaton, or, if they are many, found by hashes between word boundaries; each text is scanned once."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions import text as T

#: Bytes of names in one automaton; more names are found by their hashes.
NAME_BYTES = 1 << 20
#: Bits of the map of names' hashes (32 MB, whatever their number), bits of one of its rows, bytes of texts that are hashed at once.
NAME_BITS, ROW_BITS, BLOCK = 1 << 28, 1 << 15, 1 << 20
_WORD = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz")


def automaton(names: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for name in names:
        found.add_word(name, name)
    found.make_automaton()
    return found


def count_names(found, text: str) -> dict[str, int]:
    """How often each name stands in a text between word boundaries, without overlaps of a name with itself, from the left.

    A boundary lies between an ASCII word character and something else, so a name that begins with another character needs a
    word character before it.
    """
    counts: dict[str, int] = {}
    last: dict[str, int] = {}
    if not len(found):
        return counts
    for end, name in found.iter(text):
        start = end + 1 - len(name)
        before, after = start > 0 and text[start - 1] in _WORD, end + 1 < len(text) and text[end + 1] in _WORD
        if before != (name[0] in _WORD) and after != (name[-1] in _WORD) and start > last.get(name, -1):
            last[name] = end
            counts[name] = counts.get(name, 0) + 1
    return counts


#: The automaton that a Python worker holds, by the key of its job.
_built: dict[str, object] = {}


def mentions(texts: DataFrame, names: DataFrame, most: int = NAME_BYTES) -> DataFrame:
    """path, name, mentions of names (name, lower-cased) in texts (path, text, lower-cased). Nothing of the texts is shuffled.

    Up to `most` bytes of distinct names are broadcast as one automaton. More names are found by the hashes of what stands between word
    boundaries, one scan whatever their number; only what a map of all names' hashes lets through is then joined with the names.
    """
    spark = texts.sparkSession
    distinct = names.select("name").where("name <> ''").distinct()
    total = distinct.agg(F.sum(F.octet_length("name"))).first()[0] or 0
    if total <= most:
        return _pass(texts, spark.sparkContext.broadcast([r.name for r in distinct.collect()]))
    runs, bits = _name_map(distinct)
    return _hash_pass(texts, spark.sparkContext.broadcast((runs, bits))).join(distinct, "name", "left_semi").select("path", "name", "mentions")


def _pass(texts: DataFrame, shared) -> DataFrame:
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lorespark.operators import mentions as M

        if key not in M._built:
            M._built.clear()
            M._built[key] = M.automaton(shared.value)
        for batch in batches:
            rows = [(p.as_py(), *hit) for p, t in zip(batch.column(0), batch.column(1)) if t.is_valid for hit in M.count_names(M._built[key], t.as_py()).items()]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["path", "name", "mentions"])

    return texts.select("path", "text").mapInArrow(run, "path string, name string, mentions long")


_IS_WORD = np.array([chr(b) in _WORD for b in range(256)])
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the base, or of its inverse, modulo 2^64."""
    if len(_powers.get(kind, ())) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        _powers[kind] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, BLOCK) - 1, base, np.uint64)]))
    return _powers[kind][:n]


def _sums(text: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * base^place over each beginning of a text, modulo 2^64: with them any stretch is hashed in one step."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _power("up", len(text)))])


def _slots(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the map for each stretch."""
    h = (sums[stop] - sums[start]) * _power("down", len(sums))[start]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return (h % np.uint64(NAME_BITS)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(NAME_BITS)).astype(np.int64)


def _laid_out(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with a zero byte around each, where each starts, the word boundaries of all, and the text of each boundary."""
    whole = b"\0" + b"\0".join(texts) + b"\0"
    starts = np.cumsum([1, *(len(t) + 1 for t in texts[:-1])])
    word = _IS_WORD[np.frombuffer(whole, np.uint8)]
    at = np.flatnonzero(word[1:] != word[:-1]) + 1
    return whole, starts, at, np.searchsorted(starts, at, "right") - 1


def _name_map(names: DataFrame) -> tuple[list[int], np.ndarray]:
    """How many runs (of word characters, or of others) names have, and the map of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lorespark.operators import mentions as M

        for batch in batches:
            each = batch.column(0).to_pylist()
            found = [M.name_marks(each[at : at + 4096]) for at in range(0, len(each), 4096)]
            runs, slots = (np.concatenate(x) if x else np.empty(0, np.int64) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.int64()), pa.array(slots, pa.int64())], ["runs", "slot"])

    marks = names.select(F.col("name").cast("binary").alias("name")).mapInArrow(run, "runs long, slot long")
    rows = marks.groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("marks"), F.collect_set("runs").alias("runs")).toArrow()
    bits, runs = np.zeros(NAME_BITS // 8, np.uint8), set()
    for part, some, of in zip(rows.column("part").to_pylist(), rows.column("marks").to_pylist(), rows.column("runs").to_pylist()):
        bits[(part - 1) * ROW_BITS // 8 : part * ROW_BITS // 8] = np.frombuffer(some, np.uint8)
        runs.update(of)
    return sorted(runs), bits


def name_marks(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each name twice its number of runs, and its two places in the map."""
    whole = b"".join(names)
    stops = np.cumsum([len(n) for n in names])
    starts = stops - [len(n) for n in names]
    flat = np.frombuffer(whole, np.uint8)
    word = _IS_WORD[flat]
    turns = np.concatenate([[0, 0], np.cumsum(word[1:] != word[:-1])])  # up to the character before each place
    runs = turns[stops] - turns[starts + 1] + 1
    return np.tile(runs, 2), np.concatenate(_slots(_sums(flat), starts, stops))


def likely_names(texts: list[bytes], runs: list[int], bits: np.ndarray) -> list[Counter]:
    """For each text how often what may be a name (all names, and a few others) stands between word boundaries, counted as by count_names()."""
    out = [Counter() for _ in texts]
    whole, starts, at, of = _laid_out(texts)
    sums = _sums(np.frombuffer(whole, np.uint8))
    marked = lambda slot: (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
    for n in runs:
        start, stop = at[:-n], at[n:]
        same = np.flatnonzero(of[:-n] == of[n:])
        one, two = _slots(sums, start[same], stop[same])
        keep = marked(one)
        same = same[keep][marked(two[keep])]
        last: dict[tuple[int, bytes], int] = {}
        for i, s, e in zip(of[same].tolist(), start[same].tolist(), stop[same].tolist()):
            name = whole[s:e]
            if s >= last.get((i, name), 0):
                last[i, name] = e
                out[i][name] += 1
    return out


def _hash_pass(texts: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lorespark.operators import mentions as M

        runs, bits = shared.value
        for batch in batches:
            paths, each = batch.column(0).to_pylist(), batch.column(1)
            size, at = pc.fill_null(pc.binary_length(each), 0).to_pylist(), 0
            while at < len(paths):
                stop, total = at, 0
                while stop < len(paths) and (stop == at or total + size[stop] < M.BLOCK):
                    total += size[stop]
                    stop += 1
                found = M.likely_names([t or b"" for t in each.slice(at, stop - at).to_pylist()], runs, bits)
                rows = [(p, name.decode(), n) for p, counts in zip(paths[at:stop], found) for name, n in counts.items()]
                columns = list(zip(*rows)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["path", "name", "mentions"])
                at = stop

    return texts.select("path", F.col("text").cast("binary").alias("text")).mapInArrow(run, "path string, name string, mentions long")


def plain_text(body):
    """A body lower-cased, without its heading lines."""
    return F.lower(F.regexp_replace(body, r"(?m)^\s*#[^\n]*$", ""))


def document_names(docs: DataFrame) -> DataFrame:
    """to_path, which, name of documents (path, title)."""
    return docs.select(F.col("path").alias("to_path"), F.posexplode(T.mention_names(F.col("path"), F.col("title"))).alias("which", "name"))
