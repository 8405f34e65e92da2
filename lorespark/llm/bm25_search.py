"""Exact top-k BM25 search: an inverted index per shard, block-max WAND over its blocks, exact merge.

Statistics (documents, mean length, document frequencies) are global, so a document's score does not depend on its shard
and the k best of all shards are the k best of all.

Shards hold a bounded number of postings, whatever lengths documents have, and are built once, as a table, without a shuffle.
In a shard, documents are ordered by their most frequent word (so languages stand together), numbered and cut into blocks that all terms
share. For each term the index has its postings in document order and, per block, the largest score that the term gives there.

A query's threshold is the k-th best score so far, also of the shards that the same task has searched before; the blocks with the
largest sums of maxima are scored first where there is none. Of a query's terms, in the order of their maxima in the shard, those whose maxima
add up to less than the threshold can't carry a document: their cursors propose no pivot. The other terms' postings are read, and each document
in them is a pivot, bounded by what they give it and by the block maxima of the terms that were left out. A pivot below the threshold is skipped; the
others are scored in full, by jumps of the cursors to them, the most promising first, so the threshold rises; frequent terms, to which most jumps
go, have a table by document, where a jump is a look-up and no search. A document at
the threshold itself is still scored, so ties keep the smallest ids. This is block-max WAND with the pivots of a whole shard found
at once, which suits numpy; most queries here have hundreds of terms, of which few carry a document.

Many queries go through a shard together. What a term gives a document is the same for all of them, so it is worked out once, in a table for frequent terms. A query's
postings of rarer terms are read whole; block maxima (and what all frequent terms give the best document of a block) bound what the others add, and stretches of blocks that
can't reach a query's threshold are skipped. In the rest products of single precision give what frequent terms add, and only documents that may be among the k best are scored in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm.common import materialize, only, session_of, ship_code, text_of
from lorespark.operators.best import stretches

K1, B = 1.2, 0.75
TOP = 10
#: Postings and documents of a shard, and query terms that pass through the shards together: they bound a task's memory, and the broadcast.
POSTINGS, TERMS = 1 << 20, 1 << 22
#: Documents of a block; blocks scored to have a threshold; pivots scored before the first look at it, twice as many before each later one.
BLOCK, FIRST, STEP = 8, 4, 32
#: Numbers of a shard's table of frequent terms, which holds terms that stand in one of so many documents or more, the most frequent first.
TABLE, FREQUENT = 1 << 21, 64
#: Rows of the index for each shard, which share its postings: what the JVM holds at once is a row's. A file has one shard's rows, so one task reads them.
PIECES = 16
#: Terms times documents that are looked up at once: they bound what a search holds, however many terms a query has.
CELLS = 1 << 18
#: Queries times documents (or terms in the table) that are scored at once, and postings read for them, where many queries are searched together.
MANY = 1 << 19
#: Documents of a block where many queries are searched together, blocks whose documents are scored together, for the queries that can use one of them, and
#: stretches of a shard at most. Where fewer than FEW queries are asked or fit in MANY, as in shards of very many tiny documents, they are searched one by one.
WIDE, STRETCH, STRETCHES, FEW = 32, 2, 128, 8
#: Slices of the index, of which each task searches one, where the cluster has no more cores: they don't grow with the index.
SLICES = 12
#: Stands for a null doc_id: it comes first among ties.
NO_ID = -(1 << 63)


def term_ids(text: bytes) -> np.ndarray:
    """64-bit ids of a text's words in order: between ASCII white space, A-Z lower-cased."""
    import xxhash

    words = text.lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


class Shard:
    """ids: of the documents in the shard's order; terms, docs, counts: its postings by term and document; lengths: words of each document."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray, docs: np.ndarray, counts: np.ndarray, lengths: np.ndarray, mean: float):
        self.ids, self.doc = ids, docs
        # a posting's share of the score, without the term's rarity
        self.impact = counts * (K1 + 1)
        self.impact /= counts + (K1 * (1 - B + B * lengths / mean))[docs]
        # postings come by term: no sort
        starts = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.empty(0, np.int64)
        self.vocabulary = terms[starts]
        self.starts = np.append(starts, len(terms))
        self.blocks = -(-len(ids) // BLOCK)

    def often(self, cells: int, share: int) -> np.ndarray:
        """The most frequent terms: those in one of share documents or more, as many as have room in a table of so many cells."""
        spread = np.diff(self.starts)
        often = np.argsort(-spread, kind="stable")[: cells // max(len(self.ids), 1)]
        return often[spread[often] * share >= len(self.ids)]

    @cached_property
    def term_best(self) -> np.ndarray:
        """The largest score that each term gives in the shard."""
        return np.maximum.reduceat(self.impact, self.starts[:-1]) if len(self.vocabulary) else np.empty(0)

    @cached_property
    def number(self) -> np.ndarray:
        """The term of each posting."""
        return np.repeat(np.arange(len(self.vocabulary)), np.diff(self.starts))

    @cached_property
    def key(self) -> np.ndarray:
        """One ascending key for each posting."""
        return self.number * len(self.ids) + self.doc

    @cached_property
    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The block and best of each cell, a term's postings in a block, and where each term's cells start."""
        cell = self.number * (self.blocks + 1) + self.doc // BLOCK
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.empty(0, np.int64)
        best = np.maximum.reduceat(self.impact, first) if len(first) else np.empty(0)
        return self.doc[first] // BLOCK, best, np.searchsorted(first, self.starts)

    @cached_property
    def frequent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The column of each term, -1 for rarer ones, and the postings and block maxima of frequent terms by address."""
        often = self.often(TABLE, FREQUENT)
        spread = np.diff(self.starts)[often]
        column = np.full(len(self.vocabulary), -1)
        column[often] = np.arange(len(often))
        table, table_best = np.zeros((len(self.ids), len(often))), np.zeros((len(often), self.blocks))
        posts = _ranges(self.starts[often], self.starts[often + 1])
        table[self.doc[posts], np.repeat(np.arange(len(often)), spread)] = self.impact[posts]
        block, best, at = self.cells
        a, b = at[often], at[often + 1]
        cells = _ranges(a, b)
        table_best[np.repeat(np.arange(len(often)), b - a), block[cells]] = best[cells]
        return column, table, table_best

    def search(self, terms: np.ndarray, idf: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores, postings read) of the k best documents with a positive score, those of earlier shards (best) among them; terms are distinct."""
        ids, scores = best or (np.empty(0, np.int64), np.empty(0))
        at = np.searchsorted(self.vocabulary, terms)
        at[at == len(self.vocabulary)] = 0
        have = self.vocabulary[at] == terms if len(self.vocabulary) else np.zeros(len(terms), bool)
        at, idf = at[have], idf[have]
        if not len(at):
            return ids, scores, 0
        most = idf * self.term_best[at]
        order = np.argsort(most, kind="stable")
        at, idf, most = at[order], idf[order], most[order]
        read, done = 0, np.zeros(len(self.ids), bool)

        def keep(docs: np.ndarray, found: np.ndarray) -> None:
            nonlocal ids, scores
            found = np.round(found, 6)
            docs, found = docs[found > 0], found[found > 0]
            ids, scores = np.append(ids, self.ids[docs]), np.append(scores, found)
            first = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[first], scores[first]

        def least() -> float:
            return scores[-1] - 1e-6 if len(scores) == k else 0.0

        if len(scores) < k:
            bounds = self._bounds(at, idf)
            some = np.argsort(-bounds, kind="stable")[:FIRST]
            docs = np.concatenate([np.arange(j * BLOCK, min((j + 1) * BLOCK, len(self.ids))) for j in np.sort(some).tolist()])
            found, n = self._full(at, idf, docs)
            done[docs] = True
            read += n
            keep(docs, found)
        # a hair less, as sums are taken in several orders
        carried = int(np.searchsorted(np.cumsum(most) * (1 + 1e-9), least()))
        few, main = (at[:carried], idf[:carried]), (at[carried:], idf[carried:])
        lo, hi = self.starts[main[0]], self.starts[main[0] + 1]
        posts = _ranges(lo, hi)
        read += len(posts)
        given = np.bincount(self.doc[posts], np.repeat(main[1], hi - lo) * self.impact[posts], len(self.ids))
        bounds = self._bounds(*few)
        bounds = (given + np.repeat(bounds, BLOCK)[: len(given)]) * (1 + 1e-9)
        pivots = np.flatnonzero((given > 0) & ~done & (bounds >= least()))
        pivots = pivots[np.argsort(-bounds[pivots], kind="stable")]
        step = STEP
        while len(pivots):
            some, pivots, step = pivots[:step], pivots[step:], 2 * step
            found, n = self._full(*few, some)
            read += n
            keep(some, given[some] + found)
            pivots = pivots[bounds[pivots] >= least()]
        return ids, scores, read

    def search_many(self, asked: Asked, held: Held) -> None:
        """Offers to held what of this shard is among the k best of each query: search() for many queries at once, with the same result.

        Of a batch of queries, the postings of terms that have no column in the table are read. Per block, the best sum of these and the maxima of the
        other terms bound its documents; a query skips the stretches in which no block reaches its threshold, and in the rest one matrix product
        for all queries that are left gives nearly what the other terms add. Documents that may be among the k best are scored in double precision.
        """
        rows = min(len(asked), MANY // max(len(self.ids), 1))
        if rows >= FEW:
            number = asked.numbers(self.vocabulary)
            there = np.flatnonzero(number >= 0)
            if not len(there):
                return
            given = Given(self, number[there], asked.idf[there])
            rows = min(rows, MANY // max(given.table.shape[1], 1))
        if rows < FEW:
            for q in range(len(asked)):
                held.put(q, *self.search(*asked.words(q), held.k, held.of(q))[:2])
            return
        for lo in range(0, len(asked), rows):
            hi = min(lo + rows, len(asked))
            given.search(lo, hi - lo, *asked.part(lo, hi, number), held)

    def _bounds(self, at: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """For each block, the sum of these terms' maxima."""
        column, _, table_best = self.frequent
        block, best, starts = self.cells
        column = column[at]
        often = column >= 0
        rare, weight = at[~often], idf[~often]
        a, b = starts[rare], starts[rare + 1]
        cells = _ranges(a, b)
        found = np.bincount(block[cells], np.repeat(weight, b - a) * best[cells], self.blocks)
        return found + idf[often] @ table_best[column[often]]

    def _full(self, at: np.ndarray, idf: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, int]:
        """What these terms give these documents, and how many postings they have there: a jump of each cursor to each document."""
        if not len(at) or not len(docs):
            return np.zeros(len(docs)), 0
        some = max(1, CELLS // len(at))
        if len(docs) > some:
            each = [self._full(at, idf, docs[i : i + some]) for i in range(0, len(docs), some)]
            return np.concatenate([found for found, _ in each]), sum(n for _, n in each)
        column, table, _ = self.frequent
        column = column[at]
        often = column >= 0
        parts = table[docs[:, None], column[often]]
        found, read = parts @ idf[often], int(np.count_nonzero(parts))
        rare, weight = at[~often], idf[~often]
        if len(rare):
            wanted = (rare[:, None] * len(self.ids) + docs).ravel()
            place = np.searchsorted(self.key, wanted)
            place[place == len(self.key)] = 0
            hit = np.flatnonzero(self.key[place] == wanted)
            found += np.bincount(hit % len(docs), np.repeat(weight, len(docs))[hit] * self.impact[place[hit]], len(docs))
            read += len(hit)
        return found, read


class Given:
    """What a shard's terms that are asked for (numbers, with their idf) give its documents, whichever query asks: in a table for frequent terms, in postings for the others."""

    def __init__(self, shard: Shard, numbers: np.ndarray, idf: np.ndarray):
        spread = np.diff(shard.starts)
        weight = np.zeros(len(spread))
        weight[numbers] = idf
        self.ids, self.starts, self.doc = shard.ids, shard.starts, shard.doc.astype(np.int64)
        self.gain = shard.impact * np.repeat(weight, spread)
        often = shard.often(TABLE, FREQUENT)
        often = often[weight[often] > 0]
        self.column = np.full(len(spread), -1, np.int32)
        self.column[often] = np.arange(len(often))
        posts = _ranges(shard.starts[often], shard.starts[often + 1])
        place = self.doc[posts], np.repeat(np.arange(len(often)), spread[often])
        blocks = -(-len(shard.ids) // WIDE)
        # in single precision, and what that leaves out
        self.table, self.rest = np.zeros((2, blocks * WIDE, len(often)), np.float32)
        self.table[place] = self.gain[posts]
        self.rest[place] = self.gain[posts] - self.table[place]
        self.best = np.maximum.reduce(self.table.reshape(blocks, WIDE, len(often)), axis=1).T
        self.most = np.maximum.reduce(self.table.sum(axis=1).reshape(blocks, WIDE), axis=1)
        # a sum of single precision is as near to the exact one, as a share of it, whatever its order
        self.error = 1e-6 + len(often) * 2.0**-23

    def search(self, lo: int, n: int, query: np.ndarray, at: np.ndarray, held: Held) -> None:
        """Offers what is among the k best of n queries from number lo on; query, at: their terms."""
        width, k = len(self.table), held.k
        column = self.column[at]
        often = column >= 0
        asks = np.zeros((n, self.table.shape[1]), np.float32)
        asks[query[often], column[often]] = 1
        some = np.flatnonzero(~often)
        lows, highs = self.starts[at[some]], self.starts[at[some] + 1]
        ends = np.searchsorted(query[some], np.arange(n + 1)).tolist()
        scores = np.empty((n, width))
        for q, (a, b) in enumerate(zip(ends, ends[1:])):
            # one query at a time, as its postings and sums stay in the CPU's caches
            posts = _ranges(lows[a:b], highs[a:b])
            scores[q] = np.bincount(self.doc[posts], self.gain[posts], width)
        least = np.maximum(held.least[lo : lo + n, None] * (1 - 2 * self.error), 1e-7)
        opened = np.maximum.reduce(scores.reshape(n, -1, WIDE), axis=2) + np.minimum(asks @ self.best, self.most) >= least
        near = np.zeros((n, width), np.float32)
        stretch = max(STRETCH, -(-opened.shape[1] // STRETCHES))
        for block in (np.unique(np.flatnonzero(opened.any(axis=0)) // stretch) * stretch).tolist():
            some = np.flatnonzero(opened[:, block : block + stretch].any(axis=1))
            docs = slice(block * WIDE, (block + stretch) * WIDE)
            near[some, docs] = scores[some, docs] + asks[some] @ self.table[docs].T
        reached = near >= least.astype(np.float32)
        # of many documents only those that can be among this shard's k best are scored in full
        many = np.flatnonzero(np.count_nonzero(reached, axis=1) > 2 * k)
        if len(many):
            reached[many] &= near[many] >= np.partition(near[many], width - k, axis=1)[:, [width - k]] * (1 - 2 * self.error) - 1e-6
        some, docs = np.divmod(np.flatnonzero(reached), width)
        step = max(1, MANY // 8 // max(asks.shape[1], 1))
        for a in range(0, len(some), step):
            queries, its = some[a : a + step], docs[a : a + step]
            exact = self.table[its].astype(np.float64) + self.rest[its]
            held.offer(lo + queries, self.ids[its], scores[queries, its] + np.einsum("ij,ij->i", exact, asks[queries]))


class Asked:
    """Queries of a block. terms: the places of their terms in vocabulary, one query after the other; vocabulary: the distinct terms, ascending, with their idf."""

    def __init__(self, queries: np.ndarray, offsets: np.ndarray, terms: np.ndarray, idf: np.ndarray):
        # queries that share their most frequent term stand together
        at = np.repeat(np.arange(len(queries)), np.diff(offsets))
        first = np.lexsort((terms, idf, at))[offsets[:-1]]
        order = np.lexsort((terms[first], idf[first]))
        sizes = np.diff(offsets)[order]
        places = _ranges(offsets[:-1][order], offsets[1:][order])
        self.queries, self.offsets = queries[order], np.append(0, np.cumsum(sizes))
        self.vocabulary, one, place = np.unique(terms[places], return_index=True, return_inverse=True)
        self.terms, self.idf = place.astype(np.int32), idf[places][one]

    def __len__(self) -> int:
        return len(self.queries)

    def words(self, query: int) -> tuple[np.ndarray, np.ndarray]:
        """The terms of a query, and their idf."""
        terms = self.terms[self.offsets[query] : self.offsets[query + 1]]
        return self.vocabulary[terms], self.idf[terms]

    def numbers(self, vocabulary: np.ndarray) -> np.ndarray:
        """The place of each asked term in a shard's vocabulary, -1 where it isn't there."""
        at = np.searchsorted(self.vocabulary, vocabulary)
        at[at == len(self.vocabulary)] = 0
        hit = np.flatnonzero(self.vocabulary[at] == vocabulary)
        number = np.full(len(self.vocabulary), -1, np.int32)
        number[at[hit]] = hit
        return number

    def part(self, lo: int, hi: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """query (from 0) and number in the shard of each term that queries lo to hi ask for and the shard has."""
        at = number[self.terms[self.offsets[lo] : self.offsets[hi]]]
        have = np.flatnonzero(at >= 0)
        return np.repeat(np.arange(hi - lo), np.diff(self.offsets[lo : hi + 1]))[have], at[have]


class Held:
    """The k best documents of each of n queries so far, by score (rounded), then id. least: what a document must reach to be among them."""

    def __init__(self, n: int, k: int):
        self.k, self.ids, self.scores, self.size = k, np.zeros((n, k), np.int64), np.zeros((n, k)), np.zeros(n, np.int64)
        self.least = np.zeros(n)

    def of(self, query: int) -> tuple[np.ndarray, np.ndarray]:
        return self.ids[query, : self.size[query]], self.scores[query, : self.size[query]]

    def put(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        self.ids[query, : len(ids)], self.scores[query, : len(ids)], self.size[query] = ids, scores, len(ids)

    def offer(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores of documents (ids) for queries, a pair each."""
        k, found = self.k, np.round(scores, 6)
        some = np.flatnonzero((found > 0) & (found >= self.least[query]))
        query, ids, found = query[some], ids[some], found[some]
        if not len(query):
            return
        changed = np.unique(query)
        old = np.flatnonzero((np.arange(k) < self.size[changed][:, None]).ravel())
        query = np.append(query, np.repeat(changed, k)[old])
        ids = np.append(ids, self.ids[changed].ravel()[old])
        found = np.append(found, self.scores[changed].ravel()[old])
        order = np.lexsort((ids, -found, query))
        query, ids, found = query[order], ids[order], found[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < k
        query, place, ids, found = query[kept], place[kept], ids[kept], found[kept]
        self.ids[query, place], self.scores[query, place] = ids, found
        np.maximum.at(self.size, query, place + 1)
        full = changed[self.size[changed] == k]
        self.least[full] = self.scores[full, k - 1] - 1e-6


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers from lo to hi of each pair, one after the other."""
    n = hi - lo
    return np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())


def _bags(docs: DataFrame) -> DataFrame:
    """doc_id, terms, counts, length of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lorespark.llm import bm25_search as S

        S.only("bm25_search")
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                bags = [S.term_ids(t) for t in part.column(1).to_pylist()]
                pairs = [np.unique(b, return_counts=True) for b in bags]
                offsets = pa.array(np.cumsum([0, *(len(t) for t, _ in pairs)], dtype=np.int32))
                terms = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([t for t, _ in pairs])))
                counts = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([c for _, c in pairs]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), terms, counts, pa.array([len(b) for b in bags], pa.int64())], ["doc_id", "terms", "counts", "length"])

    return docs.select("doc_id", text_of().cast("binary").alias("text")).mapInArrow(run, "doc_id long, terms array<long>, counts array<int>, length long")


def _index(bags: DataFrame) -> DataFrame:
    """PIECES rows per shard: its documents' ids and lengths in the first, and its postings by term and document, as numbers in a row, in turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lorespark.llm import bm25_search as S

        S.only("bm25_search")
        names = ["ids", "lengths", "terms", "docs", "counts"]
        held: list[tuple] = []
        size = 0

        def shard() -> pa.RecordBatch:
            ids, terms, counts, lengths = zip(*held)
            # documents whose most frequent word is the same stand together, the shorter first
            usual = np.array([t[np.argmax(c)] if len(t) else 0 for t, c in zip(terms, counts)], np.int64)
            order = np.lexsort((lengths, usual)).tolist()
            docs = np.repeat(np.arange(len(order), dtype=np.int32), [len(terms[i]) for i in order])
            terms, counts = np.concatenate([terms[i] for i in order]), np.concatenate([counts[i] for i in order]).astype(np.int32)
            held.clear()
            by = np.argsort(terms, kind="stable")
            rows = np.array(ids, np.int64)[order], np.array(lengths, np.int64)[order], terms[by], docs[by], counts[by]
            edges = np.linspace(0, len(by), S.PIECES + 1).astype(np.int64).tolist()
            whole = [[x.tobytes(), *[b""] * (S.PIECES - 1)] for x in rows[:2]]
            cut = [[x[a:b].tobytes() for a, b in zip(edges, edges[1:])] for x in rows[2:]]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in whole + cut], names)

        for batch in batches:
            ids, lengths = batch.column(0).fill_null(S.NO_ID).to_pylist(), batch.column(3).to_pylist()
            terms, counts = batch.column(1), batch.column(2)
            edges, flat, numbers = terms.offsets.to_numpy(), terms.values.to_numpy(), counts.values.to_numpy()
            off = counts.offsets.to_numpy()
            for i, n, a, b, c, d in zip(ids, lengths, edges[:-1].tolist(), edges[1:].tolist(), off[:-1].tolist(), off[1:].tolist()):
                held.append((i, flat[a:b].copy(), numbers[c:d].copy(), n))
                size += b - a + 1  # a document without words takes room too
                if size >= S.POSTINGS:
                    yield shard()
                    held, size = [], 0
        if held:
            yield shard()

    return bags.select("doc_id", "terms", "counts", "length").mapInArrow(run, "ids binary, lengths binary, terms binary, docs binary, counts binary")


def _found(index: DataFrame, asked: pa.Table, mean: float, k: int) -> DataFrame:
    """query_id, doc_id, score: the k best of each slice of the shards, for queries (query_id, term, idf) of bounded size."""
    edges = asked.column("term").combine_chunks()
    plain = Asked(asked.column("query_id").to_numpy(), edges.offsets.to_numpy(), edges.values.to_numpy(), asked.column("idf").combine_chunks().values.to_numpy())
    context = session_of(index).sparkContext
    shared = context.broadcast(plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lorespark.llm import bm25_search as S

        S.only("bm25_search")
        asked = shared.value
        held = S.Held(len(asked), k)
        pieces: list[list[bytes]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                pieces.append([c[i].as_py() for c in batch.columns])
                if len(pieces) < S.PIECES:
                    continue
                ids, lengths, words, docs, counts = (np.frombuffer(b"".join(c), t) for c, t in zip(zip(*pieces), (np.int64, np.int64, np.int64, np.int32, np.int32)))
                # the last shard goes before the next one is made
                pieces, shard = [], None
                shard = S.Shard(ids, words, docs, counts, lengths, mean)
                del words, counts
                shard.search_many(asked, held)
        if pieces:
            raise ValueError("the index was cut inside a shard")
        there = np.arange(k) < held.size[:, None]
        columns = np.repeat(asked.queries, held.size), held.ids[there], held.scores[there]
        if there.any():
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["query_id", "doc_id", "score"])

    return index.coalesce(max(SLICES, context.defaultParallelism)).mapInArrow(run, "query_id long, doc_id long, score double")


def search(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, doc_id, score (6 decimals), rank (1 to k): the k best documents of each query, ties by doc_id.

    docs: doc_id, text; queries: query_id, text. A query asks for its distinct words, under a repeated query_id for those of all its
    rows; every document is searched, the query's own row too. BM25 with k1 = 1.2, b = 0.75 and
    idf = ln(1 + (N - df + 0.5) / (df + 0.5)). Null and empty texts match nothing and ask for nothing; such queries, and those without
    query_id, give no rows. Texts are read whole, however long. Rows that repeat a doc_id are documents of their own; a null
    doc_id comes first among ties. An empty table gives no rows. Other columns are ignored.

    Queries go through the index in blocks of about TERMS words: one block at a time is broadcast, and each task searches the
    shards of a slice of the index. Nothing of the index is shuffled. There are as many slices however many shards the index has, so the rows
    that slices find, k for each query at most, grow with the queries only. Every query still meets every shard.
    """
    spark = session_of(docs)
    ship_code(spark)
    bags = materialize(_bags(docs))
    n, mean = bags.agg(F.count("*"), F.avg("length")).first()
    nothing = spark.range(0).select(F.col("id").alias("query_id"), F.col("id").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    if not n or not mean:
        return nothing
    asked = _bags(queries.where("query_id is not null").select(F.col("query_id").alias("doc_id"), "text"))
    asked = materialize(asked.select(F.col("doc_id").alias("query_id"), F.explode("terms").alias("term")).distinct())
    rarity = bags.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).join(asked.select("term").distinct(), "term")
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(rarity.select("term", idf.alias("idf")), "term").groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("terms"))
    weighed = materialize(weighed.select("query_id", F.col("terms.term").alias("term"), F.col("terms.idf").alias("idf")))
    # the k best of a query take room too
    words = weighed.agg(F.sum(F.size("term") + 2 * k)).first()[0]
    if not words:
        return nothing
    index = materialize(_index(bags), PIECES)
    blocks = max(1, -(-words // TERMS))
    found = None
    for block in range(blocks):
        part = weighed.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()
        if part.num_rows:
            part = materialize(_found(index, part, mean, k))
            found = part if found is None else found.union(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents
), terms AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(l) AS term FROM w) GROUP BY ALL
), stats AS (
  SELECT count(*) AS n, avg(len(l)) AS mean FROM w
), rarity AS (
  SELECT term, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM (SELECT term, count(*) AS df FROM terms GROUP BY term), stats
), scored AS (
  SELECT q.doc_id AS query_id, d.doc_id, round(sum(idf * d.tf * 2.2::DOUBLE / (d.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(w.l) / mean))), 6) AS score
  FROM terms AS q JOIN terms AS d USING (term) JOIN rarity USING (term) JOIN w ON w.doc_id = d.doc_id, stats WHERE q.doc_id % 50 = 0 GROUP BY ALL
)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10
"""
