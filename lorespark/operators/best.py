"""The best rows of many queries, of scores that come in blocks, in bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows that wait until they are sorted in, and rows that are passed on at once.
WAITING, AT_ONCE = 1 << 17, 1 << 16


def stretches(upto: np.ndarray, rows: int, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows, at most `rows` each, and of a sum (its running values, from 0) of at most `most` where more than one row is in it."""
    at, n = 0, len(upto) - 1
    while at < n:
        stop = min(n, at + rows, max(at + 1, int(np.searchsorted(upto, upto[at] + most, "right")) - 1))
        yield at, stop
        at = stop


class Best:
    """For each of n queries its k first rows: those that are whole (if that is given), then by score, then by id."""

    def __init__(self, n: int, k: int):
        self.k, self.held, self.waiting, self.size = k, None, [], 0
        # what a row must reach to be among the first k
        self.whole, self.score = np.zeros(n, bool), np.full(n, -np.inf)

    def offer(self, ids: pa.Array, score: np.ndarray, whole: np.ndarray | None, inside: np.ndarray) -> None:
        """Scores of rows (ids) by queries; of those inside."""
        good = inside & ((score >= self.score) | np.isnan(score) if whole is None else (whole > self.whole) | ((whole == self.whole) & (score >= self.score)))
        row, query = np.nonzero(good)
        if len(row):
            kept = np.zeros(len(row), np.int8) if whole is None else whole[row, query].astype(np.int8)
            self.waiting.append(pa.table({"query": query, "whole": kept, "score": score[row, query], "id": ids.take(pa.array(row))}))
            self.size += len(row)
            if self.size > max(WAITING, self.held.num_rows if self.held is not None else 0):
                self._sort()

    def _sort(self) -> None:
        if not self.waiting:
            return
        rows = pa.concat_tables([*([self.held] if self.held is not None else []), *self.waiting]).combine_chunks()
        rows = rows.sort_by([("query", "ascending"), ("whole", "descending"), ("score", "descending"), ("id", "ascending")])
        query = rows.column("query").to_numpy()
        place = np.arange(len(query)) - np.searchsorted(query, query)
        rows = rows.filter(pa.array(place < self.k)).combine_chunks()
        last = np.flatnonzero(place[place < self.k] == self.k - 1)
        query = rows.column("query").to_numpy()[last]
        self.whole[query], self.score[query] = rows.column("whole").to_numpy()[last] > 0, rows.column("score").to_numpy()[last]
        self.held, self.waiting, self.size = rows, [], 0

    def rows(self) -> Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]:
        """query (its number), id, score, whole, some at a time."""
        self._sort()
        for at in range(0, self.held.num_rows if self.held is not None else 0, AT_ONCE):
            some = self.held.slice(at, AT_ONCE).combine_chunks()
            query, ids, score, whole = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (some.column(x) for x in ("query", "id", "score", "whole")))
            yield query, ids, score, whole.cast(pa.bool_())
