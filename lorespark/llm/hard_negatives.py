"""Hard-negative mining: k-means inverted lists with stored radii, visited in the order of their Cauchy-Schwarz bounds.

A list holds a bounded number of rows of one cluster and the largest distance of its rows from the centroid. With an anchor q,
a centroid c and a radius r, each row's score lies between q.c - |q| r and q.c + |q| r. Lists whose range misses the wanted
window are skipped; the others are visited from the highest bound down, until the bound falls strictly below the k-th score
found, so ties are complete. Each task does this for the lists that it reads and a block of anchors, and the best of all tasks are the best
of all. A block starts from the k-th scores in the sample that the centroids were fitted on, which no final k-th score falls below.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm.common import append_all, materialize, partitions, session_of, ship_code

#: A component x counts as floor(SCALE * x).
SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is at least LOW and at most HIGH hundredths of its positive's.
LOW, HIGH = 30, 90
#: Rounds of fitting the centroids.
ROUNDS = 10


class Limits(NamedTuple):
    """Bounds of what is held at once; none changes a result."""

    #: Rows that the centroids are fitted on (about so many; every row is indexed), and centroids.
    sample: int = 8192
    clusters: int = 256
    #: Rows of a list, bytes of vectors of the lists that are ordered together, anchors of a block, scores held at once.
    rows: int = 1024
    held: int = 32 << 20
    anchors: int = 2048
    cells: int = 1 << 20


LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Stands for a null id: it comes last among ties.
NO_ID = MOST


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def matrix(rows: list[list[int]], kind=np.int64) -> np.ndarray:
    """Rows of numbers as a matrix; shorter rows end in zeros."""
    out = np.zeros((len(rows), max(map(len, rows), default=0)), kind)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, held at the ends of a 64-bit integer."""
    width = min(q.shape[1], v.shape[1])
    q, v = q[:, :width], v[:, :width]
    most = [int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) for x in (q, v)]
    if most[0] * most[1] * max(width, 1) < 1 << 53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    exact = q.astype(object) @ v.astype(object).T
    return np.array([[min(max(int(s), LEAST), MOST) for s in row] for row in exact], np.int64).reshape(len(q), len(v))


def fit(sample: np.ndarray, clusters: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of k-means over the rows of a sample; at least one."""
    points = np.unique(sample.astype(np.float64), axis=0)
    if not len(points):
        return np.zeros((1, sample.shape[1]))
    centers = points[np.random.default_rng(7).permutation(len(points))[:clusters]]
    for _ in range(rounds):
        own = nearest(points, centers)
        size = np.bincount(own, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, own, points)
        centers = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centers)
    return centers


def nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers**2).sum(1)[None, :] - 2 * points @ centers.T, axis=1)


class Asked:
    """Questions to the lists: each has an anchor (a row of vectors), a window of scores and a number of rows wanted."""

    def __init__(self, vectors, ids, labels, anchor, low, high, start, k: int, same: bool):
        self.vectors, self.ids, self.labels, self.anchor = vectors, ids, labels, anchor
        self.low, self.high, self.start, self.k, self.same = low, high, start, k, same

    def __len__(self) -> int:
        return len(self.anchor)


class Best:
    """The k best (score, id) of each question so far, the best first."""

    def __init__(self, asked: Asked):
        self.asked = asked
        self.scores = np.full((len(asked), asked.k), LEAST, np.int64)
        self.ids = np.full((len(asked), asked.k), NO_ID, np.int64)
        self.count = np.zeros(len(asked), np.int64)

    def least(self) -> np.ndarray:
        """What a row must score at least to matter."""
        a = self.asked
        return np.maximum(np.maximum(a.start, a.low), np.where(self.count == a.k, self.scores[:, -1], LEAST))

    def offer(self, some: np.ndarray, found: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        """some: numbers of questions; found: their scores with the rows of a list."""
        a, k = self.asked, self.asked.k
        anchor = a.anchor[some]
        alike = labels[None, :] == a.labels[anchor][:, None]
        fits = (alike & ((ids[None, :] != a.ids[anchor][:, None]) | (ids[None, :] == NO_ID))) if a.same else ~alike
        fits &= (found >= self.least()[some][:, None]) & (found <= a.high[some][:, None])
        q, row = np.nonzero(fits)
        if not len(q):
            return
        old = self.count[some]
        had_q = np.repeat(np.arange(len(some)), old)
        had = _within(old)
        q = np.concatenate([had_q, q])
        s = np.concatenate([self.scores[some[had_q], had], found[fits]])
        i = np.concatenate([self.ids[some[had_q], had], ids[row]])
        order = np.lexsort((i, ~s, q))
        q, s, i = q[order], s[order], i[order]
        place = _within(np.bincount(q, minlength=len(some)))
        top = place < k
        q, s, i, place = q[top], s[top], i[top], place[top]
        self.scores[some[q], place], self.ids[some[q], place] = s, i
        self.count[some] = np.bincount(q, minlength=len(some))


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def visit(lists: list[tuple], centers: np.ndarray, best: Best, cells: int = Limits().cells) -> int:
    """Offers to best what the lists (centroid, radius, ids, labels, vectors) have for it; the number of question and list pairs visited."""
    asked = best.asked
    width = max(centers.shape[1], asked.vectors.shape[1])
    q, c = widened(asked.vectors, width).astype(np.float64), widened(centers, width)[[x[0] for x in lists]]
    middle, reach = q @ c.T, np.linalg.norm(q, axis=1)[:, None] * np.array([x[1] for x in lists])[None, :]
    # sums of doubles are off by a hair
    slack = 1e-9 * (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :] + reach) + 1
    # scores are held at the ends of 64 bits, and so are their bounds
    up, down = (np.clip(x, LEAST, MOST)[asked.anchor] for x in (middle + reach + slack, middle - reach - slack))
    high, low = asked.high.astype(np.float64)[:, None], asked.low.astype(np.float64)[:, None]
    bound = np.minimum(up, high + 1e-9 * np.abs(high))
    bound[(down > high + 1e-9 * np.abs(high)) | (up < low - 1e-9 * np.abs(low))] = -np.inf
    order = np.argsort(-bound, axis=1, kind="stable")
    visited, live = 0, np.arange(len(asked))
    for j in range(len(lists)):
        at = order[live, j]
        least = best.least()[live].astype(np.float64)
        go = bound[live, at] >= least - 1e-9 * np.abs(least)
        go &= bound[live, at] > -np.inf
        live, at = live[go], at[go]
        if not len(live):
            break
        visited += len(live)
        by = np.argsort(at, kind="stable")
        which, first = np.unique(at[by], return_index=True)
        for x, some in zip(which.tolist(), np.split(live[by], first[1:])):
            _, _, ids, labels, vectors = lists[x]
            step = max(1, cells // max(1, len(ids)))
            for k in range(0, len(some), step):
                part = some[k : k + step]
                anchors, back = np.unique(asked.anchor[part], return_inverse=True)
                best.offer(part, scores(asked.vectors[anchors], vectors)[back], ids, labels)
    return visited


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, label, units (whole numbers), row (a number of the row) of the rows that take part."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    units = F.transform("vector", lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))).cast("long"))
    return vectors.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), units.alias("units"), F.monotonically_increasing_id().alias("row"))


def inverted_lists(rows: DataFrame, centers: np.ndarray, limits: Limits = Limits()) -> DataFrame:
    """cluster, radius, ids, labels, vectors: lists of at most limits.rows rows of one cluster.

    Rows are range-sorted by cluster and a hash of the row, so a cluster of any size is spread over tasks.
    """
    shared = session_of(rows).sparkContext.broadcast(centers)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lorespark.llm import hard_negatives as H

        for batch in batches:
            x = H.matrix(batch.column(2).to_pylist(), np.float64)
            width = max(x.shape[1], shared.value.shape[1])
            own = H.nearest(H.widened(x, width), H.widened(shared.value, width)) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int64))], [*batch.schema.names, "cluster"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lorespark.llm import hard_negatives as H

        held: list[tuple] = []

        def one() -> pa.RecordBatch:
            v = H.matrix([r[2] for r in held])
            width = max(v.shape[1], shared.value.shape[1])
            center = H.widened(shared.value, width)[held[0][3]]
            # a hair more, as it is a bound
            radius = float(np.sqrt(((H.widened(v, width) - center) ** 2).sum(1).max())) * (1 + 1e-9)
            blobs = np.array([H.NO_ID if r[0] is None else r[0] for r in held], np.int64), np.array([r[1] for r in held], np.int64), v
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([cluster], pa.int64()), pa.array([radius]), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], ["cluster", "radius", "ids", "labels", "vectors"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (held[0][3] != row[3] or len(held) == limits.rows):
                    yield one()
                cluster = row[3]
                held.append(row)
        if held:
            yield one()

    placed = rows.mapInArrow(assign, "vec_id long, label long, units array<long>, row long, cluster long")
    placed = placed.repartitionByRange(partitions(session_of(rows)), "cluster", F.xxhash64("row")).sortWithinPartitions("cluster")
    return placed.select("vec_id", "label", "units", "cluster").mapInArrow(pack, "cluster long, radius double, ids binary, labels binary, vectors binary")


def search(lists: DataFrame, centers: np.ndarray, asked: Asked, limits: Limits = Limits()) -> DataFrame:
    """question, score, id, rank: the asked.k best rows of each question, ties by id; nothing of the lists is shuffled."""
    shared = session_of(lists).sparkContext.broadcast((centers, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lorespark.llm import hard_negatives as H

        centers, asked = shared.value
        best, held, size = H.Best(asked), [], 0
        for batch in batches:
            for cluster, radius, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
                ids, labels, vectors = (np.frombuffer(x, np.int64) for x in blobs)
                held.append((cluster, radius, ids, labels, vectors.reshape(len(ids), -1)))
                size += len(blobs[2])
                if size >= limits.held:
                    H.visit(held, centers, best, limits.cells)
                    held, size = [], 0
        if held:
            H.visit(held, centers, best, limits.cells)
        question = np.repeat(np.arange(len(asked)), best.count)
        place = H._within(best.count)
        yield pa.RecordBatch.from_arrays([*map(pa.array, (question, best.scores[question, place], best.ids[question, place]))], ["question", "score", "id"])

    order = Window.partitionBy("question").orderBy(F.desc("score"), "id")
    found = lists.mapInArrow(run, "question long, score long, id long")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= asked.k)


def _table(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = rows.select("vec_id", "label", "units").toArrow()
    ids = t.column("vec_id").fill_null(NO_ID).to_numpy()
    return ids, t.column("label").to_numpy(), matrix(t.column("units").to_pylist())


def mine(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, limits: Limits = Limits()) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    vectors: vec_id, label, vector; anchor: a condition on these. An anchor's positives are its `positives` best other rows of its label, and a
    positive's negatives the `negatives` best rows of other labels whose score is from low to high hundredths of the positive's;
    fewer where there are fewer. Scores are integer inner products of floor(256 * component); ties go to the smaller vec_id, a null
    one last.

    Rows with a null label, a null vector or a component that is null or not finite take no part. Shorter vectors end in
    zeros. Components and scores beyond 64 bits are held at the ends of that range. Rows equal in vec_id, label and vector are
    one anchor; as positives and negatives each counts for itself, but none with the anchor's own vec_id is a positive. Empty
    tables and anchors without positives or negatives give no rows. Other columns are ignored.

    Centroids are fitted on a bounded sample, every row is indexed, and results are exact whatever the centroids. Anchors go
    through the lists in blocks of bounded size, of which one at a time is broadcast.
    """
    spark = session_of(vectors)
    ship_code(spark)
    rows = materialize(prepared(vectors))
    n = rows.count()
    share = min(1.0, limits.sample / max(n, 1))
    sample = _table(rows.sample(fraction=share, seed=11).limit(2 * limits.sample) if share < 1 else rows)
    centers = fit(sample[2], limits.clusters)
    lists = materialize(inverted_lists(rows, centers, limits))
    anchors = materialize(rows.where(anchor).select("vec_id", "label", "units").distinct())
    blocks = max(1, -(-anchors.count() // limits.anchors))
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"

    def found() -> Iterator[DataFrame]:
        for block in range(blocks):
            part = _table(anchors.where(F.pmod(F.xxhash64("vec_id", "label", "units"), F.lit(blocks)) == block))
            if len(part[0]):
                yield _mine_block(lists, centers, sample, part, positives, negatives, low, high, limits)

    return append_all(spark, found(), shape)


def _asked(sample: tuple, anchors: tuple, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool, cells: int) -> Asked:
    """Questions that start from the k-th scores in the sample, whose rows are rows of the table too."""
    ids, labels, vectors = anchors
    asked = Asked(vectors, ids, labels, anchor, low, high, np.full(len(anchor), LEAST), k, same)
    best = Best(asked)
    every, step = np.arange(len(anchor)), max(1, cells // max(1, len(sample[0])))
    for at in range(0, len(anchor), step):
        part = every[at : at + step]
        if len(sample[0]):
            best.offer(part, scores(vectors[anchor[part]], sample[2]), sample[0], sample[1])
    asked.start = best.least()
    return asked


def _mine_block(lists: DataFrame, centers: np.ndarray, sample: tuple, anchors: tuple, positives: int, negatives: int, low: int, high: int, limits: Limits) -> DataFrame:
    spark, n = session_of(lists), len(anchors[0])
    asked = _asked(sample, anchors, np.arange(n), np.full(n, LEAST), np.full(n, MOST), positives, True, limits.cells)
    # at most `positives` rows for each anchor of the block
    near = sorted((r.question, r.rank, r.id, r.score) for r in search(lists, centers, asked, limits).collect())
    window = [(-(-low * s // 100), high * s // 100) for *_, s in near]
    some = [i for i, (a, b) in enumerate(window) if a <= b]
    asked = _asked(sample, anchors, np.array([near[i][0] for i in some], np.int64), *(np.array([min(max(window[i][e], LEAST), MOST) for i in some], np.int64) for e in (0, 1)), negatives, False, limits.cells)
    pairs = [(q, *(None if i == NO_ID else i for i in (int(anchors[0][near[k][0]]), near[k][2])), near[k][3]) for q, k in enumerate(some)]
    pairs = spark.createDataFrame(pairs, "question long, anchor_id long, positive_id long, positive_score long")
    negative = F.when(F.col("id") != NO_ID, F.col("id")).alias("negative_id")
    return search(lists, centers, asked, limits).join(F.broadcast(pairs), "question").select("anchor_id", "positive_id", "rank", negative, "positive_score", F.col("score").alias("negative_score"))


OP13_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS alike, CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(r.v AS DOUBLE[])) AS BIGINT) AS score
  FROM rows AS a JOIN rows AS r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives AS p JOIN scored AS s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""
