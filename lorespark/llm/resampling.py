"""Importance resampling towards a target set: hashed word n-grams give gains, Gumbel noise by doc_id gives scores, exact ranks.

Ranks come from a histogram of integer scores: counts summed from the highest score down are rank offsets, and the offsets
show the cutoff score. Only rows at or above it are numbered, by doc_id within each score; a score that many rows share is
numbered over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import materialize, prefix_sums, ranged, session_of, ship_code, text_of, word_blocks

BUCKETS, SCALE, SEED = 10_000, 1000, 42
#: Of documents with at least LEAST_WORDS words, PERCENT in a hundred are drawn.
LEAST_WORDS, PERCENT = 20, 5


def feature_buckets(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the runs of one to three words that end in them) of each block of a text.

    A run's checksum continues that of the run without its last word.
    """
    last: list[bytes] = []
    for words in word_blocks(text):
        n, old, run = len(words), len(last), last + words
        spaced = [b" " + w for w in run]
        one = list(map(crc32, run))
        two = list(map(crc32, spaced[1:], one))
        three = list(map(crc32, spaced[2:], two))
        yield n, np.array(one[old:] + two[max(0, old - 1) :] + three[max(0, old - 2) :], np.int64) % BUCKETS
        last = run[-2:]


def bucket_counts(texts: DataFrame) -> DataFrame:
    """bucket, n: features of all texts in each bucket that has any. A task sends one row for each bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lorespark.llm.common import only
        from lorespark.llm.resampling import BUCKETS, feature_buckets

        only("resampling")
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, at in feature_buckets(text.as_py()):
                    total += np.bincount(at, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return texts.select(text_of().cast("binary").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> DataFrame:
    """bucket, gain for each of the BUCKETS buckets."""
    every = session_of(docs).range(BUCKETS).select(F.col("id").alias("bucket"))
    s, t = (bucket_counts(x).select("bucket", F.col("n").alias(name)) for x, name in ((docs, "s"), (target, "t")))
    both = materialize(every.join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0))
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    one_more = lambda c: (F.col(c) + 1).cast("double")
    ratio = (one_more("t") * F.lit(float(all_s + BUCKETS))) / (one_more("s") * F.lit(float(all_t + BUCKETS)))
    return both.select("bucket", F.floor(SCALE * F.log(ratio)).alias("gain"))


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, pos (a number of the row), n_words, n_features, weight of each row of docs, for the gain of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lorespark.llm.common import only
        from lorespark.llm.resampling import feature_buckets

        only("resampling")
        for batch in batches:
            rows = np.zeros((3, batch.num_rows), np.int64)
            for i, text in enumerate(batch.column(2)):
                for n, at in feature_buckets(text.as_py()):
                    rows[:, i] += n, len(at), gain[at].sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, rows)], ["doc_id", "pos", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("pos"), text_of().cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, pos long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, n_features, weight, score, rank (from 1; null if not drawn), n_words.

    docs: doc_id, text; target: text. Of the rows with at least least_words words, percent in a hundred (rounded down) with
    the highest scores are drawn; ties go to the smaller doc_id, a null one first. Null and empty texts have no words, no
    features and a weight of 0. A null doc_id is hashed as an empty text. Rows that repeat a doc_id each count and are drawn for themselves;
    equal rows take ranks next to each other. Without target texts the gains say only how rare a bucket is. Texts count whole. An
    empty table gives no rows. Other columns are ignored.
    """
    ship_code(session_of(docs))
    # one number for each of the BUCKETS buckets
    gain = np.array([r.gain for r in gains(docs, target).orderBy("bucket").collect()], np.int64)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialize(weigh(docs, gain).withColumn("score", F.col("weight") + noise).withColumn("_down", -F.col("score")))
    able = F.col("n_words") >= least_words

    counts = ranged(scored.where(able).groupBy("_down").agg(F.count("*").alias("n")), [], ["_down"])
    offsets = prefix_sums(counts, [], ["_down"], {"above": F.col("n")})
    surviving = materialize(offsets.withColumn("draw", F.expr(f"above_total * {percent} div 100")).where("above < draw").select("_down", "above", "draw"))
    cutoff = surviving.agg(F.max("_down")).first()[0]
    columns = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    out = scored.withColumn("rank", F.lit(None).cast("long"))
    if cutoff is None:
        return out.select(*columns)
    inside = able & (F.col("_down") <= cutoff)
    placed = ranged(scored.where(inside), ["_down"], ["doc_id", "pos"])
    numbered = prefix_sums(placed, ["_down"], ["doc_id", "pos"], {"before": F.lit(1)}).join(surviving, "_down")
    rank = F.col("above") + F.col("before") + 1
    return out.where(~inside).select(*columns).union(numbered.withColumn("rank", F.when(rank <= F.col("draw"), rank)).select(*columns))


OP11_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i AS i, i AS c, 0 AS k FROM range(256) AS r(i)
  UNION ALL
  SELECT i, CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), texts AS (
  SELECT 0 AS part, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), words AS (
  SELECT part, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), runs AS (
  SELECT part, id, unnest(range(1, len(w) + 1)) AS i, w FROM words
), one AS (
  SELECT part, id, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM runs
), grams AS (
  SELECT part, id, a AS f FROM one
  UNION ALL SELECT part, id, a || ' ' || b FROM one WHERE b IS NOT NULL
  UNION ALL SELECT part, id, a || ' ' || b || ' ' || c FROM one WHERE c IS NOT NULL
), counted AS (
  SELECT part, id, f, count(*) AS n FROM grams GROUP BY ALL
), codes AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)
), hashed AS (
  SELECT f, xor(list_reduce(list_transform(range(1, CAST(len(h) // 2 AS BIGINT) + 1), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT)),
                            lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM codes, crc
), tallied AS (
  SELECT part, id, bucket, n FROM counted JOIN hashed USING (f)
), totals AS (
  SELECT bucket, coalesce(sum(n) FILTER (part = 0), 0) AS s, coalesce(sum(n) FILTER (part = 1), 0) AS t,
         sum(sum(n) FILTER (part = 0)) OVER () AS all_s, sum(sum(n) FILTER (part = 1)) OVER () AS all_t
  FROM tallied GROUP BY bucket
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST(all_s + 10000 AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(all_t + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM totals
), weights AS (
  SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM tallied JOIN gain USING (bucket) WHERE part = 0 GROUP BY id
), scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('42:' || CAST(d.doc_id AS VARCHAR)), 1, 8) AS UBIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score,
         CAST(len(w.w) AS BIGINT) AS n_words
  FROM documents AS d JOIN words AS w ON w.part = 0 AND w.id = d.doc_id LEFT JOIN weights ON weights.id = d.doc_id
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank, n_words FROM placed
"""
