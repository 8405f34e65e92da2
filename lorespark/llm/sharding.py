"""Contiguous shards of near-equal size, cut from global prefix sums of byte sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import prefix_sums, ranged, text_of

N_SHARDS = 40
#: Bytes that each row costs besides its text.
ROW_BYTES = 16


def sized(docs: DataFrame) -> DataFrame:
    text = text_of()
    return docs.select(
        "doc_id", (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )


def shard(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard (0 to n_shards - 1), slot (from 0, gapless in a shard).

    Rows stand in the order of doc_id (null first), then text checksum and size. A row belongs to the shard in which the
    middle of its bytes falls when all bytes are cut at n_shards equal targets, so shards are contiguous and differ by
    about one row's size. Texts count whole, however long. A null text has no bytes and counts with the row's own bytes, as an empty one does. Repeated
    rows each get a slot. A row larger than a target can leave a shard empty. An empty table gives no rows. Other columns
    are ignored.
    """
    order = ["doc_id", "text_crc32", "size"]
    placed = ranged(sized(docs), [], order)
    summed = prefix_sums(placed, [], order, {"_start": F.col("size"), "_index": F.lit(1)})
    middle = F.expr(f"((2 * _start + size) * {n_shards}) div (2 * _start_total)")
    cut = summed.withColumn("shard", F.least(middle, F.lit(n_shards - 1)).cast("int"))
    # at most n_shards rows
    firsts = cut.groupBy("shard").agg(F.min("_index").alias("_first"))
    return cut.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_index") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


OP9_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i AS i, i AS c, 0 AS k FROM range(256) AS r(i)
  UNION ALL
  SELECT i, CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), codes AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), sized AS (
  SELECT doc_id, size, xor(coalesce(list_reduce(list_transform(range(1, CAST(len(h) // 2 AS BIGINT) + 1), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT)),
                                                lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1]), 4294967295), 4294967295), 4294967295) AS text_crc32
  FROM codes, crc
), placed AS (
  SELECT *, CAST(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS before, CAST(sum(size) OVER () AS BIGINT) AS total FROM sized
  WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size)
), cut AS (
  SELECT *, CAST(least((2 * before + size) * 40 // (2 * total), 39) AS INTEGER) AS shard FROM placed
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut
"""
