"""Exact deduplication: group by a 128-bit content hash, compare bytes inside the groups, keep one row of each class."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import ASCII_SPACE, materialize, split_by_keys, text_of


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _normalised(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.regexp_replace(text_of(), ASCII_SPACE, "").alias("norm"), F.char_length(text_of()).cast("long").alias("n_cp"))


def classed(docs: DataFrame, digest: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per row of docs: doc_id, n_cp, sha, class_key (equal for equal texts only).

    Rows are grouped by the digest. Where a group has several rows, their bytes are compared: the least and the greatest text of
    the group, found with map-side aggregation, are the same where all are. The digest of such a group is its class. The rows of
    a group in which bytes differ, a collision, get the whole text as part of their class.
    """
    norm = _normalised(docs)
    rows = materialize(norm.select("doc_id", "n_cp", F.unhex(F.sha2("norm", 256)).alias("sha"), digest(F.col("norm")).alias("digest")))
    several = rows.groupBy("digest").agg(F.count("*").alias("c")).where("c > 1").select("digest")
    asked = materialize(rows.join(several, "digest", "left_semi").select("doc_id").distinct())
    # only texts of such groups are looked at; most others are told by their id
    keyed = lambda ids: _normalised(split_by_keys(docs.select("doc_id", "text"), "doc_id", ids, "doc_id")[0]).withColumn("digest", digest(F.col("norm")))
    differ = keyed(asked).groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
    differ = materialize(differ.where("least <> most").select("digest"))
    if differ.isEmpty():
        return rows.select("doc_id", "n_cp", "sha", F.col("digest").alias("class_key"))
    collided = rows.join(differ, "digest", "left_semi").select("doc_id").distinct()
    apart = keyed(collided).join(differ, "digest", "left_semi")
    apart = apart.select("doc_id", "n_cp", F.unhex(F.sha2("norm", 256)).alias("sha"), F.concat("digest", F.encode("norm", "UTF-8")).alias("class_key"))
    return rows.join(differ, "digest", "left_anti").select("doc_id", "n_cp", "sha", F.col("digest").alias("class_key")).union(apart)


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; a null text counts as empty, and empty or white texts form
    one class. The row with the most code points stays, then the smallest doc_id (a null id is the smallest). Rows that
    repeat a doc_id with an equal text count one by one, and one of them is kept. Texts are read whole. An empty table gives
    no rows. Other columns are ignored, whatever their names.
    """
    rows = classed(docs, digest)
    best = rows.groupBy("class_key").agg(F.min(F.struct((-F.col("n_cp")).alias("n"), F.col("doc_id").alias("id"))).alias("best"), F.count("*").alias("group_size"))
    best = best.select("class_key", F.col("best.id").alias("keep_id"), "group_size")
    once = rows.groupBy("doc_id", "class_key").agg(F.count("*").alias("copies"), F.first("sha").alias("sha"))
    joined = once.join(best, "class_key")
    each = joined.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return each.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with docs' own columns, whatever their names; nulls, ties, repeated rows and empty tables as there.

    Only rows whose doc_id another row repeats, or that go, are shuffled.
    """
    found = materialize(exact_dedup(docs).select(F.col("doc_id").alias("id"), "kept", F.col("text_sha256").alias("sha")))
    unsure = found.groupBy("id").agg(F.count("*").alias("rows"), F.min("kept").alias("all")).where("rows > 1 or not all").select("id")
    perhaps, sure = split_by_keys(docs, "doc_id", materialize(unsure), "id")
    rows = perhaps.select(F.struct("*").alias("row"), F.col("doc_id").alias("of"), F.sha2(F.regexp_replace(text_of(), ASCII_SPACE, ""), 256).alias("same"))
    kept = found.where("kept").select("id", "sha")
    rows = rows.join(kept, F.col("of").eqNullSafe(F.col("id")) & (F.col("same") == F.col("sha")), "left_semi").dropDuplicates(["of", "same"])
    return sure.unionByName(rows.select("row.*"))


OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), ranked AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM ranked
"""
