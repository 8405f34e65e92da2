"""Mixing sources to target weights: random order in each source, distributed prefix sums of words, cuts at exact budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm.common import WORD, prefix_sums, ranged, text_of, word_count

WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its words.
MAX_EPOCHS = 3
SEED = "mix-1"


def sized(docs: DataFrame, seed: str) -> DataFrame:
    """doc_id, size and the order key of each row; a null source is a source of its own."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.select(
        "doc_id", word_count(text_of()).alias("size"), F.col("source").isNull().cast("int").alias("_none"), F.coalesce("source", F.lit("")).alias("_source"), key.alias("_key")
    )


def targets(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Adds weight and target to one row per source (_none, _source, source_size).

    With a_i = max_epochs * size / weight ascending, the sources before the first k with
    level_k = (all words - caps before k) / (weights from k on) <= a_k get their cap; the others get level_k * weight.
    This is where resharing the excess by weight ends. The table has one row per source; its windows run in one task.
    """
    ordered = Window.orderBy("_none", "_source")
    place = F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1))
    ratio = (F.col("source_size") * max_epochs) / F.col("weight")
    filled = weighed.withColumn("_ratio", ratio)
    by_ratio = Window.orderBy("_ratio", "_none", "_source")
    before = F.coalesce(F.sum(F.col("source_size") * max_epochs).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = filled.withColumn("_level", (F.sum("source_size").over(every) - before) / after).withColumn("_k", F.row_number().over(by_ratio))
    found = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_k", "_level"))).over(every)
    filled = filled.withColumn("_found", found)
    target = F.when(F.col("_k") < F.col("_found._k"), (F.col("source_size") * max_epochs).cast("double"))
    target = target.otherwise(F.col("_found._level") * F.col("weight"))
    return filled.select("_none", "_source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, source.

    size counts words between ASCII white space; a null or empty text has none and gives none. Sources in code-point
    order, a null one last, take the weights in turn; together they get as many words as all texts have. A source's
    documents stand in the order of a hash of doc_id (then doc_id and size); the mix takes whole rounds of the source and
    then documents up to the exact budget, the last one in part. Rows that repeat a doc_id stand next to each other.
    Sources without words get a target of 0. An empty table gives no rows. Other columns are ignored.
    """
    keys, order = ["_none", "_source"], ["_key", "doc_id", "size"]
    placed = ranged(sized(docs, seed), keys, order)
    per_source = targets(placed.groupBy(*keys).agg(F.sum("size").alias("source_size")), weights, max_epochs)
    summed = prefix_sums(placed, keys, order, {"_before": F.col("size")}).drop("_before_total")
    return summed.join(per_source, keys).select(
        "doc_id", "size", "source_size", "target", taken("target").alias("taken"), F.when(F.col("_none") == 0, F.col("_source")).alias("source")
    )


def taken(target: str) -> Column:
    budget = f"cast(floor({target} + 0.5) as bigint)"
    part = f"least(size, greatest(cast(0 as bigint), {budget} % source_size - _before))"
    return F.expr(f"case when source_size = 0 then cast(0 as bigint) else ({budget} div source_size) * size + {part} end")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """docs' rows as often as the mix takes them, with docs' own columns, whatever their names.

    A source gives exactly its budget of words: where a document is taken in part, its last copy has its first words only,
    with one space between them. Documents without words (null and empty texts too) and those beyond the budget go. Rows that
    share a doc_id, source and size share their words evenly; what is left over of fewer words than such rows goes. An empty
    table gives no rows.
    """
    counts = mix(docs, **options).groupBy(F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"), F.col("size").alias("mix_size"))
    counts = counts.agg(F.expr("sum(taken) div count(*)").alias("taken")).where("taken > 0")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("of"), word_count(text_of()).alias("size"))
    same = F.col("id").eqNullSafe(F.col("mix_id")) & F.col("of").eqNullSafe(F.col("mix_source")) & (F.col("size") == F.col("mix_size"))
    each = rows.join(counts, same).select("row", "size", "taken", F.explode(F.expr("sequence(1, cast(ceil(taken / size) as int))")).alias("copy"))
    part = (F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int")
    # at most one document of each source
    text = F.when(part < F.col("size"), F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), F.lit(1), part), " ")).otherwise(F.col("row.text"))
    return each.select(*(text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, 3 * source_size / weight AS ratio FROM s
), l AS (
  SELECT *, row_number() OVER w AS k,
         CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
           / CAST(sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM r WINDOW w AS (ORDER BY ratio, source NULLS LAST)
), f AS (
  SELECT min(k) AS k FROM l WHERE level <= ratio
), t AS (
  SELECT l.source, source_size,
         CASE WHEN l.k < f.k THEN CAST(3 * source_size AS DOUBLE)
              ELSE (SELECT level FROM l AS x WHERE x.k = f.k) * weight END AS target
  FROM l, f
), o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget, d.source,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE budget // source_size * size + least(size, greatest(0, budget % source_size - before)) END AS taken, source
FROM o
"""
