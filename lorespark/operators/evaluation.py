"""Retrieval evaluation and the token benchmark."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEPTH = 10


def found(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id, expected_id, rank of the first hit that has the expected path and a heading ending in the expected one (null: none).

    hits: query_id, rank, path, heading; expected: query_id, expected_id, path, heading (null: any).
    """
    met = expected.select("query_id", "expected_id", "path", F.col("heading").alias("wanted")).join(hits.select("query_id", "rank", "path", "heading"), ["query_id", "path"])
    met = met.where(F.col("wanted").isNull() | F.col("heading").endswith(F.col("wanted")))
    first = met.groupBy("query_id", "expected_id").agg(F.min("rank").alias("rank"))
    return expected.select("query_id", "expected_id").join(first, ["query_id", "expected_id"], "left")


def per_query(ranks: DataFrame, depth: int = DEPTH) -> DataFrame:
    """query_id: r5, r10, mrr, ndcg10 from the first ranks of its expected sections."""
    gain = F.when(F.col("rank") <= depth, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    each = ranks.groupBy("query_id").agg(
        F.avg((F.coalesce("rank", F.lit(1 << 30)) <= 5).cast("double")).alias("r5"), F.avg((F.coalesce("rank", F.lit(1 << 30)) <= 10).cast("double")).alias("r10"),
        F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("mrr"), F.sum(gain).alias("dcg"), F.count("*").alias("n"),
    )
    best = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(depth)).cast("int")), F.lit(0.0), lambda t, i: t + 1 / F.log2(i + 1))
    return each.select("query_id", "r5", "r10", "mrr", (F.col("dcg") / best).alias("ndcg10"))


def evaluate(metrics: DataFrame, types: DataFrame) -> DataFrame:
    """type, queries, r5, r10, mrr, ndcg10: means of each type, and of all under the type 'all'. One pass over grouping sets."""
    joined = metrics.join(types, "query_id")
    means = [F.round(F.avg(c), 6).alias(c) for c in ("r5", "r10", "mrr", "ndcg10")]
    out = joined.rollup("type").agg(F.count("*").alias("queries"), F.grouping("type").alias("g"), *means)
    return out.withColumn("type", F.when(F.col("g") == 1, "all").otherwise(F.col("type"))).drop("g")


def failing(report: DataFrame, thresholds: DataFrame) -> DataFrame:
    """metric, value, minimum of the overall figures below their thresholds (metric, minimum)."""
    long = report.where("type = 'all'").select(F.explode(F.create_map(*[x for c in ("r5", "r10", "mrr", "ndcg10") for x in (F.lit(c), F.col(c))])).alias("metric", "value"))
    return long.join(thresholds, "metric").where("value < minimum")


def token_bench(sizes: DataFrame) -> DataFrame:
    """mode: mean, median (element n div 2), max tokens and coverage of bundles (mode, tokens, covered).

    Equal sizes are counted before they move, so a mode holds one row for each distinct size; the median is read off the running count.
    """
    each = sizes.groupBy("mode", "tokens").agg(F.count("*").alias("n"), F.sum(F.col("covered").cast("long")).alias("c"))
    inside = Window.partitionBy("mode")
    each = each.withColumn("upto", F.sum("n").over(inside.orderBy("tokens"))).withColumn("all", F.sum("n").over(inside))
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("tokens")))
    return each.groupBy("mode").agg(
        F.round(F.sum(F.col("tokens") * F.col("n")) / F.sum("n"), 6).alias("mean"), middle.alias("median"), F.max("tokens").alias("max"), F.round(F.sum("c") / F.sum("n"), 6).alias("coverage")
    )


def in_baseline(path: Column, entries: list[str]) -> Column:
    """Whether a path is one of the entries or lies below one; blank entries count for nothing."""
    named = [e.strip() for e in entries if e.strip()]
    hits = [(path == e) | path.startswith(e.removesuffix("/") + "/") for e in named]
    return reduce(or_, hits, F.lit(False))


def static_baselines(chunks: DataFrame, entries: list[str]) -> DataFrame:
    """scenario (all; curated: the paths of the entries): documents, sections and tokens that a fixed context would hold. chunks: doc_path, tokens."""
    each = chunks.select("doc_path", "tokens", F.explode(F.array_compact(F.array(F.lit("all"), F.when(in_baseline(F.col("doc_path"), entries), "curated")))).alias("scenario"))
    per = each.groupBy("scenario", "doc_path").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    return per.groupBy("scenario").agg(F.count("*").alias("documents"), F.sum("n").alias("sections"), F.sum("t").alias("tokens"))
