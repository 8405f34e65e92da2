"""What knowledge costs in tokens: everything, a curated part, or a bundle for each task at several budgets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.operators import evaluation
from lorespark.operators.compile import compile_tasks
from lorespark.sources.snapshots import Snapshots


def bench(
    store: Snapshots, chunks: DataFrame, golden: DataFrame, find: Callable[[DataFrame], DataFrame], fingerprint: str, budgets: tuple[int, ...] = (2000, 1000), baseline: list[str] | None = None, model: str = "",
) -> DataFrame:
    """scenario, mean, median, max (tokens for a task), coverage (share of tasks with an expected section), documents (null for bundles).

    golden: query_id, query, expected (path, heading); chunks: doc_path, heading, scope, tokens; find: see compile_tasks(). Scenarios: all,
    curated (documents that baseline names, if it does), and bundle-N for each budget N, over all scopes. Bundles come from one call,
    so those that the store has are not compiled again.
    """
    every = golden.agg(F.count("*")).first()[0]
    expected = golden.select("query_id", F.posexplode("expected").alias("expected_id", "e")).select("query_id", "expected_id", "e.path", "e.heading")
    wanted = expected.select("query_id", F.lit(1).alias("rank"), "path", "heading")
    named = ["all", *(["curated"] if baseline else [])]
    static = evaluation.static_baselines(chunks, baseline or []).where(F.col("scenario").isin(named))
    inside = chunks.where(evaluation.in_baseline(F.col("doc_path"), baseline or [])).select(F.col("doc_path").alias("path"), F.col("heading").alias("have"))
    met = wanted.join(inside, "path").where(F.col("heading").isNull() | F.col("have").endswith(F.col("heading"))).agg(F.countDistinct("query_id")).first()[0]
    share = F.when(F.col("scenario") == "all", 1.0).otherwise(met / max(every, 1))
    fixed = static.select("scenario", F.col("tokens").cast("double").alias("mean"), F.col("tokens").alias("median"), F.col("tokens").alias("max"), F.round(share, 6).alias("coverage"), "documents")

    scopes = sorted(r.scope for r in chunks.select("scope").distinct().collect() if r.scope)
    tasks = golden.select("query_id", F.col("query").alias("task"), F.explode(F.array(*map(F.lit, budgets))).alias("max_tokens"))
    tasks = tasks.select(F.struct("max_tokens", "query_id").alias("task_id"), "task", F.col("max_tokens").cast("long").alias("max_tokens"))
    made = compile_tasks(store, tasks, find, fingerprint, model, scopes=tuple(scopes))
    name = F.concat(F.lit("bundle-"), F.col("task_id.max_tokens").cast("string"))
    hits = made.select(F.col("task_id").alias("query_id"), F.posexplode("sections").alias("rank", "s")).select("query_id", "rank", F.col("s.doc_path").alias("path"), "s.heading")
    asked = tasks.select("task_id", F.col("task_id.query_id").alias("query_id")).join(expected, "query_id").select(F.col("task_id").alias("query_id"), "expected_id", "path", "heading")
    covered = evaluation.found(hits, asked).groupBy("query_id").agg(F.max(F.col("rank").isNotNull()).alias("covered"))
    sizes = made.join(covered, made["task_id"] == covered["query_id"], "left").select(name.alias("mode"), "tokens", F.coalesce("covered", F.lit(False)).alias("covered"))
    bundles = evaluation.token_bench(sizes).select(F.col("mode").alias("scenario"), "mean", "median", "max", "coverage", F.lit(None).cast("long").alias("documents"))
    return fixed.unionByName(bundles)
