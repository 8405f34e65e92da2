"""Query log, feedback, request metrics, proposals, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Histogram bounds in seconds; samples per series; recent requests; served documents and hours they count.
BOUNDS = (0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
SAMPLES, RECENT, SERVED, SERVED_HOURS = 512, 100, 2000, 24


def gaps_no_useful(log: DataFrame, usage: DataFrame, since: Column, limit: int) -> DataFrame:
    """Queries since a time without results, or whose bundle has feedback but none useful, most frequent first.

    log: at, name, query, scopes, results, top_score, margin, bundle_id; usage: bundle_id, useful. Rows are filtered first;
    the reason is no_results if none of those rows had results.
    """
    rated = usage.groupBy("bundle_id").agg(F.max(F.col("useful").cast("int")).alias("useful"))
    rows = log.where(F.col("at") >= since).join(rated, "bundle_id", "left").where((F.col("results") == 0) | (F.col("useful") == 0))
    out = rows.groupBy("query", "scopes").agg(F.count("*").alias("times"), F.max("at").alias("last_at"), F.max("name").alias("name"), F.max("results").alias("results"), F.max("top_score").alias("top_score"), F.max("margin").alias("margin"))
    reason = F.when(F.col("results") == 0, "no_results").otherwise("not_useful")
    return out.withColumn("reason", reason).orderBy(F.desc("times"), F.desc("last_at"), "query", "scopes").limit(limit)


def gaps_low_confidence(log: DataFrame, since: Column, limit: int) -> DataFrame:
    """Queries since a time with results whose best margin is smallest."""
    rows = log.where((F.col("at") >= since) & (F.col("results") > 0) & (F.col("top_score") > 0))
    out = rows.groupBy("query", "scopes").agg(F.count("*").alias("times"), F.max("at").alias("last_at"), F.max("name").alias("name"), F.max("results").alias("results"), F.max("top_score").alias("top_score"), F.max("margin").alias("margin"))
    return out.orderBy("margin", F.desc("last_at"), "query", "scopes").limit(limit)


def log_stats(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("entries"), F.min("at").alias("oldest"))


def prune_log(log: DataFrame, cutoff: Column) -> DataFrame:
    return log.where(F.col("at") >= cutoff)


def append_log(log: DataFrame, new: DataFrame) -> DataFrame:
    """Appends rows with their scopes sorted."""
    return log.unionByName(new.withColumn("scopes", F.array_join(F.array_sort(F.split("scopes", ",")), ",")))


def series(requests: DataFrame) -> DataFrame:
    """surface, name: requests, errors, tokens, chunks, omitted, seconds, and the cumulative histogram le_0 .. le_12 (the last: all)."""
    counts = [F.count_if(F.col("seconds") <= b).alias(f"le_{i}") for i, b in enumerate(BOUNDS)]
    return requests.groupBy("surface", "name").agg(
        F.count("*").alias("requests"), F.count_if("error").alias("errors"), F.sum("tokens").alias("tokens"), F.sum("chunks").alias("chunks"), F.sum("omitted").alias("omitted"),
        F.round(F.sum("seconds"), 6).alias("seconds"), *counts, F.count("*").alias(f"le_{len(BOUNDS)}"),
    )


def last_n(rows: DataFrame, keys: list[str], at: str, n: int, tie: str) -> DataFrame:
    """The newest n rows of each key; the plan's group limit keeps n rows of a key per task before anything moves."""
    order = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def percentiles(requests: DataFrame, tie: str, samples: int = SAMPLES) -> DataFrame:
    """p50 and p95 in ms of each series' last samples, by nearest rank: element int(q (n - 1) + 0.5). Exact."""
    kept = last_n(requests, ["surface", "name"], "at", samples, tie)
    lists = kept.groupBy("surface", "name").agg(F.array_sort(F.collect_list("seconds")).alias("l"))
    at = lambda q: F.round(F.get("l", F.floor(F.lit(q) * (F.size("l") - 1) + 0.5).cast("int")) * 1000, 6)
    return lists.select("surface", "name", at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"))


def served(calls: DataFrame, now: Column, hours: int = SERVED_HOURS, most: int = SERVED) -> DataFrame:
    """path, times, last_at, via: documents served in the last hours, once per call, newest first.

    calls: call_id, at, name, path. via is the name of the last call, of several at one time the largest.
    """
    recent = calls.where(F.col("at") >= now - F.expr(f"interval {hours} hours")).select("call_id", "at", "name", "path").distinct()
    out = recent.groupBy("path").agg(F.count("*").alias("times"), F.max("at").alias("last_at"), F.max(F.struct("at", "name")).alias("v"))
    return out.select("path", "times", "last_at", F.col("v.name").alias("via")).orderBy(F.desc("last_at"), "path").limit(most)


def prometheus(stats: DataFrame) -> DataFrame:
    """line: the text exposition of series(): requests by status, tokens, chunks, omitted, then the histogram with its sum and count."""
    label = F.concat(F.lit('{surface="'), F.col("surface"), F.lit('",name="'), F.col("name"), F.lit('"'))

    def one(metric: str, value: Column, more: str = "") -> Column:
        return F.concat(F.lit(f"lorespark_{metric}"), label, F.lit(f"{more}}} "), value.cast("string"))

    lines = [one("requests_total", F.col("requests") - F.col("errors"), ',status="ok"'), one("requests_total", F.col("errors"), ',status="error"')]
    lines += [one(f"{c}_total", F.col(c)) for c in ("tokens", "chunks", "omitted")]
    lines += [one("seconds_bucket", F.col(f"le_{i}"), f',le="{b}"') for i, b in enumerate([*map(str, BOUNDS), "+Inf"])]
    lines += [one("seconds_sum", F.col("seconds").cast("decimal(18,3)")), one("seconds_count", F.col("requests"))]
    return stats.select("surface", "name", F.posexplode(F.array(*lines)).alias("n", "line")).orderBy("surface", "name", "n").select("line")


def snapshot(stats: DataFrame) -> DataFrame:
    return stats.select(F.to_json(F.struct(*sorted(stats.columns))).alias("json"))


def proposal_counts(proposals: DataFrame) -> DataFrame:
    """One row: open, merged, closed; a status that is none of these is an error."""
    known = F.col("status").isin("open", "merged", "closed")
    checked = proposals.withColumn("status", F.when(known, F.col("status")).otherwise(F.raise_error(F.concat(F.lit("unknown status "), F.col("status"))).cast("string")))
    return checked.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("open", "merged", "closed")])


def put_proposals(proposals: DataFrame, new: DataFrame) -> DataFrame:
    """The proposals with new ones; a new one without a status is open. An id that is there already, or comes twice, is an error."""
    filled = new.withColumn("status", F.coalesce(F.nullif("status", F.lit("")), F.lit("open"))).select(proposals.columns)
    both = proposals.withColumn("_new", F.lit(0)).unionByName(filled.withColumn("_new", F.lit(1)))
    twice = F.count("*").over(Window.partitionBy("id")) > 1
    wrong = F.raise_error(F.concat(F.lit("proposal exists: "), F.col("id").cast("string"))).cast("string")
    return both.withColumn("status", F.when(twice & (F.max("_new").over(Window.partitionBy("id")) == 1), wrong).otherwise(F.col("status"))).drop("_new")


def list_proposals(proposals: DataFrame, limit: int) -> DataFrame:
    return proposals.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def open_proposals(proposals: DataFrame) -> DataFrame:
    return proposals.where("status = 'open'").orderBy("created_at", "id")


def next_status(status: Column, pr_state: Column, lookup: Column, landed: Column, has_commit: Column, branch_exists: Column) -> Column:
    """Where an open proposal stands; others stay. The pull request decides if there is one; else landed, else a branch that is gone."""
    by_pr = F.when(lookup, pr_state).otherwise("open")
    alone = F.when(landed, "merged").when(~lookup | ~has_commit | branch_exists, "open").otherwise("closed")
    return F.when(status != "open", status).when(pr_state.isNotNull(), by_pr).otherwise(alone)


def base_problem(base: Column, current: Column, new: Column) -> Column:
    """Why a change may not be applied, null if it may. base: null not checked, empty: must be new, else the file's SHA-256."""
    from lorespark.operators.ingest import has_front_matter

    return (
        F.when((base == "") & current.isNotNull(), "exists").when((base != "") & current.isNull(), "missing").when((base != "") & (F.sha2(current, 256) != base), "changed")
        .when(F.coalesce(has_front_matter(current), F.lit(False)) & ~has_front_matter(new), "front matter dropped")
    )


def health(calls: DataFrame) -> DataFrame:
    """client: requests, failures, last_ok, last_error, status. calls: client, at, code (null: cancelled, ignored), reachable.

    404 is a success. down if not reachable, degraded if the last error is newer than the last success, idle without requests.
    """
    good = F.col("code").between(200, 299) | (F.col("code") == 404)
    out = calls.groupBy("client").agg(F.count("code").alias("requests"), F.count_if(~good).alias("failures"), F.max(F.when(good, F.col("at"))).alias("last_ok"), F.max(F.when(~good, F.col("at"))).alias("last_error"), F.bool_and("reachable").alias("reachable"))
    late = F.coalesce(F.col("last_error") > F.col("last_ok"), F.col("last_error").isNotNull())
    status = F.when(~F.col("reachable"), "down").when(late, "degraded").when(F.col("requests") == 0, "idle").otherwise("ok")
    return out.withColumn("status", status).drop("reachable")


def usage_count(usage: DataFrame) -> DataFrame:
    return usage.agg(F.count("*").alias("events"))


def bundle_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("bundles"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
