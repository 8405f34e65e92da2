"""Documents against the history of the code they describe: governing, drift, coverage, age."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions import text as T


def ref_patterns(docs: DataFrame) -> DataFrame:
    """path, ref, pattern, prefix, depth of each reference of documents that have some."""
    each = docs.where(F.size("refs") > 0).select("path", F.explode("refs").alias("ref"))
    prefix = T.glob_prefix(F.col("ref"))
    return each.select("path", "ref", T.glob_regex(F.col("ref")).alias("pattern"), prefix.alias("prefix"))


def _prefixes(paths: DataFrame, column: str) -> DataFrame:
    """Each path with every directory above it, itself and the empty one, to meet references on."""
    parts = F.split(column, "/")
    heads = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return paths.select("*", F.explode(heads).alias("prefix"))


def matches(patterns: DataFrame, paths: DataFrame, column: str) -> DataFrame:
    """patterns joined with the paths they match: an equi join on the directories before the first wildcard, then the pattern.

    References that begin with a wildcard meet all paths on the empty prefix.
    """
    met = _prefixes(paths, column).join(patterns, "prefix").where(F.rlike(column, "pattern"))
    return met.drop("prefix")


def governing(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, path of the documents with a reference that matches a path of the query (query_id, code_path)."""
    return matches(ref_patterns(docs), asked, "code_path").select("query_id", "path").distinct()


def drift(docs: DataFrame, commits: DataFrame) -> DataFrame:
    """path, commits, last_change, last_path: commits after a document's age that touch what it refers to.

    docs: path, refs, updated_at; commits: hash, when, paths. Documents of unknown age and without such commits are left
    out. last_path: the first matching path of the newest commit; of commits at one time the smallest hash counts.
    """
    touched = commits.select("hash", "when", F.explode("paths").alias("code_path"))
    hit = matches(ref_patterns(docs), touched.select("code_path").distinct(), "code_path").select("path", "code_path").distinct()
    known = docs.where(F.col("updated_at").isNotNull()).select("path", "updated_at")
    each = touched.join(hit, "code_path").join(known, "path").where(F.col("when") > F.col("updated_at"))
    per_commit = each.groupBy("path", "hash", "when").agg(F.min("code_path").alias("code_path"))
    newest = F.min_by("code_path", F.struct((-F.unix_micros(F.col("when").cast("timestamp"))).alias("t"), "hash"))
    return per_commit.groupBy("path").agg(F.count("*").alias("commits"), F.max("when").alias("last_change"), newest.alias("last_path"))


def drift_of_repositories(reports: DataFrame) -> DataFrame:
    """Of reports of several repositories (repo, path, commits, ...) the one with most commits for each path, then the first repo."""
    order = Window.partitionBy("path").orderBy(F.desc("commits"), "repo")
    return reports.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def drift_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """The paths whose commits or last change differ between two reports; none: bundles stay valid."""
    a, b = old.select("path", F.struct("commits", "last_change").alias("a")), new.select("path", F.struct("commits", "last_change").alias("b"))
    return a.join(b, "path", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("path")


def drift_listing(report: DataFrame, limit: int) -> DataFrame:
    """The rows of a drift report with most commits first, then the latest change, then by path."""
    return report.orderBy(F.desc("commits"), F.desc("last_change"), "path").limit(limit)


def directories(paths: DataFrame, depth: int) -> DataFrame:
    """dir: the distinct directories of files, without hidden ones, down to a depth."""
    parts = F.split("code_path", "/")
    dirs = F.transform(F.sequence(F.lit(1), F.lit(depth)), lambda n: F.when(F.size(parts) > n, F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return paths.select(F.explode(F.array_compact(dirs)).alias("dir")).where(~F.col("dir").rlike(r"(^|/)\.")).distinct()


def coverage(dirs: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: covered, total, uncovered (sorted). A directory is covered when a reference matches it or a file in it."""
    tried = dirs.select("dir", F.explode(F.array("dir", F.concat("dir", F.lit("/file")))).alias("code_path"))
    hit = matches(ref_patterns(docs), tried, "code_path").select("dir").distinct().withColumn("hit", F.lit(True))
    each = dirs.join(hit, "dir", "left")
    return each.agg(F.count("hit").alias("covered"), F.count("*").alias("total"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("hit").isNull(), F.col("dir")))), ",").alias("uncovered"))


def stalest(docs: DataFrame, limit: int) -> DataFrame:
    return docs.where(F.col("updated_at").isNotNull()).orderBy("updated_at", "path").limit(limit)


def age_unknown(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("updated_at").isNull()).select("path")


def since(docs: DataFrame) -> DataFrame:
    return docs.agg(F.min("updated_at").alias("since"))


def changes_since(commits: DataFrame, at, most: int) -> DataFrame:
    """The newest commits after a time, at most so many."""
    return commits.where(F.col("when") > F.lit(at)).orderBy(F.desc("when"), "hash").limit(most)


def merge_paths(parents: DataFrame) -> DataFrame:
    """hash, paths of merges (hash, parent, paths): only what differs from all parents."""
    lists = parents.groupBy("hash").agg(F.collect_list("paths").alias("l"))
    return lists.select("hash", F.array_sort(F.aggregate("l", F.get("l", F.lit(0)), lambda a, b: F.array_intersect(a, b))).alias("paths"))
