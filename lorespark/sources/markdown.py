"""Reading knowledge: Markdown folders, golden sets, thresholds, BEIR data, commits, issues and pages as JSON."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.operators import ingest


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), scope, content, modified_at, content_hash of .md files in scope folders; hidden ones are skipped.

    Files are listed and read by the executors; the name filter reaches the scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM][dD]").load(root)
    base = re.escape(root.rstrip("/"))
    path = F.regexp_replace("path", rf"^.*?{base}/", "")
    out = files.select(path.alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modified_at"), F.sha2("content", 256).alias("content_hash"))
    return out.withColumn("scope", T.scope_of(F.col("path"))).where(F.col("scope").isNotNull() & ~F.col("path").rlike(r"(^|/)\."))


def documents(files: DataFrame) -> DataFrame:
    """Parsed documents: path, scope, title (of the front matter), tags, refs, front_matter, body, content_hash, modified_at."""
    fm = ingest.front_matter(F.col("content"))
    broken = F.when(fm["broken"], F.raise_error(F.concat(F.lit("front matter is not closed in "), F.col("path"))).cast("string"))
    return files.select("path", "scope", fm["title"].alias("title"), fm["tags"].alias("tags"), fm["refs"].alias("refs"), fm["raw"].alias("front_matter"), F.coalesce(broken, fm["body"]).alias("body"), "content_hash", "modified_at")


def golden(spark: SparkSession, path: str) -> DataFrame:
    """id, type, query, scopes, expected (path, heading) of a golden set in the plain YAML subset of such files.

    Rejects a missing or repeated id, an empty query and a query without expected sections. Small: read on the driver.
    """
    text = "\n".join(r.value for r in spark.read.option("wholetext", "false").text(path).collect())
    rows: list[dict] = []
    for line in text.split("\n"):
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        if m := re.match(r"-\s+id:\s*(.+)", bare):
            rows.append({"id": _plain(m[1]), "type": "keyword", "query": "", "scopes": [], "expected": []})
        elif rows and (m := re.match(r"(type|query):\s*(.*)", bare)):
            rows[-1][m[1]] = _plain(m[2])
        elif rows and (m := re.match(r"scopes:\s*\[(.*)\]", bare)):
            rows[-1]["scopes"] = [_plain(x) for x in m[1].split(",") if x.strip()]
        elif rows and (m := re.match(r"-\s+\{?\s*path:\s*([^,}]+)(?:,\s*heading:\s*([^}]+))?\}?", bare)):
            rows[-1]["expected"].append({"path": _plain(m[1]), "heading": _plain(m[2]) if m[2] else None})
        elif rows and rows[-1]["expected"] and (m := re.match(r"heading:\s*(.+)", bare)):
            rows[-1]["expected"][-1]["heading"] = _plain(m[1])
    seen: set[str] = set()
    for r in rows:
        if not r["id"] or r["id"] in seen or not r["query"].strip() or not r["expected"]:
            raise ValueError(f"golden query {r['id']!r}: id must be given once, with a query and expected sections")
        seen.add(r["id"])
    return spark.createDataFrame(rows, "id string, type string, query string, scopes array<string>, expected array<struct<path:string,heading:string>>")


def _plain(value: str) -> str:
    return value.strip().strip("\"'")


def thresholds(spark: SparkSession, path: str) -> DataFrame:
    """mode, metric, minimum."""
    mode, rows = "", []
    for r in spark.read.text(path).collect():
        if m := re.match(r"^(\w+):\s*$", r.value):
            mode = m[1]
        elif m := re.match(r"^\s+([\w@]+):\s*([0-9.]+)", r.value):
            rows.append((mode, m[1], float(m[2])))
    return spark.createDataFrame(rows, "mode string, metric string, minimum double")


def beir(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus (path, title, body), queries (query_id, query), relevant (query_id, path, score) of a BEIR folder; scores over 0."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl")
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl")
    relevant = spark.read.csv(f"{folder}/qrels/test.tsv", sep="\t", header=True, schema="query_id string, corpus_id string, score int")
    name = lambda c: F.concat(F.lit("domain/"), F.col(c), F.lit(".md"))
    return (
        corpus.select(name("_id").alias("path"), "title", F.col("text").alias("body")), queries.select(F.col("_id").alias("query_id"), F.col("text").alias("query")),
        relevant.where("score > 0").select("query_id", name("corpus_id").alias("path"), "score"),
    )


def commits(spark: SparkSession, path: str) -> DataFrame:
    """hash, when, paths from JSON lines that an external sync writes."""
    return spark.read.schema("hash string, when timestamp, paths array<string>").json(path)


def last_modified(changes: DataFrame) -> DataFrame:
    return changes.select("when", F.explode("paths").alias("path")).groupBy("path").agg(F.max("when").alias("last_modified"))


def write_documents(docs: DataFrame, path: str) -> None:
    """The index's documents, a folder per scope: a scope filter then reads only its folders."""
    docs.write.mode("overwrite").partitionBy("scope").parquet(path)
