"""The driver's tables in the roles of a knowledge base, as DataFrames and as the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import text as T

NOW = "2024-01-31 00:00:00"
#: More than the lines that one document can have.
LINES = 1 << 31


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents: chunk_id, doc_id, scope, position, content, tokens."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("scope"), F.posexplode(F.split("text", "\n")).alias("position", "content"))
    lines = lines.where(F.trim("content") != "")
    return lines.select((F.col("doc_id") * LINES + F.col("position")).alias("chunk_id"), "doc_id", "scope", "position", "content", T.token_count(F.col("content")).alias("tokens"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the benchmark table as queries, each over two scopes."""
    scopes = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("en"), F.lit("fr"))).otherwise(F.array(F.lit("de"), F.lit("en")))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), scopes.alias("scopes"))


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of their own: chunk_id, doc_id, scope, position, content, tokens."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("lang").alias("scope"), F.lit(0).alias("position"), F.col("text").alias("content"), T.token_count(F.col("text")).alias("tokens"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").alias("scope"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50."""
    v = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 50 == 0)
    return v.select((F.col("vec_id") / 50).cast("long").alias("query_id"), F.col("embedding").alias("qe"), F.array("label", F.col("label") + 1).alias("scopes"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a query log."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("ts").alias("at"), F.col("event_type").alias("name"), F.concat(F.lit("question "), F.col("user_id").cast("string")).alias("query"),
        F.when(F.col("event_id") % 2 == 0, "conventions,domain").otherwise("domain").alias("scopes"), (F.col("event_id") % 4).cast("int").alias("results"),
        F.round("value", 3).alias("top_score"), F.round(F.col("value") / 7, 3).alias("margin"), F.col("event_id").alias("bundle_id"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_id") % 3 == 0)
    return e.select(F.col("event_id").alias("bundle_id"), (F.col("user_id") % 2 == 0).alias("useful"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("ts").alias("at"), F.when(F.col("user_id") % 3 == 0, "mcp").otherwise("http").alias("surface"), F.col("event_type").alias("name"), (F.abs("value") / 40).alias("seconds"),
        (F.col("event_id") % 900).alias("tokens"), (F.col("event_id") % 7).alias("chunks"), (F.col("event_id") % 3).alias("omitted"), (F.col("event_id") % 50 == 0).alias("error"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per source with references into the code: path, refs, updated_at."""
    names = table(spark, sf_dir, "documents").select("source").distinct()
    n = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    refs = F.when(n % 4 == 0, F.array(F.concat(F.lit("svc"), n.cast("string"), F.lit("/**")))).when(n % 4 == 1, F.array(F.concat(F.lit("./svc"), n.cast("string"), F.lit("/*/main.go")), F.lit("**/3-MEDIUM/*")))
    refs = refs.when(n % 4 == 2, F.array(F.concat(F.lit("svc"), n.cast("string"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    at = F.when(n % 5 != 0, F.expr(f"timestamp_ntz'1995-01-01 00:00:00' + make_interval(0, 0, 0, {60} * cast(regexp_extract(source, '([0-9]+)', 1) as int))"))
    return names.select(F.concat(F.lit("domain/"), F.col("source"), F.lit(".md")).alias("path"), refs.alias("refs"), at.alias("updated_at"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits that touch two files each."""
    o = table(spark, sf_dir, "orders")
    svc = F.concat(F.lit("svc"), (F.col("o_custkey") % 25).cast("string"), F.lit("/"), F.replace("o_orderpriority", F.lit(" "), F.lit("-")), F.lit("/main.go"))
    return o.select(F.col("o_orderkey").alias("hash"), F.col("o_orderdate").alias("when"), F.array(svc, F.concat(F.lit("doc/"), F.col("o_orderstatus"), F.lit(".txt"))).alias("paths"))


def part_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("projects/p"), (F.col("p_partkey") % 7).cast("string"), F.lit("/part-"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"))


def part_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as links between parts: wiki links by name and by path, Markdown links; some lead nowhere."""
    i = table(spark, sf_dir, "lineitem")
    to = F.col("l_suppkey") * 23 + F.col("l_linenumber")
    kind = F.when(F.col("l_linenumber") % 3 == 0, "markdown").otherwise("wikilink")
    target = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("../p"), (to % 7).cast("string"), F.lit("/part-"), to.cast("string"), F.lit(".md")))
    target = target.when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("Part-"), to.cast("string"))).otherwise(F.concat(F.lit("projects/p"), (to % 7).cast("string"), F.lit("/part-"), to.cast("string")))
    frm = F.concat(F.lit("projects/p"), (F.col("l_partkey") % 7).cast("string"), F.lit("/part-"), F.col("l_partkey").cast("string"), F.lit(".md"))
    return i.select(frm.alias("from_path"), target.alias("target"), kind.alias("kind")).distinct()


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as knowledge documents: path, title (null: from the text), body."""
    from lorespark.sources.markup import html_to_markdown

    md = html_to_markdown(table(spark, sf_dir, "pages"))
    return md.select(F.concat(F.lit("projects/web/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"), F.lit(None).cast("string").alias("title"), F.col("markdown").alias("body"))


def linked_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    more = F.concat(F.lit("See [["), F.col("source"), F.lit("|the source]] and [x](../"), F.col("lang"), F.lit("/a.md#top), ![no](b.md) `[[code]]` [y](https://z/c.md) [[ "), F.col("source"), F.lit(" ]]\n"))
    return d.select(F.concat(F.lit("domain/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.concat(more, F.col("text")).alias("body"))


# The same in SQL.

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def sql_words(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{Nd}}]+')"


def sql_terms(text: str) -> str:
    w = sql_words(text)
    kept = f"list_filter({w}, lambda x: x NOT IN ({_STOP}))"
    return f"(CASE WHEN len({kept}) = 0 THEN {w} ELSE {kept} END)"


def sql_tokens(text: str) -> str:
    runs = r"(\n[\n\r]*|\p{L}[\p{L}\x27]*|\p{Nd}+|[^\p{L}\p{Nd}\s\x{85}\p{Z}]+)"
    one = (
        r"CASE WHEN ascii(m) = 10 THEN 1 WHEN regexp_matches(m, '^\p{L}') AND regexp_matches(m, '^[\x00-\x7F]+$') "
        "THEN (CASE WHEN length(m) <= 8 THEN 1 ELSE CAST(ceil(length(m) / 7.0) AS BIGINT) END) ELSE CAST(ceil(length(m) / 3.0) AS BIGINT) END"
    )
    return f"CAST(coalesce(list_sum(list_transform(regexp_extract_all({text}, '{runs}', 1), lambda m: {one})), 0) AS BIGINT)"


CHUNKS = f"""lines AS (
  SELECT doc_id, lang, unnest(str_split(text, chr(10))) AS content, unnest(range(len(str_split(text, chr(10))))) AS position FROM documents
), chunks AS (
  SELECT doc_id * {LINES} + position AS chunk_id, doc_id, lang AS scope, position, content, {sql_tokens("content")} AS tokens FROM lines WHERE trim(content, ' ') <> ''
)"""
QUERIES = "queries AS (SELECT item_id AS query_id, text AS query, CASE WHEN item_id % 2 = 0 THEN ['en', 'fr'] ELSE ['de', 'en'] END AS scopes FROM benchmark)"
QUERY_VECTORS = "qv AS (SELECT vec_id // 50 AS query_id, embedding AS qe, label FROM embeddings WHERE vec_id % 50 = 0)"
LOG = """log AS (
  SELECT ts, event_type AS name, 'question ' || user_id AS query, CASE WHEN event_id % 2 = 0 THEN 'conventions,domain' ELSE 'domain' END AS scopes,
         CAST(event_id % 4 AS INT) AS results, round(value, 3) AS top_score, round(value / 7, 3) AS margin, event_id AS bundle_id FROM events
), usage AS (SELECT event_id AS bundle_id, user_id % 2 = 0 AS useful FROM events WHERE event_id % 3 = 0)"""
REQUESTS = """requests AS (
  SELECT event_id, ts, CASE WHEN user_id % 3 = 0 THEN 'mcp' ELSE 'http' END AS surface, event_type AS name, abs(value) / 40 AS seconds,
         event_id % 900 AS tokens, event_id % 7 AS chunks, event_id % 3 AS omitted, event_id % 50 = 0 AS error FROM events
)"""
SOURCES = r"""sources AS (
  SELECT 'domain/' || source || '.md' AS path, n,
         CASE n % 4 WHEN 0 THEN ['^svc' || n || '/.*$'] WHEN 1 THEN ['^svc' || n || '/[^/]*/main\.go$', '^(.*/)?3-MEDIUM/[^/]*$'] WHEN 2 THEN ['^svc' || n || '(/.*)?$'] ELSE CAST([] AS VARCHAR[]) END AS patterns,
         CASE WHEN n % 5 <> 0 THEN TIMESTAMP '1995-01-01 00:00:00' + to_days(60 * n) END AS updated_at
  FROM (SELECT DISTINCT source, CAST(regexp_extract(source, '(\d+)', 1) AS INT) AS n FROM documents)
), commits AS (
  SELECT o_orderkey AS hash, o_orderdate AS ts, unnest(['svc' || o_custkey % 25 || '/' || replace(o_orderpriority, ' ', '-') || '/main.go', 'doc/' || o_orderstatus || '.txt']) AS code_path FROM orders
)"""
LINKS = """paths AS (
  SELECT 'projects/p' || p_partkey % 7 || '/part-' || p_partkey || '.md' AS path FROM part
), raw AS (
  SELECT DISTINCT 'projects/p' || l_partkey % 7 || '/part-' || l_partkey || '.md' AS from_path,
         CASE l_linenumber % 3 WHEN 0 THEN '../p' || t % 7 || '/part-' || t || '.md' WHEN 1 THEN 'Part-' || t ELSE 'projects/p' || t % 7 || '/part-' || t END AS target,
         CASE WHEN l_linenumber % 3 = 0 THEN 'markdown' ELSE 'wikilink' END AS kind, CASE WHEN l_linenumber % 3 = 0 THEN 'projects/p' || t % 7 || '/part-' || t || '.md' END AS exact, 'part-' || t AS base
  FROM (SELECT *, l_suppkey * 23 + l_linenumber AS t FROM lineitem)
), named AS (
  SELECT lower(regexp_extract(path, 'part-[0-9]+')) AS base, min(path) AS path FROM paths GROUP BY 1
), links AS (
  SELECT from_path, target, kind, coalesce(CASE WHEN kind = 'markdown' THEN e.path ELSE n.path END, '') AS to_path
  FROM raw LEFT JOIN paths e ON e.path = raw.exact LEFT JOIN named n ON n.base = raw.base
), edges AS (SELECT DISTINCT from_path, to_path FROM links WHERE to_path <> '' AND from_path <> to_path)"""
