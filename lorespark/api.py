"""What a user calls: functions over DataFrames, named as the tools of a knowledge-base service. Each returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.operators import evaluation, graph, ingest, logs, retrieval, staleness
from lorespark.operators.bundle import compile_bundle, issue_bundle
from lorespark.operators.retrieval import search_context

__all__ = ["bench", "compile_bundle", "coverage", "evaluate", "gaps", "get_document", "index", "issue_bundle", "link_graph", "list_scopes", "report_usage", "search_context", "stats", "suggest_links"]


def index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks and resolved links of parsed documents (path, title, body)."""
    return ingest.chunk_documents(docs), graph.resolve_links(ingest.extract_links(docs), docs)


def get_document(chunks: DataFrame, path: str) -> DataFrame:
    return ingest.reassemble(chunks.where(F.col("doc_path") == path))


def list_scopes(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    return ingest.scope_stats(chunks, docs).orderBy("scope")


def suggest_links(docs: DataFrame, links: DataFrame, ignored: DataFrame, limit: int = 20) -> DataFrame:
    return graph.suggest_links(docs, links, ignored, limit)


def link_graph(docs: DataFrame, links: DataFrame) -> DataFrame:
    return graph.link_graph(docs, links)


def report_usage(usage: DataFrame, new: DataFrame) -> DataFrame:
    return usage.unionByName(new)


def gaps(log: DataFrame, usage: DataFrame, since, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """Queries without useful sections, and those with the least margins."""
    return logs.gaps_no_useful(log, usage, since, limit), logs.gaps_low_confidence(log, since, limit)


def coverage(paths: DataFrame, docs: DataFrame, depth: int = 2) -> DataFrame:
    return staleness.coverage(staleness.directories(paths, depth), docs)


def stats(requests: DataFrame, tie: str) -> DataFrame:
    """Counters, histogram and percentiles of each series."""
    return logs.series(requests).join(logs.percentiles(requests, tie), ["surface", "name"])


def evaluate(hits: DataFrame, expected: DataFrame, types: DataFrame) -> DataFrame:
    return evaluation.evaluate(evaluation.per_query(evaluation.found(hits, expected)), types)


def bench(sizes: DataFrame) -> DataFrame:
    return evaluation.token_bench(sizes)


def margin(hits: DataFrame) -> DataFrame:
    return retrieval.margin(hits)
