"""Registered queries of this folder's operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.llm import bm25_search, bpe, decontamination, exact_dedup, hard_negatives, licenses, mixing, ngram_join, repeats, resampling, sharding, toxicity, url_filter
from lorespark.llm.common import read


#: Vocabulary file of the encoding query.
TOKENIZER = "word_bpe_49k.json"


def op1_url_filter(spark, sf_dir):
    return url_filter.filter_urls(read(spark, sf_dir, "pages"))


def op2_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_mix_sources(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents"))


def op4_bm25_topk(spark, sf_dir):
    """Queries: every document whose id is divisible by 50, whole, against all documents."""
    docs = read(spark, sf_dir, "documents")
    return bm25_search.search(docs, docs.where("doc_id % 50 = 0").select(docs["doc_id"].alias("query_id"), "text"))


def op5_license_scan(spark, sf_dir):
    """The spans of the notices found stand in a JSON column."""
    return licenses.scan_licenses(read(spark, sf_dir, "documents")).withColumn("spans", F.to_json("spans"))


def op6_ngram_join(spark, sf_dir):
    return ngram_join.ngram_join(read(spark, sf_dir, "documents"))


def op7_repeats(spark, sf_dir):
    return repeats.digests(repeats.dedup_repeats(read(spark, sf_dir, "documents")))


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op9_sharding(spark, sf_dir):
    return sharding.shard(read(spark, sf_dir, "documents"))


def op10_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.digests(bpe.bpe(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)))


def op11_importance_resampling(spark, sf_dir):
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_decontamination(spark, sf_dir):
    return decontamination.digests(decontamination.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op13_hard_negatives(spark, sf_dir):
    """Rows whose vec_id is divisible by 7 get the label after their own; anchors are those whose vec_id is divisible by 100."""
    vectors = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.select("vec_id", label.alias("label"), F.col("embedding").alias("vector")), F.col("vec_id") % 100 == 0)


def queries():
    every = (
        op1_url_filter, op2_toxicity, op3_mix_sources, op4_bm25_topk, op5_license_scan, op6_ngram_join, op7_repeats, op8_exact_dedup, op9_sharding, op10_bpe,
        op11_importance_resampling, op12_decontamination, op13_hard_negatives,
    )
    return {f.__name__: f for f in every}


def oracle_sql():
    return {
        "op3_mix_sources": mixing.OP3_SQL, "op4_bm25_topk": bm25_search.OP4_SQL, "op6_ngram_join": ngram_join.OP6_SQL, "op7_repeats": repeats.OP7_SQL,
        "op9_sharding": sharding.OP9_SQL, "op8_exact_dedup": exact_dedup.OP8_SQL, "op11_importance_resampling": resampling.OP11_SQL,
        "op12_decontamination": decontamination.OP12_SQL, "op13_hard_negatives": hard_negatives.OP13_SQL,
    }
