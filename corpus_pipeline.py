"""From raw documents to encoded training data: one function per stage, each over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorespark.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from lorespark.llm.catalog import TOKENIZER
from lorespark.llm.common import materialize, read


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic for their language go; the others stay as they are, repeated rows too.

    A null or empty text has the score of padding, a null language the shared threshold, a score at the threshold goes. Labels of rows that the
    input lacks are of no use; without labels nothing is calibrated. No documents give no documents.
    """
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without ASCII white space the one with the most code points stays, then the smallest doc_id, a null one first.

    Null counts as empty, so of null, empty and blank texts one stays. Of rows equal in all that, one stays. No documents give none.
    """
    return exact_dedup.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a shingle similarity of 0.75 or more, over others too, the smallest doc_id stays.

    Null, empty and blank texts have no shingles, are linked with nothing, and stay. Texts are compared whole. No documents give none.
    """
    return ngram_join.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; of a source's last document perhaps its first words only.

    Documents without words go, and those beyond their source's budget. A null source is one of its own, the last. No documents give none.
    """
    return mixing.apply_mix(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of the mix, repeats too. A null text is an empty one; texts are encoded whole."""
    import public_tokenizers

    return bpe.digests(bpe.bpe(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [("toxicity", toxic_stage), ("exact dedup", copies_stage), ("n-gram Jaccard join", near_stage), ("mixing", mix_stage), ("BPE", encode_stage)]

#: The toxicity, similarity and encoding stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each over all that the one before kept; what stands between them is written to the shared folder.

    Nulls, ties, repeated rows, empty tables and columns of other names fare as each stage says.
    """
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
