"""From raw documents to token ids: five stages, each written and read again.

Every stage works on all that the one before it kept, and all but the last
return the columns of ``documents``. Mixing repeats documents; the others keep
or change each row.

Null and empty texts pass as empty ones where the classifier keeps them: they have
no shingles, no personal data, no words and no tokens. Rows are told apart by all
their values, so that repeated rows and repeated or null doc_ids are judged row by row;
of equally near copies the one of the least doc_id stays. Columns beside those of
``documents`` are carried along, whatever their names; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewlens.llm.bpe import build_lexicon, encode
from crewlens.llm.mixing import mixed_documents
from crewlens.llm.neardup import keep_one_similar
from crewlens.llm.pii import redact
from crewlens.llm.quality import good_documents
from crewlens.llm.queries import tokenizer_path
from crewlens.llm.shared import stored


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group whose five-word shingles have a similarity of 0.8 or more."""
    return keep_one_similar(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars counts the new text."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each row."""
    path = tokenizer_path()
    return encode(docs, path, build_lexicon(docs, path)).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality classifier", good), ("SimHash near-dedup", distinct), ("PII", private), ("mixing sources", mixed), ("BPE encoding", encoded)]

#: The stages fit a model and hash shingles; SQL doesn't express them. tests/llm hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn, on all that the one before it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
