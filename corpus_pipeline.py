"""From raw documents to packed training sequences; every stage works on all rows that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsense.llm import minhash, mixing, packing, quality, secrets
from gridsense.llm.base import packed, settle, table, unpacked
from gridsense.llm.queries import MIXTURE, MIXTURE_KEPT, WORD_VOCABULARY


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the rules or the trees reject go."""
    return quality.passing(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each group of near-duplicates stays, that with the smallest doc_id.

    Documents count as near-duplicates from 0.8 on over shingles of five words.
    """
    return minhash.one_of_each(docs, width=5, percent=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: every secret found is replaced in its text, and n_chars follows; documents all stay."""
    found = secrets.without_secrets(docs)
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents are drawn by the probabilities fitted to the target shares."""
    own = packed(docs, doc_id="doc_id", source="source", lang="lang", text="text")
    return unpacked(mixing.mixed(mixing.with_topic(own), MIXTURE, MIXTURE_KEPT).where("kept"), docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: pieces with their sequence and place."""
    return packing.pack(docs, WORD_VOCABULARY).withColumnRenamed("key", "doc_id")


STAGES = [
    ("quality_rules", good),
    ("minhash_near_dedup", distinct),
    ("secret_scans", without_secrets),
    ("mixing", mixed),
    ("best_fit_packing", packed_sequences),
]

#: The fitted trees, the candidates of MinHash and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
