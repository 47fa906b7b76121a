"""Corpus pipeline: quality rules, line deduplication, near-duplicates, secrets, packing.

Each stage gets the documents that its predecessor kept (as Parquet, reread) and all but the last return the columns of
``documents``. Extra columns travel along. Null texts count as empty, an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import discard, scratch
from plumbline.llm.line_dedup import line_dedup
from plumbline.llm.packing import pack
from plumbline.llm.quality_rules import quality_rules
from plumbline.llm.queries import tokenizer_path
from plumbline.llm.secrets import secret_scan
from plumbline.llm.similar import similar_components
from plumbline.llm.simhash import one_of_each

#: Near-duplicates take shingles of this many words.
SHINGLE = 5
#: Texts are near-duplicates from this similarity of shingle sets on.
SIMILARITY = 0.8
#: SimHash tiles join texts whose fingerprints differ in so many of 64 bits, as op7 does; what is similar beyond that is searched after them.
RADIUS = 3


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns``, with n_chars (where there is one) as of the changed text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long"))
    return docs.select(*columns)


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    return quality_rules(docs, trusted).filter("kept").select(*docs.columns)


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(line_dedup(docs), docs.columns)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, find=lambda rows, key: similar_components(rows, key, width=SHINGLE, similarity=SIMILARITY, radius=RADIUS))


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(secret_scan(docs, redact=True), docs.columns)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", stage_quality),
    ("line_dedup", stage_lines),
    ("simhash_near_dedup", stage_near_duplicates),
    ("secret_scan", stage_secrets),
    ("best_fit_packing", stage_packing),
]

#: The verdicts of stages 1 and 3, and the token ids, can't be stated in SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage gives. Each stage's result is written; what it took to get there, its input included, is deleted then."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return docs
