"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, BPE round trip.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.llm import bpe_tables, decontaminate, lines, minhash, quality
from spoorline.llm._scratch import Scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.5) go.

    Null and empty texts have no features and share one score, so all stay or all go; repeated rows go together.
    Without labels every document stays. Further columns of ``docs`` stay; an empty table stays empty.
    """
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines and widespread passages go, all but their first place; n_chars, if any, follows the text.

    Documents stay, with an empty text where all lines went; null texts stay null; repeated rows are cleaned alike.
    Further columns stay; an empty table stays empty.
    """
    out = lines.remove_boilerplate(docs, long_limits=lines.LONG_LIMITS)
    if "n_chars" not in docs.columns:
        return out.select(docs.columns)
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest doc_id.

    Null and wordless texts and rows without an id stay; repeated rows of a kept document stay. Further columns stay;
    an empty table stays empty.
    """
    return minhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go: those with a twentieth of their words or more in windows of 13.

    Null and empty texts stay; repeated rows go together. Further columns stay; an empty table stays empty.
    """
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the text they decode to, as digests: one row per document, without its other columns.

    Null encodes as empty; repeated rows give repeated results; an empty table gives an empty result.
    """
    return bpe_tables.encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), digest=True)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: SQL cannot express the classifier, the signatures or the tokenizer; tests/llm/test_pipeline.py holds run() and each stage
#: against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again; a written table goes once the next stands."""
    docs, scratch, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark), None
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
