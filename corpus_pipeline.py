"""A corpus pipeline: from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's docs. All but
the last return the columns of documents.

- quality: texts whose perplexity lies outside the band of trusted texts of their language and length go.
- lines: later runs of repeated lines with 50 words or more are deleted; documents of which nothing is left go.
- near_duplicates: of each class of texts with a shingle similarity of 0.8 or more, one document stays.
- mix: documents are taken as often as the sources' targets ask for, rounded to whole documents.
- pack: documents, cut into pieces, with the sequence and offset of each.

Null and empty texts go in the first stage; texts of any length are read whole by every stage. Rows equal in id and text are rows of their own
until near_duplicates, which keeps one. Null ids, languages and sources are values like others. Columns other than doc_id, text, lang, source and
n_chars are carried along, whatever their names. Empty tables give an empty result, and without labels the first stage keeps every text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import op02_chosen_path_join, op03_winnow_lines, op06_kneser_ney_quality, op09_low_discrepancy_mix, op10_nnls_packing
from quarry.llm.common import gone_at_end, shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op06_kneser_ney_quality.kept(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = op03_winnow_lines.dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op02_chosen_path_join.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op09_low_discrepancy_mix.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_nnls_packing.pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]

#: Perplexities, string hashes of permutations and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep. Stages in between are written in the shared folder, and deleted when the driver ends."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    gone_at_end(spark, folder)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
