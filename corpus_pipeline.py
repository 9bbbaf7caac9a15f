"""Corpus pipeline: documents -> quality filter -> language filter -> near-copies out -> packed sequences."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragweave.llm import langid, packing, quality, simhash
from fragweave.session import shared_folder, table

#: A document stays if its score is at least this.
MIN_QUALITY = 0.5
#: A document stays if its best language is at least as likely as all others together.
MIN_LANGUAGE = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from the labelled ones outside the held-out third, accepts.

    Null and empty texts have the prior alone; null and repeated ids count row by row; without labels the prior
    decides. An empty table gives an empty one. All columns stay.
    """
    score = quality.scorer(quality.fit(docs, table(spark, sf_dir, "labels")))
    return docs.where(score("text") >= MIN_QUALITY)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus has; those without a letter or without a clear language go.

    Null texts go. Null and repeated ids count row by row. An empty table gives an empty one. All columns stay.
    """
    found = langid.predictor(spark, langid.fit(docs))("text")
    return docs.where((found["lang"] != langid.UNKNOWN) & (found["score"] >= MIN_LANGUAGE))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each group of near copies: that of the smallest id, null ids last.

    Rows are told apart by id and text, not by id alone: rows with a null id group like any other,
    and rows that share an id but no text stay if no other row stands for their group. Rows alike in
    both are one. Null texts are empty ones. An empty table gives an empty one. All columns stay,
    whatever their names.
    """
    marked = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-"))
    row = F.md5(F.concat(marked("doc_id"), F.lit("\n"), marked("text")))
    keyed = docs.select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row.alias("row")).alias("key"), "text")
    keep = simhash.near_groups(keyed, id_col="key").select(F.col("component_id.row").alias("row_key")).distinct()
    own = "row_key"
    while own in docs.columns:
        own += "_"
    kept = docs.withColumn(own, row).join(keep.withColumnRenamed("row_key", own), own, "left_semi")
    # what shares id and text is one document
    return kept.dropDuplicates([own]).drop(own)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences, a row per piece. Null texts are empty; an empty table gives an empty one."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", keep_quality), ("language", keep_language), ("near_copies", drop_near_copies), ("packing", pack_tokens)]

#: Learnt models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again.

    A stage's table is deleted once the next one is written; the last stays, since the result reads it.
    """
    docs = table(spark, sf_dir, "documents")
    home = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
        if last:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{home}/{last}")
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
