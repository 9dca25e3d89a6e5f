"""A training-corpus pipeline of four operators: language ID, line dedup, near-duplicate join, packing.

Every stage reads whole rows of COLUMNS; other columns end with the first stage. Ids may be null or repeat: a row is a
document of its own, but where a stage says otherwise. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marea.llm import jaccard, langid, linededup, packing, words
from marea.llm.shared import bounded_batches, new_dir, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter (null and empty texts too), or too near two codewords to tell, go.

    The margin of the latter is learned such that of rightly told texts about one in a thousand goes.
    """
    bounded_batches(spark)
    model = langid.fit(docs.where(~langid.held_out()))
    told = docs.withColumn("__told", langid.predict(F.col("text"), model))
    return told.where((F.col("__told.lang_pred") != "und") & ~F.col("__told.ambiguous")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line chunks that an earlier one has; those of which no word is left go, and n_chars is counted anew where lines went.

    Rows of one id and one text are one document and all stay here; rows of null id stay whole. Null and empty texts stay.
    """
    bounded_batches(spark)
    cut = linededup.dedup_lines(docs, min_words=linededup.PASSAGE)
    gone = (F.col("lines_removed") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")
    n_chars = F.when(F.col("lines_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.where(~gone).withColumn("n_chars", n_chars).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id (null is largest) of each component of similar rows; rows without words stay.

    Repeated rows are copies of each other, so one stays; rows of one id with texts that aren't similar all stay.
    """
    bounded_batches(spark)
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = jaccard.classes(rows, id_col="__row").select(F.col("doc_id").alias("__row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__row")
    least = rows.select("doc_id", "__row").join(found, "__row").groupBy("component_id").agg(F.min(order).alias("m")).select("m.__row")
    return rows.join(least, "__row", "left_semi").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens at most; null and empty texts are one token, the last."""
    bounded_batches(spark)
    return packing.pack(docs, words.word_tokenizer(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written and read again as the next stage's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
