"""A corpus pipeline over ``documents``: quality rules, near duplicates, repeated passages, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the
next one's ``docs``. All but the last keep the columns of ``documents``. Rows that repeat a doc_id, and rows
without one, are judged each by itself: of equal rows one passes the near duplicates, and a cut text goes to its
own row only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solidframe.llm.decontamination import decontaminate
from solidframe.llm.mixing import mix_sources
from solidframe.llm.near_dedup import near_duplicates
from solidframe.llm.quality_rules import quality_rules
from solidframe.llm.shared import materialize, remove, scratch, shared_dir
from solidframe.llm.substring_dedup import substring_dedup

#: Words of a passage that counts as repeated across documents; shorter ones are common phrases.
PASSAGE_WORDS = 50


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, a number of its own for each row, in the order of doc_id: the doc_id where all differ. Where some
    repeat or are null, rows are sorted by id and text and numbered in that order."""
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL")
    if repeated.isEmpty():
        return docs.withColumn("_row", F.col("doc_id").cast("long"))
    return materialize(docs.orderBy("doc_id", "text").withColumn("_row", F.monotonically_increasing_id()))


def _judged(rows: DataFrame) -> DataFrame:
    """What an operator reads of keyed rows: their numbers stand for the ids, so it judges each row by itself."""
    return rows.select(F.col("_row").alias("doc_id"), "text", "lang", "source")


def _keep(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Keyed rows whose number stands in ``verdicts``, with the columns of ``documents``."""
    return rows.join(verdicts.select(F.col("doc_id").alias("_row")), "_row", "left_semi").drop("_row")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed limits or the outlier test reject go."""
    rows = _keyed(docs)
    return _keep(rows, quality_rules(_judged(rows)).filter("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share four fifths of their runs of five words, the first by id stays."""
    rows = _keyed(docs)
    return _keep(rows, near_duplicates(_judged(rows), shingle=5, percent=80).filter("kept"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that stand earlier are cut out; what has no words left goes."""
    rows = _keyed(docs)
    cut = substring_dedup(_judged(rows), min_words=PASSAGE_WORDS, layout="lines").filter("n_removed > 0")
    cut = cut.select(F.col("doc_id").alias("_row"), F.col("kept_text").alias("_text"), (F.col("n_removed") == F.col("n_words")).alias("_empty"))
    out = rows.join(cut, "_row", "left").filter("_empty IS NULL OR NOT _empty")
    text = F.coalesce("_text", "text")
    return out.withColumns({"n_chars": F.when(F.col("_text").isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long")), "text": text}).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _keyed(docs)
    return _keep(rows, decontaminate(_judged(rows), items, window=10).filter(F.size("spans") == 0))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document that is left is taken, for sources weighted 3, 1, 2 and at most two epochs."""
    return mix_sources(docs, weights=(3, 1, 2), total=1.5, max_epochs=2.0)


STAGES = [("quality rules", quality), ("near duplicates", near_dedup), ("repeated passages", passages), ("benchmark decontamination", decontamination), ("mixing", mixing)]

#: SQL has no robust scatter estimate; the stages are tested against brute-force versions of their operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again; tables and results that
    nothing reads any more are deleted."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
