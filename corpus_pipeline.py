"""Documents to packed training sequences, in five stages.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame``; its result is
written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns of documents.

1. quality rules: documents that the rules reject go;
2. line dedup: later repeats of runs of lines, and of passages inside lines, are
   cut, documents left without a word by it go, ``n_chars`` follows the text;
3. n-gram Jaccard join: of documents linked to each other the one with the
   smallest id stays (texts under one id count one by one);
4. mixing sources: documents as taken by the mix, one row for each unbroken
   stretch of a text in one pass over its source;
5. packing: pieces of token ids with their sequence and offset.

No stage reads another's statistics: each works on all that the one before it
kept.  Empty tables pass through; null texts are rejected by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm import bfd_packing, line_dedup, line_quality, source_mix
from estatelens.llm.frames import own_columns
from estatelens.llm.jaccard_join import jaccard_rows
from estatelens.llm.queries import table, tokenizer_path
from estatelens.session import materialize

#: The mix draws at random and packing uses a tokenizer, so there is no SQL for the rows of ``run``.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_quality.keep_good(docs, line_quality.fit(docs, table(spark, sf_dir, "labels")))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_passages(docs)
    touched = F.col("n_lines_removed") + F.col("n_words_cut") > 0
    cut = cut.where(~touched | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(touched, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.select(own_columns(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = jaccard_rows(docs).where("doc_id != component_id").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    return docs.join(gone, same, "left_anti").select(own_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bfd_packing.pack(docs, tokenizer_path())


STAGES = [("quality_rules", quality_rules), ("line_dedup", dedup), ("ngram_jaccard_join", near_copies),
          ("source_mix", mix_sources), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
