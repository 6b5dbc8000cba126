"""A corpus pipeline: quality, toxicity, exact dedup, near dedup, packing. Each stage reads the rows
that the stage before has written and, but for the last, returns the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.exact_dedup import exact_dedup
from ledgerloom.llm.ngram_join import ngram_join
from ledgerloom.llm.packing import pack
from ledgerloom.llm.quality_mil import keep_good
from ledgerloom.llm.queries import GOOD, TOXIC, quality_model, tokenizer_path, toxicity_model
from ledgerloom.llm.runtime import Scratch, table
from ledgerloom.llm.toxicity import keep_civil


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold stay. Null and empty texts are scored alike,
    repeated rows stay or go together, an empty table stays empty."""
    return keep_good(docs, quality_model(spark, sf_dir), GOOD)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go. Null and empty texts are scored alike,
    repeated rows stay or go together, an empty table stays empty."""
    return keep_civil(docs, toxicity_model(spark, sf_dir), TOXIC)


def held(docs: DataFrame) -> DataFrame:
    """(row, id, sha) of documents: whole rows in one column, so that no column of theirs, whatever its
    name, meets one that a stage makes."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(F.struct(*columns).alias("row"), F.col("doc_id").alias("id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, that of the largest doc_id; a null doc_id is the smallest. Of rows that
    repeat id and text one stays. Null and empty texts are one text; an empty table stays empty."""
    kept = exact_dedup(docs.select("doc_id", "text")).where("kept").select(F.col("doc_id").alias("kept_id"), F.unhex("text_sha256").alias("kept_sha"))
    own = held(docs)
    found = own.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha")), "left_semi")
    place = F.row_number().over(Window.partitionBy("id", "sha").orderBy(F.lit(0)))
    return found.withColumn("place", place).where("place = 1").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near copies one row stays: that of the smallest doc_id (a null one comes
    last), of equal ids that of the smallest SHA-256. Rows without words link with nothing and stay."""
    own = held(docs).withColumn("key", F.struct(F.col("id").isNull().alias("none"), "id", "sha"))
    found = ngram_join(own.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text"))).where("doc_id = component_id")
    kept = found.groupBy(F.col("doc_id").alias("kept")).agg(F.max("n_shingles").alias("n"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0)))
    return own.join(kept, F.col("key") == F.col("kept")).withColumn("place", place).where("place = 1 or n = 0").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences. A null or empty text is its end id alone; rows that repeat an
    id are documents of their own; an empty table gives no piece."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), 1)


STAGES = [("quality", quality), ("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            scratch.drop(f"stage-{i - 1}")
    return docs
