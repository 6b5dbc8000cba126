"""The bounded sample of labelled rows that a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, text, part) of at most `most` labelled documents, those with the smallest hash of
    the id; an id labelled twice counts once, with its larger label. `part` is 0 to 3 by hash.
    The chosen labels are `most` narrow rows at most and are broadcast, so no text is shuffled."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("label")).where("id is not null and label is not null")
    own = own.groupBy("id").agg(F.max("label").alias("label"))
    chosen = own.orderBy(F.xxhash64("id"), "id").limit(most).withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)).cast("int"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "id").select("id", "label", "part", "text")
