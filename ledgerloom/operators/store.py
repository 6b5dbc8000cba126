"""The store of learned layouts as a table in buckets of keys: a batch of changes reads and rewrites the buckets
of its keys only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Stages

FIELDS = "key string, bank string, formats array<string>, style string, columns map<string,string>, learned_at timestamp, times_used long"
LAYOUT = ("bank", "formats", "style", "columns", "learned_at")


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class LayoutStore:
    """get, list, put, delete and use of layouts (FIELDS) under `path`. Rows of deleted keys stay as marks
    where a bucket would otherwise be empty, as an overwrite leaves alone what it has no rows for.
    One writer at a time: two batches that rewrite one bucket at once could lose a change."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _held(self) -> DataFrame:
        schema = f"{FIELDS}, gone boolean, bucket int"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def rows(self) -> DataFrame:
        return self._held().where("not gone").drop("gone", "bucket")

    def get(self, keys: DataFrame) -> DataFrame:
        """The layouts of keys (key): of those in the store, one row each."""
        wanted = keys.select("key").distinct().withColumn("bucket", bucket_of(F.col("key"), self.buckets))
        return self._held().where("not gone").join(wanted, ["bucket", "key"], "left_semi").drop("gone", "bucket")

    def list(self, most: int = 100) -> DataFrame:
        """The newest layouts, the smaller key of equals first."""
        return self.rows().orderBy(F.desc("learned_at"), "key").limit(most)

    def apply(self, changes: DataFrame) -> None:
        """Changes: op (put, delete or use), key, uses, at (the order of changes of a key, distinct) and, for a put, LAYOUT. Of a
        key's puts and deletes the last counts, and of its uses those after it; a use of an absent
        key does nothing. An empty batch changes nothing; a batch that is given again replaces puts by
        themselves, but counts its uses again."""
        stages = Stages(self.spark)
        own = stages.write(changes.select("op", "key", F.coalesce("uses", F.lit(1)).cast("long").alias("uses"), "at", *LAYOUT).where("key is not null"), "changes")
        ends = own.where("op in ('put', 'delete')").groupBy("key").agg(F.max("at").alias("since"), F.max_by("op", "at").alias("last"), *(F.max_by(c, "at").alias(f"new_{c}") for c in LAYOUT), F.max_by("uses", "at").alias("first_uses"))
        uses = own.where("op = 'use'").join(ends.select("key", "since"), "key", "left").where("since is null or at > since").groupBy("key").agg(F.sum("uses").alias("more"))
        folded = ends.join(uses, "key", "full").withColumn("bucket", bucket_of(F.col("key"), self.buckets))
        folded = stages.write(folded, "folded")
        touched = folded.select("bucket").distinct()
        before = self._held().join(F.broadcast(touched), "bucket")  # as many rows as there are buckets, at most
        j = before.join(folded, ["bucket", "key"], "full")
        put, deleted = F.coalesce(F.col("last") == "put", F.lit(False)), F.coalesce(F.col("last") == "delete", F.lit(False))
        there = F.coalesce(~F.col("gone"), F.lit(False))
        after = j.select("bucket", "key", *(F.when(put, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in LAYOUT),
                         (F.when(put, F.col("first_uses")).otherwise(F.coalesce("times_used", F.lit(0))) + F.coalesce("more", F.lit(0))).cast("long").alias("times_used"), (~(put | (there & ~deleted))).alias("gone"))
        after = stages.write(after, "after")
        mark = after.groupBy("bucket").agg(F.min(F.struct("gone", "key")).alias("_m"))
        kept = after.join(F.broadcast(mark), "bucket").where("not gone or (_m.gone and key = _m.key)")
        kept = kept.select(*[f.split()[0] for f in FIELDS.split(", ")], "gone", "bucket")
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        stages.drop()
