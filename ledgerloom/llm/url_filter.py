"""URL filter (operator 1): a sort-merge range join of urls with nested rules.

A rule is (host, path, verdict). It fits a url whose host is the rule's or a subdomain of it
and whose path starts with the rule's. Written with its labels reversed and a dot after each
(`org.example.`), a rule's host is a prefix of the keys it fits, so it is the interval from
that prefix up to the prefix with its last dot raised by one. These intervals nest or are
disjoint: a sweep over sorted keys keeps the open ones on a stack, a level a host. A level holds
its rules' paths by text and their lengths; of a url's path the beginnings of these lengths are looked up,
the longest first, so a level costs a url no more for a hundred thousand paths than for as many lengths.
Of the rules that fit, the longest (host and path together) wins.

Urls and rule starts are dealt to the same key ranges. Range bounds are quantiles of a sample
of the keys. A hot host repeats as a bound; its rows are dealt over all of its equal ranges,
and a rule goes to each range that its interval meets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_and_path(urls: DataFrame, url: str) -> DataFrame:
    """Adds host and path; both empty where the url is null or has no `://`."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    return (urls.withColumn("_rest", rest)
            .withColumn("host", F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), UPPER, LOWER))
            .withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1))
            .drop("_rest"))


def host_key(host) -> F.Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", rows_per_range: int = 200_000, most_ranges: int = 20_000) -> DataFrame:
    """One row per page: id, host, path, rule, verdict. `default` is the verdict where no rule
    fits (rule is null). Rules: columns host, path, verdict; repeated rules count once, and of
    equally long ones the one with the longer host wins, then `block`. Null or odd urls have
    empty host and path and fit no rule. Repeated pages give repeated rows; other columns are
    ignored, whatever their names. Empty tables give empty results (without rules: default)."""
    spark = pages.sparkSession
    urls = with_host_and_path(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")), "url").drop("url").withColumn("key", host_key(F.col("host")))
    bounds = range_bounds(spark, urls, rows_per_range, most_ranges)
    shared = spark.sparkContext.broadcast(bounds)  # at most most_ranges strings

    places = ranges_of(shared, ["key", "key"], ["left", "right"])
    dealt = urls.mapInArrow(places, with_places(urls.schema))
    meets = ranges_of(shared, ["key", "high"], ["left", "left"])
    dealt = dealt.select((F.col("l") + F.pmod(F.xxhash64("id"), F.col("r") - F.col("l") + 1)).cast("int").alias("range"), F.lit(1).alias("kind"), "key", "id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    starts = (rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host is not null").distinct()
              .withColumn("key", host_key(F.col("host"))).withColumn("high", F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/")))
              )
    starts = (starts.mapInArrow(meets, with_places(starts.schema))
              .select(F.explode(F.sequence("l", "r")).alias("range"), F.lit(0).alias("kind"), "key", F.lit(None).cast(urls.schema["id"].dataType).alias("id"), "host", "path", F.concat("host", "path").alias("rule"), "verdict"))
    events = dealt.unionByName(starts).repartition(max(1, len(bounds) + 1), "range").sortWithinPartitions("range", "key", "kind")
    out = pages.select(F.col(id_col)).schema.add("host", "string").add("path", "string").add("rule", "string").add("verdict", "string")
    return events.select("range", "kind", "key", "id", "host", "path", "rule", "verdict").mapInArrow(sweep(default, id_col), out)


def with_places(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("l", IntegerType()), StructField("r", IntegerType())])


def ranges_of(shared, columns: list[str], sides: list[str]):
    """Adds l and r to batches: the numbers of the ranges in which the values of two columns stand, one
    search a batch over its distinct values."""

    def run(batches):
        bounds = np.array(shared.value, dtype=object)
        for b in batches:
            found = []
            for column, side in zip(columns, sides, strict=True):
                coded = b.column(b.schema.get_field_index(column)).dictionary_encode()
                at = np.searchsorted(bounds, np.array(coded.dictionary.to_pylist(), dtype=object), side)
                found.append(pa.array(at[coded.indices.to_numpy(zero_copy_only=False)].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, *found], names=[*b.schema.names, "l", "r"])

    return run


def range_bounds(spark: SparkSession, urls: DataFrame, rows_per_range: int, most: int) -> list[str]:
    """Ascending keys that split the urls into ranges of about rows_per_range rows: quantiles of a
    sample whose size depends on the number of ranges alone. Only the balance hangs on it."""
    n = urls.count()
    ranges = min(most, max(spark.sparkContext.defaultParallelism, n // rows_per_range))
    if n == 0 or ranges < 2:
        return []
    share = min(1.0, 40.0 * ranges / n)
    chosen = urls.where(F.pmod(F.xxhash64("id", "path", F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30))).select("key")
    keys = sorted(r.key for r in chosen.limit(80 * ranges).collect())
    return [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []


class Level:
    """The open rules of one host."""

    def __init__(self, end: str, hosts: int):
        self.end, self.hosts = end, hosts
        self.by_path: dict[str, tuple[str, str]] = {}
        self._lengths: list[int] | None = None

    def add(self, path: str, rule: str, verdict: str) -> None:
        if path not in self.by_path or verdict == "block":
            self.by_path[path] = (rule, verdict)
            self._lengths = None

    def best(self, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest path that the given one starts with."""
        if self._lengths is None:
            self._lengths = sorted({len(p) for p in self.by_path}, reverse=True)
        return next((hit for n in self._lengths if n <= len(path) and (hit := self.by_path.get(path[:n]))), None)


def sweep(default: str, id_col: str):
    def run(batches):
        stack, at = [], None  # levels of open rules, the widest host first
        for batch in batches:
            d = batch.to_pydict()
            rows = [[] for _ in range(5)]
            for range_, kind, key, id_, host, path, rule, verdict in zip(*(d[c] for c in ("range", "kind", "key", "id", "host", "path", "rule", "verdict")), strict=True):
                if range_ != at:
                    stack, at = [], range_
                while stack and key >= stack[-1].end:
                    stack.pop()
                if kind == 0:
                    end = key[:-1] + "/"
                    if not stack or stack[-1].end != end:
                        stack.append(Level(end, len(host)))
                    stack[-1].add(path, rule, verdict)
                    continue
                fits = [(len(hit[0]), level.hosts, hit[1] == "block", hit) for level in stack if (hit := level.best(path))]
                best = max(fits)[-1] if fits else (None, default)
                for column, value in zip(rows, (id_, host, path, *best), strict=True):
                    column.append(value)
            kinds = [batch.schema.field("id").type, pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=[id_col, "host", "path", "rule", "verdict"])

    return run
