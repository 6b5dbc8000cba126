"""Exact dedup (operator 5) by composable polynomial fingerprints.

The fingerprint of bytes b is the sum of (b[i] + 1) * r^i modulo two primes, with the length.
That of `a + b` is that of a plus r^len(a) times that of b, so a text is hashed in chunks of
64 KiB, 32 at once, and the chunk hashes are combined by their shifts. Texts whose fingerprints
are equal are then compared chunk by chunk: within a group, the smallest and the largest content
of each chunk must be equal. Both are pre-aggregated before the shuffle, so a group of a third
of all rows sends one chunk of each number from every task. If a group fails, its texts differ
(a collision) and are told apart by their SHA-256."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, slices, text_buffer

CHUNK, CHUNKS_AT_ONCE = 1 << 16, 32
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1566083941)


def powers(base: int, prime: int, count: int) -> np.ndarray:
    out = np.ones(count, np.uint64)
    have = 1
    while have < count:  # r^0..r^(n-1) times r^n
        more = min(have, count - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, prime)) % np.uint64(prime)
        have += more
    return out


POWERS = [powers(b, p, CHUNK) for b, p in zip(BASES, PRIMES, strict=True)]


def chunk_hashes(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: int) -> np.ndarray:
    """Fingerprints modulo one prime of the chunks raw[start:start+size], size 1 to CHUNK, end to end."""
    at = np.arange(len(raw)) - np.repeat(starts, sizes)
    return np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * POWERS[which][at], starts) % np.uint64(PRIMES[which])


def combine(left: int, left_size: int, right: int, which: int) -> int:
    """Fingerprint of two parts end to end."""
    return (left + pow(BASES[which], left_size, PRIMES[which]) * right) % PRIMES[which]


def fingerprints(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each prime, the fingerprints of the texts between offsets; 0 for empty ones."""
    sizes = np.diff(offsets)
    counts = -(-sizes // CHUNK)
    owner = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[owner] + number * CHUNK
    chunk_sizes = np.minimum(CHUNK, offsets[owner + 1] - starts)
    out = []
    for which, (base, prime) in enumerate(zip(BASES, PRIMES, strict=True)):
        total = np.zeros(len(sizes), np.uint64)
        if len(owner):
            shift = powers(pow(base, CHUNK, prime), prime, int(number.max()) + 1)
            for i in range(0, len(owner), CHUNKS_AT_ONCE):
                own = slice(i, i + CHUNKS_AT_ONCE)
                first, last = starts[i], starts[own][-1] + chunk_sizes[own][-1]
                hashes = chunk_hashes(raw[first:last], starts[own] - first, chunk_sizes[own], which)
                np.add.at(total, owner[own], hashes * shift[number[own]] % np.uint64(prime))
        out.append((total % np.uint64(prime)).astype(np.int64))
    return out


def mark(batches):
    """(id, sha, row, text) to (id, sha, row, h1, h2, size)."""
    for b in slices(batches, 3):
        raw, offsets = text_buffer(b.column(3))
        h1, h2 = fingerprints(raw, offsets)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(h1), pa.array(h2), pa.array(np.diff(offsets))], names=["id", "sha", "row", "h1", "h2", "size"])


def chunked(batches):
    """(h1, h2, size, text) to (h1, h2, size, number, chunk)."""
    names = ["h1", "h2", "size", "number", "chunk"]
    for b in slices(batches, 3):
        raw, offsets = text_buffer(b.column(3))
        counts = -(-np.diff(offsets) // CHUNK)
        owner = np.repeat(np.arange(b.num_rows), counts)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = offsets[owner] + number * CHUNK
        ends = np.minimum(starts + CHUNK, offsets[owner + 1])
        take = pa.array(owner)
        chunks = pa.array([raw[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(3)), pa.array(number.astype(np.int64)), chunks], names=names)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256. Of equal texts the largest
    id stays. A null text is an empty text; all empty texts are one group. Rows that repeat both id
    and text are copies like any other: exactly one row of the group is kept. A null id is smaller
    than any other. Other columns are ignored, whatever their names; an empty table gives none."""
    scratch = Scratch(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("id", F.sha2("text", 256).alias("sha"), "text")
    # Rows are numbered once, in the written table; of rows alike in all else, the first number stays.
    marks = scratch.write(texts.select("id", "sha", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(mark, f"id {id_type}, sha string, row long, h1 long, h2 long, size long"), "marks")
    key = ["h1", "h2", "size"]
    several = marks.groupBy(*key).count().where("count > 1").drop("count")
    again = marks.join(several.where("size > 0"), key).select(F.col("id").alias("_id"), F.col("sha").alias("_sha"), *key).distinct()
    copies = texts.join(again, F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")))
    chunks = copies.select(*key, "text").mapInArrow(chunked, "h1 long, h2 long, size long, number long, chunk binary")
    same = chunks.groupBy(*key, "number").agg((F.min("chunk") == F.max("chunk")).alias("same"))
    groups = scratch.write(several.join(same.groupBy(*key).agg(F.bool_and("same").alias("same")), key, "left").select(*key, F.coalesce("same", F.lit(True)).alias("same")), "groups")
    # A collision's texts are told apart by their digests; all others by the group alone.
    member = marks.join(groups, key, "left").withColumn("tie", F.when(F.col("same"), F.lit("")).otherwise(F.col("sha")))
    size = member.where("same is not null").groupBy(*key, "tie").agg(F.max(F.struct("id", (-F.col("row")).alias("row"))).alias("keep"), F.count("*").alias("group_size"))
    out = member.join(size, [*key, "tie"], "left")
    alone = F.col("group_size").isNull()
    return out.select(F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                      (alone | (F.col("row") == -F.col("keep.row"))).alias("kept"), F.col("sha").alias("text_sha256"))
