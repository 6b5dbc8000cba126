"""Token-id output (operator 7): raw id payloads with a minimal perfect hash index in each shard.

Documents are dealt to ranges of ascending id; each task writes shards one after the other into
one file by Spark's own writer (so a lost task leaves nothing behind and is written anew). A
shard holds, little-endian: a header; the hash's displacements; for each slot the key's 32-bit
fingerprint, offset and document; the document ids and numbers of ids in order; the raw ids. A small
index table beside the files tells where each shard begins and which ids it holds.

The hash puts keys into buckets of four on average. Buckets of two or more, largest first, look
for a displacement under which all their keys fall on free slots; a bucket of one takes a free
slot directly. Lookup: two hashes, one slot, one comparison of fingerprints, then of the key itself."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import ragged, slices
from .word_bpe import SLICE, broadcast_definition, tokenizer_of

MAGIC, HEADER = b"LLTOKEN1", struct.Struct("<8sIIQQQQ")  # magic, bytes an id, unused, documents, keys, buckets, ids
DIRECT = np.uint32(1 << 31)
IDS_A_SHARD, DOCS_A_SHARD = 1 << 20, 1 << 16
INDEX = "_index"  # a folder that readers of the data files pass over


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def slot_of(hashes: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    return (mix(hashes ^ mix(seeds)) % np.uint64(n)).astype(np.int64)


def build_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacement of each bucket, slot of each key) for distinct 64-bit keys."""
    n = len(keys)
    buckets = max(1, n // 4)
    hashes = mix(keys.view(np.uint64))
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    starts = np.cumsum(sizes) - sizes
    seeds, slots, free = np.zeros(buckets, np.uint32), np.full(n, -1, np.int64), np.ones(n, bool)
    for b in np.argsort(-sizes, kind="stable"):
        size = sizes[b]
        if size < 2:
            break
        own = order[starts[b] : starts[b] + size]
        first = 0
        while True:
            tried = np.arange(first, first + 32, dtype=np.uint64)
            at = slot_of(hashes[own][None, :], tried[:, None], n)
            good = free[at].all(1)
            for i in np.flatnonzero(good):
                if len(set(at[i].tolist())) == size:
                    break
            else:
                first += 32
                continue
            break
        seeds[b], slots[own] = tried[i], at[i]
        free[at[i]] = False
    left = np.flatnonzero(free)
    alone = np.flatnonzero(sizes == 1)
    seeds[alone] = left.astype(np.uint32) | DIRECT
    slots[order[starts[alone]]] = left
    return seeds, slots


def find_slots(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    hashes = mix(keys.view(np.uint64))
    seed = seeds[(hashes % np.uint64(len(seeds))).astype(np.int64)]
    return np.where(seed & DIRECT, (seed & ~DIRECT).astype(np.int64) % n, slot_of(hashes, seed.astype(np.uint64), n))


def key_prints(keys: np.ndarray) -> np.ndarray:
    return (mix(mix(keys.view(np.uint64)) ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)).astype(np.uint32)


def shard_bytes(keys: np.ndarray, valid: np.ndarray, sizes: np.ndarray, ids: np.ndarray, id_bytes: int) -> bytes:
    """One shard. Null keys (valid = 0) are kept in order but not indexed; of equal keys the first is."""
    starts = np.cumsum(sizes) - sizes
    known = np.flatnonzero(valid)
    distinct, first = np.unique(keys[known], return_index=True)
    at = known[first]
    n = len(distinct)
    seeds, prints, offsets, places = np.zeros(1, np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.uint64), np.zeros(n, np.uint32)
    if n:
        seeds, slots = build_hash(distinct)
        prints[slots], offsets[slots], places[slots] = key_prints(distinct), starts[at], at
    return b"".join([HEADER.pack(MAGIC, id_bytes, 0, len(keys), n, len(seeds), len(ids)), seeds.tobytes(), prints.tobytes(), offsets.tobytes(), places.tobytes(),
                     keys.astype("<i8").tobytes(), valid.astype(np.uint8).tobytes(), sizes.astype("<u8").tobytes(), ids.astype(f"<u{id_bytes}").tobytes()])


class Shard:
    """Reads one shard out of a file's bytes."""

    def __init__(self, data: bytes, at: int = 0):
        magic, self.id_bytes, _, docs, n, buckets, ids = HEADER.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at += HEADER.size
        parts = []
        for kind, count in (("<u4", buckets), ("<u4", n), ("<u8", n), ("<u4", n), ("<i8", docs), ("u1", docs), ("<u8", docs), (f"<u{self.id_bytes}", ids)):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        self.seeds, self.prints, self.offsets, self.places, self.keys, self.valid, self.sizes, self.payload = parts
        self.ends = np.cumsum(self.sizes.astype(np.int64))
        self.end = at

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, offset, number of ids) of each key, in constant time a key."""
        if not len(self.prints):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        keys = np.ascontiguousarray(keys, np.int64)
        slot = find_slots(keys, self.seeds, len(self.prints))
        place = self.places[slot]
        found = (self.prints[slot] == key_prints(keys)) & (self.keys[place] == keys)
        return found, self.offsets[slot].astype(np.int64), self.sizes[place].astype(np.int64)

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """(offset, number of ids) of each document: of the first of each key from the index, checked
        against the list of sizes; of null keys and of those that repeat a key from that list."""
        size = self.sizes.astype(np.int64)
        start = np.cumsum(size) - size
        valid = self.valid.astype(bool)
        first = np.flatnonzero(valid & np.concatenate([[True], (self.keys[1:] != self.keys[:-1]) | ~valid[:-1]]))
        found, offset, length = self.find(self.keys[first])
        if not (found & (offset == start[first]) & (length == size[first])).all():
            raise ValueError("a shard's index does not fit its payload")
        start[first], size[first] = offset, length
        return start, size

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each document of a key: the index has the first, those that repeat it follow.
        Documents must have ids, as those written have (the end id at least)."""
        found, offset, size = self.find(np.array([key]))
        if not found[0]:
            return []
        begin, end = int(offset[0]), int(offset[0] + size[0])
        at, out = int(np.searchsorted(self.ends, begin, "right")), []
        while at < len(self.keys) and self.valid[at] and self.keys[at] == key:
            out.append(self.payload[begin:end])
            at += 1
            begin, end = end, int(self.ends[at]) if at < len(self.keys) else end
        return out


def shards_in(data: bytes):
    at = 0
    while at < len(data):
        shard = Shard(data, at)
        yield shard
        at = shard.end + 1  # the writer puts a line feed after each


def write_token_shards(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", bytes_a_file: int = 24 << 20, id_bytes: int = 2) -> None:
    """Writes all texts' ids, end_id after each, in ascending id (nulls first; rows of equal ids by
    text; those of one id may go to several files). A null text is empty: its ids are end_id alone. Ids must be below 2^16, or pass id_bytes=4.
    Document ids are taken as 64-bit integers. An empty table writes no shard."""
    spark = docs.sparkSession
    shared = broadcast_definition(spark, tokenizer_file)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    files = max(1, -(-int(total) // bytes_a_file))

    def encode(batches):
        held, n = [], 0
        for b in slices(batches, 1, SLICE):
            ids, sizes = tokenizer_of(shared).ids(b.column(1), end_id)
            if id_bytes == 2 and len(ids) and ids.max() > 0xFFFF:
                raise ValueError("an id of over 16 bits: use id_bytes=4")
            valid = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            held.append((b.column(0).fill_null(0).to_numpy(), valid, sizes, ids))
            n += len(ids)
            if n >= IDS_A_SHARD or sum(len(h[0]) for h in held) >= DOCS_A_SHARD:
                yield image(held)
                held, n = [], 0
        if held:
            yield image(held)

    def image(held):
        data = shard_bytes(*(np.concatenate([h[i] for h in held]) for i in range(4)), id_bytes)
        return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["value"])

    # Rows of one id are parted by the beginnings of their texts, equal rows by their places.
    dealt = texts.repartitionByRange(files, "id", F.substring("text", 1, 32), F.monotonically_increasing_id()).sortWithinPartitions("id", "text")
    dealt.mapInArrow(encode, "value binary").select(F.col("value").cast("string").alias("value")).write.text(path)
    shards_of(spark, path).write.parquet(f"{path}/{INDEX}")


def file_number(path: str) -> int:
    return int(path.rsplit("/part-", 1)[1].split("-")[0])


def shards_of(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, shard, begin, low, high): where each shard begins and its least and largest id;
    both null where it has no id but null."""

    def places(batches):
        names = ["path", "file", "shard", "begin", "low", "high"]
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                begin, rows = 0, []
                for number, s in enumerate(shards_in(memoryview(data.as_buffer()))):
                    keys = s.keys[s.valid.astype(bool)]
                    rows.append((name, file_number(name), number, begin, *((int(keys.min()), int(keys.max())) if len(keys) else (None, None))))
                    begin = s.end + 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(places, "path string, file long, shard long, begin long, low long, high long")


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per document as read back: id, file, shard, place (all ascending with id), start
    (ids before it in its shard), n_tokens, ids_crc32. Each is looked up by its shard's index, but
    for null ids and rows that repeat an id, which it does not hold."""

    def rows(batches):
        names = ["id", "file", "shard", "place", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                file = file_number(name)
                for number, s in enumerate(shards_in(memoryview(data.as_buffer()))):
                    start, sizes = s.spans()
                    wide = s.payload.astype("<u4")
                    crc = [zlib.crc32(wide[i:j]) for i, j in zip(start, start + sizes, strict=True)]
                    n = len(sizes)
                    yield pa.RecordBatch.from_arrays([pa.array(s.keys, pa.int64(), mask=s.valid == 0), pa.array(np.full(n, file, np.int64)), pa.array(np.full(n, number, np.int64)), pa.array(np.arange(n)), pa.array(start), pa.array(sizes), pa.array(crc, pa.int64())], names=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(rows, "id long, file long, shard long, place long, start long, n_tokens long, ids_crc32 long")


def with_global_start(rows: DataFrame, files_a_block: int = 1024) -> DataFrame:
    """Makes `start` the number of ids in all documents before. Sums are by shard, by file and by block
    of files; the last window is over one row a block, thousands where there are millions of files."""
    block = F.expr(f"file div {files_a_block}")
    shards = rows.groupBy("file", "shard").agg(F.sum("n_tokens").alias("n")).withColumn("block", block)
    blocks = shards.groupBy("block").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("block", F.coalesce(before, F.lit(0)).alias("block_start"))
    within = F.sum("n").over(Window.partitionBy("block").orderBy("file", "shard").rowsBetween(Window.unboundedPreceding, -1))
    base = shards.withColumn("within", F.coalesce(within, F.lit(0))).join(blocks, "block").select("file", "shard", (F.col("within") + F.col("block_start")).alias("base"))
    return rows.join(base, ["file", "shard"]).withColumn("start", F.col("start") + F.col("base")).drop("base")


def lookup(spark: SparkSession, path: str, keys: DataFrame, key_col: str, most_shards: int = 1_000_000, files_a_job: int = 10_000) -> DataFrame:
    """Keyed access: (key, ids as array<long>) of the keys that are there, one row a document of a key,
    also where documents repeat it. The index table tells which shards may hold a key; its size is
    checked against `most_shards` before it is broadcast. Only files with such shards are read, in
    jobs of `files_a_job` at most, and in them only those shards."""
    index = spark.read.parquet(f"{path}/{INDEX}").where("low is not null")
    if index.count() > most_shards:
        raise ValueError("too many shards for one broadcast: look up in one folder of shards at a time")
    known = index.orderBy("file", "shard").toArrow()
    shared = spark.sparkContext.broadcast(known)  # low and high ascend

    def find(batches):
        at = shared.value
        low, high = at.column("low").to_numpy(), at.column("high").to_numpy()
        for b in batches:
            own = b.column(0).to_numpy()
            first, end = np.searchsorted(high, own, "left"), np.searchsorted(low, own, "right")
            n = np.maximum(end - first, 0)
            rows = pa.array(ragged(first, n))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(own)), n))), *(at.column(c).take(rows).combine_chunks() for c in ("path", "begin"))], names=["key", "path", "begin"])

    asked = keys.select(F.col(key_col).cast("long").alias("key")).where("key is not null").distinct()
    dealt = asked.mapInArrow(find, "key long, path string, begin long").groupBy("path", "begin").agg(F.collect_set("key").alias("keys"))
    dealt = dealt.groupBy("path").agg(F.collect_list(F.struct("begin", "keys")).alias("wanted"))
    paths = [r.path for r in dealt.select("path").orderBy("path").collect()]  # one a shard asked for, most_shards at most

    def get(batches):
        for batch in batches:
            for data, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for w in wanted:
                    shard = Shard(memoryview(data.as_buffer()), w["begin"])
                    found = [(k, got.tolist()) for k in w["keys"] for got in shard.get(k)]
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([v for _, v in found], pa.list_(pa.int64()))], names=["key", "ids"])

    out = spark.createDataFrame([], "key long, ids array<long>")
    for i in range(0, len(paths), files_a_job):
        files = spark.read.format("binaryFile").load(paths[i : i + files_a_job]).select("path", "content")
        out = out.unionByName(files.join(dealt, "path").select("content", "wanted").mapInArrow(get, "key long, ids array<long>"))
    return out
