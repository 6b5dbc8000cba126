"""Document fingerprints (operator 12): MinHash over five-word shingles.

A fingerprint holds, for each of 128 universal hash functions (a x + b mod 2^64, a odd), 16 bits of
the least value over a text's shingles. Two fingerprints agree in a place with the probability of
their sets' Jaccard similarity, so the share of equal places is their likeness. All 64-bit products of a
batch are made at once in numpy.

Near copies are found by bands of four places: two texts of similarity 0.75 share one of the 32
bands but for 5 in a million. Texts of equal shingle sets are one class. In a first round, each class is paired
with the class that leads most of its bands and with the most central one that leads any; pairs are verified by the Jaccard similarity of their whole sets,
and verified links make components. In a second, classes of different components that share a band are paired where
their fingerprints and the parities of their sets leave the similarity within reach, and verified. So a group of thousands of near
copies costs a pair a member, not all its pairs, and all pairs of a band that could still join components are tried.

The documents next to each other by id meet in one exchange by ranges of ids; texts cross it compressed."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .ngram_join import SEEDS, verify
from .runtime import SLICE_BYTES, Scratch, text_buffer
from .shingles import class_hashes, parities, shingle_hashes, shingle_sets
from .token_output import mix

PLACES, BAND = 128, 4
_random = mix(np.arange(1, 2 * PLACES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTORS, TERMS = _random[:PLACES] | np.uint64(1), _random[PLACES:]
SHINGLES_AT_ONCE = 1 << 16  # their 64-bit products stay in the processor's cache
#: Below this many equal places, a pair of similarity 0.75 is less likely than one in a million.
LEAST_EQUAL = 70
BLOCK_ROWS = 2048
PARITY = 16  # 64-bit words of a set's parities


def minima(value: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The least value of each hash function over each text's shingles: texts x places. Texts without
    shingles have the largest number."""
    out = np.full((len(counts), PLACES), np.iinfo(np.uint64).max, np.uint64)
    ends = np.cumsum(counts)
    for at in range(0, len(value), SHINGLES_AT_ONCE):
        own = value[at : at + SHINGLES_AT_ONCE]
        first = int(np.searchsorted(ends, at, "right"))
        last = int(np.searchsorted(ends, at + len(own), "left"))
        texts = first + np.flatnonzero(counts[first : last + 1] > 0)
        heads = np.maximum(ends[texts] - counts[texts] - at, 0)
        for i in range(PLACES):
            least = np.minimum.reduceat(own * FACTORS[i] + TERMS[i], heads)
            out[texts, i] = np.minimum(out[texts, i], least)
    return out


def signatures(value: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """16 bits a place, from 1; all 0 for texts without shingles."""
    bits = (mix(minima(value, counts)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
    bits[counts == 0] = 0
    return bits


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(1) / PLACES


def bytes_column(values: list[bytes] | np.ndarray) -> pa.Array:
    return pa.array([v if isinstance(v, bytes) else v.tobytes() for v in values], pa.binary())


MADE = "id {0}, n_chars long, n_shingles long, cid long, check long, edited_sha256 string, sig binary, parity binary, edited_sig binary, near_edited double, near_next double, edge int, part int, zip binary"
NAMES = [f.split()[0] for f in MADE.split(", ")]


def described(ids: pa.Array, texts: list[str], following: list[str], seed: int) -> pa.RecordBatch:
    """The result rows of texts, each with the text that follows it."""
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, following, strict=True)]

    def hashed(some: list[str]):
        raw, offsets = text_buffer(pa.array(some, pa.large_string()))
        return shingle_hashes(raw, offsets)

    raw, offsets = text_buffer(pa.array(texts, pa.large_string()))
    value, sizes, classes = shingle_sets(raw, offsets, seed)
    own, changed = signatures(value, sizes), signatures(*hashed(edited))
    # Most texts that follow are themselves of this batch.
    after = np.zeros_like(own)
    after[:-1] = own[1:]
    odd = [i for i, n in enumerate(following) if i + 1 == len(texts) or n is not texts[i + 1]]
    if odd:
        after[odd] = signatures(*hashed([following[i] for i in odd]))
    n = len(texts)
    shas = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]
    return pa.RecordBatch.from_arrays([ids, pa.array([len(t) for t in texts], pa.int64()), pa.array(sizes), pa.array(classes), pa.array(class_hashes(value, sizes, seed + SEEDS)), pa.array(shas), bytes_column(own), bytes_column(parities(value, sizes, PARITY)), bytes_column(changed), pa.array(likeness(own, changed)), pa.array(likeness(own, after)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=NAMES)


def edge_row(id_value: pa.Array, edge: int, part: int, packed: bytes) -> pa.RecordBatch:
    """A task's first (0) or last (1) text, for its neighbour."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([id_value, *(pa.nulls(1, t) for t in types), pa.array([edge], pa.int32()), pa.array([part], pa.int32()), pa.array([packed], pa.binary())], names=NAMES)


def squeezed(batches):
    for b in batches:
        if b.num_rows:
            raw, offsets = text_buffer(b.column(1))
            packed = [zlib.compress(raw[i:j].tobytes(), 1) for i, j in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(packed, pa.binary())], names=["id", "h", "zip"])


def along(seed: int):
    """(id, h, zip) in order to result rows, all but the task's last, and its first and last texts."""

    def run(batches):
        part = TaskContext.get().partitionId()
        ids, texts, held, last = [], [], 0, None
        for b in batches:
            for i, z in enumerate(b.column(2)):
                if last is None:
                    yield edge_row(b.column(0).slice(i, 1), 0, part, z.as_py())
                last = z.as_py()
                ids.append(b.column(0).slice(i, 1))
                texts.append(unzipped(last))
                held += len(texts[-1])
                if held >= SLICE_BYTES and len(texts) > 1:
                    yield described(pa.concat_arrays(ids[:-1]), texts[:-1], texts[1:], seed)
                    ids, texts, held = ids[-1:], texts[-1:], len(texts[-1])
        if len(texts) > 1:
            yield described(pa.concat_arrays(ids[:-1]), texts[:-1], texts[1:], seed)
        if texts:
            yield edge_row(ids[-1], 1, part, last)

    return run


def at_edges(seed: int):
    """(id, text, the text that follows, both compressed) to result rows."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield described(b.column(0).slice(i, 1), [unzipped(b.column(1)[i].as_py())], [unzipped(b.column(2)[i].as_py())], seed)

    return run


def unzipped(packed: bytes) -> str:
    return zlib.decompress(packed).decode("utf-8", "surrogatepass")


def fingerprint_rows(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, seed: int) -> DataFrame:
    """A row for each document: id, n_chars, n_shingles, cid, check, edited_sha256, sig, parity,
    edited_sig, near_edited, near_next. Documents stand in the order of id (nulls first), then of a hash of their texts."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = MADE.format(kind)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    packed = texts.select("id", "text", F.xxhash64("text").alias("h")).mapInArrow(squeezed, f"id {kind}, h long, zip binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = packed.repartitionByRange(parts, "id", "h").sortWithinPartitions("id", "h")
    made = scratch.write(ordered.mapInArrow(along(seed), schema), f"made-{seed}")
    # Every task with rows has one first and one last text; the last one's next is the first of the
    # next such task, and of the last task the first of all.
    ends = made.where("edge is not null").select("id", "edge", "part", "zip")
    used = [r.part for r in ends.where("edge = 0").select("part").orderBy("part").collect()]  # a number a task
    if not used:
        return made.drop("edge", "part", "zip")
    follows = docs.sparkSession.createDataFrame(list(zip(used, used[1:] + used[:1], strict=True)), "part int, after int")
    pairs = ends.where("edge = 1").join(follows, "part").join(ends.where("edge = 0").select(F.col("part").alias("after"), F.col("zip").alias("next")), "after").select("id", "zip", "next")
    rest = scratch.write(pairs.mapInArrow(at_edges(seed), schema), f"rest-{seed}")
    return made.where("edge is null").unionByName(rest).drop("edge", "part", "zip")


def band_keys(batches):
    """(cid, sig) to (band, cid), a row a band."""
    for b in batches:
        if b.num_rows:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(b.num_rows, -1)  # four places each
            key = mix(sig ^ mix(np.arange(sig.shape[1], dtype=np.uint64))[None, :]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), sig.shape[1]))], names=["band", "cid"])


def within_reach(percent: int, n: np.ndarray, m: np.ndarray, sig: np.ndarray, other: np.ndarray, parity: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Whether pairs of sets of n and m shingles may reach the similarity: the fingerprints have places
    enough in common, and the sets differ, at least, in a shingle for each parity in which they differ."""
    fit = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((sig == other).sum(1) >= LEAST_EQUAL)
    apart = np.bitwise_count(parity[fit] ^ odd[fit] if odd.shape == parity.shape else parity ^ odd[fit]).sum(1).astype(np.int64)
    total = (n + m)[fit]
    fit[fit] = apart * (100 + percent) <= total * (100 - percent)
    return fit


def close_pairs(percent: int):
    """Pairs of one block of a band, of different components, that may reach the similarity. Rows of side
    0 meet those of side 1; a block against itself has them all on side 2."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        side, cid, comp, n = (t.column(c).to_numpy() for c in ("side", "cid", "c", "n"))
        sig, parity = (np.frombuffer(b"".join(t.column(c).to_pylist()), kind).reshape(len(cid), -1) for c, kind in (("sig", np.uint16), ("parity", np.uint64)))
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        out = [np.zeros((0, 2), np.int64)]
        for i in left:
            other = right[(comp[right] != comp[i]) & ((side[i] != 2) | (cid[right] > cid[i]))]
            other = other[within_reach(percent, n[i : i + 1], n[other], sig[i : i + 1], sig[other], parity[i : i + 1], parity[other])]
            out.append(np.column_stack([np.minimum(cid[i], cid[other]), np.maximum(cid[i], cid[other])]))
        pairs = np.concatenate(out)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def plausible(percent: int):
    """The pairs (a, b) that may reach the similarity."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                n, m = b.column("n_a").to_numpy(), b.column("n_b").to_numpy()
                sig, other, parity, odd = (np.frombuffer(b"".join(b.column(c).to_pylist()), kind).reshape(b.num_rows, -1) for c, kind in (("sig_a", np.uint16), ("sig_b", np.uint16), ("parity_a", np.uint64), ("parity_b", np.uint64)))
                yield b.select(["a", "b"]).filter(pa.array(within_reach(percent, n, m, sig, other, parity, odd)))

    return run


def near_groups(texts: DataFrame, classes: DataFrame, scratch: Scratch, percent: int, seed: int) -> DataFrame:
    """(cid, component_id) of classes (cid, first, n, sig, parity); texts: (id, text)."""
    bands = classes.select("cid", "sig").mapInArrow(band_keys, "band long, cid long")
    several = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = scratch.write(bands.join(several, "band"), "bands")
    # The leader of a band is the class that meets most others in all its bands: of near copies, the one nearest to most.
    central = shared.groupBy("cid").agg(F.sum("n").alias("central"))
    leads = shared.join(central, "cid").groupBy("band").agg(F.max(F.struct("central", F.col("cid").alias("lead"))).alias("l")).select("band", "l.*")
    votes = shared.join(leads, "band").where("cid <> lead").groupBy("cid", "lead").agg(F.count("*").alias("votes"), F.max("central").alias("central"))
    chosen = votes.groupBy("cid").agg(F.max_by("lead", F.struct("votes", "central", "lead")).alias("often"), F.max_by("lead", F.struct("central", "lead")).alias("top"))
    first = chosen.select("cid", F.explode(F.array_distinct(F.array("often", "top"))).alias("lead")).select(F.least("cid", "lead").alias("a"), F.greatest("cid", "lead").alias("b")).distinct()
    traits = classes.select("cid", "n", "sig", "parity")
    of = lambda side: traits.select(F.col("cid").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("n", "sig", "parity")))
    first = scratch.write(first.join(of("a"), "a").join(of("b"), "b").mapInArrow(plausible(percent), "a long, b long"), "stars")
    links = verify(texts, classes, first, scratch, "star", percent, seed)
    component = scratch.write(connected_components(links, scratch, "star-links"), "components")

    member = shared.select("band", "cid").join(component.withColumnRenamed("node", "cid"), "cid", "left").select("band", "cid", F.coalesce("component", "cid").alias("c"))
    mixed = member.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).where("low < high").select("band", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    member = member.join(mixed, "band").join(traits, "cid").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    # A block meets each block from itself on.
    dealt = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = dealt.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "cid", "c", "n", "sig", "parity")
    pairs = dealt.groupBy("band", "i", "j").applyInArrow(close_pairs(percent), "a long, b long").distinct()
    pairs = scratch.write(pairs.join(first, ["a", "b"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        more = verify(texts, classes, pairs, scratch, "pair", percent, seed)
        stars = component.select(F.col("node").alias("a"), F.col("component").alias("b"))
        component = connected_components(stars.unionByName(more), scratch, "all-links")
    grouped = classes.select("cid", "first").join(component.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    lowest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    return grouped.join(lowest, "component").select("cid", "component_id")


def fingerprint(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, n_chars, edited_sha256, fingerprint and edited_fingerprint (hex),
    near_edited, near_next, n_shingles, component_id. The edited text is the text with its last half replaced by as much
    of the next document's beginning; component_id is the smallest id among documents that verified links of
    `percent` Jaccard similarity connect, itself included.

    Null texts are empty; texts without words have a fingerprint of zeros, alike to each other only, and link
    with nothing. The next document is that of the next id, after the last the first; nulls come first, and equal ids by a hash of
    the text. A single document is followed by itself. Repeated rows stay; other columns are ignored; an
    empty table gives no rows. Of null ids, component_id is the smallest id that is not null, if any."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for seed in range(SEEDS):
        made = fingerprint_rows(docs, scratch, id_col, text_col, seed)
        kinds = made.where("n_shingles > 0").groupBy("cid").agg(F.min("id").alias("first"), F.min("n_shingles").alias("n"), F.min("sig").alias("sig"), F.min("parity").alias("parity"), (F.min("check") < F.max("check")).alias("clash"))
        classes = scratch.write(kinds, f"classes-{seed}")
        if classes.where("clash").isEmpty():
            break
    else:
        raise RuntimeError("sets of one class differ, whatever the seed")
    group = scratch.write(near_groups(texts, classes, scratch, percent, seed), "groups")
    scratch.drop("bands")
    joined = made.join(group, "cid", "left")
    return joined.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", F.lower(F.hex("sig")).alias("fingerprint"), F.lower(F.hex("edited_sig")).alias("edited_fingerprint"), "near_edited", "near_next", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
