"""Embedding near-dedup (operator 2) by product quantisation.

Unit vectors are put into inverted lists by their nearest coarse centroid; their residuals are
stored as subspace codes, each with its own quantisation error. Cosine >= t means a distance of
at most r = sqrt(2 - 2t). A vector probes every list that may hold a partner: a partner in list c
lies on c's side of the plane between the two centroids, so c is probed if the vector is within r
of that plane. Within a list, table lookups give the distance from a vector to a code; a code is a
candidate if that distance is at most r plus the code's own error. Neither step loses a link.
Candidates' cosines are then computed exactly, in double precision.

Vectors with equal label and components are one class: the search runs over classes. Lists are
cut into blocks of bounded size, and a task joins one block with one block, so a list of a third
of all rows is spread out. A task sends back its vectors' numbers of links and a spanning forest
of its links, never the pairs. The centroids and code words are fitted on a bounded sample; every
vector is indexed."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .runtime import Scratch

SLACK = 1e-6
CODED_AT_ONCE = 1024  # vectors
BLOCK_BYTES, MOST_BLOCK_ROWS = 16 << 20, 8192


@dataclass
class Index:
    centroids: np.ndarray
    words: np.ndarray  # subspaces x code words x dimensions of a subspace
    gaps: np.ndarray  # distance between each two centroids

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list of each vector, squared distances to all centroids)."""
        d = (x**2).sum(1)[:, None] - 2 * x @ self.centroids.T + (self.centroids**2).sum(1)
        return d.argmin(1), d

    def probes(self, own: np.ndarray, d: np.ndarray, radius: float) -> np.ndarray:
        """Whether each list may hold a partner of each vector."""
        gap = self.gaps[own]
        to_plane = (d - d[np.arange(len(own)), own][:, None]) / np.maximum(2 * gap, 1e-12)
        return (to_plane <= radius + SLACK) | (gap < 1e-9)

    def parts(self, x: np.ndarray) -> np.ndarray:
        m, _, size = self.words.shape
        return np.pad(x, ((0, 0), (0, m * size - x.shape[1]))).reshape(len(x), m, size)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, distance between each residual and what its codes stand for)."""
        parts = self.parts(residual)
        codes = self.distances(parts).argmin(2)
        held = self.words[np.arange(len(self.words))[None, :], codes]
        return codes.astype(np.uint8), np.sqrt(((parts - held) ** 2).sum((1, 2)))

    def distances(self, parts: np.ndarray) -> np.ndarray:
        """Squared distances of parts to the code words of their subspaces, by matrix products."""
        cross = np.einsum("nms,mws->nmw", parts, self.words)
        return np.maximum((parts**2).sum(2)[:, :, None] - 2 * cross + (self.words**2).sum(2)[None], 0)

    def tables(self, residual: np.ndarray) -> np.ndarray:
        return self.distances(self.parts(residual))


def k_means(x: np.ndarray, k: int, rounds: int, rng) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[n > 0] = total[n > 0] / n[n > 0][:, None]
    return centres


def fit_index(sample: np.ndarray, lists: int, subspaces: int, words: int, seed: int = 7) -> Index:
    rng = np.random.default_rng(seed)
    centroids = k_means(sample, min(lists, len(sample)), 8, rng)
    own = ((sample**2).sum(1)[:, None] - 2 * sample @ centroids.T + (centroids**2).sum(1)).argmin(1)
    residual = sample - centroids[own]
    m = min(subspaces, sample.shape[1])
    size = -(-sample.shape[1] // m)
    parts = np.pad(residual, ((0, 0), (0, m * size - sample.shape[1]))).reshape(len(sample), m, size)
    coded = np.stack([np.pad(c := k_means(parts[:, i], min(words, len(sample)), 8, rng), ((0, words - len(c)), (0, 0)), mode="edge") for i in range(m)])
    gaps = np.sqrt(np.maximum((centroids**2).sum(1)[:, None] - 2 * centroids @ centroids.T + (centroids**2).sum(1), 0))
    np.fill_diagonal(gaps, 0)
    return Index(centroids, coded, gaps)


def vectors_of(column) -> np.ndarray:
    """Unit vectors of a list column in double precision. Each is first scaled by its largest component,
    so that no square over- or underflows."""
    x = column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x**2).sum(1))[:, None]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component under the links i-j."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def near_pairs(index: Index, centroid: np.ndarray, query: np.ndarray, own: np.ndarray, codes: np.ndarray, errors: np.ndarray, radius: float, least: float, rows: int = 256):
    """Blocks of (query rows, own rows) with cosine >= least: candidates by table lookup, then exactly."""
    for at in range(0, len(query), rows):
        q = query[at : at + rows]
        tables = index.tables(q - centroid)
        d = np.zeros((len(q), len(own)))
        for m in range(codes.shape[1]):
            d += tables[:, m, :][:, codes[:, m]]
        i, j = np.nonzero(d <= (radius + errors[None, :] + SLACK) ** 2)
        for k in range(0, len(i), 1 << 16):
            a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            hit = np.einsum("ij,ij->i", q[a], own[b]) >= least
            yield a[hit] + at, b[hit]


def near_dedup(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", sample_rows: int = 20_000, rows_a_list: int = 256, most_lists: int = 1024, subspaces: int = 8, words: int = 32, block_rows: int | None = None) -> DataFrame:
    """One row per row: id, n_links, component_id, kept. Vectors that are null, empty, zero or hold
    null or non-finite components, and those without a label, link with nothing; so do vectors of
    different lengths. Equal vectors link with each other. Repeated ids are vectors of their own,
    but share component_id if they link. Other columns are ignored. An empty table gives none.
    The index is fitted on at most `sample_rows` vectors, those with the smallest hash."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("valid", valid)
    classes = rows.where("valid").groupBy("label", "v").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    # Numbered once: the written table is what all later steps read.
    classes = scratch.write(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("size", F.size("v")), "classes")
    sizes = [r.size for r in classes.select("size").distinct().collect()]
    found = [search(scratch, classes.where(F.col("size") == s), s, least, sample_rows, rows_a_list, most_lists, subspaces, words, block_rows) for s in sizes]
    zero = spark.createDataFrame([], "cid long, n long")
    counts, links = zero, spark.createDataFrame([], "a long, b long")
    for c, e in found:
        counts, links = counts.unionByName(c), links.unionByName(e)
    component = connected_components(links, scratch, "links")
    member = classes.select("cid", "first").join(component.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    lowest = member.groupBy("component").agg(F.min("first").alias("component_id"))
    solved = member.join(lowest, "component").join(counts.groupBy("cid").agg(F.sum("n").alias("n")), "cid", "left").select("cid", "component_id", F.coalesce("n", F.lit(0)).alias("n"))
    held = [x for s in sizes for x in (f"encoded-{s}", f"found-{s}")]
    solved = scratch.write(classes.join(solved, "cid").select("label", "v", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id"), "solved")
    for name in ("classes", *held):
        scratch.drop(name)
    out = rows.where("valid").join(solved, ["label", "v"]).select("id", "n_links", "component_id")
    out = out.unionByName(rows.where("not valid").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").cast(id_type).alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def search(scratch: Scratch, classes: DataFrame, size: int, least: float, sample_rows: int, rows_a_list: int, most_lists: int, subspaces: int, words: int, block_rows: int | None) -> tuple[DataFrame, DataFrame]:
    """(cid, n): links of each class to rows of other classes, by block; (a, b): links that connect them."""
    spark = scratch.spark
    radius = float(np.sqrt(max(0.0, 2 - 2 * least)))
    block_rows = block_rows or max(256, min(MOST_BLOCK_ROWS, BLOCK_BYTES // (8 * size)))
    total = classes.count()
    share = min(1.0, 1.2 * sample_rows / total)
    sample = classes.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy(F.xxhash64("v"), "label").limit(sample_rows).select("v").toArrow()
    index = fit_index(vectors_of(sample.column("v").combine_chunks()), max(1, min(most_lists, total // rows_a_list)), subspaces, words)
    shared = spark.sparkContext.broadcast(index)  # most_lists centroids and their gaps at most
    kind = classes.schema["label"].dataType.simpleString()

    def encode(batches):
        names = ["cid", "label", "copies", "v", "list", "codes", "error", "probes"]
        for b in (b.slice(i, CODED_AT_ONCE) for b in batches for i in range(0, b.num_rows, CODED_AT_ONCE)):
            ix = shared.value
            x = vectors_of(b.column(3))
            own, d = ix.nearest(x)
            codes, error = ix.encode(x - ix.centroids[own])
            # A pair of lists is searched once, from the smaller to the larger number.
            reach = ix.probes(own, d, radius) & (np.arange(len(ix.centroids))[None, :] >= own[:, None])
            reach[np.arange(len(own)), own] = True
            row, lists = np.nonzero(reach)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(x)))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(lists.astype(np.int32)))], names=names)

    name = f"encoded-{size}"
    coded = scratch.write(classes.select("cid", "label", "copies", "v").mapInArrow(encode, f"cid long, label {kind}, copies long, v binary, list int, codes binary, error double, probes array<int>"), name)
    queries = coded.select("cid", "label", "copies", "v", F.col("list").alias("own"), F.explode("probes").alias("list"))
    held = coded.groupBy("label", "list").agg(F.count("*").alias("held"))
    asked = queries.groupBy("label", "list").agg(F.count("*").alias("asked"))
    blocks = held.join(asked, ["label", "list"]).select("label", "list", F.ceil(F.col("held") / block_rows).cast("int").alias("hb"), F.ceil(F.col("asked") / block_rows).cast("int").alias("ab"))
    block = lambda salt, n: F.pmod(F.xxhash64("cid", F.lit(salt)), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    unit = ["label", "list", "h", "a"]
    index_rows = coded.join(blocks, ["label", "list"]).withColumn("h", block(1, "hb")).withColumn("a", spread("ab")).select(*unit, "cid", "copies", "v", "codes", "error")
    query_rows = queries.join(blocks, ["label", "list"]).withColumn("a", block(2, "ab")).withColumn("h", spread("hb")).select(*unit, "cid", "copies", "v", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error"), "own")
    both = index_rows.withColumn("own", F.lit(-1)).unionByName(query_rows)

    def compare(t: pa.Table) -> pa.Table:
        ix = shared.value
        t = t.combine_chunks()
        here = t.column("list")[0].as_py()
        asks = t.column("own").to_numpy() >= 0
        cid, copies = t.column("cid").to_numpy(), t.column("copies").to_numpy()
        v = np.frombuffer(b"".join(t.column("v").to_pylist()), np.float64).reshape(len(cid), -1)
        own, ask = np.flatnonzero(~asks), np.flatnonzero(asks)
        n, label = np.zeros(len(cid), np.int64), np.arange(len(cid))
        if len(own) and len(ask):
            codes = np.frombuffer(b"".join(t.column("codes").take(pa.array(own)).to_pylist()), np.uint8).reshape(len(own), -1)
            errors = t.column("error").take(pa.array(own)).to_numpy()
            inside = t.column("own").to_numpy()[ask] == here
            # A class stands here twice, as query and as indexed row: both get one number.
            _, number = np.unique(cid, return_inverse=True)
            label = np.arange(number.max() + 1)
            for i, j in near_pairs(ix, ix.centroids[here], v[ask], v[own], codes, errors, radius, least):
                good = ~inside[i] | (cid[ask[i]] < cid[own[j]])  # within a list, once a pair
                i, j = ask[i[good]], own[j[good]]
                np.add.at(n, i, copies[j])
                np.add.at(n, j, copies[i])
                joined = forest(len(label), label[number[i]], label[number[j]])
                label = joined[label]
            first = np.zeros(len(label), np.int64)
            first[number] = cid
            root = first[label[number]]
        else:
            root = cid
        use = (n > 0) | (root != cid)
        return pa.table({"cid": cid[use], "n": n[use], "root": root[use]})

    out = scratch.write(both.groupBy(*unit).applyInArrow(compare, "cid long, n long, root long"), f"found-{size}")
    return out.where("n > 0").select("cid", "n"), out.where("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b"))
