"""Hard-negative mining (operator 13) over anchor-clustered shared lists.

Anchors are clustered by direction. For a cluster with centre c, whose members lie within an angle
w of c, no member of unit length scores a candidate x higher than |x| cos(max(0, angle(x, c) - w)).
Each cluster sorts the candidates by this bound once, into bins of falling bound, and all its
members walk that one list. A member stops where its answer is certain: it has all it asked for,
and the bound of what is left, times its own length, lies below the last of these or below the
lowest score asked for. Only clusters with members still walking send for their next part of the
list, each part four times as long as all before.

A part is cut into blocks of candidates and of members, so that no task holds more than one block of
each, however large a cluster; a task returns each member's best. Scores are exact integers. The
centres are fitted on a bounded sample of anchors; every anchor walks and every row is listed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .embedding_dedup import k_means
from .runtime import Scratch, usual_length
from .token_output import mix

SCORE_BITS = 55
BINS_AN_OCTAVE, OCTAVES = 64, 24
LAST_BIN = BINS_AN_OCTAVE * OCTAVES
BLOCK_BYTES, MOST_BLOCK_ROWS, MEMBERS_AT_ONCE = 16 << 20, 8192, 256
ASKS_A_BLOCK = 8192
SLACK = 1e-9

ROW = "uid long, id long, label string, x binary, anchor boolean"


def binary_of(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as values of a binary column."""
    offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.itemsize * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def matrix_of(column, kind=np.int32) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), kind).reshape(len(parts), -1)


def packed(vectors: DataFrame, anchor: Column, scale: int, size: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Rows that take part, their components floored to 32-bit integers."""
    most = int((2.0**SCORE_BITS / max(size, 1)) ** 0.5)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c * scale) > most))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") == size) & ~odd)

    def pack(batches):
        for b in batches:
            if b.num_rows:
                x = np.floor(b.column("v").flatten().to_numpy().reshape(b.num_rows, size) * scale).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("id"), b.column("label"), binary_of(x), b.column("anchor")], names=["uid", "id", "label", "x", "anchor"])

    return rows.select(F.monotonically_increasing_id().alias("uid"), "id", "label", "v", "anchor").mapInArrow(pack, ROW)


def angles(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length of each vector, its angle to each centre; 0 for vectors without a length)."""
    length = np.sqrt((x**2).sum(1))
    cosine = (x / np.where(length > 0, length, 1)[:, None]) @ centres.T
    return length, np.where(length[:, None] > 0, np.arccos(np.clip(cosine, -1, 1)), 0)


def bounds(x: np.ndarray, centres: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The most that a member of each cluster, of unit length, can score each vector."""
    length, angle = angles(x, centres)
    return length[:, None] * np.cos(np.maximum(angle - widths[None, :] - SLACK, 0))


def bins_of(bound: np.ndarray, longest: float) -> np.ndarray:
    """Bin of a bound: bin i holds bounds from longest / 2^((i + 1) / 64) to longest / 2^(i / 64); the
    last one all lower ones, those below zero too."""
    share = np.maximum(bound / max(longest, 1e-300), 2.0 ** -(OCTAVES + 1))
    return np.minimum(np.floor(np.maximum(-np.log2(share), 0) * BINS_AN_OCTAVE), LAST_BIN).astype(np.int64)


def edge_of(at: int, longest: float) -> float:
    """No bound in bin `at` or after it lies above."""
    return longest * 2.0 ** (-at / BINS_AN_OCTAVE) * (1 + 1e-9)


def scores_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products, exact: in doubles where no sum can exceed their 53 bits, else in integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores first, ties by smaller id."""
    if len(score) > 4 * k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        kept = np.flatnonzero(score >= floor)
        return kept[np.lexsort((ids[kept], -score[kept]))[:k]]
    return np.lexsort((ids, -score))[:k]


class Lists:
    """The shared lists: one for each cluster of anchors."""

    def __init__(self, scratch: Scratch, rows: DataFrame, size: int, anchors_a_list: int, most_lists: int, sample_anchors: int, block_rows: int | None):
        self.scratch, self.spark, self.rows, self.size = scratch, scratch.spark, rows, size
        self.block_rows = block_rows or max(256, min(MOST_BLOCK_ROWS, BLOCK_BYTES // max(4 * size, 1)))
        anchors = rows.where("anchor")
        sample = anchors.orderBy(F.xxhash64("x"), "uid").limit(sample_anchors).select("x").toArrow().column("x")
        x = matrix_of(sample).astype(np.float64)
        x = x / np.maximum(np.sqrt((x**2).sum(1)), 1e-300)[:, None]
        centres = k_means(x, max(1, min(most_lists, len(x), anchors.count() // anchors_a_list)), 8, np.random.default_rng(13))
        length = np.sqrt((centres**2).sum(1))
        self.centres = np.where(length[:, None] > 1e-12, centres / np.maximum(length, 1e-12)[:, None], np.eye(1, x.shape[1]))
        self.anchors = scratch.write(anchors.mapInArrow(self.joiner(), "uid long, id long, label string, x binary, cluster int, angle double, length double"), "anchors")
        self.widths = np.zeros(len(self.centres))
        for r in self.anchors.groupBy("cluster").agg(F.max("angle").alias("w")).collect():  # most_lists rows at most
            self.widths[r.cluster] = r.w
        self.longest = float(np.sqrt(rows.mapInArrow(longest_square, "n double").agg(F.max("n")).head()[0] or 0))
        self.held = self.histogram()

    def joiner(self):
        centres = self.centres

        def join(batches):
            for b in batches:
                if b.num_rows:
                    length, angle = angles(matrix_of(b.column("x")).astype(np.float64), centres)
                    own = angle.argmin(1)
                    yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("id"), b.column("label"), b.column("x"), pa.array(own.astype(np.int32)), pa.array(angle[np.arange(len(own)), own]), pa.array(length)], names=["uid", "id", "label", "x", "cluster", "angle", "length"])

        return join

    def histogram(self) -> np.ndarray:
        """Candidates in each bin of each list."""
        centres, widths, longest = self.centres, self.widths, self.longest

        def count(batches):
            held = np.zeros((len(centres), LAST_BIN + 1), np.int64)
            for b in batches:
                if b.num_rows:
                    at = bins_of(bounds(matrix_of(b.column("x")).astype(np.float64), centres, widths), longest)
                    for c in range(len(centres)):
                        held[c] += np.bincount(at[:, c], minlength=LAST_BIN + 1)
            c, i = np.nonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(held[c, i])], names=["c", "i", "n"])

        held = np.zeros((len(centres), LAST_BIN + 1), np.int64)
        for r in self.rows.select("x").mapInArrow(count, "c int, i int, n long").groupBy("c", "i").agg(F.sum("n").alias("n")).collect():  # lists x bins at most
            held[r.c, r.i] = r.n
        return held

    def part(self, cuts: dict[int, tuple[int, int, int, int]]) -> DataFrame:
        """Candidates of the clusters' next bins; cuts: (first bin, bin after the last, blocks of
        candidates, blocks of members) of each cluster."""
        centres, widths, longest, names = self.centres, self.widths, self.longest, ["cluster", "cb", "mbs", "uid", "id", "label", "x"]

        def pick(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                at = bins_of(bounds(matrix_of(b.column("x")).astype(np.float64), centres, widths), longest)
                place = mix(b.column("uid").to_numpy().view(np.uint64))
                for c, (low, high, blocks, member_blocks) in cuts.items():
                    own = np.flatnonzero((at[:, c] >= low) & (at[:, c] < high))
                    if len(own):
                        t = b.take(pa.array(own))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), c, np.int32)), pa.array((place[own] % np.uint64(blocks)).astype(np.int32)), pa.array(np.full(len(own), member_blocks, np.int32)), t.column("uid"), t.column("id"), t.column("label"), t.column("x")], names=names)

        return self.rows.select("uid", "id", "label", "x").mapInArrow(pick, "cluster int, cb int, mbs int, uid long, id long, label string, x binary")

    def walk(self, asks: DataFrame, k: int, same: bool, name: str, first_rows: int | None = None) -> DataFrame:
        """(member, ask, rank, score, id): the k best rows of each ask, those of the member's own label and
        another id (same) or of another label, with a score from `low` to `high`. asks: member, ask,
        own_id, label, x, cluster, length, low, high."""
        scratch, done, target = self.scratch, np.zeros(len(self.centres), np.int64), first_rows or self.block_rows
        ranked = Window.partitionBy("member", "ask").orderBy(F.desc("score"), "id", "uid")
        active, found, turn = asks, None, 0
        while True:
            walking = {r.cluster: r.n for r in active.groupBy("cluster").agg(F.count("*").alias("n")).collect()}  # most_lists rows at most
            cuts = {}
            for c, n in walking.items():
                gone = np.cumsum(self.held[c])
                high = LAST_BIN + 1 if target >= gone[-1] else max(int(np.searchsorted(gone, target)), int(done[c])) + 1
                rows = int(self.held[c, done[c] : high].sum())
                cuts[c] = (int(done[c]), high, -(-rows // self.block_rows) or 1, -(-n // ASKS_A_BLOCK))
            if not cuts:
                break
            new = self.meet(active, cuts, k, same)
            best = (new if found is None else found.unionByName(new)).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            found = scratch.write(best.drop("rank"), f"{name}-found-{turn}")
            for c, cut in cuts.items():
                done[c] = cut[1]
            left = [(c, edge_of(int(done[c]), self.longest)) for c in cuts if done[c] <= LAST_BIN]
            edges = self.spark.createDataFrame(left, "cluster int, edge double")  # a row a list
            held = found.groupBy("member", "ask").agg(F.count("*").alias("n"), F.min("score").alias("least"))
            reach = F.col("edge") * F.col("length") * (1 + SLACK) + SLACK  # what is left scores this at most
            certain = (F.col("low") > reach) | F.coalesce((F.col("n") >= k) & (F.col("least") > reach), F.lit(False))
            active = scratch.write(active.join(F.broadcast(edges), "cluster").join(held, ["member", "ask"], "left").where(~certain).select(*asks.columns), f"{name}-active-{turn}")
            for old in (f"{name}-found-{turn - 1}", f"{name}-active-{turn - 1}") if turn else ():
                scratch.drop(old)
            turn, target = turn + 1, 4 * target
        return (found if found is not None else self.spark.createDataFrame([], FOUND)).withColumn("rank", F.row_number().over(ranked))

    def meet(self, asks: DataFrame, cuts: dict, k: int, same: bool) -> DataFrame:
        """The best of each block of candidates for each ask."""
        blocks = self.spark.createDataFrame([(c, cut[2], cut[3]) for c, cut in cuts.items()], "cluster int, cbs int, mbs int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        member = asks.join(F.broadcast(blocks), "cluster").withColumn("mb", F.pmod(F.xxhash64("member"), F.col("mbs")).cast("int")).withColumn("cb", each("cbs"))
        member = member.select("cluster", "mb", "cb", F.col("member").alias("uid"), F.col("own_id").alias("id"), "label", "x", "ask", "low", "high")
        none = [F.lit(None).cast(t).alias(c) for c, t in (("ask", "int"), ("low", "long"), ("high", "long"))]
        listed = self.part(cuts).withColumn("mb", each("mbs")).select("cluster", "mb", "cb", "uid", "id", "label", "x", *none)

        def match(t: pa.Table) -> pa.Table:
            t = t.combine_chunks()
            asking = t.column("ask").is_valid().to_numpy()
            asks, rows = t.take(pa.array(np.flatnonzero(asking))), t.take(pa.array(np.flatnonzero(~asking)))
            got: list[tuple] = []
            if asks.num_rows and rows.num_rows:
                word = {w: i for i, w in enumerate(set(t.column("label").to_pylist()))}
                labels, ids, uids = np.array([word[w] for w in rows.column("label").to_pylist()]), rows.column("id").to_numpy(), rows.column("uid").to_numpy()
                x = matrix_of(rows.column("x"))
                who, first, at = np.unique(asks.column("uid").to_numpy(), return_index=True, return_inverse=True)
                order = np.argsort(at, kind="stable")
                ends = np.cumsum(np.bincount(at, minlength=len(who)))
                number, low, high = (asks.column(c).to_numpy() for c in ("ask", "low", "high"))
                own_label, own_id = [word[w] for w in asks.column("label").to_pylist()], asks.column("id").to_numpy()
                a = matrix_of(asks.column("x").take(pa.array(first)))
                for start in range(0, len(who), MEMBERS_AT_ONCE):
                    score = scores_of(a[start : start + MEMBERS_AT_ONCE], x)
                    for m, s in enumerate(score, start):
                        one = first[m]
                        fits = np.flatnonzero((labels == own_label[one]) & (ids != own_id[one]) if same else labels != own_label[one])
                        own = s[fits]
                        for q in order[ends[m - 1] if m else 0 : ends[m]]:
                            use = fits[(own >= low[q]) & (own <= high[q])]
                            use = use[best_of(s[use], ids[use], k)]
                            got.append((np.full(len(use), who[m]), np.full(len(use), number[q]), s[use], ids[use], uids[use]))
            columns = [np.concatenate(c) for c in zip(*got, strict=True)] if got else [np.zeros(0, np.int64)] * 5
            return pa.table({"member": columns[0].astype(np.int64), "ask": columns[1].astype(np.int32), "score": columns[2], "id": columns[3], "uid": columns[4]})

        return member.unionByName(listed).groupBy("cluster", "mb", "cb").applyInArrow(match, FOUND)


FOUND = "member long, ask int, score long, id long, uid long"


def longest_square(batches):
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([float((matrix_of(b.column("x")).astype(np.float64) ** 2).sum(1).max())])], names=["n"])


def share_of(score: str, percent: int, up: bool) -> Column:
    """percent * score / 100, rounded up or down, in integers."""
    product = f"{score} * {-percent if up else percent}"
    floor = F.expr(f"({product} - pmod({product}, 100)) div 100")
    return (-floor if up else floor).cast("long")


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchors_a_list: int = 64, most_lists: int = 256, sample_anchors: int = 20_000, block_rows: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Components are floored
    after scaling; a score is the inner product with the anchor, an exact integer. An anchor's positives
    are its `positives` best rows of its label and of another id; for each, the `negatives` best rows of
    other labels whose score is `least` to `most` percent of the positive's. Equal scores come by the smaller id;
    an anchor without positives, and a positive without negatives, give no row.

    Rows with a null id, label or vector, with null or non-finite components, with components that
    scale beyond 2^27.5 / sqrt(length), or of another length than most vectors have take no part. Rows that repeat an id
    are rows of their own (each as an anchor too). Other columns are ignored; an empty table gives none."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    size = usual_length(vectors, vector_col)
    if not size:
        return spark.createDataFrame([], out)
    rows = scratch.write(packed(vectors, anchor, scale, size, id_col, vector_col, label_col), "rows")
    if rows.where("anchor").isEmpty():
        return spark.createDataFrame([], out)
    lists = Lists(scratch, rows, size, anchors_a_list, most_lists, sample_anchors, block_rows)
    top = 1 << 62
    asks = lists.anchors.select(F.col("uid").alias("member"), F.lit(0).alias("ask"), F.col("id").alias("own_id"), "label", "x", "cluster", "length", F.lit(-top).cast("long").alias("low"), F.lit(top).cast("long").alias("high"))
    near = lists.walk(asks, positives, True, "positives").select("member", F.col("rank").cast("int").alias("ask"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id"))
    asks = asks.drop("ask", "low", "high").join(near, "member").withColumn("low", share_of("positive_score", least, True)).withColumn("high", share_of("positive_score", most, False)).where("low <= high")
    asks = scratch.write(asks, "asks")
    found = lists.walk(asks.drop("positive_id", "positive_score"), negatives, False, "negatives")
    named = asks.select("member", "ask", F.col("own_id").alias("anchor_id"), "positive_id", "positive_score")
    return found.join(named, ["member", "ask"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
