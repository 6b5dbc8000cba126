"""N-gram Jaccard join (operator 3) with adaptive multi-match prefixes.

Two sets of which one has n shingles can only reach Jaccard t if they share ceil(t n) of them.
Under one order of all shingles, prefixes of n - ceil(t n) + k shingles then share at least k.
The order puts frequent shingles last: a pass over all texts finds them, and they are ranked by
how often they occur. k grows with the candidates that a prefix is estimated to bring, one for a
shingle that is not frequent and as many as its other texts for one that is: by one for every four
up to the prefix's size, and with the logarithm of what goes beyond. The prefix is lengthened by as
much, and a partner must share as many (the smaller k of both).

Documents with equal sets are one class; the join runs over classes. First, every class
is compared with the central classes of its prefix shingles, if they share enough; verified links
make components. Then, only classes of different components can still change the result. They meet
by a shingle of both unlengthened prefixes that is early enough in both to be the first in common
(shingles of just the same classes count as one), and become a pair only if two bounds that their rows carry allow it: a bitmap of each lengthened
prefix, by which they may share k shingles of these, and the parities of each whole set, by which
the sets may differ by little enough. The pairs left must then share k shingles, counted exactly,
before they are compared. So a group of thousands of near copies costs a few comparisons each, not
all its pairs; no link that changes a component is lost. Sets are compared whole and exactly on
64-bit shingle hashes. A class is known by 64 bits of hash and checked by 64 more: if two sets of
a class differ in these, all is done anew with another seed."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .runtime import Scratch, slices, text_buffer
from .shingles import class_hashes, parities, shingle_sets

HOT_LEAST, HOT_MOST, HOT_A_TASK = 8, 1 << 18, 1 << 17
ONCE_BITS = 1 << 27
COST = 256
EVERY = 4
SEEN_MOST = 1 << 20
BITS = 1 << 24
PARITY, PREFIX = 8, 4  # 64-bit words of a set's parities, of a prefix's bitmap
SEEDS = 4


def needed(n, percent: int):
    """Shingles that a partner of a set of n must share."""
    return -(-n * percent // 100)


class Fresh:
    """Classes that a task has not had yet, as far as it remembers. Forgetting costs repeated rows only."""

    def __init__(self):
        self.seen: set[int] = set()

    def mask(self, classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if len(self.seen) > SEEN_MOST:
            self.seen.clear()
        out = np.zeros(len(classes), bool)
        for i, c in enumerate(classes.tolist()):
            if sizes[i] and c not in self.seen:
                self.seen.add(c)
                out[i] = True
        return out


def describe(seed: int):
    """(id, text) to one row a document (id, n, cid, check, parities), and rows (token, seen) of shingles
    that several classes of the task share: its most frequent ones."""
    words = [f"o{i}" for i in range(PARITY)]
    names = ["id", "n", "cid", "token", "seen", "check", *words]

    def run(batches):
        fresh, kind = Fresh(), None
        once = np.zeros(ONCE_BITS >> 3, np.uint8)  # a bit a shingle, by hash: had before by a class of this task
        tokens, seen = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in slices(batches):
            kind = b.column(0).type
            value, sizes, classes = shingle_sets(*text_buffer(b.column(1)), seed)
            none = pa.nulls(b.num_rows, pa.int64())
            odd = parities(value, sizes, PARITY)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(classes), none, none, pa.array(class_hashes(value, sizes, seed + SEEDS)), *(pa.array(odd[:, i]) for i in range(PARITY))], names=names)
            new, count = np.unique(value[np.repeat(fresh.mask(classes, sizes), sizes)], return_counts=True)
            at, bit = (new >> np.uint64(3)) % np.uint64(len(once)), np.uint8(1) << (new & np.uint64(7)).astype(np.uint8)
            use = (count > 1) | (once[at] & bit > 0)
            np.bitwise_or.at(once, at, bit)
            new, count = new[use], count[use]
            both, where = np.unique(np.concatenate([tokens, new]), return_inverse=True)
            seen = np.bincount(where, weights=np.concatenate([seen, count]), minlength=len(both)).astype(np.int64)
            tokens = both
            if len(tokens) > HOT_A_TASK:
                top = np.sort(np.argpartition(-seen, HOT_A_TASK)[:HOT_A_TASK])
                tokens, seen = tokens[top], seen[top]
        if len(tokens):
            none = pa.nulls(len(tokens), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(tokens), kind), none, none, pa.array(tokens.view(np.int64)), pa.array(seen), *[none] * (PARITY + 1)], names=names)

    return run


def may_reach(percent: int) -> F.Column:
    """Whether a match of rows x and y can be one of the first k of a pair that reaches the similarity:
    with those before it and all that follows it in the smaller rest, there must be shingles enough."""
    k, rest = F.least("kx", "ky"), F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    enough = (k - 1 + rest) * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent
    return enough & (F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent)


def may_begin(percent: int) -> F.Column:
    """Whether a match of rows x and y can be the first of a pair that reaches the similarity: the
    match and all that follows it in the smaller rest must be shingles enough."""
    rest = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    return (rest * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent) & (F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent)


def may_share() -> F.Column:
    """Whether rows x and y may share k shingles of their lengthened prefixes: each common shingle has
    its bit in both bitmaps, and `twice` shingles of a prefix at most found theirs taken."""
    both = sum(F.bit_count(F.col(f"b{i}x").bitwiseAND(F.col(f"b{i}y"))) for i in range(PREFIX))
    return both + F.least("twicex", "twicey") >= F.least("kx", "ky")


def may_differ(percent: int) -> F.Column:
    """Whether the sets of rows x and y may reach the similarity: they differ in a shingle for each
    parity in which they differ, at least."""
    odd = sum(F.bit_count(F.col(f"o{i}x").bitwiseXOR(F.col(f"o{i}y"))) for i in range(PARITY))
    return odd * (100 + percent) <= (F.col("nx") + F.col("ny")) * (100 - percent)


def prefix(tokens: np.ndarray, frequency: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """(prefix, k) of one set; frequency is 0 for shingles that are not frequent."""
    n = len(tokens)
    share = needed(n, percent)
    size = n - share + 1
    order = np.lexsort((tokens, frequency))
    cost = int(np.maximum(frequency[order[:size]] - 1, 1).sum())
    k = 1 + min(cost, size) // EVERY
    if cost - size > COST:
        k += int(math.log2((cost - size) / COST) * max(1.0, size / 8))
    k = min(k, share, 2 * size)
    return tokens[order[: size + k - 1]], k


def prefixes(shared, percent: int, seed: int):
    """(text) to (token, cid, n, k, position of the token in its set's order), once a class and task.
    A prefix without frequent shingles costs as many candidates as it has shingles."""

    def run(batches):
        hot, often = shared.value
        fresh = Fresh()
        for b in slices(batches, 0):
            value, sizes, classes = shingle_sets(*text_buffer(b.column(0)), seed)
            new = fresh.mask(classes, sizes)
            value, sizes, classes = value[np.repeat(new, sizes)], sizes[new], classes[new]
            frequency = np.zeros(len(value), np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, value), len(hot) - 1)
                frequency = np.where(hot[at] == value, often[at], 0)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            calm = frequency == 0
            ends = np.cumsum(sizes)
            before = np.concatenate([[0], np.cumsum(calm)])
            share = needed(sizes, percent)
            length = sizes - share + 1
            match = np.minimum(1 + length // EVERY, share)
            length = length + match - 1
            rank = before[:-1] - before[ends - sizes][owner]
            plenty = before[ends] - before[ends - sizes] >= length
            take = calm & plenty[owner] & (rank < length[owner])
            out = [value[take]]
            of, k, position = [owner[take]], [match[owner[take]]], [rank[take]]
            for i in np.flatnonzero(~plenty):
                own = slice(ends[i] - sizes[i], ends[i])
                tokens, more = prefix(value[own], frequency[own], percent)
                out.append(tokens)
                of.append(np.full(len(tokens), i))
                k.append(np.full(len(tokens), more))
                position.append(np.arange(len(tokens)))
            of = np.concatenate(of)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(classes[of]), pa.array(sizes[of]), pa.array(np.concatenate(k)), pa.array(np.concatenate(position))], names=["token", "cid", "n", "k", "p"])

    return run


def shared_runs(batches):
    """Rows sorted by (token, cid) to those whose token several classes have, once a class. Only an
    open run's first row is kept from batch to batch."""
    names = ["token", "cid", "n", "k", "p"]
    first = None  # the open run's first row, whether it has been given out, and its last class
    for b in batches:
        rows = np.column_stack([b.column(i).to_numpy() for i in range(5)])
        if not len(rows):
            continue
        lead = first is not None
        if lead:  # the open run's first row stands before the batch
            rows = np.concatenate([first[0][None], rows])
        token, cid = rows[:, 0], rows[:, 1]
        start = np.ones(len(rows), bool)
        start[1:] = token[1:] != token[:-1]
        run = np.cumsum(start) - 1
        at = np.flatnonzero(start)
        before = np.concatenate([[cid[0]], cid[:-1]])
        if lead and len(cid) > 1:
            before[1] = first[2]
        use = ~start & (cid != before)
        several = np.bincount(run[use], minlength=len(at)) > 0
        heads = at[several]
        given = bool(lead and first[1])
        if given and len(heads) and heads[0] == 0:
            heads = heads[1:]
        taken = np.sort(np.concatenate([heads, np.flatnonzero(use)]))
        if len(taken):
            yield pa.RecordBatch.from_arrays([pa.array(rows[taken, i]) for i in range(5)], names=names)
        last = at[-1]
        first = (rows[last], bool(several[-1]) or (given and last == 0), cid[-1])


def sets_of(shared, seed: int):
    """(bit, text) of documents whose bit is set to (cid, shingles), once a class and task."""

    def run(batches):
        bits, fresh = shared.value, Fresh()
        for b in batches:
            bit = b.column(0).to_numpy()
            b = b.filter(pa.array((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1))
            for s in slices([b]):
                value, sizes, classes = shingle_sets(*text_buffer(s.column(1)), seed)
                ends = np.cumsum(sizes)
                use = np.flatnonzero(fresh.mask(classes, sizes))
                yield pa.RecordBatch.from_arrays([pa.array(classes[use]), pa.array([value[ends[i] - sizes[i] : ends[i]].tobytes() for i in use], pa.binary())], names=["cid", "tokens"])

    return run


def verified(percent: int):
    def run(batches):
        for b in batches:
            good = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                p, q = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                if len(p) > len(q):
                    p, q = q, p
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                good[i] = 100 * both >= percent * (len(p) + len(q) - both)
            yield b.select(["a", "b"]).filter(pa.array(good))

    return run


def star_pairs(matches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes, a few a class, from rows (token, cid, n, k, p).

    Classes of one grade are those whose sizes differ by less than the similarity allows: partners are
    of the same or the next grade. The head of a shingle and grade is the class whose shingles are the
    most shared: of near copies, the one that is nearest to most; the second such class is one for the
    head itself. Of the heads of its shingles, a class
    is paired with those that it meets k times, with the one that it meets most often, and with the one
    whose shingles are the most shared. What this misses is found by the join of all."""
    grade = F.floor(F.log("n") / math.log(100 / percent))
    by_token = Window.partitionBy("token")
    central = matches.withColumn("df", F.count("*").over(by_token)).groupBy("cid").agg(F.sum("df").alias("shared"))
    ranked = matches.join(central, "cid").withColumn("grade", grade).repartition("token")
    # One exchange by token serves both windows; each row brings its token's heads, two a grade.
    place = F.row_number().over(Window.partitionBy("token", "grade").orderBy(F.desc("shared"), F.desc("cid")))
    head = F.when(place <= 2, F.struct("grade", F.col("shared").alias("rank"), F.col("cid").alias("y"), F.col("n").alias("ny"), F.col("k").alias("ky"), F.col("p").alias("py")))
    rows = ranked.withColumn("head", head).withColumn("heads", F.collect_list("head").over(by_token))
    near = F.filter("heads", lambda h: (h["y"] != F.col("cid")) & (F.abs(h["grade"] - F.col("grade")) <= 1))
    asks = rows.select(*(F.col(c).alias(v) for c, v in (("cid", "x"), ("n", "nx"), ("k", "kx"), ("p", "px"))), F.explode(near).alias("h"))
    met = asks.select("x", "nx", "kx", "px", "h.*").where(may_reach(percent))
    met = met.groupBy("x", "y").agg(F.count("*").alias("both"), F.min(F.least("kx", "ky")).alias("k"), F.max("rank").alias("rank"))
    met = met.groupBy("x").agg(F.max_by("y", F.struct("rank", "y")).alias("top"), F.max_by("y", F.struct("both", "rank", "y")).alias("often"), F.collect_set(F.when(F.col("both") >= F.col("k"), F.col("y"))).alias("many"))
    return met.select("x", F.explode(F.array_union("many", F.array("top", "often"))).alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def plausible(pairs: DataFrame, classes: DataFrame, parity: list[str], percent: int) -> DataFrame:
    """The pairs (a, b) whose sets' parities leave the similarity within reach."""
    x, y = (classes.select(F.col("cid").alias(c), F.col("n").alias("n" + v), *(F.col(o).alias(o + v) for o in parity)) for c, v in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").where(may_differ(percent)).select("a", "b")


def ngram_join(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id. Texts that are null or have no words have
    no shingles and link with nothing. Repeated rows link with each other. Of null ids, component_id
    is the smallest id that is not null, if any. Other columns are ignored, whatever their names."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parity = [f"o{i}" for i in range(PARITY)]
    fields = f"id {id_type}, n long, cid long, token long, seen long, check long, {', '.join(f'{c} long' for c in parity)}"
    for seed in range(SEEDS):
        described = scratch.write(texts.mapInArrow(describe(seed), fields), f"described-{seed}")
        rows = described.where("cid is not null").select("id", "n", "cid")
        sets = described.where("n > 0").groupBy("cid").agg(F.min("id").alias("first"), F.min("n").alias("n"), (F.min("check") < F.max("check")).alias("clash"), *(F.min(c).alias(c) for c in parity))
        classes = scratch.write(sets, f"classes-{seed}")
        if classes.where("clash").isEmpty():
            break
    else:
        raise RuntimeError("sets of one class differ, whatever the seed")
    hot = described.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= HOT_LEAST)
    # At most HOT_MOST shingles, the most frequent: which ones only sets the order, not the result.
    found = hot.orderBy(F.desc("seen"), "token").limit(HOT_MOST).toArrow()
    tokens = found.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    shared = spark.sparkContext.broadcast((tokens[order], found.column("seen").to_numpy()[order]))

    fields = "token long, cid long, n long, k long, p long"
    dealt = texts.select("text").mapInArrow(prefixes(shared, percent, seed), fields).repartition("token").sortWithinPartitions("token", "cid")
    matches = scratch.write(dealt.mapInArrow(shared_runs, fields), "matches")

    stars = scratch.write(plausible(star_pairs(matches, percent), classes, parity, percent), "stars")
    links = verify(texts, classes, stars, scratch, "star", percent, seed)
    component = scratch.write(connected_components(links, scratch, "star-links"), "components")

    member = matches.join(component.withColumnRenamed("node", "cid"), "cid", "left").select("token", "cid", "n", "k", "p", F.coalesce("component", "cid").alias("c"))
    mixed = member.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("token")
    member = scratch.write(member.join(mixed, "token"), "mixed")
    # Of each class, the shingles of its lengthened prefix that others have, and a bitmap of these.
    bitmap = [f"b{i}" for i in range(PREFIX)]
    one = F.expr("shiftleft(1L, cast(pmod(token, 64) as int))")
    word = F.pmod(F.shiftright("token", 6), F.lit(PREFIX))
    lists = member.groupBy("cid").agg(F.first("k").alias("k"), F.count("*").alias("m"), F.collect_list("token").alias("tokens"), *(F.coalesce(F.bit_or(F.when(word == i, one)), F.lit(0)).alias(b) for i, b in enumerate(bitmap)))
    lists = scratch.write(lists.withColumn("twice", F.col("m") - sum(F.bit_count(b) for b in bitmap)), "lists")
    bounds = lists.drop("tokens", "m").join(classes.select("cid", *parity), "cid")
    # Shingles that the same classes have early are one for the join: near copies share long rows of
    # them. Two hashes over their classes and the number of these tell which are the same; the place
    # is that of the first, which for two classes that have it is that of the first in common.
    own = Window.partitionBy("token")
    early = member.where(F.col("p") * 100 <= F.col("n") * (100 - percent)).select("token", "cid", "n", "p", "c")
    early = early.withColumn("f", F.bit_xor(F.xxhash64("cid")).over(own)).withColumn("g", F.bit_xor(F.xxhash64("cid", F.lit(7))).over(own)).withColumn("m", F.count("*").over(own)).where("m > 1")
    early = early.groupBy("f", "g", "m", "cid").agg(F.min("p").alias("p"), F.first("n").alias("n"), F.first("c").alias("c")).join(bounds, "cid")
    x, y = (early.select("f", "g", "m", F.col("cid").alias(v), *(F.col(c).alias(c + v) for c in ("n", "p", "c", "k", "twice", *bitmap, *parity))) for v in ("x", "y"))
    met = x.join(y, ["f", "g", "m"]).where((F.col("cx") < F.col("cy")) & may_begin(percent) & may_share() & may_differ(percent))
    met = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    a, b = (lists.select(F.col("cid").alias(v), F.col("k").alias("k" + v), F.col("tokens").alias("t" + v)) for v in ("a", "b"))
    enough = F.size(F.array_intersect("ta", "tb")) >= F.least("ka", "kb")
    pairs = scratch.write(met.join(a, "a").join(b, "b").where(enough).select("a", "b"), "pairs")
    if not pairs.isEmpty():
        more = verify(texts, classes, pairs, scratch, "pair", percent, seed)
        stars_of = component.select(F.col("node").alias("a"), F.col("component").alias("b"))
        component = connected_components(stars_of.unionByName(more), scratch, "all-links")

    grouped = classes.join(component.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    lowest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    solved = scratch.write(grouped.join(lowest, "component").select("cid", "component_id"), "solved")
    for name in (f"classes-{seed}", "matches", "stars", "links-star", "components", "mixed", "lists", "pairs", "links-pair"):
        scratch.drop(name)
    out = rows.where("n > 0").join(solved, "cid").select("id", "n", "component_id").unionByName(rows.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def verify(texts: DataFrame, classes: DataFrame, pairs: DataFrame, scratch: Scratch, name: str, percent: int, seed: int) -> DataFrame:
    """The pairs (a, b) of classes that reach the similarity. Their sets are made anew from one text a
    class. A bitmap of fixed size, over hashes of those texts' ids, spares the other texts the work;
    the joins that follow are exact."""
    spark = texts.sparkSession
    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    bit = F.pmod(F.xxhash64("id"), F.lit(BITS)).cast("long")
    words = wanted.join(classes, "cid").select(F.expr(f"pmod(xxhash64(first), {BITS}L)").alias("bit")).select(F.shiftright("bit", 3).alias("at"), F.expr("shiftleft(1, cast(bit & 7 as int))").alias("one")).groupBy("at").agg(F.bit_or("one").alias("byte")).toArrow()
    bits = np.zeros(BITS >> 3, np.uint8)
    bits[words.column("at").to_numpy()] = words.column("byte").to_numpy()
    shared = spark.sparkContext.broadcast(bits)
    sets = scratch.write(texts.select(bit.alias("bit"), "text").mapInArrow(sets_of(shared, seed), "cid long, tokens binary"), f"sets-{name}")
    a, b = (sets.select(F.col("cid").alias(c), F.col("tokens").alias(f"tokens_{c}")) for c in ("a", "b"))
    found = pairs.join(a, "a").join(b, "b").select("a", "b", "tokens_a", "tokens_b").mapInArrow(verified(percent), "a long, b long")
    links = scratch.write(found, f"links-{name}")
    scratch.drop(f"sets-{name}")
    return links
