"""Whitening, fingerprints and hard negatives against brute force, with nulls, ties, repeated rows, empty
tables and columns of clashing names."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import queries as q
from ledgerloom.llm.eigen_contour import Contour, below
from ledgerloom.llm.embedding_dedup import near_dedup
from ledgerloom.llm.fingerprints import PLACES, fingerprint, minima, signatures
from ledgerloom.llm.hard_negatives import Lists, hard_negatives
from ledgerloom.llm.shingles import shingle_hashes, word_hashes
from ledgerloom.llm.whitening import whiten

VECTORS = "vec_id long, embedding array<float>, label int, score string, rank string, n string, x string"
TEXTS = "doc_id long, text string, sig string, cid string, part string"
ROOT = "/root/testdata/sf0.001"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "s", "r", "n", "x") for i, v, label in rows], VECTORS)


def mined(rows, every=100, scale=256):
    """Hard negatives by plain loops, on rows that take part."""
    x = {k: np.floor(scale * np.array(v, np.float32).astype(float)).astype(np.int64) for k, (_, v, _) in enumerate(rows)}
    out = []
    for k, (i, _, label) in enumerate(rows):
        if i % every:
            continue
        best = sorted((-int(x[k] @ x[m]), j) for m, (j, _, other) in enumerate(rows) if other == label and j != i)[:5]
        against = sorted((-int(x[k] @ x[m]), j) for m, (j, _, other) in enumerate(rows) if other != label)
        for p, j in best:
            fit = [(n, m) for n, m in against if 80 * -p <= 100 * -n <= 100 * -p][:5]
            out += [(i, j, r, m, -p, -n) for r, (n, m) in enumerate(fit, 1)]
    return sorted(out)


def clustered(seed=5, n=900, size=12):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, size))
    x = centres[rng.integers(6, size=n)] + 0.15 * rng.standard_normal((n, size))
    return [(i, [float(c) for c in np.float32(v)], int(rng.integers(4))) for i, v in enumerate(x)]


@pytest.mark.parametrize("block_rows", [None, 40])
def test_hard_negatives_are_those_of_plain_loops(spark, block_rows):
    rows = clustered()
    rows += [(2000 + i, rows[i][1], rows[i][2]) for i in range(120)]  # equal scores
    bad = [(None, rows[0][1], 1), (3000, None, 1), (3100, [None] * 12, 1), (3200, [float("nan")] * 12, 1), (3300, rows[0][1], None), (3400, [1.0], 2), (3500, [1e30] * 12, 1), (3600, [0.0] * 12, 1)]
    got = hard_negatives(vectors(spark, rows + bad), F.col("vec_id") % 100 == 0, anchors_a_list=3, block_rows=block_rows)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows + bad[-1:])


def test_a_member_stops_once_its_answer_is_certain(spark, monkeypatch):
    sent, part = [], Lists.part

    def counted(self, cuts):
        sent.append(sum(int(self.held[c, low:high].sum()) for c, (low, high, *_) in cuts.items()))
        return part(self, cuts)

    monkeypatch.setattr(Lists, "part", counted)
    rows = clustered(n=1500)
    got = hard_negatives(vectors(spark, rows), F.col("vec_id") % 100 == 0, anchors_a_list=2, block_rows=60)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows)
    lists = 15 // 2
    assert sum(sent) < 2 * lists * len(rows) / 2  # of both walks, less than half of the lists


def test_hard_negatives_of_nothing(spark):
    for rows in ([], [(1, [1.0], 1)], [(100, None, 1)], [(100, [1.0, 2.0], 1)]):
        assert hard_negatives(vectors(spark, rows), F.col("vec_id") % 100 == 0).collect() == []


def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 30):
        m = rng.standard_normal((n, n))
        m = m + m.T
        for s in rng.standard_normal(9) * 3:
            assert below(m, s) == int((np.linalg.eigvalsh(m) < s).sum())
    assert below(np.zeros((3, 3)), 0.5) == 3 and below(np.array([[0.0, 1.0], [1.0, 0.0]]), 0) == 1


@pytest.mark.parametrize("kind", ["random", "equal", "clusters", "deficient", "ladder"])
def test_contour_finds_the_largest_pairs(spark, kind):
    rng = np.random.default_rng(2)
    a = rng.standard_normal((40, 60))
    turn = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    v = {"random": a @ a.T, "equal": np.eye(40), "clusters": turn @ np.diag([9.0] * 18 + [2.0] * 20 + [1e-3] * 2) @ turn.T,
         "deficient": np.eye(40) - np.ones((40, 40)) / 40, "ladder": turn @ np.diag(10.0 ** -(np.arange(40) / 5)) @ turn.T}[kind]
    v = (v + v.T) / 2
    value, vector = Contour(spark, v).largest(32, np.abs(v).sum(1).max() * 2.0**-36)
    want = np.linalg.eigvalsh(v)[::-1][:32]
    assert len(value) == 32 and np.abs(value - want).max() < 1e-13 * want[0]
    assert np.abs(vector.T @ vector - np.eye(32)).max() < 1e-13 and np.abs(v @ vector - vector * value).max() < 1e-13 * want[0]


def test_contour_is_not_stretched_by_outliers(spark):
    rng = np.random.default_rng(5)
    spectrum = np.array([400.0, 130.0] + [60.0] * 30 + list(np.linspace(10, 59, 32)))
    turn = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    v = (turn * spectrum) @ turn.T
    v = (v + v.T) / 2
    value, vector = Contour(spark, v).largest(32, np.abs(v).sum(1).max() * 2.0**-36)
    assert np.abs(value - spectrum[:32]).max() < 1e-10 and np.abs(v @ vector - vector * value).max() < 1e-10


def test_whitening_is_that_of_a_dense_solver(spark):
    rng = np.random.default_rng(3)
    base = (rng.standard_normal((300, 9)) @ rng.standard_normal((9, 9))).astype(np.float32)
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(base)] + [(5, [float(c) for c in base[7]], 2), (None, [float(c) for c in base[8]], 2)]
    odd = [(900, None, 1), (901, [None] * 9, 1), (902, [float("inf")] * 9, 1), (903, [1.0], 1), (904, [], 1)]
    got = whiten(vectors(spark, rows + odd)).toPandas()
    x = np.floor(64 * np.array([r[1] for r in rows])).astype(np.int64) + 1_000_000
    n = len(x)
    d = n * x - x.sum(0)
    v = (d / n).T @ (d / n) / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    want = (d / n) @ u / np.sqrt(e)
    assert len(got) == n * 9 and set(got.n) == {n}
    for k in range(9):
        own = got[got.component == k + 1]
        assert np.abs(own.explained - e[k] / e.sum()).max() < 1e-12
        near = min(np.abs(np.sort(own.whitened.to_numpy()) - np.sort(s * want[:, k])).max() for s in (1, -1))
        assert near < 1e-9
    assert sorted(got[got.component == 1].deviation) == sorted((d**2).sum(1)) and got.identity_error.max() < 1e-10
    assert got[got.component == 3].vec_id.isna().sum() == 1 and (got[got.component == 3].vec_id == 5).sum() == 2


def test_whitening_of_little(spark):
    assert whiten(vectors(spark, [])).count() == 0 and whiten(vectors(spark, [(1, [1.0, 2.0], 1)])).count() == 0
    assert whiten(vectors(spark, [(1, [1.0, 2.0], 1)] * 3)).count() == 0
    two = whiten(vectors(spark, [(1, [1.0, 2.0], 1), (2, [3.0, 2.0], 1)])).toPandas()
    assert two.component.tolist() == [1, 1] and np.allclose(two.whitened.abs(), 1) and two.explained.tolist() == [1.0, 1.0]
    wide = spark.createDataFrame([(1, [6e16, 0.0]), (2, [-6e16, 1.0]), (3, [5.0, 2.0])], "vec_id long, embedding array<double>")
    assert whiten(wide).toPandas().deviation.isna().sum() == 2  # beyond 64 bits: two rows, one component with variance


def test_links_of_very_small_and_large_vectors(spark):
    rows = [(1, [1e-200, 2e-200]), (2, [1e-200, 2e-200]), (3, [1e200, 2e200]), (4, [2e200, 4e200]), (5, [1.0, 2.0]), (6, [2.0, 4.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    assert {(r.n_links, r.component_id) for r in near_dedup(df).collect()} == {(5, 1)}


def prints(texts):
    """(sha of the edited text, Jaccard with it, Jaccard with the next), by plain loops."""
    def shingles(t):
        w = t.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    out = []
    for i, t in enumerate(texts):
        n, after = len(t), texts[(i + 1) % len(texts)]
        edited = t[: n - n // 2] + after[: n // 2]
        sets = [shingles(s) for s in (t, edited, after)]
        jaccard = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        out.append((hashlib.sha256(edited.encode()).hexdigest(), *jaccard))
    return out


def test_fingerprints_follow_the_next_document_and_the_similarity(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rnd.choices(words, k=rnd.choice([0, 1, 3, 8, 60, 400]))) for _ in range(150)] + ["", "é" * 7, "日本 語 🙂 x y z"]
    texts[20] = texts[21] = texts[70]
    rows = [(3 * i, t, "a", "b", "c") for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    got = fingerprint(spark.createDataFrame(rows, TEXTS).repartition(5)).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == [3 * i for i in range(len(texts))] and [r.n_chars for r in got] == [len(t) for t in texts]
    want = prints(texts)
    assert [r.edited_sha256 for r in got] == [w[0] for w in want]
    for r, (_, edited, after) in zip(got, want, strict=True):
        assert abs(r.near_edited - edited) < 0.2 and abs(r.near_next - after) < 0.2
        assert len(r.fingerprint) == len(r.edited_fingerprint) == 4 * PLACES
    assert len({r.fingerprint for r in got}) == len({" ".join(t.split()) for t in texts})
    assert got[20].near_next == 1.0


def test_near_groups_are_those_of_the_jaccard_similarity(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    base = [rnd.choices(words, k=80) for _ in range(4)]
    texts = [" ".join(rnd.choice(words) if rnd.random() < 0.015 else w for w in rnd.choice(base)) for _ in range(160)] + [" ".join(rnd.choices(words, k=50)) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in enumerate(texts)], TEXTS)
    got = {r.doc_id: r.component_id for r in fingerprint(df).collect()}
    assert got == {r.doc_id: r.component_id for r in q.ngram_join(df.select("doc_id", "text")).collect()}


def test_fingerprints_of_odd_tables(spark):
    make = lambda rows: {(r.doc_id, r.n_chars): r for r in fingerprint(spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], TEXTS)).collect()}
    assert make([]) == {}
    one = make([(7, "a b c d e f")])[7, 11]
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a b c a b c"[:6] + b"a b c").hexdigest()
    odd = make([(None, "a b c d e f"), (None, None), (1, ""), (1, "z"), (2, " \n")])
    assert len(odd) == 5 and odd[None, 0].near_next in (0.0, 1.0) and odd[2, 2].n_shingles == 0


def test_hash_functions_by_plain_loops():
    value = np.arange(1, 200_001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.array([0, 150_000, 0, 1, 49_999, 0])
    got, at = minima(value, counts), 0
    from ledgerloom.llm.fingerprints import FACTORS, TERMS
    for i, n in enumerate(counts):
        for p in (0, 77):
            own = [(int(v) * int(FACTORS[p]) + int(TERMS[p])) % 2**64 for v in value[at : at + n]]
            assert int(got[i, p]) == (min(own) if own else 2**64 - 1)
        at += n
    assert (signatures(value, counts)[[0, 2, 5]] == 0).all() and (signatures(value, counts)[1] > 0).all()


def test_words_cut_by_pieces_hash_alike():
    raw = np.frombuffer("one TWO  thrée\nfour five six".encode() * 3, np.uint8)
    offsets = np.array([0, len(raw) // 3, len(raw)])
    whole = word_hashes(raw, offsets)
    for piece in (1, 2, 5, 1000):
        part = word_hashes(raw, offsets, piece)
        assert (part[0] == whole[0]).all() and (part[1] == whole[1]).all()
    assert len(shingle_hashes(raw, offsets)[0]) == shingle_hashes(raw, offsets)[1].sum()


def test_queries_as_registered(spark):
    n = spark.read.parquet(f"{ROOT}/embeddings.parquet").count()
    white = q.op11_whitening(spark, ROOT)
    assert white.count() == 32 * n and white.agg(F.max("identity_error")).head()[0] < 1e-4
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").count()
    made = q.op12_fingerprints(spark, ROOT).toPandas()
    assert len(made) == docs and (made.near_edited > made.near_next).mean() > 0.9
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{ROOT}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in q.op13_hard_negatives(spark, ROOT).collect()) == mined(rows)
