"""Odd input of the operators (nulls, repeats, ties, empty tables, names that clash), and what SQL cannot
express against plain loops."""

import json
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import queries as q
from ledgerloom.llm.chat_format import format_chats, loss_text, records_of_rows, turns_of
from ledgerloom.llm.embedding_dedup import Index, near_dedup
from ledgerloom.llm.exact_dedup import exact_dedup
from ledgerloom.llm.ngram_join import ngram_join
from ledgerloom.llm.packing import pack
from ledgerloom.llm.quality_mil import Network, fit_quality, passage_features, score_quality
from ledgerloom.llm.sentencepiece_codec import decode_ids, encode_texts
from ledgerloom.llm.shingles import class_hashes, parities
from ledgerloom.llm.token_output import INDEX, lookup, read_token_shards, with_global_start, write_token_shards
from ledgerloom.llm.toxicity import FEATURES, NEAR, Features, fit_toxicity, score_toxicity
from ledgerloom.llm.url_filter import filter_urls
from ledgerloom.llm.word_traits import SECOND_PERSON, TraitCache, traits
from ledgerloom.llm.words import WordMemory, spread

from test_operators import brute_components, frame

TOKENS = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def words():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(q.tokenizer_path(TOKENS))


def test_urls_repeat_and_rules_tie(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x/y", "v")] * 2 + [(None, "http://a.org/x/y", "v"), (3, "http://a.org/", "v")], "page_id long, url string, verdict string")
    rules = spark.createDataFrame([("a.org", "/x", "allow"), ("a.org", "/x", "allow"), ("org", "/x/y", "allow"), ("a.org", "/x", "block"), ("A.org", None, "block")], "host string, path string, verdict string")
    got = Counter((r.page_id, r.rule, r.verdict) for r in filter_urls(pages, rules).collect())
    assert got == Counter({(1, "a.org/x", "block"): 2, (None, "a.org/x", "block"): 1, (3, "a.org", "block"): 1})


def test_odd_vectors(spark):
    inf, v = float("inf"), [1.0, 0.0, 0.5]
    rows = [(1, v, 0, 9), (1, v, 0, 9), (2, [1.0, 0.001, 0.5], 0, 9), (3, [], 0, 9), (4, [inf, 0.0, 1.0], 0, 9), (5, [None, 1.0, 0.0], 0, 9), (6, [1.0, 0.0], 0, 9), (7, [1.0, 0.0], 0, 9), (None, v, 0, 9), (8, v, 1, 9)]
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, cid long")).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False), (0, 3, 1, False), (8, 0, 8, True)], key=str)


def test_code_distances():
    rng = np.random.default_rng(3)
    ix = Index(np.zeros((1, 10)), rng.normal(size=(4, 8, 3)), np.zeros((1, 1)))
    x = rng.normal(size=(50, 10))
    parts = np.pad(x, ((0, 0), (0, 2))).reshape(50, 4, 3)
    plain = np.array([[[((p - w) ** 2).sum() for w in ix.words[m]] for m, p in enumerate(row)] for row in parts])
    codes, error = ix.encode(x)
    assert np.allclose(ix.tables(x), plain) and (codes == plain.argmin(2)).all() and np.allclose(error, np.sqrt(plain.min(2).sum(1)))


def test_sets_of_odd_documents(spark):
    long = " ".join(f"w{i % 7}" for i in range(30_000)) + " " + " ".join(f"x{i}" for i in range(40_000))
    texts = [(1, long), (2, long + " end"), (3, "a b c d e f"), (3, "A b c d e f"), (4, None)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(frame(spark, texts)).collect())
    sizes = brute_components([(1, long), (2, long + " end")])
    assert got == Counter([(1, sizes[1][0], 1), (2, sizes[2][0], 1), (3, 2, 3), (3, 2, 3), (4, 0, 4)])
    nulls = ngram_join(frame(spark, [(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f")])).collect()
    assert {r.component_id for r in nulls} == {7}


def test_bounds_of_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 62, rng.integers(1, 300)).astype(np.uint64)) for _ in range(40)]
    sets += [np.sort(np.concatenate([s[5:], s[:0]])) for s in sets if len(s) > 9]
    sizes = np.array([len(s) for s in sets])
    odd = parities(np.concatenate(sets), sizes, 8).view(np.uint64)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            assert int(np.bitwise_count(odd[i] ^ odd[j]).sum()) <= len(np.setxor1d(a, b))
    one, two = (class_hashes(np.concatenate(sets), sizes, s) for s in (0, 1))
    assert len(set(one.tolist())) == len(sets) and (one != two).all()


def test_words_are_remembered():
    made = []

    def make(words):
        made.extend(words)
        return np.concatenate([np.full(len(w), len(w)) for w in words]), [len(w) for w in words]

    memory = WordMemory(make, np.uint32, limit=200)
    for some in (["a", "bcd"], ["bcd", "ef"], ["x" * 90], ["a"]):
        flat, starts, sizes = memory.of(pa.array(some, pa.large_string()))
        assert spread(flat, starts, sizes, 1).tolist() == [len(w) for w in some for _ in w]
    assert made == ["a", "bcd", "ef", "x" * 90, "a"]


def test_chats_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, 0, None, None), (1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (1, 0, "assistant", "a"), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: ([tuple(t) for t in r.t], r.loss) for r in format_chats(records_of_rows(rows), "conv_id", "record").select("conv_id", turns_of(F.col("formatted")).alias("t"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert got == {1: ([("", ""), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")], "aab"), None: ([("user", "x")], "")}
    assert format_chats(records_of_rows(rows.where("false")), "conv_id", "record").count() == 0
    same = spark.createDataFrame([(1, json.dumps({"prompt": "p", "completion": "c"}), "l", 5)] * 2, "id long, record string, layout string, n_turns int")
    assert [(r.layout, r.n_turns) for r in format_chats(same, "id", "record").collect()] == [("prompt_completion", 2)] * 2


def test_codec_of_odd_rows(spark):
    model = q.tokenizer_path("piece_bpe_32k.model")
    assert decode_ids(encode_texts(frame(spark, []), model), model).count() == 0
    assert [(r.doc_id, r.text) for r in decode_ids(encode_texts(frame(spark, [(None, "a b")]), model), model).collect()] == [(None, "a b")]


def test_token_files(spark, words, tmp_path):
    write_token_shards(frame(spark, []), str(tmp_path / "none"), q.tokenizer_path(TOKENS), 2)
    assert with_global_start(read_token_shards(spark, str(tmp_path / "none"))).count() == 0
    texts = [(i, f"number {i} " * (i % 5)) for i in range(300)] + [(7, "again")] * 40 + [(None, "lost")]
    path = str(tmp_path / "many")
    write_token_shards(frame(spark, texts), path, q.tokenizer_path(TOKENS), 70_000, bytes_a_file=1500, id_bytes=4)
    encode = lambda t: [*words.encode(t, add_special_tokens=False).ids, 70_000]
    rows = sorted(with_global_start(read_token_shards(spark, path), files_a_block=2).collect(), key=lambda r: r.start)
    at = 0
    for r, (i, t) in zip(rows, sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1])), strict=True):
        assert (r.id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(encode(t)), zlib.crc32(np.array(encode(t), "<u4")))
        at += r.n_tokens
    asked = spark.createDataFrame([(7,), (150,), (900,), (None,)], "k long")
    found = lookup(spark, path, asked, "k")
    assert Counter((r.key, tuple(r.ids)) for r in found.collect()) == Counter([(7, tuple(encode(dict(texts[:8])[7]))), (150, tuple(encode(texts[150][1]))), *[(7, tuple(encode("again")))] * 40])
    index = spark.read.parquet(f"{path}/{INDEX}").collect()
    may = {r.path for r in index if r.low is not None and any(r.low <= k <= r.high for k in (7, 150, 900))}
    assert {f.rsplit("/", 1)[-1] for f in found.inputFiles()} <= {p.rsplit("/", 1)[-1] for p in may} or len(may) < len({r.path for r in index})


def test_pieces_by_document(spark, words):
    texts = [(1, "a b c " * 900), (2, None), (2, "again"), (None, "lost"), (3, "x" * 9000)]
    rows = pack(frame(spark, texts), q.tokenizer_path(TOKENS), 1, size=64).collect()
    want = Counter()
    for i, t in texts:
        ids = np.array([*words.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        pieces = [r for r in rows if r.doc_id == i and r.doc_tokens == len(ids)]
        assert sum(r.length for r in pieces) == len(ids)
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length])
        want[i] += len(pieces)
    assert sum(want.values()) == len(rows)
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in sorted(w)) <= 64 for w in windows.values())


def test_equal_texts_of_odd_rows(spark):
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(frame(spark, [(None, "a"), (None, "a"), (1, "a "), (1, "a")])).collect())
    assert got == Counter([(None, 1, 3, False), (None, 1, 3, False), (1, 1, 1, True), (1, 1, 3, True)])


ODD = ["You are LOUD!!", "plain words", "", "b4d w0rd $$ you", "a" * 300, "YOU you\n" * 40 + "x ..."]


def test_toxicity_features_by_plain_loops():
    weights = {"loud": 3.5, "wor*": 1.0, "b4d": 2.0}
    x = Features(weights).of(pa.array(ODD))
    for row, text in zip(x, ODD, strict=True):
        parts = text.split()
        t = [traits(w) for w in parts]
        core = [w.strip("\"'()[]{}.,;:!?*#%&$-|").lower() for w in parts]
        found = [max((v for k, v in weights.items() if len(c) > 2 and (c == k or (k.endswith("*") and len(c) >= len(k) - 1 and c[: len(k) - 1] == k[:-1] and len(k) - 1 in (4, 5, 6)))), default=0.0) for c in core]
        n = max(1, len(parts))
        person = [c in SECOND_PERSON for c in core]
        near = sum(w >= 1.5 and any(person[max(0, i - NEAR) : i + NEAR + 1]) for i, w in enumerate(found))
        chars, letters = max(1, sum(map(len, parts))), max(1, sum(c.isalpha() for w in parts for c in w))
        want = [math.log1p(len(parts)), sum(w >= 3 for w in found), sum(w >= 3 for w in found) / n, sum(w >= 1.5 for w in found), sum(w >= 1.5 for w in found) / n, sum(found) / n, max(found, default=0), near, near / n, sum(person) / n,
                sum(a[6] for a in t) / n, sum(c.isupper() for w in parts for c in w) / letters, sum(w.count("!") + w.count("?") for w in parts) / n, sum(not c.isalnum() for w in parts for c in w) / chars, sum(c.isdigit() for w in parts for c in w) / chars, sum(a[11] for a in t) / n, sum(a[10] for a in t) / n, sum(map(len, parts)) / n]
        assert np.allclose(row, want, atol=1e-5), dict(zip(FEATURES, zip(row, want, strict=True), strict=True))


def test_attention_by_plain_loops():
    x, passages = passage_features(TraitCache(), pa.array([*ODD, "w " * 200]))
    assert passages.tolist() == [1, 1, 1, 1, 1, 2, 4]
    rng = np.random.default_rng(2)
    d, h, g = x.shape[1], 5, 3
    p = {"w": rng.normal(size=(d, h)), "b": rng.normal(size=h), "v": rng.normal(size=(h, g)), "u": rng.normal(size=(h, g)), "a": rng.normal(size=g), "c": rng.normal(size=h), "d": rng.normal(size=1)}
    net = Network(p, x.mean(0), x.std(0) + 1e-3)
    score, _ = net.forward(x, passages)
    at = 0
    for s, n in zip(score, passages, strict=True):
        hidden = [np.tanh(np.clip((row - net.mean) / net.std, -8, 8) @ p["w"] + p["b"]) for row in x[at : at + n]]
        e = np.exp([sum(p["a"][k] * math.tanh(z @ p["v"][:, k]) / (1 + math.exp(-(z @ p["u"][:, k]))) for k in range(g)) for z in hidden])
        z = sum(w * row for w, row in zip(e / e.sum(), hidden, strict=True))
        assert abs(s - 1 / (1 + math.exp(-(z @ p["c"] + p["d"][0])))) < 1e-9
        at += n
    label = np.array([0, 1, 1, 0, 1, 0, 1.0])
    loss = lambda: -np.mean(label * np.log(net.forward(x, passages)[0]) + (1 - label) * np.log(1 - net.forward(x, passages)[0]))
    for k, slope in net.gradients(x, passages, label).items():
        place = tuple(0 for _ in p[k].shape)
        kept = p[k][place]
        p[k][place] = kept + 1e-6
        up = loss()
        p[k][place] = kept - 1e-6
        down = loss()
        p[k][place] = kept
        assert abs(slope[place] - (up - down) / 2e-6) < 1e-5, k


def test_classifiers_by_recall_and_precision(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for query, label, recall, precision in ((q.op8_toxicity, "toxic", 0.7, 0.8), (q.op9_quality, "quality", 0.9, 0.9)):
        held = [(r.predicted, labels[r.doc_id][label]) for r in query(spark, sf).collect() if r.held_out and r.doc_id in labels]
        both = sum(a == b == 1 for a, b in held)
        assert both >= recall * sum(b for _, b in held) and both >= precision * sum(a for a, _ in held)


def test_one_label_and_repeated_rows(spark):
    docs = frame(spark, [(1, "a b"), (1, "a b"), (None, "a b"), (2, None)])
    ones = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (None, 0, 0)], "doc_id long, toxic int, quality int")
    for fit, score in ((fit_toxicity, score_toxicity), (fit_quality, score_quality)):
        got = score(docs, fit(docs, ones)).collect()
        assert Counter(r.doc_id for r in got) == Counter([1, 1, None, 2]) and {r.score for r in got} == {1.0}
