"""Operators against brute force on small fixtures, with nulls, empty tables, ties, repeated rows and
columns of clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import queries as q
from ledgerloom.llm.chat_format import PARSER_LIMIT, format_chats, loss_text, records_of_rows, turns_of
from ledgerloom.llm.embedding_dedup import near_dedup
from ledgerloom.llm.exact_dedup import CHUNK, PRIMES, combine, exact_dedup, fingerprints
from ledgerloom.llm.ngram_join import ngram_join
from ledgerloom.llm.packing import pack
from ledgerloom.llm.quality_mil import WIDTH, fit_quality, score_quality
from ledgerloom.llm.sentencepiece_codec import SPACE, UNKNOWN_PENALTY, decode_ids, encode_texts
from ledgerloom.llm.token_output import Shard, lookup, read_token_shards, shard_bytes, with_global_start, write_token_shards
from ledgerloom.llm.toxicity import fit_toxicity, score_toxicity
from ledgerloom.llm.url_filter import filter_urls

SCHEMA = "doc_id long, text string, sha string, component string, label string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in texts], SCHEMA)


def near_copies(seed=3):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = rnd.choices(words, k=30)
    base = rnd.choices(words, k=60)
    out = []
    for i in range(60):
        t = list(base)
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(60)] = rnd.choice(words)
        out.append(" ".join(t))
    out += [" ".join(passage + rnd.choices(words, k=rnd.randint(0, 40))) for _ in range(60)]
    out += [" ".join(rnd.choices(words, k=rnd.randint(1, 12))) for _ in range(30)] + ["a b c", "A\tB\nc", "a b", "", None, " \n", out[0], out[0], "Ä b c d e f", "ä b c d e f"]
    return list(enumerate(out))


def brute_components(texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_ngram_join(spark):
    texts = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(frame(spark, texts).repartition(5)).collect()}
    assert got == brute_components(texts)
    assert ngram_join(frame(spark, [])).count() == 0


def test_exact_dedup(spark):
    texts = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, "x" * (3 * CHUNK + 5)), (7, "x" * (3 * CHUNK + 5)), (8, "x" * (3 * CHUNK + 4) + "y"), (2, "a"), (None, "q")]
    got = exact_dedup(frame(spark, texts)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == Counter([(1, 2, 3, False), (2, 2, 3, True), (2, 2, 3, False), (3, 3, 1, True), (4, 5, 2, False), (5, 5, 2, True), (6, 7, 2, False), (7, 7, 2, True), (8, 8, 1, True), (None, None, 1, True)])
    assert exact_dedup(frame(spark, [])).count() == 0


def test_fingerprints_combine():
    data = np.random.default_rng(1).integers(0, 256, 2 * CHUNK + 77).astype(np.uint8)
    for which in range(len(PRIMES)):
        whole, left, right = (int(fingerprints(x, np.array([0, len(x)]))[which][0]) for x in (data, data[:1000], data[1000:]))
        assert whole == combine(left, 1000, right, which)


def test_url_filter(spark):
    urls = ["http://a.org/x", "https://example.org/es/1?q", "http://deep.EXAMPLE.org/en/12#f", "http://example.org", "ftp://notexample.org/es/", "x", None, "http://fr.com/fr/", "http://a.com/de/z"]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(q.URL_RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in filter_urls(pages, rules, rows_per_range=2).collect()}
    assert got == {0: ("org/", "allow"), 1: ("example.org/es/", "block"), 2: ("example.org/en/1", "block"), 3: (None, "allow"), 4: ("org/", "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: ("com/fr/", "allow"), 8: ("com/de/", "block")}
    assert filter_urls(pages.limit(0), rules).count() == 0
    assert filter_urls(pages, rules.limit(0)).where("rule is null").count() == len(urls)


def test_chat_layouts(spark):
    nasty = r"<|im_end|> \ <\| \\<|" + "\nü"
    import json

    records = [json.dumps(x) for x in ({"messages": [{"role": "user", "content": nasty}, {"role": "assistant", "content": nasty}], "id": 3}, {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}, {"instruction": "do", "input": "", "output": "done"}, {"prompt": "p", "completion": "c"}, {"other": 1}, {"messages": []})] + [None, "{broken"]
    out = format_chats(spark.createDataFrame(list(enumerate(records)), "id long, record string"), "id", "record")
    got = {r.id: ([tuple(t) for t in r.t], r.loss, r.layout) for r in out.select("id", "layout", turns_of(F.col("formatted")).alias("t"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert got[0] == ([("user", nasty), ("assistant", nasty)], nasty, "messages")
    assert got[1] == ([("user", "hi"), ("assistant", "yo")], "yo", "conversations")
    assert got[2] == ([("user", "do"), ("assistant", "done")], "done", "instruction_input")
    assert got[3][1] == "c"
    assert all(got[i] == ([], "", None) for i in (4, 5, 6, 7))


def test_chats_of_any_size(spark):
    long = F.repeat(F.lit("<|"), PARSER_LIMIT // 2 + 1)
    rows = spark.range(3).select(F.expr("id div 2").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.when(F.col("id") == 1, long).otherwise("hi").alias("text"))
    got = {r.conv_id: r for r in format_chats(records_of_rows(rows), "conv_id", "record").select("conv_id", "layout", "n_turns", F.length("formatted").alias("n"), F.sha2(loss_text(F.col("formatted"), F.col("loss_spans")), 256).alias("said")).collect()}
    assert [(got[i].layout, got[i].n_turns) for i in (0, 1)] == [("messages", 2), ("messages", 1)]
    assert got[0].said == hashlib.sha256(b"hi" + b"<|" * (PARSER_LIMIT // 2 + 1)).hexdigest()
    assert got[0].n == 2 * 33 + 2 + 3 * (PARSER_LIMIT // 2 + 1) and got[1].n == 33 + 2
    text = F.concat(F.lit('{"prompt": "p", "completion": "'), F.repeat(F.lit("x"), PARSER_LIMIT + 1), F.lit('"}'))
    rows = spark.range(2).select("id", F.when(F.col("id") == 0, text).otherwise('{"prompt": "p", "completion": "c"}').alias("record"))
    got = [(r.layout, r.n_turns, r.reason and r.reason[:19]) for r in format_chats(rows, "id", "record").select("id", "layout", "n_turns", "reason").orderBy("id").collect()]
    assert got[0] == (None, 0, "record too large to") and got[1][0] is not None and got[1][1:] == (2, None)


def test_typed_chats(spark):
    pair = spark.createDataFrame([(1, ("do", "x", "done")), (2, ("do", None, "done")), (3, None)], "id long, record struct<instruction:string,input:string,output:string>")
    got = {r.id: (r.layout, [tuple(t) for t in r.t]) for r in format_chats(pair, "id", "record").select("id", "layout", turns_of(F.col("formatted")).alias("t")).collect()}
    assert got == {1: ("instruction_input", [("user", "do\n\nx"), ("assistant", "done")]), 2: ("instruction_input", [("user", "do"), ("assistant", "done")]), 3: (None, [])}
    other = spark.createDataFrame([(1, ([("a", "b")],))], "id long, record struct<chat:array<struct<role:string,content:string>>>")
    assert [(r.layout, r.n_turns) for r in format_chats(other, "id", "record").collect()] == [(None, 0)]


def test_embedding_dedup(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16))
    rows = []
    for i in range(240):
        v = (centres[i % 6] + rng.normal(size=16) * 0.12).astype(np.float32)
        rows.append((i, [float(x) for x in v], i % 2))
    rows += [(240, rows[0][1], 0), (241, rows[0][1], None), (242, None, 0), (243, [0.0] * 16, 0), (244, [float("nan")] * 16, 0), (245, [2 * x for x in rows[0][1]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_dedup(df, rows_a_list=30, block_rows=25).collect()}
    good = {i: np.array(v) / np.linalg.norm(v) for i, v, lab in rows if v and lab is not None and np.isfinite(v).all() and any(v)}
    lab = {i: x for i, _, x in rows}
    links = {i: {j for j in good if j != i and lab[i] == lab[j] and good[i] @ good[j] >= 0.98} for i in good}
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert got[i] == (len(links.get(i, ())), min(seen))
    assert near_dedup(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def words():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(q.tokenizer_path("word_bpe_49k.json"))


ODD = [(5, "Hello <|endoftext|> it's"), (1, None), (2, ""), (9, "a\x01b \x01 c\x0bd\x0ce\u0085f g"), (3, "x" * 5000 + " " + "yz " * 3000), (7, "日本 é́ ﬁ ÄÖ"), (7, "again"), (8, "  lead\n\ntrail  ")]


def test_tokens(spark, words, tmp_path):
    path = str(tmp_path / "shards")
    write_token_shards(frame(spark, ODD), path, q.tokenizer_path("word_bpe_49k.json"), 2)
    rows = sorted(with_global_start(read_token_shards(spark, path)).collect(), key=lambda r: r.start)
    want, at = [], 0
    for i, t in sorted(ODD, key=lambda x: (x[0], x[1] or "")):
        ids = np.array([*words.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    assert [(r.id, r.start, r.n_tokens, r.ids_crc32) for r in rows] == want
    found = {r.key: r.ids for r in lookup(spark, path, spark.createDataFrame([(5,), (4,), (1,)], "k long"), "k").collect()}
    assert found == {5: [*words.encode(ODD[0][1], add_special_tokens=False).ids, 2], 1: [2]}


def test_perfect_hash():
    keys = np.random.default_rng(2).choice(10**12, 3000, replace=False)
    s = Shard(shard_bytes(keys, np.ones(3000), np.full(3000, 2), np.arange(6000), 2))
    found, offset, size = s.find(keys)
    assert found.all() and (offset == np.arange(3000) * 2).all() and (size == 2).all()
    assert s.find(np.arange(-2000, 0))[0].sum() <= 1


def test_index_is_read():
    keys, valid = np.array([0, 0, 0, 5, 5, 9]), np.array([0, 1, 1, 1, 1, 1])
    s = Shard(shard_bytes(keys, valid, np.array([2, 1, 3, 1, 2, 1]), np.arange(10), 2))
    assert [x.tolist() for x in s.spans()] == [[0, 2, 3, 6, 7, 9], [2, 1, 3, 1, 2, 1]]
    assert [[x.tolist() for x in s.get(k)] for k in (0, 5, 9, 4)] == [[[2], [3, 4, 5]], [[6], [7, 8]], [[9]], []]
    asked, find = [], s.find
    s.find = lambda k: asked.extend(k.tolist()) or find(k)
    s.spans()
    assert asked == [0, 5, 9]
    s.offsets = s.offsets + np.uint64(1)
    with pytest.raises(ValueError, match="index"):
        s.spans()


def test_repeated_ids_are_found(spark, words, tmp_path):
    path = str(tmp_path / "shards")
    write_token_shards(frame(spark, ODD), path, q.tokenizer_path("word_bpe_49k.json"), 2)
    found = [r.ids for r in lookup(spark, path, spark.createDataFrame([(7,)], "k long"), "k").collect()]
    assert sorted(found) == sorted([*words.encode(t, add_special_tokens=False).ids, 2] for i, t in ODD if i == 7)


def test_packing(spark, words):
    texts = [*ODD, *((100 + i, "word " * (37 * i % 900)) for i in range(80))]
    rows = pack(frame(spark, texts).repartition(4), q.tokenizer_path("word_bpe_49k.json"), 1, open_windows=4).collect()
    windows, total = defaultdict(list), 0
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
        total += r.length
    for pieces in windows.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    assert total == sum(len(words.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts)
    assert len(windows) == -(-total // 2048)
    assert pack(frame(spark, []), q.tokenizer_path("word_bpe_49k.json"), 1).count() == 0


def test_sentencepiece(spark):
    model = q.tokenizer_path("piece_bpe_32k.model")
    texts = [(i, t) for i, (_, t) in enumerate(ODD)]
    back = {r.doc_id: r.text for r in decode_ids(encode_texts(frame(spark, texts), model), model).collect()}
    assert back == {i: t or "" for i, t in texts}


def test_sentencepiece_ids_by_plain_viterbi(spark):
    import sentencepiece

    path = q.tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(sp.get_piece_size())
    in_use = {sp.id_to_piece(i): i for i in every if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) or sp.is_byte(i))}
    as_byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in every if sp.is_byte(i)}
    lowest, longest = min(map(sp.get_score, every)) - UNKNOWN_PENALTY, max(map(len, in_use))

    def plain(text):
        """Over whole texts; of equal sums the path whose last piece is longest, from the end."""
        chars = (" " + text).replace(" ", SPACE) if text else ""
        best = [(0.0, 0, [])]
        for j in range(1, len(chars) + 1):
            ways = [(best[i][0] + sp.get_score(in_use[chars[i:j]]), -i, [in_use[chars[i:j]]]) for i in range(max(0, j - longest), j) if chars[i:j] in in_use]
            if chars[j - 1] not in in_use:
                ways.append((best[j - 1][0] + lowest, 1 - j, [as_byte[b] for b in chars[j - 1].encode()]))
            best.append(max(ways, key=lambda w: w[:2]))
        out, j = [], len(chars)
        while j:
            out[:0] = best[j][2]
            j = -best[j][1]
        return out

    texts = [(i, t) for i, (_, t) in enumerate([*ODD, (0, "the cat of the house, and the dog"), (0, "a \U0001F9A5 b\nthe\tend")])]
    want = {i: plain(t) for i, t in texts}
    encoded = encode_texts(frame(spark, texts), path)
    assert {r.doc_id: r.ids for r in encoded.collect()} == want
    got = {r.doc_id: (r.n_ids, r.n_byte_ids, r.ids_crc32) for r in decode_ids(encoded, path).collect()}
    assert got == {i: (len(x), sum(k in as_byte.values() for k in x), zlib.crc32(np.array(x, "<u4"))) for i, x in want.items()}


def test_quality_sample_is_bounded_before_the_driver(spark, monkeypatch):
    docs = frame(spark, [(i, " ".join([f"good w{k}"] * (32 * (1 + k % 3)))) for i in range(12) for k in range(30)] + [(20, " ".join(["long"] * 32_000))])
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(12), 20]], "doc_id long, quality int")
    came, collect = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda df: came.append(collect(df)) or came[-1])
    model = fit_quality(docs, labels, most_rows=50, most_passages=8)
    assert model.weights and max(t.num_rows for t in came) <= 13
    assert sum(len(x) for t in came if "x" in t.column_names for x in t.column("x").to_pylist()) == 8 * WIDTH * 4


def test_classifiers(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for query, label, least in ((q.op8_toxicity, "toxic", 0.93), (q.op9_quality, "quality", 0.93)):
        held = [(r.predicted, labels[r.doc_id][label]) for r in query(spark, sf).collect() if r.held_out and r.doc_id in labels]
        assert np.mean([a == b for a, b in held]) >= least
    empty = frame(spark, [])
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    docs = frame(spark, [(1, None), (2, "text")])
    assert {r.score for r in score_toxicity(docs, fit_toxicity(empty, none)).collect()} == {0.0}
    assert {r.score for r in score_quality(docs, fit_quality(empty, none)).collect()} == {1.0}
