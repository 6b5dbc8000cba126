"""The queries as they are registered: against their SQL, or plain loops with the libraries."""

import hashlib
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import queries as q
from ledgerloom.llm.exact_dedup import BASES, CHUNK, CHUNKS_AT_ONCE, PRIMES, exact_dedup, fingerprints
from ledgerloom.llm.url_filter import Level, filter_urls

SF = "/root/testdata/sf0.001"


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(round(r[i], 6) if isinstance(r[i], float) else r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF).iterdir():
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want, got = con.sql(q.ORACLE[name]), q.QUERIES[name](spark, SF)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), want.columns)


def documents(spark):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())


def encoded(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(q.tokenizer_path("word_bpe_49k.json"))
    return [e.ids + [end] for e in t.encode_batch(texts, add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op6_decodes_to_the_texts(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in q.op6_sentencepiece(spark, SF).collect()}
    assert {i: got[i].decoded_sha256 for i, _ in docs} == {i: hashlib.sha256(t.replace("\u2581", " ").encode()).hexdigest() for i, t in docs}


def test_op7_by_the_library(spark):
    docs, at, want = documents(spark), 0, []
    for (i, _), ids in zip(docs, encoded([t for _, t in docs], 2), strict=True):
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(tuple(r) for r in q.op7_token_output(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def whole_pieces(rows, docs):
    """Whether the pieces are all of the documents' ids, once each, in gapless sequences of 2048 at most."""
    ids = dict(zip((i for i, _ in docs), encoded([t for _, t in docs], 1), strict=True))
    own, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
    for i, pieces in own.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[i])
    for spans in seqs.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    return set(own)


def test_op10_by_the_library(spark):
    docs = documents(spark)
    assert whole_pieces(q.op10_packing(spark, SF).collect(), docs) == {i for i, _ in docs}


def test_pipeline_as_registered(spark):
    docs = documents(spark)
    kept = whole_pieces(q.pipeline(spark, SF).collect(), docs)
    texts = dict(docs)
    assert kept and len({texts[i] for i in kept}) == len(kept)  # no two equal texts are left
    near = {r.doc_id: r.component_id for r in q.op3_ngram_join(spark, SF).collect()}
    assert len({near[i] for i in kept}) > 0.95 * len(kept)


def test_many_paths_of_one_host(spark):
    rules = spark.range(20_000).select(F.lit("example.org").alias("host"), F.concat(F.lit("/p"), F.col("id")).alias("path"), F.when(F.col("id") % 2 == 0, "block").otherwise("allow").alias("verdict")).unionByName(spark.createDataFrame([("org", "/", "allow"), ("example.org", "/p7", "block")], "host string, path string, verdict string"))
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.example.org/p"), F.col("id") * 77, F.lit("/x")).alias("url"))
    got = {r.page_id: (r.rule, r.verdict) for r in filter_urls(pages, rules).collect()}
    for i, found in got.items():
        digits = str(i * 77)
        n = max(n for n in range(1, len(digits) + 1) if int(digits[:n]) < 20_000 and str(int(digits[:n])) == digits[:n])
        path = f"/p{digits[:n]}"
        assert found == (f"example.org{path}", "block" if path == "/p7" or int(digits[:n]) % 2 == 0 else "allow")


def test_a_level_looks_up_lengths_not_paths():
    level = Level("x/", 3)
    for i in range(100_000):
        level.add(f"/{i}", f"h/{i}", "allow")
    assert level.best("/99999x") == ("h/99999", "allow") and level.best("/") is None and len(level._lengths) == 5


def test_fingerprint_of_a_text_of_many_pieces():
    rng = np.random.default_rng(0)
    sizes = [0, 5, CHUNK * (CHUNKS_AT_ONCE + 3) + 17, 0, CHUNK, 1]
    raw = rng.integers(0, 256, sum(sizes)).astype(np.uint8)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    for got, base, prime in zip(fingerprints(raw, offsets), BASES, PRIMES, strict=True):
        for k, n in enumerate(sizes):
            want, power = 0, 1
            for b in raw[offsets[k] : offsets[k] + n].tolist():
                want, power = (want + (b + 1) * power) % prime, power * base % prime
            assert int(got[k]) == want


def test_one_row_of_repeated_rows_is_kept(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (None, "b"), (None, "b"), (2, "c"), (3, "a")], "doc_id long, text string").repartition(3)
    got = exact_dedup(df).groupBy("doc_id").agg(F.sum(F.col("kept").cast("int")).alias("k"), F.count("*").alias("n")).collect()
    assert {r.doc_id: (r.k, r.n) for r in got} == {1: (0, 3), None: (1, 2), 2: (1, 1), 3: (1, 1)}
