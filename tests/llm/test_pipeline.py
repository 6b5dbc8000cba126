"""The pipeline's stages against brute force, each on what the stage before it kept."""

import hashlib

import corpus_pipeline
from ledgerloom.llm.runtime import Scratch

from test_operators import brute_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch, kept = Scratch(spark), [{r.doc_id: r.text for r in docs.collect()}]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, SF), name.replace(" ", "-"))
        assert docs.columns == columns
        rows = docs.collect()
        assert len({r.doc_id for r in rows}) == len(rows)
        kept.append({r.doc_id: r.text for r in rows})
        assert kept[-1].items() <= kept[-2].items()
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for before, after, good in ((kept[0], kept[1], lambda r: r.quality == 1), (kept[1], kept[2], lambda r: r.toxic == 0)):
        clean = [i for i in before if i in labels and good(labels[i])]
        assert sum(i in after for i in clean) >= 0.9 * len(clean)
    latest = {}
    for i in sorted(kept[2]):
        latest[kept[2][i] or ""] = i
    assert set(kept[3]) == set(latest.values())
    assert set(kept[4]) == {i for i, (_, c) in brute_components(sorted(kept[3].items())).items() if i == c}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r.doc_id for r in packed} == set(kept[4]) and all(r["sum(length)"] == r["max(doc_tokens)"] for r in packed)


def test_near_copies_of_repeated_ids(spark):
    def pair(letter):
        text = " ".join(f"{letter}{i}" for i in range(60))
        return text, text + " x"

    (a, a2), (b, b2), (c, c2), (d, d2), (e, _) = map(pair, "abcde")
    first = lambda *texts: min(texts, key=lambda t: hashlib.sha256(t.encode()).digest())
    texts = [(3, a), (7, a2), (7, e), (None, b), (None, b2), (8, c), (8, c2), (None, c), (4, d), (4, d), (None, d2), (5, None), (5, ""), (6, None)]
    rows = corpus_pipeline.near(spark, spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, sha string"), SF).collect()
    want = [(3, a), (7, e), (None, first(b, b2)), (8, first(c, c2)), (4, d), (5, ""), (5, ""), (6, "")]
    assert sorted(map(str, ((r.doc_id, r.text or "") for r in rows))) == sorted(map(str, want))


def test_stages_with_clashing_columns_and_empty_tables(spark):
    """Columns that stages make themselves, in documents: they come through untouched."""
    schema = "doc_id long, text string, _id long, _own string, row string, id long, sha string, key string, kept string, n long, place long, component_id long, keep_id long"
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, t, 1, "o", "r", 2, "s", "k", "x", 3, 4, 5, 6) for i, t in ((1, text), (2, text), (3, text + " y"), (4, None), (None, "alone"))]
    docs = spark.createDataFrame(rows, schema)
    once = corpus_pipeline.exact(spark, docs, SF)
    assert once.columns == docs.columns
    assert sorted(map(str, map(tuple, once.collect()))) == sorted(map(str, (r for r in rows if r[0] != 1)))
    last = corpus_pipeline.near(spark, once, SF)
    assert last.columns == docs.columns
    assert sorted(map(str, map(tuple, last.collect()))) == sorted(map(str, (r for r in rows if r[0] not in (1, 3))))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), SF).count() == 0, name
    assert corpus_pipeline.packing(spark, docs.where("false"), SF).count() == 0
