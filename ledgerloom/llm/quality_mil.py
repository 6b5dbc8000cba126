"""Quality classifier (operator 9): attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is encoded from dense traits of its
words; gated attention, learned from the documents' labels, weighs the passages; the weighted
representation is scored. Every passage of a text is encoded. The network has some hundred
weights: it is fitted on the driver, on a bounded sample, and broadcast."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import slices, worker_cache
from .training import labelled_sample
from .word_traits import TRAITS, TraitCache, sums
from .words import word_codes

PASSAGE_WORDS = 64
WIDTH = len(TRAITS) + 5


def passage_features(cache: TraitCache, column) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, number of passages of each text); a text without words is one empty passage."""
    counts, codes, words = word_codes(column)
    traits = cache.of(words)
    of = [traits[:, i] for i in range(len(TRAITS))]
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(codes)) - (np.cumsum(counts) - counts)[owner]
    passages = np.maximum(1, -(-counts // PASSAGE_WORDS))
    first = np.cumsum(passages) - passages
    passage = first[owner] + place // PASSAGE_WORDS
    size = np.bincount(passage, minlength=int(passages.sum()))
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (passage[1:] == passage[:-1])
    distinct = np.bincount(np.unique(passage.astype(np.int64) * (len(words) + 1) + codes) // (len(words) + 1), minlength=len(size))
    total = sums((*(t[codes] for t in of), same, of[0][codes] ** 2), size)
    n, chars = np.maximum(size, 1)[:, None], np.maximum(total[:, :1], 1)
    mean = total[:, :1] / n
    spread = np.sqrt(np.maximum(total[:, len(TRAITS) + 1 :] / n - mean**2, 0))
    x = np.concatenate([total[:, 1:6] / chars, total[:, 6 : len(TRAITS)] / n, mean / 10, spread / 10, total[:, len(TRAITS) : len(TRAITS) + 1] / n, distinct[:, None] / n, size[:, None] / PASSAGE_WORDS, np.log1p(passages)[np.repeat(np.arange(len(counts)), passages)][:, None]], 1)
    return x, passages


@dataclass
class Network:
    """Without weights every score is `constant`. Encoder w, b; gated attention v, u, a; scorer c, d. mean and std standardise the features."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    std: np.ndarray
    constant: float = 1.0

    def forward(self, x: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, dict]:
        p = self.weights
        x = np.clip((x - self.mean) / self.std, -8, 8)
        h = np.tanh(x @ p["w"] + p["b"])
        left, right = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (left * right) @ p["a"]
        starts = np.cumsum(passages) - passages
        owner = np.repeat(np.arange(len(passages)), passages)
        e = np.exp(e - np.maximum.reduceat(e, starts)[owner])
        attention = e / np.add.reduceat(e, starts)[owner]
        z = np.add.reduceat(attention[:, None] * h, starts)
        score = 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))
        return score, {"x": x, "h": h, "left": left, "right": right, "attention": attention, "z": z, "owner": owner, "starts": starts}

    def gradients(self, x: np.ndarray, passages: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        score, k = self.forward(x, passages)
        error = (score - label) / len(label)
        dz = error[:, None] * p["c"]
        along = (dz[k["owner"]] * k["h"]).sum(1)
        de = k["attention"] * (along - np.add.reduceat(k["attention"] * along, k["starts"])[k["owner"]])
        dgate = de[:, None] * p["a"]
        dleft, dright = dgate * k["right"] * (1 - k["left"] ** 2), dgate * k["left"] * k["right"] * (1 - k["right"])
        dh = k["attention"][:, None] * dz[k["owner"]] + dleft @ p["v"].T + dright @ p["u"].T
        dpre = dh * (1 - k["h"] ** 2)
        return {"w": k["x"].T @ dpre, "b": dpre.sum(0), "v": k["h"].T @ dleft, "u": k["h"].T @ dright, "a": (k["left"] * k["right"]).T @ de, "c": k["z"].T @ error, "d": error.sum(keepdims=True)}


def fit_network(x: np.ndarray, passages: np.ndarray, label: np.ndarray, hidden: int = 24, gates: int = 12, rounds: int = 400, rate: float = 0.02, decay: float = 1e-5, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    weights = {"w": rng.normal(0, 0.3, (x.shape[1], hidden)), "b": np.zeros(hidden), "v": rng.normal(0, 0.3, (hidden, gates)), "u": rng.normal(0, 0.3, (hidden, gates)), "a": rng.normal(0, 0.3, gates), "c": rng.normal(0, 0.3, hidden), "d": np.zeros(1)}
    net = Network(weights, x.mean(0), x.std(0) + 1e-3)
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    order = np.cumsum(passages) - passages
    for step in range(1, rounds + 1):
        picked = rng.permutation(len(passages))[:1024]
        rows = np.concatenate([np.arange(order[i], order[i] + passages[i]) for i in picked])
        for k, g in net.gradients(x[rows], passages[picked], label[picked]).items():
            g = g + decay * weights[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            weights[k] -= rate * (1 - step / (rounds + 1)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return net


def trait_cache() -> TraitCache:
    return worker_cache("quality", TraitCache)


def fit_quality(docs: DataFrame, labels: DataFrame, most_rows: int = 6000, most_passages: int = 300_000, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Fits on at most `most_rows` labelled documents, one row an id: that of the fewest passages, then
    of the smallest digest. Their passages are counted first; documents that go beyond `most_passages`
    in the order of the ids' hashes are left out, and only the others' features come to the driver.
    Where the sample holds one label only, all scores are that label; without labels, 1. Null texts are
    empty texts, of no passage; an id labelled twice has the larger label, ids and labels that are null have none."""

    def run(batches):
        for b in slices(batches, 2):
            x, passages = passage_features(trait_cache(), b.column(2))
            ends = np.cumsum(passages)
            x = x.astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(passages), pa.array([x[e - n : e].tobytes() for e, n in zip(ends, passages, strict=True)], pa.binary())], names=["id", "label", "n", "x"])

    def count(batches):
        for b in slices(batches, 2):
            passages = np.maximum(1, -(-word_codes(b.column(2))[0] // PASSAGE_WORDS))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(passages)], names=["id", "sha", "n"])

    sample = labelled_sample(docs, labels, label, most_rows, id_col, text_col).select("id", "label", F.sha2("text", 256).alias("sha"), "text")
    kind = sample.schema["id"].dataType.simpleString()
    counted = sample.select("id", "sha", "text").mapInArrow(count, f"id {kind}, sha string, n long").groupBy("id").agg(F.min(F.struct("n", "sha")).alias("r"))
    counted = counted.select("id", "r.n", "r.sha")
    rows = counted.toArrow()
    ids, sizes = rows.column("id").to_pylist(), rows.column("n").to_pylist()
    chosen, total = [], 0
    for i in sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), str(ids[i]))):
        if total + sizes[i] <= most_passages:
            chosen.append(i)
            total += sizes[i]
    picked = docs.sparkSession.createDataFrame(rows.take(pa.array(chosen, pa.int64())).select(["id", "sha"]), counted.select("id", "sha").schema)
    texts = sample.join(F.broadcast(picked), ["id", "sha"]).groupBy("id").agg(F.first("label").alias("label"), F.first("text").alias("text"))
    bags = texts.mapInArrow(run, f"id {kind}, label double, n long, x binary").toArrow().to_pydict()
    kept = sorted(range(len(bags["id"])), key=lambda i: (zlib.crc32(str(bags["id"][i]).encode()), str(bags["id"][i])))
    if len({bags["label"][i] > 0 for i in kept}) < 2:
        return Network({}, np.zeros(0), np.zeros(0), float(not kept or bags["label"][kept[0]] > 0))
    x = np.concatenate([np.frombuffer(bags["x"][i], np.float32).reshape(-1, WIDTH) for i in kept]).astype(np.float64)
    return fit_network(x, np.array([bags["n"][i] for i in kept]), np.array([float(bags["label"][i] > 0) for i in kept]))


def score_quality(docs: DataFrame, model: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score (0 to 1). Null and empty texts are one empty passage. Repeated
    rows give repeated rows; other columns are ignored, whatever their names."""
    if not model.weights:
        return docs.select(F.col(id_col), F.lit(model.constant).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in slices(batches):
            score, _ = shared.value.forward(*passage_features(trait_cache(), b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double")


def keep_good(docs: DataFrame, model: Network, threshold: float, text_col: str = "text") -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns; nothing is shuffled. Null
    and empty texts are scored alike; repeated rows stay or go together; a score of just the threshold
    stays; an empty table stays empty."""
    if not model.weights:
        return docs if model.constant >= threshold else docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in slices(batches, at):
            score, _ = shared.value.forward(*passage_features(trait_cache(), b.column(at)))
            yield b.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)
