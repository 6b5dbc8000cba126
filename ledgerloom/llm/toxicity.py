"""Toxicity (operator 8): gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words and word beginnings (4 to 6 letters) is learned from the labelled sample: those
that toxic documents hold far more often than others. The features of a text are its lexicon
densities, how near second-person words they are, and rates of capitals, punctuation and
obfuscated words. Three quarters of the sample fit the lexicon and the trees, the last quarter
the isotonic map from the trees' margin to a probability."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from .runtime import Scratch, slices, worker_cache
from .training import labelled_sample
from .word_traits import TraitCache, sums
from .words import WordMemory, word_codes

STEMS = (4, 5, 6)
STRONG, MID = 3.0, 1.5
NEAR = 5


def core(word: str) -> str:
    return word.strip("\"'()[]{}.,;:!?*#%&$-|").lower()


def grams(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)] if len(word) > 2 else []


def gram_counts(batches):
    """(label, text) to the lexicon candidates of each slice with how many toxic and other texts hold them."""
    for b in slices(batches):
        counts, codes, words = word_codes(b.column(1))
        of = [grams(core(w)) for w in words.to_pylist()]
        found: list[Counter] = [Counter(), Counter()]
        at = 0
        for label, n in zip(b.column(0).to_pylist(), counts.tolist(), strict=True):
            found[label > 0].update({g for c in np.unique(codes[at : at + n]).tolist() for g in of[c]})
            at += n
        both = list(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([found[1][g] for g in both], pa.int64()), pa.array([found[0][g] for g in both], pa.int64())], names=["gram", "toxic", "other"])


FEATURES = ("words", "strong", "strong_rate", "mid", "mid_rate", "weight_rate", "heaviest", "near_person", "near_rate", "person_rate", "capital_words", "capital_letters", "bang_rate", "symbol_rate", "digit_rate", "obfuscated_rate", "run_rate", "word_length")


class Features:
    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.cache, self.weights = lexicon, TraitCache(), WordMemory(self.weight, np.float32, 1)

    def weight(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        find = self.lexicon.get
        return np.array([[max((find(g, 0.0) for g in grams(core(w))), default=0.0)] for w in words], np.float32).reshape(len(words), 1), np.ones(len(words), np.int32)

    def of(self, column) -> np.ndarray:
        counts, codes, words = word_codes(column)
        traits = self.cache.of(words)
        flat, starts, _ = self.weights.of(words)
        w = flat[starts, 0][codes]
        ends = np.cumsum(counts)
        owner = np.repeat(np.arange(len(counts)), counts)
        person = np.concatenate([[0], np.cumsum(traits[:, 12][codes])])
        at = np.arange(len(codes))
        low, high = np.maximum(at - NEAR, (ends - counts)[owner]), np.minimum(at + NEAR + 1, ends[owner])
        near = (w >= MID) & (person[high] > person[low])
        total = sums((w >= STRONG, w >= MID, w, near, *(traits[:, i][codes] for i in (12, 6, 2, 5, 4, 3, 11, 10, 0, 1))), counts)
        heaviest = np.zeros(len(counts))
        np.maximum.at(heaviest, owner, w)
        n, chars, letters = np.maximum(counts, 1), np.maximum(total[:, 12], 1), np.maximum(total[:, 13], 1)
        return np.column_stack([np.log1p(counts), total[:, 0], total[:, 0] / n, total[:, 1], total[:, 1] / n, total[:, 2] / n, heaviest, total[:, 3], total[:, 3] / n, total[:, 4] / n, total[:, 5] / n, total[:, 6] / letters, total[:, 7] / n, total[:, 8] / chars, total[:, 9] / chars, total[:, 10] / n, total[:, 11] / n, total[:, 12] / n])


def features_of(shared) -> Features:
    lexicon = shared.value
    return worker_cache(("toxicity", id(lexicon)), lambda: Features(lexicon))  # which keeps the lexicon, so its id stays its own


def with_features(texts: DataFrame, shared, keep: list[str]) -> DataFrame:
    """Columns `keep` and the features of `text`."""

    def run(batches):
        for b in slices(batches, len(keep)):
            x = features_of(shared).of(b.column(len(keep)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), lists], names=[*keep, "x"])

    out = StructType([texts.schema[c] for c in keep]).add("x", ArrayType(DoubleType()))
    return texts.select(*keep, "text").mapInArrow(run, out).withColumn("features", array_to_vector("x")).drop("x")


@dataclass
class ToxicityModel:
    """Without trees (the sample had one label only, or none) every score is `constant`."""

    lexicon: dict[str, float]
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None
    constant: float = 0.0


def fit_toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = 8000, most_grams: int = 2000, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fits on at most `most_rows` labelled documents and keeps a lexicon of at most `most_grams`.
    Where the sample holds one label only, all scores are that label; without labels, 0. Null texts are
    empty texts; an id labelled twice has the larger label, ids and labels that are null have none."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    sample = scratch.write(labelled_sample(docs, labels, label, most_rows, id_col, text_col), "sample")
    n = {r.label > 0: r["count"] for r in sample.where("part < 3").groupBy("label").count().collect()}
    if not n.get(True) or not n.get(False):
        return ToxicityModel({}, constant=float(bool(n.get(True))))
    counted = sample.where("part < 3").select("label", "text").mapInArrow(gram_counts, "gram string, toxic long, other long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = F.log((F.col("toxic") + 0.5) / n[True]) - F.log((F.col("other") + 0.5) / n[False])
    strong = counted.where(F.col("toxic") >= max(3, 0.01 * n[True])).withColumn("odds", odds).where(F.col("odds") >= MID)
    lexicon = {r.gram: r.odds for r in strong.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "gram").limit(most_grams).collect()}
    shared = spark.sparkContext.broadcast(lexicon)
    rows = scratch.write(with_features(sample, shared, ["id", "label", "part"]).coalesce(2), "features")
    trees = GBTClassifier(maxIter=25, maxDepth=4, stepSize=0.2, minInstancesPerNode=5, seed=7).fit(rows.where("part < 3"))
    margins = trees.transform(rows.where("part = 3")).select("label", vector_to_array("rawPrediction")[1].alias("margin"))
    if margins.isEmpty():
        margins = trees.transform(rows).select("label", vector_to_array("rawPrediction")[1].alias("margin"))
    calibration = IsotonicRegression(featuresCol="margin", predictionCol="score").fit(margins.where("margin is not null"))
    for name in ("sample", "features"):
        scratch.drop(name)
    return ToxicityModel(lexicon, trees, calibration)


def scored(texts: DataFrame, model: ToxicityModel, keep: str) -> DataFrame:
    """Column `keep` and the score of `text`."""
    if model.trees is None:
        return texts.select(keep, F.lit(model.constant).alias("score"))
    shared = texts.sparkSession.sparkContext.broadcast(model.lexicon)
    margins = model.trees.transform(with_features(texts, shared, [keep])).select(keep, vector_to_array("rawPrediction")[1].alias("margin"))
    return model.calibration.transform(margins).select(keep, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("score"))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score (0 to 1). Null and empty texts get the score of a text without
    words. Repeated rows give repeated rows; other columns are ignored, whatever their names."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return scored(texts, model, "id").select(F.col("id").alias(id_col), "score")


def keep_civil(docs: DataFrame, model: ToxicityModel, threshold: float, text_col: str = "text") -> DataFrame:
    """The documents whose score is below the threshold, with all their columns; nothing is shuffled. Null
    and empty texts are scored alike; repeated rows stay or go together; a score of just the threshold
    goes; an empty table stays empty."""
    texts = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return scored(texts, model, "row").where(F.col("score") < threshold).select("row.*")
