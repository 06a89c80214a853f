"""Quality classifier by compression: how much better a text packs with a dictionary of good texts than of bad ones.

Two zstandard dictionaries are trained on good and bad labelled texts. A text is packed block by block with both; the
difference of the packed sizes, by the text's length, says which it is like; the smaller of the two, by the length, how
much it repeats itself, where any dictionary packs it well and the difference is near 0. A logistic curve fitted on
labelled texts that the dictionaries did not see turns both into the probability of label 1.

The fit takes a bounded sample: at most ``FIT_TEXTS`` labelled texts of each class, of ``FIT_BYTES`` at most each, the
first ones by a hash of the key. Scores are computed for all rows and whole texts, one pass, without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_rows

FIT_TEXTS, FIT_BYTES = 1500, 8000
BLOCK, DICTIONARY, LEVEL = 1024, 96 << 10, 3
# One of so many sampled texts goes to the calibration, the others to the dictionaries.
CALIBRATION = 3
FOLDS = 5
THRESHOLD = 0.3


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from all learning: crc32 of the key as text leaves no remainder. A null key is kept too."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS == 0, F.lit(True))


@dataclass
class Model:
    """Dictionaries of good and bad texts, and slopes and intercept of the curve."""

    good: bytes
    bad: bytes
    slopes: tuple[float, float] = (0.0, 0.0)
    intercept: float = 0.0

    def packers(self) -> list[zstandard.ZstdCompressor]:
        if not hasattr(self, "_packers"):
            self._packers = []
            for data in (self.good, self.bad):
                words = zstandard.ZstdCompressionDict(data)
                words.precompute_compress(level=LEVEL)
                args = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
                self._packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, **args))
        return self._packers

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_packers"}

    def features(self, text: str) -> tuple[float, float]:
        """Packed size with the bad dictionary less that with the good one, and the smaller of both, by the length.
        A text of no bytes has no difference and does not repeat itself."""
        data = text.encode()
        good, bad = self.packers()
        as_good = as_bad = 0
        for a in range(0, len(data), BLOCK):
            part = data[a : a + BLOCK]
            as_good += len(good.compress(part))
            as_bad += len(bad.compress(part))
        n = len(data)
        return ((as_bad - as_good) / n, min(as_good, as_bad) / n) if n else (0.0, 1.0)

    def score(self, text: str) -> float:
        difference, packed = self.features(text)
        z = self.slopes[0] * difference + self.slopes[1] * packed + self.intercept
        return 1 / (1 + math.exp(-min(max(z, -700.0), 700.0)))


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4) -> tuple[tuple[float, ...], float]:
    """Logistic regression by Newton steps; the small ridge keeps separable classes finite."""
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    design, beta = np.column_stack([(x - centre) / scale, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (y - p)) - ridge * weight.sum() * beta
        bend = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * weight.sum() * np.eye(len(beta))
        step = np.linalg.solve(bend, slope)
        beta += step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))  # long steps overshoot
        if np.abs(step).max() < 1e-9:
            break
    slopes = beta[:-1] / scale
    return tuple(slopes.tolist()), float(beta[-1] - slopes @ centre)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", fit_texts: int = FIT_TEXTS) -> Model:
    """A model from labelled rows that are not held out; a single class or no labelled text gives a flat curve.

    Labels that are null or not 0 or 1 are left out, keys with both labels too. Class sizes, which set the weights of
    the calibration, are counted over all labels; the texts are a sample.
    """
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).dropna()
    known = known.filter(F.col("_label").isin(0, 1) & ~held_out("_key"))
    known = known.groupBy("_key").agg(F.min("_label").alias("_label"), F.max("_label").alias("_top"))
    known = known.filter("_label = _top").drop("_top")
    sizes = dict(known.groupBy("_label").count().collect())
    lean = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(F.octet_length("_text").between(1, FIT_BYTES))
    sample = []
    for value in (0, 1):
        order = F.xxhash64("_key")
        # at most fit_texts keys, so the broadcast side and the rows fetched are bounded
        some = known.filter(F.col("_label") == value).orderBy(order, "_key").limit(fit_texts)
        rows = lean.join(F.broadcast(some), "_key").select("_label", "_text", order.alias("_order")).limit(2 * fit_texts)
        sample.append(sorted(map(tuple, rows.collect()), key=lambda r: (r[2], r[1])))

    def dictionary(rows: list[tuple]) -> bytes:
        parts = [data[a : a + BLOCK] for i, (_, t, _) in enumerate(rows) if i % CALIBRATION for data in [t.encode()] for a in range(0, len(data), BLOCK)]
        total = sum(map(len, parts))
        if len(parts) < 20 or total < 2000:  # too little for the trainer: the raw text serves
            return b" ".join(parts)[:DICTIONARY] or b" " * 8
        try:
            return zstandard.train_dictionary(max(1024, min(DICTIONARY, total // 8)), parts).as_bytes()
        except zstandard.ZstdError:  # texts too much alike
            return b" ".join(parts)[:DICTIONARY]

    model = Model(dictionary(sample[1]), dictionary(sample[0]))
    rows = [r for part in sample for i, r in enumerate(part) if i % CALIBRATION == 0]
    y = np.array([r[0] for r in rows], float)
    if 0 < y.sum() < len(y):
        x = np.array([model.features(r[1]) for r in rows])
        weight = np.where(y == 1, sizes[1] / y.sum(), sizes[0] / (len(y) - y.sum()))
        model.slopes, model.intercept = _curve(x, y, weight / weight.mean())
    elif len(y):
        model.intercept = 3.0 if y[0] else -3.0
    return model


def scored(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``score`` of every row; null and empty texts have the score of no difference and no repeats."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            scores = pa.array([model.score(t) for t in text_rows(batch, "_text")], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=[key, "score"])

    lean = docs.select(key, F.col(text).alias("_text"))
    return lean.mapInArrow(run, lean.select(key).schema.add("score", "double"))


def classified(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` of every row."""
    out = scored(docs, fit(docs, labels, text, key, label), text, key)
    return out.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
