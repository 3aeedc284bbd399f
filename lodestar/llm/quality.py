"""Quality: Naive Bayes support vectors.

A text is the set of its word and word-pair indicators. Words are runs of word characters or runs of other signs, lower-cased;
a word that repeats the one before it is replaced by a mark, so repetition is an indicator as well. Each indicator is
scaled by the logarithm of the ratio of its smoothed frequencies in the two classes, a text's vector is divided by its
length, and a linear hinge-loss model is fitted by dual coordinate descent. Margins of held-back training rows give the
logistic that turns margins into scores.

The model is fitted on the driver on at most `per_class` labelled documents of either class; it keeps the indicators
that at least `least` of these have. Scoring covers every row and whole texts.

Defined results: null text counts as the empty text, which scores by the intercept alone; texts of any length are
scored whole; equal texts score equally; without labels of both classes every score is 1; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from math import fsum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import text_column, training_sample
from lodestar.llm.svm import SparseRows, calibrate, fit_hinge, held_back, probability

PER_CLASS = 3000
THRESHOLD = 0.3
_WORD = re.compile(r"\w+|[^\w\s]+")
_BLOCK = 1 << 16


def indicators(text: str) -> set:
    """Words, and pairs of neighbouring words as tuples."""
    found = _WORD.findall(text.lower())
    out: set = set()
    for at in range(0, len(found), _BLOCK):
        part = found[max(0, at - 1) : at + _BLOCK]
        after = part[1:]
        out.update(part)
        out.update(zip(part, after))
        if any(map(str.__eq__, part, after)):
            out.add(("", ""))
            repeats = sum(map(str.__eq__, part, after))
            for k in range(1, 6):
                if repeats * (1 << k) >= len(part):
                    out.add(("", str(k)))
    return out


@dataclass
class Model:
    weights: dict = field(default_factory=dict)
    bias: float = 0.0
    a: float = 1.0
    c: float = 35.0

    def margins(self, texts: list[str]) -> np.ndarray:
        out, get = np.empty(len(texts)), self.weights.__getitem__
        keys = self.weights.keys()
        for k, t in enumerate(texts):
            known = keys & indicators(t)
            out[k] = fsum(map(get, known)) / max(1.0, len(known)) ** 0.5 + self.bias
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return probability(self.margins(texts), self.a, self.c)


def _frequent(texts: list[str], least: int) -> list:
    """Indicators that at least `least` texts have. Counts by hash value come first, so that the many rare ones are
    never held."""
    rough = np.zeros(1 << 22, dtype=np.int32)
    for t in texts:
        found = indicators(t)
        rough[np.unique(np.fromiter(map(hash, found), dtype=np.int64, count=len(found)) & (len(rough) - 1))] += 1
    maybe = rough >= least
    exact = Counter(g for t in texts for g in indicators(t) if maybe[hash(g) & (len(rough) - 1)])
    return sorted((g for g, n in exact.items() if n >= least), key=repr)


def _fit(texts: list[str], y: np.ndarray, least: int, cost: float, smooth: float) -> Model:
    names = _frequent(texts, least)
    number = {g: i for i, g in enumerate(names)}
    rows = [np.array(sorted(number[g] for g in number.keys() & indicators(t)), dtype=np.int32) for t in texts]
    counts = {s: np.full(len(names), smooth) for s in (-1, 1)}
    for r, s in zip(rows, y):
        counts[int(s)][r] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())
    x = SparseRows([(r, (ratio[r] / max(1.0, len(r)) ** 0.5).astype(np.float32)) for r in rows], len(names))
    w, bias = fit_hinge(x, y, cost=cost, epochs=12)
    scaled = w * ratio
    return Model({g: float(v) for g, v in zip(names, scaled) if v}, bias)


def fit(rows: list[tuple[str, int]], least: int = 3, cost: float = 1.0, smooth: float = 1.0) -> Model:
    """rows: (text, 0 or 1)."""
    y = np.array([1 if q == 1 else -1 for _, q in rows])
    if len(set(y.tolist())) < 2:
        return Model()
    back = held_back(y)
    model = _fit([t for (t, _), h in zip(rows, back) if not h], y[~back], least, cost, smooth)
    margin = model.margins([t for (t, _), h in zip(rows, back) if h])
    model.a, model.c = calibrate(margin, y[back])
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    return fit(training_sample(docs, labels, "quality", per_class))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, quality (0 to 1) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sent.value.scores(part.column("text").to_pylist()))], names=["doc_id", "quality"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, quality double")
