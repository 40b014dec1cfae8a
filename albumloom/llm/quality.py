"""Quality classifier: a generalised additive model with pairwise interactions, scored by lookups in bin tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from albumloom.llm.common import hash_sample, held_out

FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digits", "stops", "bangs", "bars", "symbols", "other_marks", "not_ascii", "line_ends",
    "distinct_words", "top_word", "repeated_next", "distinct_lines",
)
_BYTE = np.arange(256)
#: for each byte the group it counts for: 1 A-Z, 2 a-z, 3 digits, 4 . and ,, 5 ! and ?, 6 |, 7 symbols, 8 other marks, 9 not ASCII, 10 line ends
_GROUP = np.select(
    [(_BYTE >= 65) & (_BYTE <= 90), (_BYTE >= 97) & (_BYTE <= 122), (_BYTE >= 48) & (_BYTE <= 57), np.isin(_BYTE, list(b".,")), np.isin(_BYTE, list(b"!?")), _BYTE == 124,
     np.isin(_BYTE, list(b"#$%&*@^~<>=+\\_`")), (_BYTE > 32) & (_BYTE < 127), _BYTE >= 128, _BYTE == 10],
    list(range(1, 11)),
)


def features(text: str | None) -> list[float]:
    """Shares and lengths of a whole text; zeros for null and empty."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    held = np.bincount(_GROUP, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), 11)
    words, lines = text.split(), text.splitlines()
    n, chars = max(1, len(words)), len(raw)
    letters = max(1.0, held[1] + held[2])
    return [
        np.log1p(chars), np.log1p(len(words)), chars / n, held[1] / letters, held[3] / chars, held[4] / n, held[5] / n, held[6] / n, held[7] / n, held[8] / n,
        held[9] / chars, held[10] / n, len(set(words)) / n, max(Counter(words).values(), default=0) / n, sum(map(eq, words, words[1:])) / n, len(set(lines)) / max(1, len(lines)),
    ]


@dataclass(frozen=True)
class Fit:
    """How the model is learned: ``rows`` bounds the sample of labelled documents per label value."""

    rows: int = 6000
    bins: int = 64
    coarse: int = 8
    rounds: int = 120
    pairs: int = 6
    pair_rounds: int = 40
    rate: float = 0.1
    ridge: float = 1.0


@dataclass
class Model:
    """score = sigmoid(base + one table entry per feature + one per pair)."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            z += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        for j, k, table in self.pairs:
            z += table[np.searchsorted(self.coarse[j], x[:, j], "right"), np.searchsorted(self.coarse[k], x[:, k], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of bins with gradient and curvature sums g, h."""
    if len(g) < 2:
        return 0.0, 0
    lg, lh = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = lg**2 / (lh + ridge) + (g.sum() - lg) ** 2 / (h.sum() - lh + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _line_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """A tree of three leaves over bins: the best cut, then the best cut of either side."""
    leaves = [(0, len(g))]
    for _ in range(2):
        gain, leaf, at = max((*_cut(g[a:b], h[a:b], ridge)[:1], (a, b), _cut(g[a:b], h[a:b], ridge)[1]) for a, b in leaves)
        if gain <= 0:
            break
        leaves.remove(leaf)
        leaves += [(leaf[0], leaf[0] + at), (leaf[0] + at, leaf[1])]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray, ridge: float, depth: int = 2) -> tuple[np.ndarray, float]:
    """A tree of depth two over a grid of bins, cut along either axis; its values and its gain."""
    cuts = [(*_cut(g.sum(1), h.sum(1), ridge), 0), (*_cut(g.sum(0), h.sum(0), ridge), 1)]
    gain, at, axis = max(cuts)
    if not depth or gain <= 0:
        return np.full(g.shape, g.sum() / (h.sum() + ridge)), 0.0
    parts = [_grid_tree(a, b, ridge, depth - 1) for a, b in zip(np.split(g, [at], axis), np.split(h, [at], axis))]
    return np.concatenate([v for v, _ in parts], axis), gain + sum(more for _, more in parts)


def fit_model(x: np.ndarray, y: np.ndarray, weight: np.ndarray, fit: Fit = Fit()) -> Model:
    """Boosts each feature in turn by small trees over its bins, then the pairs that explain most of what is left.

    Without both labels the score is the share of label 1, or one half without any row.
    """
    if len(y) == 0:
        return Model(0.0)
    mean = float(np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4))
    model = Model(float(np.log(mean / (1 - mean))))
    if y.min() == y.max():
        return model
    quantiles = lambda j, n: np.unique(np.quantile(x[:, j], np.linspace(0, 1, n + 1)[1:-1]))
    model.edges = [quantiles(j, fit.bins) for j in range(x.shape[1])]
    model.coarse = [quantiles(j, fit.coarse) for j in range(x.shape[1])]
    fine = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    rough = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.coarse)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(len(y), model.base)

    def left() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(fit.rounds):
        for j, b in enumerate(fine):
            g, h = left()
            n = len(model.tables[j])
            step = fit.rate * _line_tree(np.bincount(b, g, n), np.bincount(b, h, n), fit.ridge)
            model.tables[j] += step
            z += step[b]

    def grid(j: int, k: int, values: np.ndarray) -> np.ndarray:
        shape = (len(model.coarse[j]) + 1, len(model.coarse[k]) + 1)
        return np.bincount(rough[j] * shape[1] + rough[k], values, shape[0] * shape[1]).reshape(shape)

    g, h = left()
    d = x.shape[1]
    gains = sorted(((_grid_tree(grid(j, k, g), grid(j, k, h), fit.ridge)[1], j, k) for j in range(d) for k in range(j + 1, d)), reverse=True)
    model.pairs = [(j, k, np.zeros(grid(j, k, g).shape)) for _, j, k in gains[: fit.pairs]]
    for _ in range(fit.pair_rounds):
        for j, k, table in model.pairs:
            g, h = left()
            step = fit.rate * _grid_tree(grid(j, k, g), grid(j, k, h), fit.ridge)[0]
            table += step
            z += step[rough[j], rough[k]]
    return model


def _features(text: str) -> Column:
    @pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([features(t) for t in texts], dtype=object)

    return of(text)


def learn(docs: DataFrame, labels: DataFrame, out: Column, fit: Fit = Fit()) -> Model:
    """Model of ``labels.quality`` from the texts of a bounded sample of the labelled documents where ``out`` is false.

    The sample has at most about ``fit.rows`` documents of each label; weights bring back the shares of the labels.
    """
    known = labels.select("doc_id", F.col("quality").cast("double").alias("y")).where((F.col("y").isin(0.0, 1.0)) & ~out)
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # its number of rows is bounded by fit.rows
    chosen = F.broadcast(hash_sample(known, "y", fit.rows))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select(_features("text").alias("x"), "y").toPandas()
    if rows.empty:
        return Model(0.0)
    rows = rows.iloc[np.lexsort(np.array(rows["x"].tolist()).T)]  # tasks end in any order
    y = rows["y"].to_numpy()
    weight = np.where(y == 1, shares.get(1.0, 0) / max(1, (y == 1).sum()), shares.get(0.0, 0) / max(1, (y == 0).sum()))
    return fit_model(np.array(rows["x"].tolist()), y, weight * len(y) / weight.sum(), fit)


def scored(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1 from the whole text; null and empty texts score as texts of no words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.score(np.array([features(t) for t in texts], dtype=float).reshape(-1, len(FEATURES))))

    return docs.withColumn(out, score("text"))


def judged(docs: DataFrame, labels: DataFrame, least: float = 0.7, k: int = 4, remainder: int = 2, fit: Fit = Fit()) -> DataFrame:
    """(doc_id, text, ...) and labels (doc_id, quality) -> the columns of docs, held_out, score, predicted.

    Rows whose crc32 has this remainder are never learned from. Labels of unknown documents and null labels are left
    out; without labels every score is one half. Columns of docs with the three new names are replaced.
    """
    model = learn(docs, labels, held_out(k, remainder), fit)
    return scored(docs.drop("held_out", "predicted"), model).withColumn("held_out", held_out(k, remainder)).withColumn("predicted", (F.col("score") >= least).cast("int"))
