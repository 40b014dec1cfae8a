"""Toxicity by compression distance: windows are compressed with dictionaries of toxic and of ordinary text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from albumloom.llm.common import hash_sample, held_out


@dataclass(frozen=True)
class Fit:
    """What is learned from, at most: ``rows`` documents of each label, none of over ``longest`` characters.

    Both dictionaries end in the same ``base`` bytes of ordinary text; ``own`` bytes before that are trained apart, each
    on stretches of strings of ``gram`` bytes that more of its label's documents have than of the other's, by ``gap``
    standard errors.
    """

    rows: int = 4000
    longest: int = 50_000
    window: int = 60
    base: int = 65_536
    own: int = 2048
    segment: int = 16
    gram: int = 6
    gap: float = 5.0
    level: int = 12
    cuts: tuple[int, ...] = (1, 2, 3, 4, 5, 6)


#: strings of bytes are counted in 2 ** SLOTS counters by their hash
SLOTS = 22


def flat(text: str | None) -> bytes:
    """A text as bytes after a space, A-Z lower-cased."""
    return b" " + text.encode("utf-8", "surrogatepass").lower() if text else b""


def windows(text: str | None, size: int) -> list[bytes]:
    """A text, A-Z lower-cased, in pieces of ``size`` bytes, each drawn out to the end of its word (64 bytes at most)."""
    return re.findall(rb"[\s\S]{%d}\S{0,64}|[\s\S]+" % size, flat(text))


def lengths(dictionary: bytes, level: int) -> Callable[[list[bytes]], np.ndarray]:
    """Compressed length of each window with the dictionary."""
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    c = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False)
    return lambda ws: np.fromiter((len(c.compress(w)) for w in ws), np.int64, len(ws))


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A zstandard dictionary of the samples; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b" " * 8


def grams(text: bytes, size: int) -> np.ndarray:
    """Counter of the string of ``size`` bytes at each place."""
    h = np.zeros(max(0, len(text) - size + 1), np.uint64)
    raw = np.frombuffer(text, np.uint8).astype(np.uint64)
    for i in range(size):
        h = h * np.uint64(257) + raw[i : i + len(h)]
    return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)).astype(np.int64)


def spread(texts: list[str], size: int) -> np.ndarray:
    """Share of the texts that have a string, for each counter."""
    seen = np.zeros(1 << SLOTS, np.int32)
    for t in texts:
        seen[np.unique(grams(flat(t), size))] += 1
    return seen / len(texts)


def marked(texts: list[str], marks: np.ndarray, size: int) -> list[bytes]:
    """The stretches of the texts that strings with a mark cover, touching ones in one; of 8 bytes, which zstandard asks for, where they are shorter."""
    out = []
    for text in map(flat, texts):
        at = np.flatnonzero(marks[grams(text, size)])
        if len(at):
            ends = np.flatnonzero(np.diff(at) > size)
            out += [text[i : max(j + size, i + 8)] for i, j in zip(at[np.r_[0, ends + 1]], at[np.r_[ends, len(at) - 1]])]
    return out


def told_apart(toxic: list[str], ordinary: list[str], fit: Fit) -> tuple[bytes, bytes]:
    """A dictionary of each: of the stretches that more documents of the one than of the other have."""
    x, y = spread(toxic, fit.gram), spread(ordinary, fit.gram)
    n, m = len(toxic), len(ordinary)
    both = (x * n + y * m) / (n + m)
    gap = (x - y) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / n + 1 / m))
    mine, theirs = marked(toxic, gap > fit.gap, fit.gram), marked(ordinary, gap < -fit.gap, fit.gram)
    return trained(mine, fit.own, fit.segment), trained(theirs, fit.own, fit.segment)


@dataclass
class Model:
    """Two dictionaries and the weights that turn a text's window differences into a chance."""

    fit: Fit
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def __post_init__(self):
        self._lengths = None

    def __getstate__(self):
        return self.__dict__ | {"_lengths": None}

    def distances(self, text: str | None) -> np.ndarray:
        """Per window the bytes that the toxic dictionary saves over the ordinary one."""
        if self._lengths is None:
            self._lengths = lengths(self.ordinary, self.fit.level), lengths(self.toxic, self.fit.level)
        ws = windows(text, self.fit.window)
        return self._lengths[0](ws) - self._lengths[1](ws)

    def summary(self, text: str | None) -> list[float]:
        """Share of windows beyond each cut, mean, and share on the other side; zeros without windows."""
        d = self.distances(text)
        if not len(d):
            return [0.0] * (len(self.fit.cuts) + 2)
        return [*(float((d >= c).mean()) for c in self.fit.cuts), float(d.mean()), float((d <= -2).mean())]

    def score(self, rows: list[list[float]]) -> np.ndarray:
        x = (np.array(rows, dtype=float).reshape(-1, len(self.fit.cuts) + 2) - self.mean) / self.spread
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    weight = weight / weight.sum()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (p - y)) + ridge * w)
    return w


def fit_model(toxic: list[str], ordinary: list[str], share: float, fit: Fit = Fit()) -> Model:
    """Dictionaries from four fifths of the texts, thresholds calibrated on the rest at the share of toxic labels.

    Without texts of both labels, the score is the share of toxic labels throughout.
    """
    d = len(fit.cuts) + 2
    level = Model(fit, b" " * 8, b" " * 8, np.zeros(d), np.ones(d), np.array([*[0.0] * d, np.log(max(share, 1e-4) / max(1 - share, 1e-4))]))
    if len(toxic) < 2 or len(ordinary) < 4:
        return level
    n, m = max(1, len(toxic) * 4 // 5), len(ordinary) * 4 // 5
    base = trained([w for t in ordinary[: min(m, n)] for w in windows(t, fit.window)], fit.base, fit.segment)
    mine, theirs = told_apart(toxic[:n], ordinary[:m], fit)
    model = Model(fit, theirs + base, mine + base, np.zeros(d), np.ones(d), np.zeros(d + 1))
    x = np.array([model.summary(t) for t in toxic[n:] + ordinary[m:]])
    y = np.array([1.0] * len(toxic[n:]) + [0.0] * len(ordinary[m:]))
    if y.min() == y.max():
        return level
    weight = np.where(y == 1, share / y.sum(), (1 - share) / (1 - y).sum())
    model.mean, model.spread = x.mean(0), x.std(0) + 1e-6
    model.weights = _logistic((x - model.mean) / model.spread, y, weight)
    return model


def learn(docs: DataFrame, labels: DataFrame, out: Column, fit: Fit = Fit()) -> Model:
    """Model of ``labels.toxic`` from a bounded sample of the labelled documents where ``out`` is false."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~out)
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # its number of rows is bounded by fit.rows
    chosen = F.broadcast(hash_sample(known, "y", fit.rows))
    texts = docs.select("doc_id", "text").where(F.length("text") <= fit.longest).join(chosen, "doc_id")
    rows = sorted((r["h"], r["y"], r["text"]) for r in texts.select(F.xxhash64("doc_id", "text").alias("h"), "y", "text").collect())
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit_model([t for _, y, t in rows if y == 1], [t for _, y, t in rows if y == 0], share, fit)


def judged(docs: DataFrame, labels: DataFrame, least: float = 0.5, k: int = 5, remainder: int = 0, fit: Fit = Fit()) -> DataFrame:
    """(doc_id, text, ...) and labels (doc_id, toxic) -> the columns of docs, held_out, score, predicted.

    Whole texts are scored; null and empty texts have no windows and score as texts without any difference. Rows whose
    crc32 has this remainder are never learned from. Columns of docs with the three new names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, held_out(k, remainder), fit))

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.score([shared.value.summary(t) for t in texts]))

    kept = docs.drop("held_out", "score", "predicted").withColumn("score", score("text"))
    return kept.withColumn("held_out", held_out(k, remainder)).withColumn("predicted", (F.col("score") >= least).cast("int"))
