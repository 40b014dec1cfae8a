"""Language identification: per-language unigrams over a fixed piece vocabulary, summed over all segmentations."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from albumloom.llm.common import hash_sample
from albumloom.llm.tokencount import MOST_BYTES

#: what a word starts with in the vocabulary
START = "▁"
CHUNK = 4_000_000
UNKNOWN = 1e-9
#: words whose scores a worker holds at most before it begins anew
MOST_WORDS = 300_000


@cache
def run_pattern() -> re.Pattern:
    """Runs of letters and their marks, by Unicode category L and M; a run begins with a letter."""
    kinds = "".join(unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1))
    spans = lambda of: "".join(f"{re.escape(chr(m.start()))}-{re.escape(chr(m.end() - 1))}" for m in re.finditer(of, kinds))
    return re.compile(f"[{spans('L+')}][{spans('[LM]+')}]*")


def runs(text: str | None) -> list[str]:
    return run_pattern().findall(text.lower()) if isinstance(text, str) else []


@dataclass(frozen=True)
class Fit:
    """``rows`` documents per language bound what is learned from; all their words count."""

    rows: int = 500
    rounds: int = 3
    smooth: float = 0.05


@dataclass(frozen=True)
class Lattice:
    """All ways to put words together out of pieces. Nodes are places between characters, those of a word in a row.

    An edge is a piece (``piece``) from node ``source`` to node ``end``. Edges are in order of the place of their
    end in its word and then of the node; ``steps`` cuts them by place, ``heads`` are the first edges of each end. ``first`` and ``last`` are the
    outer nodes of each word.
    """

    source: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    steps: np.ndarray
    heads: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def forward(self, logs: np.ndarray) -> np.ndarray:
        """Per node the log chance of all segmentations up to it; ``logs`` has one column per language or none."""
        out = np.zeros((self.last[-1] + 1, *logs.shape[1:]))
        cuts = np.searchsorted(self.heads, self.steps)
        for k in range(len(self.steps) - 1):
            a, b = self.steps[k], self.steps[k + 1]
            heads = self.heads[cuts[k] : cuts[k + 1]]
            out[self.end[heads]] = np.logaddexp.reduceat(out[self.source[a:b]] + logs[self.piece[a:b]], heads - a, axis=0)
        return out


class Pieces:
    """The vocabulary's pieces of letters as a trie, and lattices of words over them.

    Edges of the trie are sorted keys (state * characters + character) with their targets; ``at_state`` is the piece
    that ends in a state. ``longest`` leaves longer pieces out; none by default.
    """

    def __init__(self, pieces: list[str], longest: int | None = None):
        letters = run_pattern()
        whole = lambda p: not p or letters.fullmatch(p)
        kept = sorted({p for p in pieces if p and whole(p.removeprefix(START)) and (longest is None or len(p) <= longest)})
        self.ids = {p: i for i, p in enumerate(kept)}
        self.none, self.unknown = len(kept), len(kept) + 1
        self.longest = max(map(len, kept), default=1)
        self.chars = np.array(sorted({ord(c) for p in kept for c in p}), np.int64)
        code = {int(c): i for i, c in enumerate(self.chars)}
        edges: dict[int, int] = {}
        ends = [self.none]
        for i, p in enumerate(kept):
            state = 0
            for c in p:
                key = state * len(code) + code[ord(c)]
                if key not in edges:
                    edges[key] = len(ends)
                    ends.append(self.none)
                state = edges[key]
            ends[state] = i
        self.keys = np.array(sorted(edges), np.int64)
        self.to = np.array([edges[int(k)] for k in self.keys], np.int64)
        self.at_state = np.array(ends, np.int64)

    def _step(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The state each goes on to, -1 where there is none; codes are -1 for characters that no piece has."""
        if not len(self.keys):
            return np.full(len(state), -1, np.int64)
        key = state * len(self.chars) + codes
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((codes >= 0) & (self.keys[at] == key), self.to[at], -1)

    def lattice(self, words: list[str]) -> Lattice:
        """Walks the trie from all characters of all words at once; a character that is no piece stands for itself."""
        marked = [START + w for w in words]
        size = np.fromiter(map(len, marked), np.int64, len(marked))
        points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), size)
        offset = np.arange(len(points)) - np.repeat(np.cumsum(size) - size, size)
        codes = np.searchsorted(self.chars, points)
        codes = np.where(self.chars[np.minimum(codes, len(self.chars) - 1)] == points, codes, -1) if len(self.chars) else np.full(len(points), -1, np.int64)
        rows, state, found = np.arange(len(points)), np.zeros(len(points), np.int64), []
        for k in range(self.longest):
            state = self._step(state, codes[rows + k])
            piece = np.where(state >= 0, self.at_state[state], self.none)
            if k == 0:
                piece = np.where(piece == self.none, self.unknown, piece)
            told = piece != self.none
            found.append((rows[told], np.full(int(told.sum()), k + 1), piece[told]))
            on = (state >= 0) & (offset[rows] + k + 1 < size[word[rows]])
            rows, state = rows[on], state[on]
        start, length, piece = (np.concatenate(x) for x in zip(*found))
        # a word of t characters has t + 1 nodes
        source = start + word[start]
        end, place = source + length, offset[start] + length
        order = np.lexsort((end, place))
        source, end, piece, place = source[order], end[order], piece[order], place[order]
        steps = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1, [len(place)]))
        heads = np.concatenate(([0], np.flatnonzero(np.diff(end)) + 1)) if len(end) else np.empty(0, np.int64)
        last = np.cumsum(size + 1) - 1
        return Lattice(source, end, piece, steps, heads, last - size, last)


def learn_pieces(pieces: Pieces, words: list[str], counts: np.ndarray, fit: Fit) -> np.ndarray:
    """Piece chances by expectation maximisation: expected uses of each piece over all segmentations of the words."""
    size = len(pieces.ids)
    own = pieces.lattice(words)
    # the same edges in order of their sources, for sums from the end
    word = np.repeat(np.arange(len(words)), own.last - own.first + 1)
    left = own.last[word[own.source]] - own.source
    order = np.lexsort((own.source, left))
    back = Lattice(
        own.end[order], own.source[order], own.piece[order], np.concatenate(([0], np.flatnonzero(np.diff(left[order])) + 1, [len(order)])),
        np.concatenate(([0], np.flatnonzero(np.diff(own.source[order])) + 1)), own.last, own.last,
    )
    uses = np.bincount(own.piece, counts[word[own.source]], size + 2)
    p = np.zeros(size + 2)
    for step in range(fit.rounds + 1):
        p = np.zeros(size + 2)
        p[:size] = (uses[:size] + fit.smooth) / (uses[:size].sum() + fit.smooth * size)
        p[pieces.unknown] = UNKNOWN
        if step < fit.rounds:
            logs = np.log(np.maximum(p, 1e-300))
            alpha, beta = own.forward(logs), back.forward(logs)
            chance = alpha[own.source] + logs[own.piece] + beta[own.end] - alpha[own.last][word[own.source]]
            uses = np.bincount(own.piece, np.exp(chance) * counts[word[own.source]], size + 2)
    return p


@dataclass
class Model:
    langs: list[str]
    pieces: Pieces
    p: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log chance of each word under each language, all segmentations summed, whatever its length."""
        if not len(words) or not self.langs:
            return np.zeros((len(words), len(self.langs)))
        lattice = self.pieces.lattice(words)
        return lattice.forward(np.log(np.maximum(self.p, 1e-300)))[lattice.last]


class Scores:
    """Scores of the words that a worker has seen, so that a word that comes again is looked up."""

    def __init__(self, model: Model):
        self.model, self.index, self.table = model, {}, np.zeros((0, len(model.langs)))

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.index) > MOST_WORDS:
            self.index, self.table = {}, self.table[:0]
        new = [w for w in words if w not in self.index]
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.table = np.concatenate((self.table, self.model.word_scores(new)))
        return self.table[[self.index[w] for w in words]]


_scores: dict[int, Scores] = {}


def held_scores(shared: Broadcast) -> Scores:
    """The scores of this model in this worker, which may work on one task after another."""
    model = shared.value
    if id(model) not in _scores:
        _scores.clear()
        _scores[id(model)] = Scores(model)
    return _scores[id(model)]


def read_pieces(spark, path: str) -> list[str]:
    """Pieces of a sentencepiece model, read by Spark; its size is checked."""
    import sentencepiece

    row = spark.read.format("binaryFile").load(path).where(F.col("length") <= MOST_BYTES).select("content").first()
    if row is None:
        raise ValueError(f"no model of at most {MOST_BYTES} bytes at {path}")
    model = sentencepiece.SentencePieceProcessor(model_proto=bytes(row[0]))
    return [model.id_to_piece(i) for i in range(model.get_piece_size())]


def _runs(text: str) -> Column:
    @pandas_udf("array<string>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([runs(t) for t in texts], dtype=object)

    return of(text)


def learn(docs: DataFrame, path: str, out: Column, fit: Fit = Fit()) -> Model:
    """Model of the languages in ``docs.lang`` from a bounded sample of the documents where ``out`` is false."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~out).select("doc_id", "lang", "text")
    words = hash_sample(known, "lang", fit.rows).select("lang", F.explode(_runs("text")).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    rows = words.toPandas()
    pieces = Pieces(read_pieces(docs.sparkSession, path))
    langs = sorted(rows["lang"].unique())
    tables = []
    for lang in langs:
        own = rows[rows["lang"] == lang].sort_values("word")
        tables.append(learn_pieces(pieces, own["word"].tolist(), own["n"].to_numpy(float), fit))
    return Model(langs, pieces, np.array(tables).T if tables else np.zeros((pieces.unknown + 1, 0)))


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text, ...) -> the columns of docs, lang_pred, score.

    The chance of a text is the product over its words; score is the chance of the language foretold against all
    others. Null texts, texts without letters (number signs are none), and all texts where no language was learned are
    'und' with score 0. A run of letters and marks of any length is one word, as in scripts without spaces; repeated rows
    have equal results; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("lang_pred string, score double")
    def foretell(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, m = held_scores(shared), shared.value
        for texts in batches:
            langs, scores, at = [], [], 0
            while at < len(texts):
                held, chars = [], 0
                while at < len(texts) and chars < CHUNK:
                    t = texts.iloc[at]
                    held.append(runs(t))
                    chars += len(t) if isinstance(t, str) else 0
                    at += 1
                flat = np.empty(sum(map(len, held)), dtype=object)
                flat[:] = list(chain.from_iterable(held))
                codes, unique = pd.factorize(flat)
                each = known.of(list(unique))[codes]
                ends = np.cumsum([len(x) for x in held])
                total = np.concatenate((np.zeros((1, len(m.langs))), np.cumsum(each, axis=0)))
                for a, b in zip(np.concatenate(([0], ends[:-1])), ends):
                    if a == b or not m.langs:
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    z = total[b] - total[a]
                    best = int(np.argmax(z))
                    langs.append(m.langs[best])
                    scores.append(float(1 / np.exp(z - z[best]).sum()))
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return docs.withColumn("_l", foretell("text")).select(*[c for c in docs.columns if c not in ("lang_pred", "score")], "_l.*")
