"""Token counts by a linear longest-match automaton: a trie with failure links and counts of the tokens they pop."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: the largest vocabulary file that is sent to every executor
MOST_BYTES = 64 << 20
#: characters that are held as words at a time
CHUNK = 2_000_000


@dataclass(frozen=True)
class Automaton:
    """Trie edges as sorted keys (state * 256 + byte) with their targets; failure state and tokens popped on failing.

    State 0 is the root. ``fail`` is -1 where the text cannot be cut on: the word is unknown.
    """

    keys: np.ndarray
    to: np.ndarray
    fail: np.ndarray
    pops: np.ndarray


def vocabulary(spark, path: str) -> list[bytes]:
    """Pieces of a byte-level tokenizer file (its 'model.vocab'), as bytes; read by Spark, its size checked."""
    row = spark.read.format("binaryFile").load(path).where(F.col("length") <= MOST_BYTES).select("content").first()
    if row is None:
        raise ValueError(f"no vocabulary of at most {MOST_BYTES} bytes at {path}")
    model = json.loads(bytes(row[0]))
    added = {t["content"] for t in model.get("added_tokens", [])}
    # printable stand-ins of bytes in byte-level vocabularies: the printable Latin-1 bytes are themselves
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}
    return [bytes(byte[c] for c in piece) for piece in model["model"]["vocab"] if piece not in added]


def automaton(pieces: list[bytes]) -> Automaton:
    """Trie of the pieces with failure links: where a state has no edge on, the longest piece on its path is popped,
    then the longest pieces of what is left, until the rest is a path of the trie again."""
    children: list[dict[int, int]] = [{}]
    ends = [False]
    for piece in pieces:
        at = 0
        for b in piece:
            if b not in children[at]:
                children[at][b] = len(children)
                children.append({})
                ends.append(False)
            at = children[at][b]
        ends[at] = at != 0
    fail, pops = [-1] * len(children), [0] * len(children)
    queue = [0]
    for at in queue:
        for b, child in children[at].items():
            queue.append(child)
            if ends[child]:
                fail[child], pops[child] = 0, 1
                continue
            # the popped tokens are those of the parent, then as many as it takes to go on with b
            state, count = fail[at], pops[at]
            while state >= 0 and b not in children[state]:
                count += pops[state]
                state = fail[state]
            if state >= 0:
                fail[child], pops[child] = children[state][b], count
    edges = sorted((s * 256 + b, c) for s, kids in enumerate(children) for b, c in kids.items())
    keys, to = (np.array(x, dtype=np.int64) for x in (zip(*edges) if edges else ((), ())))
    return Automaton(keys, to, np.array(fail, dtype=np.int64), np.array(pops, dtype=np.int64))


def count_pieces(a: Automaton, words: list[bytes]) -> np.ndarray:
    """Greedy longest-match pieces of each word; 1 for a word that cannot be cut. All words take a byte per step."""
    n = len(words)
    counts = np.zeros(n, np.int64)
    if not n or not len(a.keys):
        return np.array([int(bool(w)) for w in words], dtype=np.int64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    flat = np.frombuffer(b"".join(words), np.uint8)
    state = np.zeros(n, np.int64)

    def walk(rows: np.ndarray, keys: np.ndarray | None) -> None:
        """Follow ``keys`` (bytes), or fail to the root where they are None."""
        while len(rows):
            s = state[rows]
            if keys is None:
                done = s == 0
            else:
                wanted = s * 256 + keys
                at = np.minimum(np.searchsorted(a.keys, wanted), len(a.keys) - 1)
                done = a.keys[at] == wanted
                state[rows[done]] = a.to[at[done]]
            rows, s = rows[~done], s[~done]
            keys = keys[~done] if keys is not None else None
            counts[rows] += a.pops[s]
            state[rows] = a.fail[s]
            lost = state[rows] < 0
            unknown[rows[lost]] = True
            rows = rows[~lost]
            keys = keys[~lost] if keys is not None else None

    unknown = np.zeros(n, bool)
    order = np.argsort(-lengths, kind="stable")
    alive = n
    sizes = lengths[order]
    for step in range(int(lengths.max())):
        while alive and sizes[alive - 1] <= step:
            alive -= 1
        rows = order[:alive]
        rows = rows[~unknown[rows]]
        walk(rows, flat[starts[rows] + step].astype(np.int64))
    walk(np.flatnonzero(~unknown & (lengths > 0)), None)
    counts[unknown] = 1
    return counts


def _counter(shared):
    @pandas_udf("n_words bigint, n_tokens bigint")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        a = shared.value
        for texts in batches:
            words, tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            at = 0
            while at < len(texts):
                first, held, chars = at, [], 0
                while at < len(texts) and chars < CHUNK:
                    t = texts.iloc[at]
                    held.append(t.encode("utf-8", "surrogatepass").split() if isinstance(t, str) else [])
                    chars += len(t) if isinstance(t, str) else 0
                    at += 1
                flat = np.empty(sum(map(len, held)), dtype=object)
                flat[:] = list(chain.from_iterable(held))
                codes, unique = pd.factorize(flat)
                # a word is cut with the space before it, as the vocabulary has it
                each = count_pieces(a, [b" " + w for w in unique])[codes] if len(flat) else np.empty(0, np.int64)
                n = np.array([len(x) for x in held])
                words[first:at] = n
                tokens[first:at] = np.diff(np.concatenate(([0], np.cumsum(each)))[np.concatenate(([0], np.cumsum(n)))])
            yield pd.DataFrame({"n_words": words, "n_tokens": tokens})

    return counts


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_tokens: words cut greedily into the longest pieces of a public vocabulary.

    The automaton is built once from the vocabulary, whose size is checked, and sent to the executors; a word is read
    byte by byte, each once, and no pieces are made. Distinct words of a batch are walked together. Null, empty and
    blank texts have no words. Other columns are not read; rows that repeat are counted each.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(automaton(vocabulary(spark, path)))
    return docs.select("doc_id", _counter(shared)("text").alias("c")).select("doc_id", "c.*")
