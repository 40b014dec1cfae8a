"""Sums over all segmentations against a plain recursion, and what counts as a letter."""

import functools

import numpy as np
import pytest

from albumloom.llm import language


@pytest.mark.parametrize("length", [1, 7, 60])
def test_long_runs(length):
    pieces = language.Pieces(["▁a", "▁", "a", "b", "ab", "▁ab", "ba", "abbabab", "aaaaaaaaaaaaaaaaa"])
    rng = np.random.default_rng(length)
    p = np.concatenate((rng.dirichlet(np.ones(pieces.none)), [0, language.UNKNOWN]))
    words = ["".join(rng.choice(list("abc"), length)) for _ in range(20)] + ["a" * length]

    def brute(w):
        @functools.cache
        def total(at):
            if at == len(w):
                return 1.0
            out = sum(p[pieces.ids[w[at:k]]] * total(k) for k in range(at + 1, len(w) + 1) if w[at:k] in pieces.ids)
            return out + (language.UNKNOWN * total(at + 1) if w[at] not in pieces.ids else 0)

        return total(0)

    got = language.Model(["x"], pieces, p[:, None]).word_scores(words)[:, 0]
    assert got == pytest.approx([np.log(brute("▁" + w)) for w in words])


def test_letters(spark):
    assert language.runs("½ ² Ⅷ 12") == [] and language.runs("हिन्दी x1y") == ["हिन्दी", "x", "y"] and language.runs(None) == []
    model = language.Model(["a", "b"], language.Pieces(["▁x", "x"]), np.array([[0.1, 0.2], [0.5, 0.3], [0, 0], [1e-9, 1e-9]]))
    rows = [(1, "½ ² Ⅷ 12"), (2, "x"), (3, "हिन्दी"), (4, "x" * 20_000), (2, "x"), (5, "́")]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identified(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    assert got[1] == got[5] == "und" and got[2] == "a" and got[4] == "b" and got[3] in ("a", "b")


def test_scores_are_held(monkeypatch):
    pieces = language.Pieces(["▁", "a", "b", "ab"])
    model = language.Model(["x"], pieces, np.linspace(0.1, 0.4, pieces.unknown + 1)[:, None])
    monkeypatch.setattr(language, "MOST_WORDS", 3)
    held = language.Scores(model)
    for words in (["a", "ab"], ["ab", "b", "ba"], ["a"], ["bb", "a", "bb"], []):
        assert held.of(words).tolist() == model.word_scores(words).tolist()
