import math
from collections import Counter

import numpy as np

from brindle.llm import lm
from tests.llm.common import awkward, empty, words


def bucket_of(ab, b):
    """Powers of two of the pair's count, or of the word's where the pair is unseen."""
    if ab:
        return 1 + min(int(math.log2(ab)), 13)
    return 16 + min(int(math.log2(b)), 15) if b else 15


def brute(rows, rounds=60):
    """Deleted interpolation from dictionaries of counts, token by token: scores and weights."""
    folds = lm.fold_of(np.array([i for i, _ in rows]), lm.FOLDS).tolist()
    counts, size, vocab, texts = [Counter() for _ in range(lm.FOLDS)], [0] * lm.FOLDS, set(), []
    for (_, text), fold in zip(rows, folds, strict=True):
        s = ["<1>", "<2>", *words(text), "<3>"]
        texts.append(s)
        size[fold] += len(s) - 2
        vocab |= set(s)
        for n in (1, 2, 3):
            counts[fold].update(tuple(s[i : i + n]) for i in range(len(s) - n + 1))
    total = sum(counts, Counter())
    found, unknown = [], 1 / (len(vocab) + 1)
    for s, fold in zip(texts, folds, strict=True):
        c = lambda *gram: total[gram] - counts[fold][gram]  # noqa: B023, E731
        tokens = []
        for i in range(2, len(s)):
            ab, b = c(*s[i - 2 : i]), c(s[i - 1])
            p3 = c(*s[i - 2 : i + 1]) / ab if ab else 0.0
            p2 = c(*s[i - 1 : i + 1]) / b if b else 0.0
            tokens.append((bucket_of(ab, b), p3, p2, c(s[i]) / max(1, sum(size) - size[fold]), unknown))
        found.append(np.array(tokens))
    everything = np.concatenate(found)
    kinds, p = everything[:, 0].astype(int), everything[:, 1:]
    weights = np.full((32, 4), 0.25)
    for _ in range(rounds):
        share = weights[kinds] * p
        share /= share.sum(axis=1, keepdims=True)
        for k in np.unique(kinds):
            weights[k] = share[kinds == k].mean(axis=0)
    score = lambda w: sorted((i, len(f), float(np.log2((w[f[:, 0].astype(int)] * f[:, 1:]).sum(axis=1)).sum())) for (i, _), f in zip(rows, found, strict=True))
    return score, weights


def compare(got, want):
    """The relative differences of the documents' log-probabilities."""
    got = sorted((r.doc_id, r.tokens, r.log2_prob) for r in got)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    return np.array([abs(x[2] - y[2]) / max(1.0, abs(y[2])) for x, y in zip(got, want, strict=True)])


def test_whole_table(spark, sf, monkeypatch):
    """With the hashes' own width, counts and estimates are exact (but for a shared hash); the histogram's weights are as good as exact ones."""
    monkeypatch.setattr(lm, "BUCKET_ENTRIES", 20_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    score, weights = brute([(r.doc_id, r.text) for r in docs.collect()])
    off = compare(lm.score(docs, weights=weights).collect(), score(weights))
    assert off.max() < 0.01 and (off < 1e-9).mean() > 0.95
    learned = lm.score(docs).collect()
    assert compare(learned, score(weights)).max() < 0.01
    assert abs(sum(r.log2_prob for r in learned) / sum(x[2] for x in score(weights)) - 1) < 1e-3


def test_wide_hashes_give_exact_scores(spark, sf, monkeypatch):
    monkeypatch.setattr(lm, "SPARE_BITS", 36)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    score, weights = brute([(r.doc_id, r.text) for r in docs.collect()], rounds=3)
    assert compare(lm.score(docs, weights=weights).collect(), score(weights)).max() < 1e-9


def test_awkward_rows(spark):
    docs = awkward(spark)
    score, weights = brute([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    assert compare(lm.score(docs, weights=weights).collect(), score(weights)).max() < 1e-3
    assert lm.score(docs).count() == docs.where("doc_id is not null").count()
    assert lm.score(empty(spark)).count() == 0


def test_em_never_lowers_the_likelihood():
    rng = np.random.default_rng(0)
    kinds, n = rng.integers(0, 32, 500), rng.integers(1, 50, 500)
    p = rng.random((3, 500)) * (rng.random((3, 500)) < 0.7)
    last = -np.inf
    for rounds in (1, 2, 5, 20):
        weights = lm.learn(kinds, n, p, 10_000, rounds)
        now = (n * np.log((weights[kinds] * np.column_stack([*p, np.full(500, 1e-4)])).sum(axis=1))).sum()
        assert now >= last and np.allclose(weights.sum(axis=1), 1)
        last = now
