import random

import numpy as np

from brindle.llm import toxicity
from tests.llm.common import awkward, documents, empty, prose


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train, test = labels.where("doc_id % 5 > 0"), labels.where("doc_id % 5 = 0")
    scored = toxicity.score(docs, toxicity.train(docs, train)).join(test, "doc_id")
    hit, said, there = scored.selectExpr("count_if(is_toxic and toxic = 1)", "count_if(is_toxic)", "count_if(toxic = 1)").first()
    assert hit / said > 0.9 and hit / there > 0.9


def test_logits_are_the_sum_over_all_pairs():
    rng = np.random.default_rng(1)
    terms = np.sort(rng.choice(1 << 22, 30, replace=False))
    model = toxicity.FactorizationMachine(terms, rng.normal(size=30), rng.normal(size=(30, 4)), -1.5)
    docs = [np.sort(rng.choice(terms, n, replace=False)) for n in (0, 1, 2, 7, 30)]
    got = model.logits(np.repeat(np.arange(5), [len(d) for d in docs]), np.concatenate(docs).astype(np.int64), 5)
    for d, score in zip(docs, got, strict=True):
        at = [int(np.searchsorted(terms, t)) for t in d]
        want = -1.5 + sum(model.w[i] for i in at) + sum(float(model.v[i] @ model.v[j]) for n, i in enumerate(at) for j in at[n + 1 :])
        assert abs(score - want) < 1e-6


def test_pairs_are_all_tested():
    """The blocks and bounds of the pair test leave out no pair."""
    rng = np.random.default_rng(4)
    y = (rng.random(600) < 0.3).astype(np.float32)
    here = rng.random((600, 40)) < rng.uniform(0.05, 0.6, 40)
    here[:, 3] |= (y > 0) & here[:, 5] & (rng.random(600) < 0.8)
    here[:, 8] = np.where(here[:, 9] & (y > 0), False, here[:, 8])
    doc, at = (x.astype(np.int32) for x in np.nonzero(here))
    df, pos = here.sum(axis=0).astype(np.int32), here[y > 0].sum(axis=0).astype(np.float32)
    base = float(y.mean())
    odds = np.log((pos + base) / (df - pos + 1 - base))
    want = np.zeros(40, dtype=bool)
    for a in range(40):
        for b in range(a):
            both = here[:, a] & here[:, b]
            if both.sum() < 2:
                continue
            p, e = y[both].mean(), 1 / (1 + np.exp(-(odds[a] + odds[b] - np.log(base / (1 - base)))))
            kl = p * np.log(max(p, 1e-9) / e) + (1 - p) * np.log(max(1 - p, 1e-9) / (1 - e))
            if both.sum() * kl >= np.log(40 * 39 / 2):
                want[[a, b]] = True
    got = toxicity._in_pairs(doc, at, y, df, pos, base)
    assert want.any() and not want.all() and (got == want).all()


def test_pairs_with_the_defaults(spark):
    """The four words are neutral by themselves; no screen of single terms may keep their pairs out."""
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(1500):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        w = prose(rng, 12).split() + ["insult"] * insult + ["group"] * group + ["calm"] * (not insult) + ["alone"] * (not group)
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(insult == group)))
    docs = documents(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    scored = toxicity.score(docs, toxicity.train(docs, marks.where("doc_id < 1200"))).join(marks, "doc_id").where("doc_id >= 1200")
    assert scored.where("is_toxic = (toxic = 1)").count() > 0.9 * scored.count()


def test_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None), (4, 7), (8, 0)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs, model).count() == docs.count()
    left = toxicity.reject(docs, model)
    assert left.schema == docs.schema
    nothing = toxicity.train(docs, labels.where("false"))
    assert toxicity.reject(docs, nothing).count() == docs.count()
    assert toxicity.score(empty(spark), toxicity.train(empty(spark), labels)).count() == 0
