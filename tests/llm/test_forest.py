import numpy as np

from brindle.llm import forest


def recall(df, found, k):
    rows = df.collect()
    x = np.array([r.embedding for r in rows], dtype=np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = x @ x.T
    np.fill_diagonal(sims, -9)
    ids = np.array([r.vec_id for r in rows])
    truth = {(int(ids[i]), int(ids[j])) for i in range(len(ids)) for j in np.argsort(-sims[i])[:k]}
    return len(truth & {(r.vec_id, r.neighbour) for r in found}) / len(truth)


def test_recall_of_every_row(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    found = forest.neighbours(df).collect()
    assert recall(df, found, 10) >= 0.95
    assert len(found) == 10 * df.count()
    assert all(abs(r.similarity) <= 1.001 and r.vec_id != r.neighbour for r in found)


def test_recall_with_many_pages_and_full_ones(spark, monkeypatch):
    """Small pages, a heap of equal vectors, clusters, and loners."""
    monkeypatch.setattr(forest, "PAGE", 40)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    x = np.concatenate([centres[rng.integers(0, 20, 500)] + 0.2 * rng.normal(size=(500, 16)), rng.normal(size=(60, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    assert recall(df, forest.neighbours(df, k=5).collect(), 5) >= 0.9
    heap = spark.createDataFrame([(1000 + i, [1.0] * 16) for i in range(400)], df.schema).unionAll(df)
    found = forest.neighbours(heap, k=5).where("vec_id >= 1000").collect()
    assert len(found) == 2000 and all(r.similarity > 0.999 for r in found)
    # more than k equal vectors: the least ids, in order
    for i in (1000, 1003, 1399):
        assert [r.neighbour for r in sorted((r for r in found if r.vec_id == i), key=lambda r: r.rank)] == [j for j in range(1000, 1007) if j != i][:5]


def test_stated_queries_have_the_neighbours_of_a_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = forest.neighbours(df, df.where("vec_id % 50 = 0")).collect()
    asked = {r.vec_id for r in found}
    assert asked == {r.vec_id for r in df.where("vec_id % 50 = 0").select("vec_id").collect()}
    rows = df.collect()
    x = np.array([r.embedding for r in rows], dtype=np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r.vec_id for r in rows])
    q = np.flatnonzero(ids % 50 == 0)
    sims = x[q] @ x.T
    sims[np.arange(len(q)), q] = -9
    truth = {(int(ids[i]), int(ids[j])) for i, row in zip(q, sims, strict=True) for j in np.argsort(-row)[:10]}
    assert len(truth & {(r.vec_id, r.neighbour) for r in found}) >= 0.95 * len(truth)
    assert len(found) == 10 * len(q)


def test_the_ascent_ends_at_the_target(spark):
    """In a cluster that is far from all else, candidates come from deep levels only, and the level falls with the target."""
    rng = np.random.default_rng(2)
    strings = np.sort(rng.integers(0, 2**63, 500).astype(np.uint64))
    for bits in (0, 3):
        ask = strings[100:101]
        lo, hi = forest._range(strings, np.repeat(ask, 65), np.arange(65))
        want = [int(np.sum((strings ^ ask[0]) >> np.uint64(64 - d) == 0)) if d else 500 for d in range(65)]
        assert (hi - lo).tolist() == want
        counts = np.array(want[bits:], dtype=np.int64).tobytes()
        batch = forest.pa.RecordBatch.from_arrays([forest.pa.array([7, 7], forest.pa.int64()), forest.pa.array([counts, counts])], ["vec_id", "counts"])
        for target in (1, 2, 50, 400):
            [level] = [r for b in forest._stop(iter([batch]), bits, target) for r in b.column(1).to_pylist()]
            assert level == max([d for d in range(bits, 65) if 2 * want[d] >= target], default=bits)


def test_awkward_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (None, [1.0, 1.0]), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 as cell", "2 as string", "3 as count", "4 as parts")
    got = {(r.vec_id, r.neighbour, r.rank) for r in forest.neighbours(df).collect()}
    assert got == {(1, 2, 1), (2, 1, 1)}
    assert forest.neighbours(df, df.where("vec_id = 1 or vec_id = 3 or vec_id is null")).count() == 1
    assert forest.neighbours(df, df.where("false")).count() == 0
    assert forest.neighbours(df.where("false")).count() == 0
    assert forest.neighbours(df.where("vec_id = 2")).count() == 0
