import math
import random

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import minhash
from brindle.llm.components import components
from brindle.llm.textkernel import buffers, words_of
from tests.llm.common import awkward, documents, empty, prose


def brute(rows, coords=minhash.COORDS, threshold=minhash.THRESHOLD):
    """Groups over all pairs of signatures."""
    data, base = buffers(pa.array([t or "" for _, t in rows]))
    texts, sig = minhash.signatures(words_of(data, base), coords)
    ids = [rows[t][0] for t in texts]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero((sig[i] == sig[i + 1 :]).sum(axis=1) >= math.ceil(threshold * coords)) + i + 1:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for x in range(len(ids)):
        least[find(x)] = min(least.get(find(x), ids[x]), ids[x])
    return {(ids[x], least[find(x)]) for x in range(len(ids)) if ids[x] != least[find(x)]}


def edited(rng, text, share):
    w = text.split()
    for _ in range(int(len(w) * share)):
        w[rng.randrange(len(w))] = prose(rng, 1)
    return " ".join(w)


def links(rows, coords=minhash.COORDS, threshold=minhash.THRESHOLD):
    """Of each document, the least one with its signature, and how many other signatures match."""
    data, base = buffers(pa.array([t or "" for _, t in rows]))
    texts, sig = minhash.signatures(words_of(data, base), coords)
    distinct, which = np.unique(sig, axis=0, return_inverse=True)
    need = math.ceil(threshold * coords)
    number = [int(((distinct == x).sum(axis=1) >= need).sum()) - 1 for x in distinct]
    least = {}
    for t, w in zip(texts, which.ravel().tolist(), strict=True):
        least[w] = min(least.get(w, rows[t][0]), rows[t][0])
    return {rows[t][0]: (least[w], number[w]) for t, w in zip(texts, which.ravel().tolist(), strict=True)}


@pytest.mark.parametrize("block", [5, 2048])
def test_groups_and_links_are_those_of_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(5)
    rows, n = [], 0
    for share in (0, 0.02, 0.05, 0.1, 0.2, 0.3):
        for _ in range(12):
            text = prose(rng, rng.randint(3, 120))
            for _ in range(rng.randint(1, 12)):
                rows.append((n, edited(rng, text, share)))
                n += 1
    want = links(rows)
    for r in (found := minhash.near_duplicates(documents(spark, rows)).collect()):
        assert (r.class_id, r.links) == want[r.doc_id]
    assert {(r.doc_id, r.kept_id) for r in found} == brute(rows)


@pytest.mark.parametrize("block", [7, 2048])
def test_long_lists_in_blocks(block, monkeypatch):
    """One list of 60 classes, a third of them linked; blocks and small portions of pairs change nothing."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "PAIRS", 50)
    rng = np.random.default_rng(1)
    sig = rng.integers(0, 2**32, (60, 64), dtype=np.uint32)
    sig[::3, :40] = sig[0, :40]
    sig[:, 63] = 9
    n = np.array([(sig[:, c] == sig[i, c]).sum() for i in range(60) for c in range(64)]).reshape(60, 64)
    lists = [sorted({"step": int(4 * math.log2(n[i, c])), "key": c << 32 | int(sig[i, c]), "n": int(n[i, c])}.items() for c in range(64) if n[i, c] > 1) for i in range(60)]
    lists = [sorted((dict(x) for x in one), key=lambda x: (x["step"], x["key"])) for one in lists]
    use = [i for i in range(60) if len(lists[i]) >= 29]
    kind = pa.list_(pa.struct([("step", pa.int32()), ("key", pa.int64()), ("n", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(use, pa.int64()), pa.array([sig[i].tobytes() for i in use]), pa.array([lists[i] for i in use], kind)], ["profile", "sig", "lists"])
    rows = pa.Table.from_batches(list(minhash._emit(iter([batch]), 64, 29))).sort_by([(c, "ascending") for c in ("key", "low", "high", "part")])
    found = [r for b in minhash._links(iter(rows.combine_chunks().to_batches(max_chunksize=13)), 64, 29) for r in b.to_pylist()]
    total = {}
    for r in found:
        total[r["a"]] = total.get(r["a"], 0) + r["links"]
    assert {k: v for k, v in total.items() if v} == {i: 19 for i in range(0, 60, 3)}


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found, rows = minhash.near_duplicates(docs).collect(), [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    assert {(r.doc_id, r.kept_id) for r in found} == brute(rows)
    want = links(rows)
    assert all((r.class_id, r.links) == want[r.doc_id] for r in found)


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = {(r.doc_id, r.kept_id) for r in minhash.near_duplicates(docs).collect()}
    # by brute force: of the equal rows of one id one is taken, and rows without an id are left out
    assert got == brute(sorted({(r.doc_id, r.text or "") for r in docs.collect() if r.doc_id is not None}))
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - docs.where(f"doc_id in ({','.join(str(a) for a, _ in got)})").count()
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (10, 11), (11, 10), (12, 11), *[(i, i + 1) for i in range(100, 160)], (None, 1)]
    got = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "x bigint, y bigint"), "x", "y").collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (10, 10), (11, 10), (12, 10), *((i, 100) for i in range(100, 161))}
