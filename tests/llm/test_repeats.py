"""Substring dedup and suffix-array dedup against brute force."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from brindle.llm import anchors, rlz, suffixes
from tests.llm.common import awkward, documents, empty, prose, words


def brute(rows, span):
    first, out = {}, defaultdict(set)
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        for s in range(len(w) - span + 1):
            k = tuple(w[s : s + span])
            if first.setdefault(k, (i, s)) != (i, s):
                out[i].update(range(s, s + span))
    return dict(out)


def covered(rows):
    out = defaultdict(set)
    for r in rows:
        out[r.doc_id].update(range(r.start_word, r.end_word))
    return dict(out)


def corpus(seed):
    """Passages of many lengths, repeated in many places, some broken by edits, some periodic."""
    rng = random.Random(seed)
    passages = [prose(rng, n) for n in (15, 19, 20, 21, 35, 60, 90)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages).split()
            cut = rng.randint(0, 10)
            p = p[cut : len(p) - rng.randint(0, 8)]
            if p and rng.random() < 0.4:
                p[rng.randrange(len(p))] = "edited"
            parts += [prose(rng, rng.randint(0, 30)), " ".join(p)]
        if i % 10 == 0:
            parts.append("la la lo " * rng.randint(1, 40))
        rows.append((i, " ".join(parts)))
    rows.append((99, rows[5][1]))
    return rows


@pytest.mark.parametrize("module", [rlz, suffixes])
@pytest.mark.parametrize("seed", [1, 2])
def test_spans_are_exactly_the_repeated_blocks(spark, module, seed):
    rows = corpus(seed)
    found = module.repeats(documents(spark, rows), min_words=20).collect()
    assert covered(found) == brute(rows, 20)
    text = {i: words(t) for i, t in rows}
    for r in found:  # every span repeats its reference, which comes before
        size = r.end_word - r.start_word
        assert size >= 20
        assert text[r.doc_id][r.start_word : r.end_word] == text[r.ref_id][r.ref_start : r.ref_start + size]
        assert (r.ref_id, r.ref_start) < (r.doc_id, r.start_word)


def greedy(words, references, entries, span):
    """A quadratic parser: at a word, the longest agreement on any diagonal that is entered, taken from where it begins; on from its end."""
    out, at = [], 0
    diagonals = {(ref, place - start) for start, ref, place in entries}
    while at < len(words):
        best = None
        for ref, shift in diagonals:
            base, other = references[ref]
            agrees = lambda i: 0 <= i + shift - base < len(other) and words[i] == other[i + shift - base]  # noqa: B023, E731
            s = e = at
            while e < len(words) and agrees(e):
                e += 1
            while s > 0 and agrees(s - 1):
                s -= 1
            if e > at and e - s >= span:
                best = min(best or (-e, s, ref, s + shift), (-e, s, ref, s + shift))
        if best:
            out.append((best[1], -best[0], best[2], best[3]))
        at = -best[0] if best else at + 1
    return out


@pytest.mark.parametrize("seed", range(20))
def test_the_parse_is_greedy(seed):
    rng = np.random.default_rng(seed)
    words = rng.integers(0, 3, 120).astype(np.uint64)
    references, entries = {}, []
    for ref in range(5):
        other = rng.integers(0, 3, 80).astype(np.uint64)
        for _ in range(4):
            s, t, n = rng.integers(0, 80), rng.integers(0, 50), rng.integers(5, 30)
            other[t : t + n] = words[s : s + n]
            entries.append((int(s), ref, int(t) + 7 * ref))
        references[ref] = (7 * ref, other)
    assert rlz.parse(words, references, entries, 6) == greedy(words, references, entries, 6)


@pytest.mark.parametrize("seed", [1, 2])
def test_factors_are_as_long_as_their_references_agree(spark, seed):
    rows = corpus(seed)
    text = {i: words(t) for i, t in rows}
    repeated = brute(rows, 20)
    for r in rlz.repeats(documents(spark, rows), min_words=20).collect():
        mine, other = text[r.doc_id], text[r.ref_id]
        after, before = r.ref_start + r.end_word - r.start_word, r.ref_start - 1
        assert r.end_word == len(mine) or after == len(other) or mine[r.end_word] != other[after]
        assert r.start_word == 0 or before < 0 or mine[r.start_word - 1] != other[before] or r.start_word - 1 not in repeated[r.doc_id]


def test_a_factor_goes_on_where_another_reference_is_entered(spark):
    w = prose(random.Random(8), 300).split()
    rows = [(1, " ".join(w[100:160])), (2, " ".join(w)), (3, " ".join(w))]
    found = {tuple(r) for r in rlz.repeats(documents(spark, rows)).collect()}
    assert found == {(2, 100, 160, 1, 0), (3, 0, 300, 2, 0)}


@pytest.mark.parametrize("module", [rlz, suffixes])
def test_whole_table(spark, sf, module):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert covered(module.repeats(docs).collect()) == brute([(r.doc_id, r.text) for r in docs.collect()], 50)


@pytest.mark.parametrize("module", [rlz, suffixes])
def test_awkward_rows(spark, module):
    docs = awkward(spark)
    found = covered(module.repeats(docs).collect())
    once = {(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None}
    # rows of one id are one document, so its two equal rows aren't copies of each other
    assert found.keys() == brute([x for x in once if x[0] != 9] + [x for x in once if x[0] == 9], 50).keys()
    assert module.repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("size", [1, 2000, 1 << 30])
def test_combining_before_the_shuffle_changes_nothing(monkeypatch, size):
    monkeypatch.setattr(anchors, "COMBINE_BYTES", size)
    rows = corpus(3) + [(200 + i, corpus(3)[7][1]) for i in range(5)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], ["doc_id", "text"])
    parts = [batch.slice(i, 6) for i in range(0, len(rows), 6)]
    for make, solve in ((rlz._blocks, rlz.factor), (suffixes._segments, lambda t: suffixes.sort_piece(t, 20))):
        table = pa.Table.from_batches(list(anchors.combine(make(iter(parts), 20))))
        found = [table.filter(pc.is_null(table.column("content"))).select(["doc_id", "start", "n", "ref_id", "ref_start"]).to_pylist()]
        left = table.filter(pc.is_valid(table.column("content"))).sort_by([("key", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        for whole in anchors.lists(iter(left.select(["key", "doc_id", "start", "content"]).combine_chunks().to_batches())):
            found.append(solve(whole).to_pylist())
        got = defaultdict(set)
        for r in (r for part in found for r in part):
            got[r["doc_id"]].update(range(r["start"], r["start"] + r["n"] + 19))
        assert dict(got) == brute(rows, 20)


def test_equal_codes_of_different_words_are_told_apart(monkeypatch):
    """Codes of no bits at all: the windows' own hashes still tell."""
    monkeypatch.setattr(suffixes, "_codes", lambda hashed: np.zeros((len(hashed), suffixes.CODE), dtype=np.uint8))
    rng = random.Random(6)
    w = prose(rng, 40).split()
    rows = [(1, " ".join(w)), (2, " ".join([*w[:25], "other", *w[26:]])), (3, " ".join(w[3:]))]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], ["doc_id", "text"])
    monkeypatch.setattr(anchors, "COMBINE_BYTES", 1 << 30)
    table = pa.Table.from_batches(list(anchors.combine(suffixes._segments(iter([batch]), 20))))
    got = defaultdict(set)
    parts = [table.filter(pc.is_null(table.column("content"))).select(["doc_id", "start", "n"])]
    left = table.filter(pc.is_valid(table.column("content"))).sort_by([("key", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
    for whole in anchors.lists(iter(left.select(["key", "doc_id", "start", "content"]).combine_chunks().to_batches())):
        parts.append(pa.Table.from_batches([suffixes.sort_piece(whole, 20)]).select(["doc_id", "start", "n"]))
    for r in (r for part in parts for r in part.to_pylist()):
        got[r["doc_id"]].update(range(r["start"], r["start"] + r["n"] + 19))
    assert dict(got) == brute(rows, 20)


def test_blind_trie_sorts_with_common_prefixes():
    rng = np.random.default_rng(4)
    rows = rng.integers(0, 3, (200, 12)).astype(np.uint32)
    rows[50:90, :8] = 1
    order, lcp = suffixes.blind_trie(rows)
    assert sorted(order) == list(range(200))
    listed = rows[order].tolist()
    assert listed == sorted(rows.tolist())
    for a, b, n in zip(listed[:-1], listed[1:], lcp[1:], strict=True):
        same = next((i for i in range(12) if a[i] != b[i]), 12)
        assert n == same


def test_cut_repeats(spark):
    docs = awkward(spark)
    got = suffixes.cut_repeats(docs)
    assert got.columns == docs.columns
    before, after = docs.collect(), got.collect()
    spans = covered(suffixes.repeats(docs).collect())
    left = {(r.doc_id, r.text) for r in after}
    for r in before:
        if r.doc_id is None or r.doc_id not in spans:
            assert (r.doc_id, r.text) in left
        else:
            kept = [w for i, w in enumerate(words(r.text)) if i not in spans[r.doc_id]]
            match = [t for i, t in left if i == r.doc_id and words(t) == kept]
            assert bool(match) == bool(kept)
    assert all(r.n_chars == len(r.text) for r in after if r.doc_id in spans)
    assert suffixes.cut_repeats(empty(spark)).count() == 0
