"""MinHash near-dedup by a signature-coordinate inverted join.

Every document gets ``coords`` MinHash values over its distinct shingles of
``shingle`` lower-cased words (a shorter document is one shingle).  Two documents
are near copies if at least ``ceil(threshold * coords)`` coordinates agree.

The join works on an inverted index of the coordinate-value pairs:

1. documents with one signature are one *class*, so exact copies cost nothing;
2. each class is posted under its coordinate-value pairs; the lengths of the
   posting lists are counted, and lists of one class are dropped;
3. **prefix**: lists are ordered by length (in steps of a quarter power of two), then key.  A class left in
   fewer lists than the match threshold ``T`` has no partner.  Of a class in ``s`` lists only
   the ``s - T + 1`` first are merged: two classes that collide ``T`` times share one of those;
4. **skip**: classes that meet in a list are counted on from there, in strides of
   coordinates, and a pair is left as soon as its misses rule out ``T`` collisions.  A pair is
   counted in the first list that both have and skipped in all others;
5. pairs above the threshold are retained as links: their number for every class, and a
   spanning forest of each list's links for the groups.

A list of more than ``BLOCK`` classes is cut into blocks, and each pair of blocks is a
task's work of its own.  No list is capped, and no link between different texts is lost: all
pairs within a list are compared, so many different near copies of one text take
quadratic work (spread over tasks), though no more than a row each of output.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.components import components
from brindle.llm.runtime import materialise, named, prepare, without
from brindle.llm.textkernel import U64, Words, chunks, lower_ascii, mix, window_hashes, window_ok

COORDS, SHINGLE, THRESHOLD, SEED = 64, 3, 0.45, 11
STRIDE = 16
#: Pairs that are compared at a time, and classes of a block of a long list.
PAIRS, BLOCK = 1 << 17, 2048


def _constants(coords: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, coords, dtype=np.uint64) * U64(2) + U64(1)


def signatures(words: Words, coords: int = COORDS, shingle: int = SHINGLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have words, and their MinHash values (uint32, one row each)."""
    hashed = words.hashes(lower_ascii(words.data))
    counts = words.counts
    long_ones = np.maximum(counts - shingle + 1, 0)
    grams = window_hashes(hashed, shingle)[window_ok(words.first, shingle)]
    short = np.flatnonzero((counts > 0) & (long_ones == 0))
    if len(short):
        whole = np.array([_whole(hashed[words.first[d] : words.first[d + 1]]) for d in short], dtype=U64)
        grams = np.insert(grams, np.concatenate([[0], np.cumsum(long_ones)])[short], whole)
        long_ones[short] = 1
    texts = np.flatnonzero(long_ones)
    edge = np.concatenate([[0], np.cumsum(long_ones)])[texts]
    out = np.empty((len(texts), coords), dtype=np.uint32)
    if len(texts):
        scratch = np.empty_like(grams)
        for k, factor in enumerate(_constants(coords, seed)):
            np.multiply(grams, factor, out=scratch)
            np.right_shift(scratch, U64(32), out=scratch)
            out[:, k] = np.minimum.reduceat(scratch, edge)
    return texts, out


def _whole(hashes: np.ndarray) -> np.uint64:
    total = U64(len(hashes))
    with np.errstate(over="ignore"):
        for h in hashes:
            total = total * U64(0x9E3779B97F4A7C15) + h
    return mix(np.array([total], dtype=U64))[0]


def _sign(batches: Iterator[pa.RecordBatch], coords: int, shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, words in chunks(batch, "text"):
            texts, values = signatures(words, coords, shingle)
            rows = [x.tobytes() for x in values]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(texts)), pa.array(rows, pa.binary())], ["doc_id", "sig"])


def _post(batches: Iterator[pa.RecordBatch], coords: int) -> Iterator[pa.RecordBatch]:
    """Postings of profiles: the coordinate in a key's upper half, the value in the lower."""
    upper = np.arange(coords, dtype=U64) << U64(32)
    for batch in batches:
        values = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(-1, coords)
        keys = (values | upper).view(np.int64).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column(0).to_numpy(), coords))], ["key", "profile"])


def _agree(sig: np.ndarray, a: np.ndarray, b: np.ndarray, need: int) -> np.ndarray:
    """Whether rows ``a`` and ``b`` of ``sig`` agree ``need`` times, skipping pairs that can't."""
    coords = sig.shape[1]
    out = np.zeros(len(a), dtype=bool)
    rows, have = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for at in range(0, coords, STRIDE):
        part = sig[:, at : at + STRIDE]
        have += (part[a[rows]] == part[b[rows]]).sum(axis=1)
        stay = have + max(0, coords - at - STRIDE) >= need
        rows, have = rows[stay], have[stay]
    out[rows[have >= need]] = True
    return out


def _emit(batches: Iterator[pa.RecordBatch], coords: int, need: int) -> Iterator[pa.RecordBatch]:
    """Prefix postings: ``(key, low, high, part, profile, sig, steps)``, once for each pair of blocks of a long list."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            lists = part.column(2)
            size = pc.list_value_length(lists).to_numpy()
            flat = lists.flatten()
            step, key, n = (pc.struct_field(flat, i).to_numpy() for i in range(3))
            owner = np.repeat(np.arange(len(size)), size)
            steps = np.zeros((len(size), coords), dtype=np.uint8)
            steps[owner, key >> 32] = step
            place = np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)
            use = place < size[owner] - (need - 1)
            key, n, owner = key[use], n[use], owner[use]
            blocks = -(-n // BLOCK)
            mine = (mix(part.column(0).to_numpy().view(U64))[owner] % blocks.astype(U64)).astype(np.int64)
            again = np.repeat(np.arange(len(key)), blocks)
            other = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            row, mine = owner[again], mine[again]
            arrays = [pa.array(key[again]), *[pa.array(x.astype(np.int32)) for x in (np.minimum(mine, other), np.maximum(mine, other), mine)], part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array([x.tobytes() for x in steps], pa.binary()).take(pa.array(row))]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "low", "high", "part", "profile", "sig", "steps"])


def merge_lists(key: np.ndarray, low: np.ndarray, high: np.ndarray, part: np.ndarray, sig: np.ndarray, steps: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of some whole lists (or pairs of blocks), sorted by list and part.

    Returns, for each row, how many links are counted in its list, and the least row of its list that links lead to.
    """
    rows = len(key)
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
    edge = np.append(np.flatnonzero(new), rows)
    end = np.repeat(edge[1:], np.diff(edge))
    # within a block, all later rows; of two blocks, the second's rows for each of the first's
    turn = np.concatenate([[True], new[1:] | (part[1:] != part[:-1])])
    second = np.append(np.flatnonzero(turn), rows)[np.cumsum(turn)]
    one = low == high
    begin = np.where(one, np.arange(rows) + 1, np.where(part == low, np.minimum(second, end), end))
    size = end - begin
    links, root = np.zeros(rows, dtype=np.int64), np.arange(rows)
    total = np.concatenate([[0], np.cumsum(size)])
    upper = np.arange(sig.shape[1], dtype=U64) << U64(32)
    at = 0
    while at < rows:
        to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, side="right")) - 1)
        a = np.repeat(np.arange(at, to), size[at:to])
        b = np.repeat(begin[at:to], size[at:to]) + np.arange(len(a)) - np.repeat(total[at:to] - total[at], size[at:to])
        hit = _agree(sig, a, b, need)
        a, b = a[hit], b[hit]
        for s in range(0, len(a), 1 << 15):
            x, y = a[s : s + (1 << 15)], b[s : s + (1 << 15)]
            order = (steps[x].astype(U64) << U64(40)) | upper | sig[x]
            here = (steps[x, key[x] >> 32].astype(U64) << U64(40)) | key[x].view(U64)
            first = np.where(sig[x] == sig[y], order, ~U64(0)).min(axis=1) == here
            links += np.bincount(x[first], minlength=rows) + np.bincount(y[first], minlength=rows)
        while len(a):  # union by least roots
            root = _settle(root)
            x, y = root[a], root[b]
            apart = x != y
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        at = to
    return links, _settle(root)


def _settle(root: np.ndarray) -> np.ndarray:
    while True:
        up = root[root]
        if (up == root).all():
            return root
        root = up


def _links(batches: Iterator[pa.RecordBatch], coords: int, need: int) -> Iterator[pa.RecordBatch]:
    """``(a, b, links)``: classes that are linked, and how many links a class has in some lists; rows arrive sorted by list and part."""

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        key, low, high, part, profile = (table.column(i).to_numpy() for i in range(5))
        sig = np.frombuffer(b"".join(table.column(5).to_pylist()), dtype=np.uint32).reshape(-1, coords)
        steps = np.frombuffer(b"".join(table.column(6).to_pylist()), dtype=np.uint8).reshape(-1, coords)
        links, root = merge_lists(key, low, high, part, sig, steps, need)
        apart = root != np.arange(len(root))
        x, y = profile[apart], profile[root[apart]]
        both = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], axis=1), axis=0)
        some, which = np.unique(profile[links > 0], return_inverse=True)
        sums = np.bincount(which, links[links > 0], len(some)).astype(np.int64)
        arrays = [pa.array(np.concatenate([both[:, 0], some])), pa.concat_arrays([pa.array(both[:, 1]), pa.nulls(len(some), pa.int64())]), pa.array(np.concatenate([np.zeros(len(both), np.int64), sums]))]
        return pa.RecordBatch.from_arrays(arrays, ["a", "b", "links"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key, low, high = (batch.column(i).to_numpy() for i in range(3))
        if rows >= 20_000:
            last = tuple(held[-1].column(i)[-1].as_py() for i in range(3))
            other = np.flatnonzero((key != last[0]) | (low != last[1]) | (high != last[2]))
            if len(other):  # the list that was held may go on up to here
                held.append(batch.slice(0, int(other[0])))
                yield done(held)
                batch, held, rows = batch.slice(int(other[0])), [], 0
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield done(held)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", coords: int = COORDS, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, kept_id, class_id, links)``: each document that repeats another, and its group's least id.

    Groups are the components of the pairs whose signatures agree at least
    ``ceil(threshold * coords)`` times; the document ``kept_id`` itself has no
    row.  ``class_id`` is the least document with the same signature, and ``links`` is how many
    other classes match it, wherever they are.  Rows without an id, and documents
    without words (empty, white space or null), are in no group.  Rows that share an id count as one
    document, so a repeated row is not its own copy; the result has one row for an id (of
    several texts with it the one with the least class, and the most links).
    """
    spark = docs.sparkSession
    prepare(spark)
    need = math.ceil(threshold * coords)
    signed = materialise(named(docs, id_col, text_col).mapInArrow(lambda it: _sign(it, coords, shingle), "doc_id bigint, sig binary"))
    profiles = materialise(signed.groupBy("sig").agg(F.min("doc_id").alias("profile")).select("profile", "sig"))
    posted = profiles.mapInArrow(lambda it: _post(it, coords), "key bigint, profile bigint")
    lists = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    step = F.floor(4 * F.log2("n")).cast("int")
    kept = posted.join(lists, "key").groupBy("profile").agg(F.array_sort(F.collect_set(F.struct(step.alias("step"), "key", "n"))).alias("lists")).where(F.size("lists") >= need)
    shared = kept.join(profiles, "profile").select("profile", "sig", "lists").mapInArrow(lambda it: _emit(it, coords, need), "key bigint, low int, high int, part int, profile bigint, sig binary, steps binary")
    sorted_lists = shared.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "part")
    linked = materialise(sorted_lists.mapInArrow(lambda it: _links(it, coords, need), "a bigint, b bigint, links bigint"))
    copies = signed.join(profiles, "sig").select("doc_id", "profile")
    edges = linked.where("b is not null").select("a", "b").unionAll(copies.where("doc_id <> profile").select(F.col("doc_id").alias("a"), F.col("profile").alias("b")))
    groups = components(edges, "a", "b").where("node <> root").select(F.col("node").alias("doc_id"), F.col("root").alias("kept_id"))
    links = linked.where("b is null").groupBy(F.col("a").alias("profile")).agg(F.sum("links").alias("links"))
    classes = copies.join(links, "profile", "left").groupBy("doc_id").agg(F.min("profile").alias("class_id"), F.max(F.coalesce("links", F.lit(0))).cast("bigint").alias("links"))
    return groups.join(classes, "doc_id").select("doc_id", "kept_id", "class_id", "links")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that repeat another; all columns stay.

    Rows without an id, and documents without words, stay; all rows of an id that repeats
    another one go.
    """
    return without(docs, near_duplicates(docs, id_col=id_col, **options).select("doc_id"), id_col)
