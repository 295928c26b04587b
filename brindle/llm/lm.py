"""Language-model scoring by deleted interpolation of word trigrams.

A token's probability given the two before it mixes maximum-likelihood estimates,

    p = w3 * c(abc)/c(ab) + w2 * c(bc)/c(b) + w1 * c(c)/N + w0 / V,

with weights ``w`` for each bucket of context frequency: the power of two of
``c(ab)``, or of ``c(b)`` where ``ab`` is unseen.  Counts are *deleted*: documents
fall into ``folds`` by a hash of their ids, and a document is scored with the
counts of all documents outside its fold.  So every token is held-out data, and
expectation-maximisation on all of them learns the weights.

How the counts meet the texts:

1. documents are encoded to batches of one fold (distinct words and word numbers)
   in the shared folder;
2. each batch asks for the counts of its distinct n-grams.  The questions, sorted
   hashes as differences, go to buckets of the hash range, where all batches'
   counts are added up, and the sum less the asking fold's goes back.  A frequent
   n-gram is one entry a batch, so it makes no bucket heavy;
3. batches and answers meet, and every document gets the counts of its tokens' n-grams.
   A token falls into a *cell*: its bucket and the whole powers of two of its three estimates.
   A histogram of the cells (at most 32 * 32**3 of them), with the means of the estimates in each, is
   all that the driver sees, for the EM;
4. documents are scored from their counts, without rounding.

Hashes have 18 bits more than it takes to number the n-grams (at most 62 bits),
so about one in 260,000 n-grams shares its count with another.

Each batch sends a row to each bucket of n-grams that it has, as in any shuffle: with b batches and r
buckets that is b * r rows of a few thousand n-grams each, at most as many as there are n-grams.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.runtime import discard, materialise, named, prepare, release
from brindle.llm.textkernel import RADIX, U64, chunks, mix

FOLDS, ROUNDS = 4, 60
BATCH_WORDS, BUCKET_ENTRIES, SPARE_BITS = 800_000, 1_500_000, 18
BEGIN, BEGUN, END = U64(0x1B873593CC9E2D51), U64(0x2545F4914F6CDD1D), U64(0x27D4EB2F165667C5)
NONE = 31  # the power that stands for probability 0
BODY = "batch bigint, fold int, tokens bigint, docs binary, counts binary, vocab binary, ids binary"


def fold_of(ids: np.ndarray, folds: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U64)) % U64(folds)).astype(np.int64)


def _pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of integers, byte by byte so that high ones compress, behind their number."""
    planes = np.ascontiguousarray(values.astype(U64).view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(values).to_bytes(4, "little") + pa.compress(pa.py_buffer(planes), codec="zstd", asbytes=True)


def _unpack(data: bytes, width: int) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(pa.decompress(memoryview(data)[4:], decompressed_size=n * width, codec="zstd"), dtype=np.uint8).reshape(width, n)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view(U64).ravel()


def _encode(batches: Iterator[pa.RecordBatch], folds: int) -> Iterator[pa.RecordBatch]:
    """Batches of documents of one fold, as ``BODY`` rows; a text is BEGIN BEGUN words END."""
    held: list[list[tuple]] = [[] for _ in range(folds)]
    sizes = [0] * folds

    def out(fold: int) -> pa.RecordBatch:
        docs, counts, hashed = (np.concatenate(x) for x in zip(*held[fold], strict=True))
        held[fold], sizes[fold] = [], 0
        vocab, ids = np.unique(hashed, return_inverse=True)
        row = [[uuid.uuid4().int >> 65], [fold], [len(hashed) - 2 * len(docs)], [docs.tobytes()], [counts.astype(np.int32).tobytes()], [_pack(np.diff(vocab, prepend=U64(0)), 8)], [_pack(ids, 4)]]
        kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], [x.split()[0] for x in BODY.split(", ")])

    for batch in batches:
        for part, words in chunks(batch, "text"):
            ids, counts = part.column(0).to_numpy(), words.counts
            edge = np.concatenate([[0], np.cumsum(counts + 3)])
            hashed = np.empty(edge[-1], dtype=U64)
            hashed[edge[:-1]], hashed[edge[:-1] + 1], hashed[edge[1:] - 1] = BEGIN, BEGUN, END
            inside = np.ones(len(hashed), dtype=bool)
            inside[edge[:-1]] = inside[edge[:-1] + 1] = inside[edge[1:] - 1] = False
            hashed[inside] = words.hashes()
            folds_of = fold_of(ids, folds)
            for fold in np.unique(folds_of):
                rows = np.flatnonzero(folds_of == fold)
                take = np.repeat(folds_of == fold, counts + 3)
                held[fold].append((ids[rows], counts[rows] + 3, hashed[take]))
                sizes[fold] += int(take.sum())
                if sizes[fold] >= BATCH_WORDS:
                    yield out(fold)
    for fold in range(folds):
        if held[fold]:
            yield out(fold)


class _Batch:
    """A body row: its tokens, and the n-grams that end at each of them."""

    def __init__(self, counts: bytes, vocab: bytes, ids: bytes, bits: int):
        self.counts = np.frombuffer(counts, dtype=np.int32).astype(np.int64)
        h = np.cumsum(_unpack(vocab, 8), dtype=U64)[_unpack(ids, 4).astype(np.int64)]
        edge = np.cumsum(self.counts)
        first = edge - self.counts
        self.place = np.arange(len(h)) - np.repeat(first, self.counts)
        two = mix(h[:-1] * RADIX + h[1:])
        three = mix(two[:-1] * RADIX + h[2:])
        shift, last = U64(64 - bits), U64(1)
        # the last bit tells single words apart
        self.word = (mix(h) >> shift) | last
        self.pair = np.zeros(len(h), dtype=U64)
        self.pair[1:] = (two >> shift) & ~last
        self.triple = np.zeros(len(h), dtype=U64)
        self.triple[2:] = (three >> shift) & ~last

    def grams(self) -> np.ndarray:
        return np.concatenate([self.word, self.pair[self.place >= 1], self.triple[self.place >= 2]])


def _ask(batches: Iterator[pa.RecordBatch], bits: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """A batch's distinct n-grams and how often it has each, by bucket."""
    edges = (np.arange(1, buckets) * (2**bits / buckets)).astype(U64)
    for batch in batches:
        for key, fold, _, _, counts, vocab, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            grams, n = np.unique(_Batch(counts, vocab, ids, bits).grams(), return_counts=True)
            cut = [0, *np.searchsorted(grams, edges).tolist(), len(grams)]
            rows = []
            for b, (s, e) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if e > s:
                    steps = np.diff(grams[s:e], prepend=U64(0))
                    start, steps[0] = int(steps[0]), 0
                    width = 4 if int(steps.max()) < 2**32 else 8
                    rows.append((b, key, fold, start, width, _pack(steps, width), _pack(n[s:e], 4), e - s))
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "batch", "fold", "start", "width", "steps", "counts", "n"])


def _answer(batches: Iterator[pa.RecordBatch], folds: int) -> Iterator[pa.RecordBatch]:
    """Counts outside the asking fold; rows come sorted by bucket."""
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        size = [r[7] for r in rows]
        grams = np.concatenate([U64(r[3]) + np.cumsum(_unpack(r[5], r[4]), dtype=U64) for r in rows])
        counts = np.concatenate([_unpack(r[6], 4).astype(np.int64) for r in rows])
        fold = np.repeat([r[2] for r in rows], size)
        order = np.argsort(grams, kind="stable")  # merges the sorted runs
        sorted_grams = grams[order]
        head = np.flatnonzero(np.concatenate([[True], sorted_grams[1:] != sorted_grams[:-1]]))
        which = np.empty(len(grams), dtype=np.int64)
        which[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(grams))))
        words = int((sorted_grams[head] & U64(1)).sum())
        by_fold = np.bincount(which * folds + fold, counts, len(head) * folds).astype(np.int64).reshape(-1, folds)
        reply = np.minimum(by_fold.sum(axis=1)[which] - by_fold[which, fold], 2**32 - 1)
        edge = np.concatenate([[0], np.cumsum(size)])
        made = [(r[1], r[0], _pack(reply[s:e], 4), 0 if i else words) for i, (r, s, e) in enumerate(zip(rows, edge[:-1], edge[1:], strict=True))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], ["batch", "bucket", "reply", "words"])

    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and rows[0][0] != row[0]:
                yield out(rows)
                rows = []
            rows.append(row)
    if rows:
        yield out(rows)


def context_bucket(pair: np.ndarray, word: np.ndarray) -> np.ndarray:
    """1-14 by ``c(ab)``; 16-31 by ``c(b)`` where that is 0; 15 where both are."""
    log = lambda c: np.floor(np.log2(np.maximum(c, 1))).astype(np.int64)
    return np.where(pair > 0, 1 + np.minimum(log(pair), 13), np.where(word > 0, 16 + np.minimum(log(word), 15), 15))


def estimates(counts: np.ndarray, edge: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context buckets of the tokens, and their maximum-likelihood estimates of order 3, 2 and 1 (one row each).

    ``counts`` holds, for each document of n tokens (``edge``: where they begin), the counts of its n
    trigrams, of n + 1 pairs and of n + 1 words, the first ones those before its first token;
    ``total`` is the number of tokens outside its fold.
    """
    n = np.diff(edge)
    first = np.cumsum(3 * n + 2) - (3 * n + 2)
    place = np.arange(int(edge[-1])) - np.repeat(edge[:-1], n)
    three = np.repeat(first, n) + place
    pair, word = three + np.repeat(n, n), three + np.repeat(2 * n + 1, n)
    abc, ab, bc, b, c = (counts[at].astype(np.float64) for at in (three, pair, pair + 1, word, word + 1))
    found = np.stack([abc / np.maximum(np.maximum(ab, abc), 1), bc / np.maximum(np.maximum(b, bc), 1), c / np.maximum(np.repeat(total, n), 1)])
    return context_bucket(ab, b), found


def _counted(batches: Iterator[pa.RecordBatch], bits: int, totals: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Counts of every document; a batch's body comes first, then its answers by bucket."""

    def out(body: tuple, replies: list[bytes]) -> pa.RecordBatch:
        _, fold, docs, counts, vocab, ids = body
        made = _Batch(counts, vocab, ids, bits)
        place = made.place
        _, which = np.unique(made.grams(), return_inverse=True)
        count = np.concatenate([_unpack(r, 4) for r in replies]).astype(np.int64)[which]
        word = count[: len(place)]
        two = len(place) + int((place >= 1).sum())
        pair, triple = count[len(place) : two], count[two:]
        n = made.counts - 2
        rows = []
        at_word, at_pair, at_triple = (np.cumsum(made.counts - x) - (made.counts - x) for x in (0, 1, 2))
        for i, k in enumerate(n.tolist()):  # the word that begins a text is no context
            rows.append(_pack(np.concatenate([triple[at_triple[i] : at_triple[i] + k], pair[at_pair[i] : at_pair[i] + k + 1], word[at_word[i] + 1 : at_word[i] + k + 2]]), 4))
        return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(docs, np.int64)), pa.array(np.full(len(rows), totals.get(fold, 0), np.int64)), pa.array(rows, pa.binary())], ["doc_id", "total", "counts"])

    body, replies = None, []
    for batch in batches:
        for key, fold, _, docs, counts, vocab, ids, bucket, reply in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket < 0:
                if body is not None:
                    yield out(body, replies)
                body, replies = (key, fold, docs, counts, vocab, ids), []
            else:
                replies.append(reply)
    if body is not None:
        yield out(body, replies)


def _of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the documents' tokens begin, their buckets and estimates."""
    counts = [_unpack(x, 4) for x in batch.column(2).to_pylist()]
    edge = np.concatenate([[0], np.cumsum([(len(x) - 2) // 3 for x in counts])])
    return edge, *estimates(np.concatenate(counts), edge, batch.column(1).to_numpy())


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of some documents each, as counts unpack to much more than they take."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            yield batch.slice(at, 200)


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells, how many tokens they have, and the sums of their estimates."""
    for batch in _parts(batches):
        _, bucket, p = _of(batch)
        cell = bucket
        for x in p:
            with np.errstate(divide="ignore"):
                cell = (cell << 5) | np.where(x > 0, np.clip(np.floor(-np.log2(x)), 0, NONE - 1), NONE).astype(np.int64)
        cell, which, n = np.unique(cell, return_inverse=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n), *[pa.array(np.bincount(which, x, len(cell))) for x in p]], ["cell", "n", "p3", "p2", "p1"])


def learn(bucket: np.ndarray, n: np.ndarray, p: np.ndarray, words: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (bucket, order 3 to 0) by expectation-maximisation: ``n`` tokens each have the estimates ``p`` (one row an order)."""
    p = np.column_stack([*p, np.full(len(n), 1 / max(words, 1))])
    weights = np.full((32, 4), 0.25)
    for _ in range(rounds):
        part = weights[bucket] * p
        part *= (n / part.sum(axis=1))[:, None]
        new = np.stack([np.bincount(bucket, part[:, j], 32) for j in range(4)], axis=1)
        total = new.sum(axis=1, keepdims=True)
        weights = np.where(total > 0, new / np.maximum(total, 1e-300), weights)
    return weights


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, weights: np.ndarray | None = None) -> DataFrame:
    """``(doc_id, tokens, log2_prob, perplexity)`` of every row with an id.

    Words are runs of characters other than ASCII white space; a text ends with
    one more token, so null and empty texts have one.  Rows that share an id are
    scored one by one, in one fold, so copies with one id don't predict each
    other.  Rows without an id are left out and not counted.  ``weights`` (32 buckets, orders 3 to 0)
    are learned if they aren't given.
    """
    spark = docs.sparkSession
    prepare(spark)
    body = materialise(named(docs, id_col, text_col).mapInArrow(lambda it: _encode(it, folds), BODY))
    sizes = body.select("fold", "tokens").withColumnRenamed("tokens", "n").groupBy("fold").agg(F.sum("n").alias("n")).collect()
    total = sum(r.n for r in sizes)
    others = {r.fold: total - r.n for r in sizes}  # tokens to predict outside the fold
    bits = min(62, math.ceil(math.log2(3 * max(total, 1) + 2)) + SPARE_BITS)
    buckets = max(1, math.ceil(1.6 * total / BUCKET_ENTRIES))
    asked = body.mapInArrow(lambda it: _ask(it, bits, buckets), "bucket int, batch bigint, fold int, start bigint, width int, steps binary, counts binary, n int")
    answers = materialise(asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _answer(it, folds), "batch bigint, bucket int, reply binary, words bigint"))
    words = (answers.agg(F.sum("words")).first()[0] or 0) + 1
    none = F.lit(None)
    left = body.select("*", F.lit(-1).alias("bucket"), none.cast("binary").alias("reply"))
    right = answers.select("batch", none.cast("int").alias("fold"), none.cast("bigint").alias("tokens"), *[none.cast("binary").alias(c) for c in ("docs", "counts", "vocab", "ids")], "bucket", "reply")
    met = left.unionAll(right).repartition("batch").sortWithinPartitions("batch", "bucket")
    release(spark)
    coded = materialise(met.mapInArrow(lambda it: _counted(it, bits, others), "doc_id bigint, total bigint, counts binary"))
    discard(body, answers)
    if weights is None:
        sums = [F.sum(c).alias(c) for c in ("n", "p3", "p2", "p1")]
        cells = coded.mapInArrow(_histogram, "cell bigint, n bigint, p3 double, p2 double, p1 double").groupBy("cell").agg(*sums).toArrow()
        cell, n, *p = (cells.column(c).to_numpy() for c in ("cell", "n", "p3", "p2", "p1"))
        weights = learn(cell >> 15, n, np.stack(p) / np.maximum(n, 1), words)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            edge, bucket, p = _of(batch)
            mixed = weights[bucket, 3] / max(words, 1)
            for j in range(3):
                mixed += weights[bucket, j] * p[j]
            size, logs = np.diff(edge), np.add.reduceat(np.log2(mixed), edge[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(logs), pa.array(2.0 ** np.minimum(-logs / size, 1000))], ["doc_id", "tokens", "log2_prob", "perplexity"])

    return coded.mapInArrow(final, "doc_id bigint, tokens bigint, log2_prob double, perplexity double")
