"""Toxicity: a factorization machine over hashed terms.

A document is the set of its words (runs of letters and digits, case folded), each hashed to one of
``2**hash_bits`` terms.  The model is

    logit = b + sum_i w_i + sum_{i<j} <v_i, v_j>

over the document's terms: ``w`` are additive weights, and the factors ``v``
give every pair of terms (an insult and the mention of a group, say) a weight of
its own.  It is fitted with AdaGrad on labelled documents, at most
``max_train`` of them (the smallest hashes of their ids): the one bound here.
Terms of ``min_df`` documents enter the model if their share of toxic documents in that
sample differs from the base rate by ``min_z`` standard errors, or if their share beside
some other term differs from what the two terms' own shares add up to by more than chance
would give in all pairs.  All pairs are tested, whatever their terms are by themselves.  The
fit makes ``steps`` updates at every size, and the decision threshold is the one of best F1
on a tenth of the sample that takes no part in it.

Scoring reads every document once, whole, in vectorised Arrow batches; the model
is a few thousand rows at any corpus size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.runtime import named, prepare
from brindle.llm.textkernel import chunks, fold

HASH_BITS = 22
#: Pairs that are looked up at a time, and cells of a block of the term-document matrix.
PAIRS, BLOCK = 4_000, 6_000_000


def _terms(words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of each text: (text, term), sorted."""
    hashed = (words.hashes() >> np.uint64(64 - bits)).astype(np.int64)
    key = np.unique((words.doc() << bits) | hashed)
    return key >> bits, key & ((1 << bits) - 1)


@dataclass
class FactorizationMachine:
    """``terms`` (sorted hashed terms) with weights ``w``, factors ``v``; bias and threshold."""

    terms: np.ndarray
    w: np.ndarray
    v: np.ndarray
    bias: float
    cut: float = 0.0
    bits: int = HASH_BITS

    def logits(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Scores of ``n`` texts from their distinct terms, sorted by text."""
        if not len(self.terms):
            return np.full(n, self.bias)
        at = np.searchsorted(self.terms, term)
        at[at == len(self.terms)] = 0
        known = self.terms[at] == term
        at, doc = at[known], doc[known]
        v = self.v[at].astype(np.float64)
        out = self.bias + np.bincount(doc, self.w[at], n)
        for j in range(v.shape[1]):
            out += 0.5 * (np.bincount(doc, v[:, j], n) ** 2 - np.bincount(doc, v[:, j] ** 2, n))
        return out


def _bits(doc: np.ndarray, at: np.ndarray, terms: np.ndarray, n: int, inside: np.ndarray) -> np.ndarray:
    """Which of the documents ``inside`` each of ``terms`` (of ``n``) is in, a bit a document."""
    row = np.full(n, -1, dtype=np.int32)
    row[terms] = np.arange(len(terms))
    place = np.where(inside, np.cumsum(inside) - 1, -1).astype(np.int32)
    out = np.zeros((len(terms), -(-int(inside.sum()) // 64) * 8), dtype=np.uint8)
    for s in range(0, len(at), 500_000):
        r, d = row[at[s : s + 500_000]], place[doc[s : s + 500_000]]
        known = (r >= 0) & (d >= 0)
        r, d = r[known], d[known]
        np.bitwise_or.at(out, (r, d >> 3), (1 << (d & 7)).astype(np.uint8))
    return out.view(np.uint64)


def _in_pairs(doc: np.ndarray, at: np.ndarray, y: np.ndarray, df: np.ndarray, pos: np.ndarray, base: float) -> np.ndarray:
    """Whether each term is in a pair with an interaction; ``at`` are the terms of the documents ``doc``.

    With n documents of both terms, a toxic share of p and one of e to be expected,
    chance gives such a share with a probability of exp(-n KL(p, e)) at most (Chernoff).
    All pairs are tested.  Of those with more toxic documents than expected, k, n KL(p, e) is
    k log(1 / e) at most, so pairs are first counted over toxic documents alone (a product of
    blocks of the term-document matrix), and n is looked up for what passes; those with
    fewer toxic documents likewise from the clean ones.
    """
    n, docs = len(df), len(y)
    inside = np.zeros(n, dtype=bool)
    limit = np.log(max(2.0, n * (n - 1) / 2))
    odds = np.log((pos + base) / (df - pos + 1 - base))  # one text at the base rate is added
    shift = odds - np.log(base / (1 - base))

    def expected(a: np.ndarray, b: np.ndarray, side: int) -> np.ndarray:
        e = np.clip(1 / (1 + np.exp(-(odds[a] + shift[b]))), 1e-4, 1 - 1e-4)
        return e if side else 1 - e

    for side in (1, 0):
        count = pos if side else df - pos
        can = np.flatnonzero(count >= 1)
        for _ in range(3):  # terms with a partner that leaves room for the limit, among those of which that is true
            room = np.zeros(len(can))
            steps = np.unique(np.geomspace(1, max(1.0, float(count[can].max(initial=1))), 48))
            for low, high in zip(steps, [*steps[1:], np.inf], strict=True):
                partners = can[count[can] >= low]
                if len(partners):
                    extreme = partners[[int(np.argmin(shift[partners]) if side else np.argmax(shift[partners]))]]
                    room = np.maximum(room, np.minimum(count[can], high) * -np.log(expected(can, extreme, side)))
            can = can[room >= limit]
        if len(can) < 2:
            continue
        can = can[np.argsort(shift[can] if side else -shift[can], kind="stable")]
        row = np.full(n, -1, dtype=np.int32)
        row[can] = np.arange(len(can))
        there = (y > 0) == bool(side)
        place = np.where(there, np.cumsum(there, dtype=np.int32) - 1, -1).astype(np.int32)
        use = there[doc] & (row[at] >= 0)
        width = int(place.max()) + 1
        low = max(1, width - 1).bit_length()
        key = row[at[use]].astype(np.uint32 if len(can).bit_length() + low <= 32 else np.uint64)  # term and document in one number, sorted in place
        key <<= low
        key |= place[doc[use]].astype(key.dtype)
        del use
        key.sort()
        edge = np.searchsorted(key, np.arange(len(can) + 1).astype(key.dtype) << low)
        key &= (1 << low) - 1
        d = key.view(np.int32) if key.dtype == np.uint32 else key.astype(np.int32)
        step = max(1, min(1024, BLOCK // max(1, width)))
        bits = _bits(doc, at, can, n, ~there)  # of the other side

        def block(rows: np.ndarray) -> np.ndarray:
            out = np.zeros((len(rows), width), dtype=np.float32)  # noqa: B023
            size = edge[rows + 1] - edge[rows]  # noqa: B023
            out[np.repeat(np.arange(len(rows)), size), d[np.repeat(edge[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]] = 1  # noqa: B023
            return out

        rest = np.arange(len(can))
        while len(rest) > 1:
            # partners come later, so the first of the rest is the most extreme one for all
            rest = rest[count[can[rest]] * -np.log(expected(can[rest], can[rest[:1]], side)) >= limit]
            mine = rest[:step]
            if not len(mine):
                break
            left = block(mine)
            log_q = -np.log(expected(can[rest], can[rest[:1]], side))
            others = rest[np.minimum(count[can[rest]], float(count[can[mine]].max())) * log_q >= limit]
            rest = rest[step:]
            for o in range(0, len(others), step):
                theirs = others[o : o + step]
                k = left @ block(theirs).T
                i, j = np.nonzero((k >= 2) & (k * -np.log(expected(can[mine][:, None], can[theirs][None, :], side)) >= limit))
                k, i, j = k[i, j], mine[i], theirs[j]
                fresh = (i < j) & ~(inside[can[i]] & inside[can[j]])
                i, j, k = i[fresh], j[fresh], k[fresh]
                for c in range(0, len(i), PAIRS):
                    ii, jj = i[c : c + PAIRS], j[c : c + PAIRS]
                    total = k[c : c + PAIRS] + np.bitwise_count(bits[ii] & bits[jj]).sum(axis=1)
                    e, p = expected(can[ii], can[jj], side), k[c : c + PAIRS] / total
                    kl = p * np.log(np.maximum(p, 1e-9) / e) + (1 - p) * np.log(np.maximum(1 - p, 1e-9) / (1 - e))
                    found = (p > e) & (total * kl >= limit)
                    inside[can[ii[found]]] = inside[can[jj[found]]] = True
    return inside


def fit(ptr: np.ndarray, term: np.ndarray, y: np.ndarray, *, factors: int = 8, steps: int = 900, rate: float = 0.3, l2: float = 1e-5, min_df: int = 5, min_z: float = 3.3, batch: int = 256, seed: int = 7, bits: int = HASH_BITS) -> FactorizationMachine:
    """Fit on texts whose distinct terms are ``term[ptr[d]:ptr[d + 1]]`` with labels ``y``, by ``steps`` updates."""
    n = len(y)
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(ptr))
    held = np.zeros(n, dtype=bool)
    held[9::10] = True
    use = ~held
    base = float(np.clip(y[use].mean(), 1e-4, 1 - 1e-4)) if use.any() else 0.5
    bias = np.log(base / (1 - base))
    df, pos = np.zeros(1 << bits, dtype=np.int32), np.zeros(1 << bits, dtype=np.float32)
    for s in range(0, n, 1000):  # in parts: the sample's terms are the driver's largest array
        part = slice(ptr[s], ptr[min(n, s + 1000)])
        inside = use[doc[part]]
        np.add.at(df, term[part][inside], 1)
        np.add.at(pos, term[part][inside], y[doc[part][inside]])
    listed = np.flatnonzero(df >= min_df)
    df, pos = df[listed], pos[listed]
    enters = np.abs(pos - df * base) / np.sqrt(df * base * (1 - base) + 1e-9) >= min_z
    if not enters.all() and 1e-4 < base < 1 - 1e-4:
        rank = np.full(1 << bits, -1, dtype=np.int32)
        rank[listed] = np.arange(len(listed))
        known = (rank[term] >= 0) & use[doc]
        enters |= _in_pairs(doc[known], rank[term[known]], np.where(use, y, 0), df, pos, base)
        del rank, known
    terms = np.sort(listed[enters])
    del df, pos
    rng = np.random.default_rng(seed)
    w = np.zeros(len(terms), dtype=np.float32)
    v = rng.normal(0, 0.01, (len(terms), factors)).astype(np.float32)
    model = FactorizationMachine(terms, w, v, bias, bits=bits)
    if not len(terms) or base in (1e-4, 1 - 1e-4):
        model.w[:] = 0
        model.v[:] = 0
        return model
    at = np.searchsorted(terms, term)
    at[at == len(terms)] = 0
    known = terms[at] == term
    at, doc = at[known], doc[known]
    edge = np.searchsorted(doc, np.arange(n + 1))
    gw, gv, gb = np.full(w.shape, 1e-6, np.float32), np.full(v.shape, 1e-6, np.float32), 1e-6
    train = np.flatnonzero(use)
    order, made = train[:0], 0
    while made < steps:
        if not len(order):
            order = rng.permutation(train)
        rows, order, made = order[:batch], order[batch:], made + 1
        size = edge[rows + 1] - edge[rows]
        owner = np.repeat(np.arange(len(rows)), size)
        ix = at[np.repeat(edge[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        vi = v[ix]
        sums = np.stack([np.bincount(owner, vi[:, j], len(rows)) for j in range(factors)], axis=1)
        squares = np.bincount(owner, (vi * vi).sum(axis=1), len(rows))
        f = bias + np.bincount(owner, w[ix], len(rows)) + 0.5 * ((sums**2).sum(axis=1) - squares)
        g = (1 / (1 + np.exp(-np.clip(f, -30, 30))) - y[rows]) / len(rows)
        u, inv = np.unique(ix, return_inverse=True)
        gi = g[owner]
        grad = np.bincount(inv, gi, len(u)) + l2 * w[u]
        gw[u] += grad * grad
        w[u] -= rate * grad / np.sqrt(gw[u])
        pair = gi[:, None] * (sums[owner] - vi)
        for j in range(factors):
            grad = np.bincount(inv, pair[:, j], len(u)) + l2 * v[u, j]
            gv[u, j] += grad * grad
            v[u, j] -= 0.3 * rate * grad / np.sqrt(gv[u, j])
        gb += float(g.sum()) ** 2
        bias -= rate * float(g.sum()) / np.sqrt(gb)
    model.bias = float(bias)
    if held.any() and y[held].any():
        row = np.cumsum(held) - 1
        inside = held[doc]
        scores = model.logits(row[doc[inside]], terms[at[inside]], int(held.sum()))
        model.cut = _best_cut(scores, y[held])
    return model


def _best_cut(scores: np.ndarray, y: np.ndarray) -> float:
    """The middle of the score interval with the best F1, kept within +-2 of even odds."""
    order = np.argsort(-scores, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    best = int(np.argmax(f1))
    below = scores[order[best + 1]] if best + 1 < len(y) else scores[order[best]] - 1
    return float(np.clip((scores[order[best]] + below) / 2, -2, 2))


def _hash_batches(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, words in chunks(batch, "text", change=fold):
            doc, term = _terms(words, bits)
            edge = np.searchsorted(doc, np.arange(part.num_rows + 1))
            term = term.astype(np.int32)
            terms = [term[edge[i] : edge[i + 1]].tobytes() for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(terms, pa.binary())], ["doc_id", "toxic", "terms"])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = 20_000, **options) -> FactorizationMachine:
    """Fit on labelled documents; with no usable label the model rejects nothing.

    Null and empty texts are documents without terms; documents without an id, and
    labels without a document, are left out; a repeated row counts as often as it is
    there.  Further columns of either table are not read.

    Labels other than 0 and 1, and null ones, are left out; of several labels of
    one document the largest counts.
    """
    prepare(docs.sparkSession)
    marks = labels.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # the sample is bounded by max_train, so it can be broadcast and no text is shuffled
    rows = named(docs, id_col, text_col).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic")
    found = rows.mapInArrow(lambda it: _hash_batches(it, HASH_BITS), "doc_id bigint, toxic int, terms binary").toArrow().sort_by("doc_id")
    y = found.column("toxic").to_numpy().astype(np.float32)
    if not len(y):
        none = np.zeros(0)
        return FactorizationMachine(none.astype(np.int64), none, none.reshape(0, 1), -30.0)
    size = pc.binary_length(found.column("terms")).to_numpy() // 4
    term = np.frombuffer(b"".join(x.as_py() for x in found.column("terms")), dtype=np.int32)
    del found
    return fit(np.concatenate([[0], np.cumsum(size)]), term, y, **options)


def _score_batches(batches: Iterator[pa.RecordBatch], model: FactorizationMachine) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, words in chunks(batch, "text", change=fold):
            scores = model.logits(*_terms(words, model.bits), part.num_rows)
            p = 1 / (1 + np.exp(-np.clip(scores, -50, 50)))
            arrays = [*part.columns[:-1], pa.array(np.round(p, 6)), pa.array(scores > model.cut)]
            yield pa.RecordBatch.from_arrays(arrays, [*part.schema.names[:-1], "toxicity", "is_toxic"])


def score(docs: DataFrame, model: FactorizationMachine, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, toxicity, is_toxic)`` for every row of ``docs``.

    Repeated rows and rows without an id are scored like any other; an empty or
    null text has the model's bias alone.
    """
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _score_batches(it, sent.value), "doc_id bigint, toxicity double, is_toxic boolean")


def reject(docs: DataFrame, model: FactorizationMachine, *, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the model calls toxic; all columns stay.

    Every row is judged by its text alone, so rows without an id and repeated rows are
    treated like any other; null and empty texts have the model's bias, which is toxic
    only if most of the labelled documents are.
    """
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in chunks(batch, text_col, change=fold):
                scores = sent.value.logits(*_terms(words, sent.value.bits), part.num_rows)
                yield part.filter(pa.array(scores <= sent.value.cut))

    return docs.mapInArrow(run, docs.schema)
