"""Best-fit packing of documents into training sequences of ``capacity`` tokens.

Documents longer than a sequence are cut into pieces; all but the last fill a
sequence each.  Which lengths share a sequence is decided on the histogram of
piece lengths, whose size is bounded by the capacity, by a configuration linear
program: choose how often to use each configuration (a multiset of lengths that
fits) so that every length is covered and the sequences are as few as possible.

* **multiplicative weights**: every length has a weight, which falls exponentially
  with the share of it that has been covered; a piece's price is its length's weight
  over its count, at first the share of a sequence that it takes;
* **pricing**: the configuration of most value at the prices is an unbounded
  knapsack, solved by dynamic programming over the capacity.  Its table also gives the
  best configuration through each length, and a round raises all that are within
  ``slack`` of the best, by no more than covers ``step`` of any length.  The uses of
  the second half of the rounds, over the coverage they reach, are the fractional solution;
* **dual bound**: no packing takes fewer sequences than the worth of all pieces over
  that of the best configuration, whatever the prices.  The largest such bound (of
  the rounds, and of their average prices, also smoothed) is in the plan;
* **rounding**: configurations are used a whole number of times, the best filled
  first, then once more by the parts cut off, as far as pieces are left; what remains goes
  best-fit decreasing.  Best-fit decreasing of all pieces is the plan to beat: it is
  taken if it is no worse, and rounds end once it is within ``tol`` of the bound.

The plan on the driver has a row for each configuration, not for each document.
Pieces are then numbered within their length, in one shuffle of (id, length)
rows, and a piece's number tells its sequence and offset.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.runtime import materialise, named, prepare
from brindle.llm.textkernel import chunks

CAPACITY, ROUNDS, RATE, STEP, SLACK, TOL, PARTS = 2048, 200, 1.0, 0.3, 0.05, 0.001, 256


def knapsack(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The value of the best configuration for every room (0 .. capacity), and the length it takes there (0: room is left)."""
    dense = np.full(capacity, -np.inf)
    dense[lengths - 1] = prices
    value = np.zeros(capacity + 1)  # from the end: value[capacity - room], so that a room's sums are of slices
    pick = np.zeros(capacity + 1, dtype=np.int64)
    gain = np.empty(capacity)
    for room in range(int(lengths[0]), capacity + 1):
        sums = np.add(value[capacity - room + 1 :], dense[:room], out=gain[:room])
        k = int(sums.argmax())
        if sums[k] > value[capacity - room + 1]:
            value[capacity - room], pick[room] = sums[k], k + 1
        else:
            value[capacity - room] = value[capacity - room + 1]
    return value[::-1], pick


def through(first: np.ndarray, pick: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The best configurations that hold each of the lengths ``first`` (numbers in ``lengths``), by the table ``pick``: one row each."""
    where = np.zeros(capacity + 1, dtype=np.int64)
    where[lengths] = np.arange(len(lengths))
    out = np.zeros((len(first), len(lengths)), dtype=np.int16)
    out[np.arange(len(first)), first] = 1
    room, live = capacity - lengths[first], np.arange(len(first))
    while len(live):
        taken = pick[room[live]]
        hit = taken > 0
        out[live[hit], where[taken[hit]]] += 1
        room[live] -= np.where(hit, taken, 1)
        live = live[room[live] > 0]
    return out


Config = tuple[tuple[int, int], ...]  # (number of the length, how many), ascending


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, best: float, rounds: int = ROUNDS, rate: float = RATE, step: float = STEP, slack: float = SLACK, tol: float = TOL) -> tuple[dict[Config, float], float]:
    """Uses of configurations by multiplicative weights, and the dual bound.

    Ends early, without uses, once ``best``, what a packing takes, is within ``tol`` of the bound.
    """
    weight = np.log(counts * lengths / capacity)
    covered, average = np.zeros(len(lengths)), np.zeros(len(lengths))
    uses: dict[Config, float] = {}
    bound = 0.0
    for turn in range(rounds):
        now = np.exp(np.maximum(weight - weight.max(), -300))
        prices = now / counts
        value, pick = knapsack(prices, lengths, capacity)
        bound = max(bound, float(now.sum() / value[capacity]))
        if best <= (1 + tol) * bound + 1:
            return {}, bound
        if turn == rounds // 2:
            covered[:], average[:] = 0, 0
            uses = {}
        average += prices / value[capacity]
        good = np.flatnonzero(prices + value[capacity - lengths] >= (1 - slack) * value[capacity])
        configs = through(good, pick, lengths, capacity)
        amount = counts[good] / configs[np.arange(len(good)), good]
        share = (amount @ configs) / counts
        amount /= np.where(configs > 0, share, 0).max(axis=1)  # crowded lengths are shared
        share = (amount @ configs) / counts
        scale = step / share.max()
        row, length = np.nonzero(configs)
        edge = np.searchsorted(row, np.arange(len(good) + 1))
        many = configs[row, length]
        for i, more in enumerate((scale * amount).tolist()):
            inside = slice(edge[i], edge[i + 1])
            key = tuple(zip(length[inside].tolist(), many[inside].tolist(), strict=True))
            uses[key] = uses.get(key, 0.0) + more
        covered += scale * share
        weight -= rate * scale * share
    for width in (0, 8, 16, 24, 32, 48):  # noise in the prices only lowers the bound: neighbours' means, ascending with the length
        smooth = np.maximum.accumulate(np.convolve(np.pad(average, width, mode="edge"), np.ones(2 * width + 1), "valid"))
        bound = max(bound, float(smooth @ counts / knapsack(smooth, lengths, capacity)[0][capacity]))
    reached = float(np.quantile(covered, 0.1))  # nearly all lengths; the others' pieces are left to the rounding
    return {c: x / max(reached, 1e-9) for c, x in uses.items()}, bound


@dataclass
class Plan:
    """``uses[i]`` sequences are filled as ``configs[i]`` says; ``bound`` is the dual bound on their number."""

    lengths: np.ndarray
    configs: list[Config]
    uses: np.ndarray
    bound: float = 0.0

    @property
    def base(self) -> np.ndarray:
        """Configuration ``i`` fills the sequences ``base[i] .. base[i] + uses[i] - 1``."""
        return np.concatenate([[0], np.cumsum(self.uses)])


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[Config, int]]:
    """Best-fit decreasing over runs of equal pieces: configurations and their uses."""
    rooms: list[int] = []  # rooms of open sequences, ascending
    open_: dict[int, list[tuple[list[int], int]]] = {}  # room -> [(pieces, how many such sequences)]
    for k in np.flatnonzero(counts)[::-1].tolist():
        size, todo = int(lengths[k]), int(counts[k])
        while todo:
            at = bisect.bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                pieces, many = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
                each = 1 if many > 1 or todo < 2 * many else min(room // size, todo // many)
                now = min(many, todo // each)
                if now < many:
                    _keep(rooms, open_, room, pieces, many - now)
            else:
                room, pieces = capacity, []
                each = min(capacity // size, todo)
                now = todo // each
            _keep(rooms, open_, room - each * size, [*pieces, *[k] * each], now)
            todo -= each * now
    return [(tuple(sorted(Counter(pieces).items())), many) for groups in open_.values() for pieces, many in groups]


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> Plan:
    """Whole configurations that hold exactly ``counts`` pieces of ``lengths`` (1 .. capacity, ascending)."""
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    if not len(lengths):
        return Plan(lengths, [], np.zeros(0, dtype=np.int64))
    chosen = best_fit(lengths, counts, capacity)
    uses, bound = fractional(lengths, counts, capacity, sum(n for _, n in chosen), rounds)
    left = counts.tolist()
    rounded: list[tuple[Config, int]] = []

    def use(config: Config, most: int) -> None:
        times = min([most, *(left[k] // n for k, n in config)])
        if times > 0:
            for k, n in config:
                left[k] -= times * n
            rounded.append((config, times))

    size = lengths.tolist()
    for config in sorted(uses, key=lambda c: (-sum(size[k] * n for k, n in c), -uses[c])):
        use(config, int(uses[config]))
    for config in sorted(uses, key=lambda c: int(uses[c]) - uses[c]):
        use(config, 1)
    rounded += best_fit(lengths, np.array(left), capacity)
    if sum(n for _, n in rounded) < sum(n for _, n in chosen):
        chosen = rounded
    merged: dict[Config, int] = {}
    for config, times in chosen:
        merged[config] = merged.get(config, 0) + times
    return Plan(lengths, list(merged), np.array(list(merged.values())), bound)


def _keep(rooms: list[int], open_: dict, room: int, pieces: list[int], many: int) -> None:
    if room not in open_:
        bisect.insort(rooms, room)
        open_[room] = []
    open_[room].append((pieces, many))


class _Places:
    """Where the pieces of one length go, by their number."""

    def __init__(self, made: Plan):
        self.of: dict[int, tuple] = {}
        rows = [(k, i, n) for i, config in enumerate(made.configs) for k, n in config]
        length, config, each = (np.array(x, dtype=np.int64) for x in (zip(*rows, strict=True) if rows else ((), (), ())))
        ahead = np.cumsum(made.lengths[length] * each) - made.lengths[length] * each
        new = np.concatenate([[True], config[1:] != config[:-1]]) if len(config) else np.zeros(0, bool)
        ahead -= np.maximum.accumulate(np.where(new, ahead, 0)) if len(config) else ahead
        order = np.argsort(length, kind="stable")
        edge = np.searchsorted(length[order], np.arange(len(made.lengths) + 1))
        base = made.base
        for k, size in enumerate(made.lengths.tolist()):
            at = order[edge[k] : edge[k + 1]]
            i = config[at]
            self.of[size] = (np.concatenate([[0], np.cumsum(each[at] * made.uses[i])]), each[at], base[i], ahead[at])

    def find(self, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        for s in np.unique(size):
            rows = np.flatnonzero(size == s)
            edge, each, base, ahead = self.of[int(s)]
            i = np.searchsorted(edge, number[rows], side="right") - 1
            nth = number[rows] - edge[i]
            sequence[rows], offset[rows] = base[i] + nth // each[i], ahead[i] + nth % each[i] * s
        return sequence, offset


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, words in chunks(batch, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.counts.astype(np.int64) + 1)], ["doc_id", "tokens"])


def lengths_of(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, tokens)``: words and an end mark, for every row with an id."""
    prepare(docs.sparkSession)
    return named(docs, id_col, text_col).mapInArrow(_count, "doc_id bigint, tokens bigint")


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, rounds: int = ROUNDS, lengths: DataFrame | None = None) -> DataFrame:
    """``(doc_id, piece, start, tokens, sequence, offset)``: every piece and its place.

    ``lengths`` has ``(doc_id, tokens)``, a tokenizer's counts, in place of words and
    an end mark (null ids and counts, and counts below 1, are left out); ``docs`` isn't
    read then.

    A piece is tokens ``start .. start + tokens - 1`` of its document.  A token is
    a word, plus one end mark a document, so a null or empty text is one token.
    Pieces of one sequence don't overlap, and each token of each row is in one
    piece; rows that share an id are packed as rows of their own, and rows without
    an id are left out.
    """
    if lengths is None:
        lengths = lengths_of(docs, id_col=id_col, text_col=text_col)
    else:
        prepare(docs.sparkSession)
        lengths = lengths.selectExpr("cast(doc_id as bigint) as doc_id", "cast(tokens as bigint) as tokens").where("doc_id is not null and tokens > 0")
    lengths = materialise(lengths)
    whole = F.floor(F.col("tokens") / capacity).cast("bigint")
    rest = (F.col("tokens") % capacity).cast("bigint")
    histogram = lengths.select(rest.alias("rest"), whole.alias("whole")).groupBy("rest").agg(F.count("*").alias("n"), F.sum("whole").alias("whole")).collect()  # at most capacity rows
    full = sum(r.whole for r in histogram)
    bars = sorted((r.rest, r.n) for r in histogram if r.rest)
    made = plan(np.array([b for b, _ in bars], dtype=np.int64), np.array([n for _, n in bars], dtype=np.int64), capacity, rounds)
    places = docs.sparkSession.sparkContext.broadcast(_Places(made))
    planned = int(made.uses.sum())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, number = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            sequence, offset = places.value.find(size, number)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "tokens", "sequence", "offset"])

    schema = "doc_id bigint, piece bigint, start bigint, tokens bigint, sequence bigint, offset bigint"
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    ends = lengths.select("doc_id", whole.alias("piece"), (whole * capacity).alias("start"), rest.alias("tokens"), part.alias("part")).where("tokens > 0")
    # pieces are numbered within length and part, so that a frequent length is no single task's
    ahead = F.sum("count").over(Window.partitionBy("tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = ends.groupBy("tokens", "part").count().select("tokens", "part", F.coalesce(ahead, F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("tokens", "part").orderBy("doc_id")).cast("bigint") - 1
    numbered = ends.withColumn("nth", nth).join(firsts, ["tokens", "part"])
    placed = numbered.select("doc_id", "piece", "start", "tokens", (F.col("first") + F.col("nth")).alias("number")).mapInArrow(place, schema)
    if not full:
        return placed
    # full pieces need no plan: every document's get the next sequences, by a running sum over parts
    parts = lengths.where(whole > 0).select("doc_id", whole.alias("whole"))
    sums = {r.part: r.n for r in parts.groupBy(part.alias("part")).agg(F.sum("whole").alias("n")).collect()}  # at most PARTS rows
    starts = dict(zip(sorted(sums), np.cumsum([0, *(sums[k] for k in sorted(sums))])[:-1].tolist(), strict=True))
    first = F.create_map(*[x for k, v in starts.items() for x in (F.lit(int(k)).cast("bigint"), F.lit(int(v) + planned).cast("bigint"))])
    before = F.sum("whole").over(Window.partitionBy("part").orderBy("doc_id", "whole").rowsBetween(Window.unboundedPreceding, -1))
    numbered = parts.withColumn("part", part).select("doc_id", "whole", (F.element_at(first, F.col("part")) + F.coalesce(before, F.lit(0))).alias("from"))
    filled = numbered.select("doc_id", "from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).alias("piece")).select(
        "doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("bigint").alias("tokens"), (F.col("from") + F.col("piece")).alias("sequence"), F.lit(0).cast("bigint").alias("offset")
    )
    return placed.unionAll(filled)
