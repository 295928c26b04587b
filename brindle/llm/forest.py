"""Approximate nearest neighbours (cosine) with a hash-prefix forest.

Each of ``trees`` trees gives a vector a string of 64 bits, the signs of random
projections, and keeps its vectors as an array sorted by that string.  Vectors
with a long common prefix lie next to each other, and those that share ``d`` bits
with a query are one range of the array.

0. equal vectors are one class: its least id stands for it, so a heap of copies is one
   entry; the ids of a class take their places in the result at the end;
1. **descend**: in every tree a query goes down to its longest-prefix matches,
   whatever their length, and learns how many vectors share each of its prefixes;
2. **ascend**, in all trees at once, one bit at a time: the query goes up until the vectors that
   share its prefix in some tree (counted once for each tree) are ``target`` at least.  As the
   counts of all levels are known from the descent, the level where that ends is
   reached at once.  These candidates are compared with the query and give its
   ``k``-th similarity ``s``;
3. two vectors of similarity ``s`` share a bit with probability ``p = 1 - acos(s)/pi``, so at
   level ``d`` a neighbour that is at least as close as the ``k``-th so far is in
   none of the ranges with probability ``(1 - p**d)**trees``.  Where that is more than
   ``miss``, the query goes on up to the deepest level where it isn't.

So vectors with close neighbours stop deep in the trees, vectors without go up as
far as they must, and no bound is set on the candidates.  The sorted arrays are
cut into pages of about ``PAGE`` vectors by their leading bits (and those by id if
they are too full); a range longer than a page is searched page by page, and a page
passes on no more than the ``k`` best of a query.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.anchors import binary
from brindle.llm.runtime import materialise, prepare

TREES, K, MISS, SEED, PAGE, TARGET = 12, 10, 0.04, 5, 4096, 1024
U64 = np.uint64


def planes(dim: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim, trees * 64)).astype(np.float32)


def hash_strings(vectors: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """Strings of 64 bits, the first bit highest: one row a vector, one column a tree."""
    bits = np.packbits(vectors @ normals > 0, axis=1)
    return np.ascontiguousarray(bits).view(">u8").astype(U64)


def _base(batches: Iterator[pa.RecordBatch], dim: int, trees: int, seed: int) -> Iterator[pa.RecordBatch]:
    normals = planes(dim, trees, seed)
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
        norm = np.linalg.norm(x, axis=1)
        fine = np.isfinite(norm) & (norm > 0)
        x = x[fine] / norm[fine, None]
        sizes = np.full(len(x), 1)
        strings = hash_strings(x, normals)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fine)), binary(x.view(np.uint8).ravel(), sizes * dim * 4), binary(strings.view(np.uint8).ravel(), sizes * trees * 8)], ["vec_id", "vec", "strings"])


def _strings(column: pa.Array, trees: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=U64).reshape(-1, trees)


def _pages(strings: np.ndarray, bits: int) -> np.ndarray:
    return (strings >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(strings), dtype=np.int64)


def _entries(batches: Iterator[pa.RecordBatch], trees: int, bits: int) -> Iterator[pa.RecordBatch]:
    """A vector's entry in every tree."""
    for batch in batches:
        strings = _strings(batch.column(2), trees)
        for t in range(trees):
            cell = (t << 48) + _pages(strings[:, t], bits)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0), batch.column(1), pa.array(strings[:, t].view(np.int64))], ["cell", "vec_id", "vec", "string"])


def _asks(batches: Iterator[pa.RecordBatch], trees: int, bits: int) -> Iterator[pa.RecordBatch]:
    """A query's visits to the pages of its range, in every tree."""
    for batch in batches:
        strings, depth = _strings(batch.column(2), trees), batch.column(3).to_numpy()
        for d in np.unique(depth):
            rows = np.flatnonzero(depth == d)
            part = batch.take(pa.array(rows))
            up = max(0, bits - int(d))
            for t in range(trees):
                first = _pages(strings[rows, t], bits) >> up << up
                for more in range(1 << up):
                    yield pa.RecordBatch.from_arrays([pa.array((t << 48) + first + more), part.column(0), part.column(1), pa.array(strings[rows, t].view(np.int64)), part.column(3), part.column(4)], ["cell", "vec_id", "vec", "string", "depth", "kth"])


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype=np.float32).reshape(len(column), -1)


FOUND = ["vec_id", "neighbour", "similarity"]
ASKS = "cell bigint, vec_id bigint, vec binary, string bigint, depth bigint, kth float"


def _visit(batches: Iterator[pa.RecordBatch], work: Callable) -> Iterator[pa.RecordBatch]:
    """``work`` on batches of queries and the sorted page that they visit: (queries, strings, ids, vectors).

    A page's entries come before its queries, which pass by in batches.
    """
    cell, entries = None, []
    page: tuple | None = None
    for batch in batches:
        key, depth = batch.column(0).to_numpy(), batch.column(4).to_numpy()
        if not len(key):
            continue
        kind = depth >= 0
        edge = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (kind[1:] != kind[:-1])) + 1), len(key)]
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            if key[s] != cell:
                cell, entries, page = key[s], [], None
            part = batch.slice(s, e - s)
            if not kind[s]:
                entries.append(part)
                continue
            if page is None:
                if not entries:
                    continue
                table = pa.Table.from_batches(entries)
                string = table.column(3).to_numpy().view(U64)
                order = np.argsort(string, kind="stable")
                vectors = None if table.column(2).null_count else _vectors(table.column(2))[order]
                page, entries = (string[order], table.column(1).to_numpy()[order], vectors), []
            yield from work(part, *page)


def _range(array: np.ndarray, string: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings that share ``depth`` bits with each of ``string`` begin and end."""
    d = depth.astype(U64)
    mask = np.where(d > 0, ~U64(0) << (U64(64) - np.maximum(d, U64(1))), U64(0))
    return np.searchsorted(array, string & mask, side="left"), np.searchsorted(array, string | ~mask, side="right")


def _count(asks: pa.RecordBatch, array: np.ndarray, ids: np.ndarray, target: None, bits: int) -> Iterator[pa.RecordBatch]:
    """How many entries of the page share each prefix of ``bits`` bits and more with a query."""
    string = asks.column(3).to_numpy().view(U64)
    counts = np.empty((len(string), 65 - bits), dtype=np.int64)
    for d in range(bits, 65):
        lo, hi = _range(array, string, np.full(len(string), d))
        counts[:, d - bits] = hi - lo
    yield pa.RecordBatch.from_arrays([asks.column(1), binary(counts.view(np.uint8).ravel(), np.full(len(string), counts.shape[1] * 8))], ["vec_id", "counts"])


def _stop(batches: Iterator[pa.RecordBatch], bits: int, target: int) -> Iterator[pa.RecordBatch]:
    """The level at which a query's synchronous ascent meets ``target``; rows come sorted by query."""
    held, total = None, np.zeros(65 - bits, dtype=np.int64)

    def level() -> int:
        return bits + int(np.flatnonzero(total >= target).max(initial=0))  # counts fall with the depth

    for batch in batches:
        rows: list[tuple[int, int]] = []
        for who, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if who != held:
                if held is not None:
                    rows.append((held, level()))
                held, total = who, np.zeros(65 - bits, dtype=np.int64)
            total = total + np.frombuffer(counts, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*rows, strict=True)) or [(), ()])], ["vec_id", "depth"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([level()], pa.int64())], ["vec_id", "depth"])


def _search(asks: pa.RecordBatch, array: np.ndarray, ids: np.ndarray, target: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """One batch of queries in one page, sorted by ``array``: of each the ``k`` best entries that aren't below its ``kth``."""
    string, depth, kth, who = asks.column(3).to_numpy().view(U64), asks.column(4).to_numpy(), asks.column(5).to_numpy(), asks.column(1).to_numpy()
    x = _vectors(asks.column(2))
    order = np.lexsort((string, depth))
    for s in range(0, len(order), 256):
        q = order[s : s + 256]
        lo, hi = _range(array, string[q], depth[q])
        for a in range(int(lo.min()), int(hi.max()), PAGE):
            b = min(a + PAGE, int(hi.max()))
            sims = np.round(x[q] @ target[a:b].T, 6)  # so that equal vectors tie whatever the product's order
            column = np.arange(a, b)
            sims[(column < lo[:, None]) | (column >= hi[:, None]) | (ids[a:b] == who[q][:, None])] = -2
            if b - a > k:  # nothing below the k-th in this page
                floor = -np.partition(-sims, k - 1, axis=1)[:, k - 1]
            else:
                floor = np.full(len(q), -2, dtype=np.float32)
            rows, cols = np.nonzero((sims >= np.maximum(kth[q] - np.float32(1e-6), floor)[:, None]) & (sims > -2))
            mine, other, found = who[q[rows]], ids[cols + a], sims[rows, cols]
            best = np.lexsort((other, -found, rows))
            rows, mine, other, found = rows[best], mine[best], other[best], found[best]
            head = np.searchsorted(rows, rows)
            keep = np.arange(len(rows)) - head < k
            yield pa.RecordBatch.from_arrays([pa.array(mine[keep]), pa.array(other[keep]), pa.array(found[keep])], FOUND)


def _best(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` best distinct neighbours of each query; rows come sorted by query."""
    held: list[pa.Table] = []
    rows = 0

    def out(table: pa.Table) -> pa.RecordBatch:
        who, other, s = (table.column(i).to_numpy() for i in range(3))
        order = np.lexsort((-s, other, who))
        who, other, s = who[order], other[order], s[order]
        new = np.concatenate([[True], (who[1:] != who[:-1]) | (other[1:] != other[:-1])])
        who, other, s = who[new], other[new], s[new]
        order = np.lexsort((other, -s, who))
        who, other, s = who[order], other[order], s[order]
        edge = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        rank = np.arange(len(who)) - np.repeat(edge, np.diff(np.append(edge, len(who))))
        keep = rank < k
        return pa.RecordBatch.from_arrays([pa.array(who[keep]), pa.array(other[keep]), pa.array(s[keep]), pa.array((rank[keep] + 1).astype(np.int32))], [*FOUND, "rank"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held.append(table)
        rows += len(table)
        last = batch.column(0)[-1].as_py()
        if rows > 200_000 and held[0].column(0)[0].as_py() != last:
            whole = pa.concat_tables(held)
            cut = int(np.searchsorted(whole.column(0).to_numpy(), last))
            if cut:
                yield out(whole.slice(0, cut))
            held, rows = [whole.slice(cut)], len(whole) - cut
    if held:
        yield out(pa.concat_tables(held))


def neighbours(vectors: DataFrame, queries: DataFrame | None = None, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, trees: int = TREES, target: int = TARGET, miss: float = MISS, seed: int = SEED) -> DataFrame:
    """``(vec_id, neighbour, similarity, rank)``: the ``k`` nearest other vectors of every query.

    ``queries`` has the ids (``id_col``) whose vectors are asked about, all of them without it; its
    other columns aren't read, and ids that ``vectors`` doesn't have are left out.
    Vectors are compared by cosine, to six decimals; equal similarities rank by id.  Rows without
    an id, null or zero vectors, vectors with a null or infinite element, and ones
    whose length isn't the most frequent length (the smallest of several) are left
    out.  Rows that share an id are one vector, the first by its elements.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<float>").alias("v")).where("vec_id is not null and v is not null and not exists(v, x -> x is null)")
    sizes = rows.groupBy(F.size("v").alias("dim")).count().where("dim > 0").orderBy(F.desc("count"), "dim").first()
    schema = "vec_id bigint, neighbour bigint, similarity float, rank int"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim = sizes.dim
    once = rows.where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))
    base = materialise(once.mapInArrow(lambda it: _base(it, dim, trees, seed), "vec_id bigint, vec binary, strings binary"))
    # classes of equal vectors, with their k + 1 least ids; the limit on the rank is applied before the shuffle too
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    least = base.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    classes = materialise(least.groupBy("vec").agg(F.min_by("strings", "vec_id").alias("strings"), F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("vec_id"), "vec", "strings", "ids"))
    asked = base.select("vec_id", "vec")
    if queries is not None:
        asked = asked.join(queries.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id")).distinct(), "vec_id", "left_semi")
    asked = materialise(asked.join(classes.select("vec", F.col("vec_id").alias("class")), "vec").select("vec_id", "class"))
    forest = classes.select("vec_id", "vec", "strings")
    wanted = materialise(forest.join(asked.select(F.col("class").alias("vec_id")).distinct(), "vec_id", "left_semi"))
    n = classes.count()
    bits = max(0, math.ceil(math.log2(max(n, 1) / PAGE)))
    entries = forest.mapInArrow(lambda it: _entries(it, trees, bits), "cell bigint, vec_id bigint, vec binary, string bigint")
    # pages that stay too full, of vectors with equal strings, are divided by id
    full = materialise(entries.groupBy("cell").count().where(F.col("count") > 4 * PAGE).select("cell", F.ceil(F.col("count") / (2 * PAGE)).cast("int").alias("parts")))
    part = F.coalesce(F.pmod(F.xxhash64("vec_id"), F.col("parts")), F.lit(0)).cast("int")
    placed = entries.join(full, "cell", "left").select((F.col("cell") + (part.cast("bigint") * (1 << 32))).alias("cell"), "vec_id", "vec", "string", F.lit(-1).cast("bigint").alias("depth"), F.lit(0.0).cast("float").alias("kth"))

    def visits(who: DataFrame) -> DataFrame:
        """The pages that queries ``(vec_id, depth, kth)`` visit."""
        asks = wanted.join(who, "vec_id").select("vec_id", "vec", "strings", "depth", "kth").mapInArrow(lambda it: _asks(it, trees, bits), ASKS)
        return asks.join(full, "cell", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))).select((F.col("cell") + F.col("part").cast("bigint") * (1 << 32)).alias("cell"), "vec_id", "vec", "string", "depth", "kth")

    def visit(page: DataFrame, who: DataFrame, work: Callable, result: str) -> DataFrame:
        both = page.unionAll(visits(who)).repartition("cell").sortWithinPartitions("cell", "depth")
        return both.mapInArrow(lambda it: _visit(it, work), result)

    def merge(found: DataFrame) -> DataFrame:
        return found.repartition("vec_id").sortWithinPartitions("vec_id").mapInArrow(lambda it: _best(it, k), schema)

    nothing = F.lit(-1.0).cast("float")
    start = wanted.select("vec_id", F.lit(64).cast("bigint").alias("depth"), nothing.alias("kth"))
    bare = placed.withColumn("vec", F.lit(None).cast("binary"))
    counts = visit(bare, start, lambda *page: _count(*page, bits), "vec_id bigint, counts binary")
    stops = materialise(counts.repartition("vec_id").sortWithinPartitions("vec_id").mapInArrow(lambda it: _stop(it, bits, target), "vec_id bigint, depth bigint"))
    triples = "vec_id bigint, neighbour bigint, similarity float"
    best = materialise(merge(visit(placed, stops.withColumn("kth", nothing), lambda *page: _search(*page, k), triples)))
    kth = best.groupBy("vec_id").agg(F.when(F.count("*") >= k, F.min("similarity")).otherwise(nothing).cast("float").alias("kth"))
    now = stops.join(kth, "vec_id", "left").select("vec_id", F.col("depth").alias("done"), F.coalesce("kth", nothing).alias("kth"))
    p = 1 - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("kth").cast("double")))) / math.pi
    deep = F.floor(math.log(1 - miss ** (1 / trees)) / F.log(F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-6), p))))
    more = materialise(now.select("vec_id", "done", F.greatest(F.lit(0), F.least(F.lit(64), deep)).cast("bigint").alias("depth"), "kth").where("depth < done").select("vec_id", "depth", "kth"))
    best = materialise(merge(visit(placed, more, lambda *page: _search(*page, k), triples).unionAll(best.select("vec_id", "neighbour", "similarity"))))
    # from classes to ids: a class stands for its k + 1 least ones, and a query's own class is as close as can be
    near = best.select(F.col("vec_id").alias("class"), F.col("neighbour").alias("other"), "similarity").unionAll(wanted.select(F.col("vec_id").alias("class"), F.col("vec_id").alias("other"), F.lit(1.0).cast("float").alias("similarity")))
    ids = near.join(classes.select(F.col("vec_id").alias("other"), "ids"), "other").select("class", F.explode("ids").alias("neighbour"), "similarity")
    # the k + 1 best of a class, of which every one of its ids leaves out itself, if it is there
    rank = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("similarity"), "neighbour"))
    short = ids.withColumn("nth", rank).where(F.col("nth") <= k + 1).drop("nth")
    return merge(asked.join(short, "class").where("vec_id <> neighbour").select("vec_id", "neighbour", "similarity"))
