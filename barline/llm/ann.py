"""Nearest neighbours by largest inner product over shifted space-filling curves.

Each curve orders all distinct vectors by the Hilbert key of a rotated projection on a few directions; vectors of equal
key follow a further direction. A query enters each curve at several places, its probes: its own, and those of copies of
it shifted over the nearest of the planes that halve the directions, in the order of the shift's length. The `WINDOW` rows
on both sides of every probe are compared with the query, and around its own place `OWN` of all that it is compared
with, which is what finds neighbours in tight clusters, where no plane passes. The lists of all curves merge.

Spark partitions each curve by ranges, its blocks, whose bounds come from a sample of at most about `SAMPLE` vectors; a
query goes to the blocks that its probes fall in. With n vectors of a length, a curve has about log2(n / 2 WINDOW)
directions, so that a window is about as long as the part of the curve between two such planes, and

    rows compared on a curve = FIRST (n / 2000) ** GROWTH, at least FIRST, probes = (1 - OWN) of that / (2 WINDOW)

so the share of rows that a query is compared with falls as n ** (GROWTH - 1). The README has the recall and share that
were measured. No list has an own row for a copy: equal vectors are one point, whose ids come back at the end.

The curves order directions, so recall is that of inner products of vectors of about equal length; where lengths differ
widely, a larger FIRST makes up for it.

Scores are sums of products in double precision, in the order of the components.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.llm.common import cut, dealt_join, slices

CURVES, WINDOW, FIRST, GROWTH, OWN = 4, 16, 720, 0.8, 0.4
SAMPLE, BLOCK, KEY_BITS, FLIPS = 200_000, 16_384, 52, 10
_SUBSETS = np.array(list(product((0, 1), repeat=FLIPS)), dtype=bool)


class Plan:
    """How the vectors of one length lie on the curves: directions, bits of a coordinate, probes, and bounds of blocks."""

    def __init__(self, size: int, n: int, first: int = FIRST):
        self.dims = int(min(size, 24, max(1, round(np.log2(max(n, 1) / (2 * WINDOW))))))
        self.bits = min(8, KEY_BITS // self.dims)
        compared = first * max(1.0, n / 2000) ** GROWTH
        self.probes, self.own = int(np.ceil((1 - OWN) * compared / (2 * WINDOW))), int(np.ceil(OWN * compared / 2))
        self.blocks = max(1, min(-(-n // BLOCK), SAMPLE // 16))
        self.axes, self.bounds, self.first_block = rotations(size, self.dims), [np.empty(0, complex)] * CURVES, 0

    def spread(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        """Coordinates of the directions of vectors on a curve's axes, and last on the further one."""
        unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
        return unit @ self.axes[curve] * np.sqrt(vectors.shape[1])

    def keys(self, spread: np.ndarray) -> np.ndarray:
        """Places on the curve: the Hilbert key, and as imaginary part the further coordinate, so they sort as pairs."""
        cells = np.clip((spread[:, : self.dims] / 6 + 0.5) * (1 << self.bits), 0, (1 << self.bits) - 1).astype(np.int64)
        return hilbert_keys(cells, self.bits) + 1j * spread[:, -1]

    def probe_keys(self, spread: np.ndarray) -> np.ndarray:
        """For each vector the keys of its probes, one a row of the result; the first is its own."""
        m = min(self.dims, FLIPS)
        order = np.argsort(np.abs(spread[:, : self.dims]), axis=1)[:, :m]
        subsets = _SUBSETS[: 1 << m, FLIPS - m :]
        cost = np.take_along_axis(spread, order, 1) ** 2 @ subsets.T.astype(float)
        best = np.argsort(cost, axis=1, kind="stable")[:, : self.probes]
        out = np.empty(best.shape, complex)
        for p in range(best.shape[1]):
            flip = np.zeros(spread.shape, bool)
            np.put_along_axis(flip, order, subsets[best[:, p]], 1)
            out[:, p] = self.keys(np.where(flip, -spread, spread))
        return out

    def block(self, keys: np.ndarray, curve: int) -> np.ndarray:
        return self.first_block + curve * self.blocks + np.searchsorted(self.bounds[curve], keys, side="right")


def rotations(size: int, dims: int) -> list[np.ndarray]:
    """For each curve orthonormal directions, one a column, the last one for ties; the same in every run."""
    out = []
    for c in range(CURVES):
        rng = np.random.default_rng(1000 + c)
        axes = np.linalg.qr(rng.normal(size=(size, dims)))[0]
        out.append(np.column_stack((axes, rng.normal(size=size) / np.sqrt(size))))
    return out


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of integer coordinates below 2**bits, by Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            x[0] = np.where(on, x[0] ^ p, x[0])
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= t
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


def points_of(rows: DataFrame, every: int, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows that can take part as (p1, p2, vec_id), and their distinct vectors as points.

    p1 and p2, together 128 bits, are a hash of the vector. A point has the smallest id, the number of ids, and whether
    a query has it.
    """
    v = F.col(vector_col)
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    own = rows.where(F.col(id_col).isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    own = own.withColumns({"p1": F.xxhash64("v"), "p2": F.xxhash64(F.lit("point"), "v")})
    asked = F.max((F.col("vec_id") % every == 0).cast("int")).alias("asked")
    points = own.groupBy("p1", "p2").agg(F.any_value("v").alias("v"), F.min("vec_id").alias("least"), F.count("*").alias("n"), asked)
    return own.drop("v"), points.withColumn("size", F.size("v"))


def _by_size(batch: pa.RecordBatch, plans: dict):
    """(plan, rows, vectors) for each length of the vectors in columns v and size."""
    sizes = batch.column("size").to_numpy()
    for size in np.unique(sizes).tolist():
        own = batch.filter(pa.array(sizes == size))
        yield plans[size], own, own.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _sample_batches(plans: dict):
    def run(batches):
        for batch in batches:
            for plan, own, vectors in _by_size(batch, plans):
                for c in range(CURVES):
                    keys = plan.keys(plan.spread(vectors, c))
                    cols = [own.column("size"), pa.array(np.full(len(keys), c, np.int32)), pa.array(keys.real), pa.array(keys.imag)]
                    yield pa.RecordBatch.from_arrays(cols, names=["size", "curve", "key", "tie"])

    return run


def plan_of(points: DataFrame, first: int = FIRST) -> dict[int, Plan]:
    """For each length of vectors how they lie on the curves. Lengths are taken to be few, as a table's models are."""
    plans, n_blocks = {}, 0
    sizes = {r[0]: r[1] for r in points.groupBy("size").count().collect()}
    for size, n in sorted(sizes.items()):
        plans[size] = plan = Plan(size, n, first)
        plan.first_block, n_blocks = n_blocks, n_blocks + CURVES * plan.blocks
    share = min(1.0, SAMPLE / max(1, sum(sizes.values())))
    drawn = points.where(F.pmod(F.col("p2"), F.lit(1 << 20)) < int((1 << 20) * share))
    sample = drawn.select("v", "size").mapInArrow(_sample_batches(plans), "size int, curve int, key double, tie double").toPandas()
    for (size, curve), own in sample.groupby(["size", "curve"]):
        keys = np.sort(own["key"].to_numpy() + 1j * own["tie"].to_numpy())
        cuts = np.arange(1, plans[size].blocks) * len(keys) // plans[size].blocks
        plans[size].bounds[curve] = keys[cuts]
    return plans


def _place_batches(plans: dict, kind: pa.DataType):
    """Rows of points in blocks (kind 0), and after them queries with the keys of their probes there (kind 1)."""

    def run(batches):
        for batch in slices(batches):
            for plan, own, vectors in _by_size(batch, plans):
                asked = np.flatnonzero(own.column("asked").to_numpy())
                for c in range(CURVES):
                    spread = plan.spread(vectors, c)
                    keys = plan.keys(spread)
                    yield _placed(own, plan.block(keys, c), 0, keys, pa.nulls(own.num_rows, pa.list_(pa.float64())), kind)
                    if not len(asked):
                        continue
                    probes = plan.probe_keys(spread[asked])
                    blocks = plan.block(probes, c)
                    order = np.argsort(blocks, axis=1, kind="stable")
                    probes, blocks = np.take_along_axis(probes, order, 1), np.take_along_axis(blocks, order, 1)
                    new = np.ones(blocks.shape, bool)
                    new[:, 1:] = blocks[:, 1:] != blocks[:, :-1]
                    row, col = np.nonzero(new)
                    flat = np.flatnonzero(new.ravel())
                    ends = pa.array(np.append(flat, blocks.size), pa.int32())
                    lists = pa.ListArray.from_arrays(ends, pa.array(probes.real.ravel()))
                    yield _placed(own.take(pa.array(asked[row])), blocks[row, col], 1, keys[asked[row]], lists, kind)

    return run


def _placed(rows: pa.RecordBatch, blocks: np.ndarray, which: int, keys: np.ndarray, probes: pa.Array, kind: pa.DataType) -> pa.RecordBatch:
    cols = [pa.array(blocks.astype(np.int32)), pa.array(np.full(len(blocks), which, np.int32)), pa.array(keys.real), pa.array(keys.imag), probes]
    cols += [rows.column("p1"), rows.column("p2"), rows.column("least"), rows.column("n"), rows.column("v").cast(kind)]
    return pa.RecordBatch.from_arrays(cols, names=["block", "kind", "key", "tie", "probes", "p1", "p2", "least", "n", "v"])


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of rows with a query, summed in the order of the components."""
    out = np.zeros(len(vectors))
    for k in range(vectors.shape[1]):
        out += vectors[:, k] * query[k]
    return out


def near_rows(keys: np.ndarray, probes: np.ndarray, own: complex, around: int) -> np.ndarray:
    """Rows of a block, sorted by key, in the windows of probes and `around` a query's own place, if that is a probe.

    Windows at an end of the block reach further in.
    """
    at = np.searchsorted(keys, probes)
    start = np.clip(at - WINDOW, 0, max(0, len(keys) - 2 * WINDOW))
    seen = np.zeros(len(keys) + 2 * WINDOW, bool)
    seen[start[:, None] + np.arange(2 * WINDOW)] = True
    if (probes == own).any():
        first = min(max(0, int(np.searchsorted(keys, own)) - around), max(0, len(keys) - 2 * around))
        seen[first : first + 2 * around] = True
    return np.flatnonzero(seen[: len(keys)])


_FOUND = "q1 long, q2 long, p1 long, p2 long, least long, n long, score double, compared long"


def _search_batches(k: int, around: dict):
    """Of each block the k + 1 best points in the windows of each query; rows come sorted by block, kind and key."""

    def run(batches):
        block, rows, held = None, None, []
        for batch in slices(batches):
            blocks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.flatnonzero(np.diff(blocks * 2 + kinds)) + 1
            for start, end in zip([0, *new], [*new, batch.num_rows]):
                part = batch.slice(start, end - start)
                if blocks[start] != block:
                    block, rows, held = blocks[start], None, []
                if kinds[start] == 0:
                    held.append(part)
                    continue
                if rows is None:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    column = [whole.column(i).to_numpy() for i in (5, 6, 7, 8)]
                    flat = whole.column(9).combine_chunks().flatten().to_numpy(zero_copy_only=False)
                    rows = whole.column(2).to_numpy() + 1j * whole.column(3).to_numpy(), column, flat.astype(np.float64).reshape(whole.num_rows, -1)
                    held = []
                yield from _searched(part, *rows, k, around)

    return run


def _searched(part: pa.RecordBatch, keys: np.ndarray, column: list, vectors: np.ndarray, k: int, around: dict):
    out, queries = [], part.column(9).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
    key, tie, probes = part.column(2).to_numpy(), part.column(3).to_numpy(), part.column(4)
    for i, query in enumerate(queries):
        at = near_rows(keys, probes[i].values.to_numpy() + 1j * tie[i], key[i] + 1j * tie[i], around[queries.shape[1]])
        score = vectors[at] @ query
        if len(at) > k + 1:
            kth = np.partition(score, len(at) - k - 1)[len(at) - k - 1]
            best = score >= kth - 1e-9 * (1 + abs(kth))
            own, score = at[best], exact(vectors[at[best]], query)
        else:
            own, score = at, exact(vectors[at], query)
        order = np.lexsort((column[2][own], -score))[: k + 1]
        out.append((i, own[order], score[order], len(at)))
    size = [len(o) for _, o, _, _ in out]
    of, own = np.repeat([i for i, *_ in out], size), np.concatenate([o for _, o, _, _ in out])
    seen = np.zeros(len(of), np.int64)
    seen[np.cumsum([0, *size[:-1]])] = [n for *_, n in out]
    cols = [part.column(5).take(pa.array(of)), part.column(6).take(pa.array(of)), *(pa.array(c[own]) for c in column), pa.array(np.concatenate([s for _, _, s, _ in out])), pa.array(seen)]
    yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _FOUND.split(", ")])


def lists_of(points: DataFrame, k: int, first: int = FIRST) -> DataFrame:
    """(q1, q2, p1, p2, least, n, score, compared): what the curves find for each query point, at most k + 1 a block.

    compared is the number of rows that the query was compared with in a block, on one of its rows there, else 0.
    """
    plans = plan_of(points, first)
    kind = points.schema["v"].dataType.elementType
    schema = f"block int, kind int, key double, tie double, probes array<double>, p1 long, p2 long, least long, n long, v array<{kind.simpleString()}>"
    arrow = pa.list_({"float": pa.float32(), "double": pa.float64()}.get(kind.simpleString(), pa.float64()))
    placed = points.mapInArrow(_place_batches(plans, arrow), schema)
    return placed.repartition("block").sortWithinPartitions("block", "kind", "key", "tie").mapInArrow(_search_batches(k, {size: p.own for size, p in plans.items()}), _FOUND)


def search(rows: DataFrame, k: int, every: int, id_col: str = "vec_id", vector_col: str = "embedding", first: int = FIRST) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row whose id is divisible by `every` the k nearest found of all other rows.

    Nearest first, ties to the smaller id; all candidates if there are fewer. Vectors that are null, zero or hold null
    or non-finite components and rows without an id take no part; vectors of another length than the query's are no
    candidates. Rows that repeat an id and vector count once; an id with several vectors asks and is found with each.
    A table of up to `first` vectors is compared whole, so `first` as large as the table makes any search exact.
    """
    kind = rows.schema[vector_col].dataType.elementType.simpleString()
    if kind not in ("float", "double"):
        rows = rows.withColumn(vector_col, F.col(vector_col).cast("array<double>"))
    own, points = points_of(rows, every, id_col, vector_col)
    points = cut(points)
    best = F.row_number().over(W.partitionBy("q1", "q2").orderBy(F.desc("score"), "least"))
    found = cut(lists_of(points, k, first).drop("compared").distinct().withColumn("place", best).where(F.col("place") <= k + 1).drop("place"))
    # ids of the points found: of equal vectors only the k + 1 smallest can count
    place = F.row_number().over(W.partitionBy("p1", "p2").orderBy("vec_id"))
    copies = own.distinct().withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
    single = found.where("n = 1").select("q1", "q2", F.col("least").alias("vec_id"), "score")
    several = found.where("n > 1").join(copies, ["p1", "p2"]).select("q1", "q2", "vec_id", "score")
    near = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id", "score")))
    place = F.row_number().over(W.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id"))
    lists = single.unionByName(several).withColumn("place", place).where(F.col("place") <= k + 1).groupBy("q1", "q2").agg(near.alias("near"))
    # a vector that very many queries have is joined in parts
    queries = own.where(F.col("vec_id") % every == 0).distinct().select(F.col("vec_id").alias("query_id"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))
    lists = lists.join(queries.groupBy("q1", "q2").count(), ["q1", "q2"])
    out = dealt_join(queries, lists, ["q1", "q2"], "query_id").select("query_id", F.explode("near").alias("x")).select("query_id", "x.vec_id", "x.score").where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
