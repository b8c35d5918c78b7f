"""Exact top-k by integer inner product: a ball tree per shard, searched by branch and bound.

A node's ball bounds the inner product of anything in it with a query q by q.c + |q| r. Each query visits the
leaves of a shard in falling order of that bound and stops where it is below the k-th score it already has.

Vectors belong to the cell of their nearest centre, and a large cell is dealt over several shards. Every cell has
a root ball around its centre. A query first visits the cell of highest bound; its k-th score there goes with it to
the other cells, and only to those whose root bound reaches it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Rows, cut, groups_of, lean

LEAF = 256
#: Vectors of a shard and queries of a block; the task that joins one of each holds both.
SHARD, QUERIES = 16384, 4096
#: Vectors of a cell, and cells at most; centres come from CELL_SAMPLE vectors for each, so the driver holds no more.
CELL, MOST_CELLS, CELL_SAMPLE = 8192, 256, 8
#: Cells up to this count (a row each) are broadcast; only a table of very many widths has more.
BROADCAST_CELLS = 100_000
FOUND = "asked long, score long, vec_id long"
_FOUND = pa.schema([("asked", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())])


def leaves_of(x: np.ndarray, order: np.ndarray) -> list[np.ndarray]:
    """Splits rows at the median of the widest of a few directions until LEAF are left; copies split too."""
    if len(order) <= LEAF:
        return [order]
    own = x[order]
    far = own[np.argmax(((own - own.mean(axis=0)) ** 2).sum(axis=1))]
    other = own[np.argmax(((own - far) ** 2).sum(axis=1))]
    half = len(order) // 2
    ranked = order[np.argpartition(own @ (other - far), half)]
    return leaves_of(x, ranked[:half]) + leaves_of(x, ranked[half:])


class BallTree:
    """Leaves of a shard with their balls; inner nodes are balls over runs of leaves, two by two."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        parts = leaves_of(x.astype(np.float64), np.arange(len(x)))
        self.rows = [p[np.argsort(ids[p], kind="stable")] for p in parts]
        self.x, self.ids = x, ids
        self.first = np.array([ids[p[0]] for p in self.rows])  # the smallest id of each leaf
        self.levels = []  # from leaves to the root: centres and radii
        groups = self.rows
        while True:
            centres = np.stack([x[g].astype(np.float64).mean(axis=0) for g in groups])
            radii = np.array([np.sqrt(((x[g] - c) ** 2).sum(axis=1).max()) for g, c in zip(groups, centres, strict=True)])
            self.levels.append((centres, radii))
            if len(groups) == 1:
                break
            groups = [np.concatenate(groups[i : i + 2]) for i in range(0, len(groups), 2)]

    def bounds(self, q: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Upper bounds of each query in each leaf; -inf where a node above is already below the query's least score."""
        norm = np.sqrt((q * q).sum(axis=1))
        live = np.ones((len(q), 1), bool)
        for centres, radii in reversed(self.levels):
            live = np.repeat(live, 2, axis=1)[:, : len(centres)] if len(centres) > 1 else live
            bound = q @ centres.T + norm[:, None] * radii
            bound += 1e-9 * np.abs(bound) + 1e-6  # for rounding: scores are whole numbers
            live = live & (bound >= least[:, None])
        return np.where(live, bound, -np.inf)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole-number inner products, by floating point where that is exact."""
    if len(q) and len(x) and float(np.abs(q).max()) * float(np.abs(x).max()) * x.shape[1] < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def search(tree: BallTree, q: np.ndarray, own_ids: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, id, score) of each query's best k rows of the tree whose score is at least its ``least``.

    Rows of the query's own id are no candidates. Ties go to the smaller id.
    """
    n = len(q)
    bound = tree.bounds(q.astype(np.float64), least)
    turn = np.argsort(-bound, axis=1, kind="stable")
    none = np.iinfo(np.int64).min + 1  # so that its negative is a number too
    score, ids = np.full((n, k), none), np.full((n, k), np.iinfo(np.int64).max)
    kth = least.astype(np.float64).copy()
    live = np.arange(n)
    for step in range(bound.shape[1]):
        leaf = turn[live, step]
        top = bound[live, leaf]
        live, leaf = live[keep := (top >= kth[live]) & (top > -np.inf)], leaf[keep]
        if not len(live):
            break
        for f in np.unique(leaf).tolist():
            who = live[leaf == f]
            rows = tree.rows[f]
            s = _products(q[who], tree.x[rows])
            names = tree.ids[rows]
            s = np.where((names[None] == own_ids[who][:, None]) | (s < least[who][:, None]), none, s)
            m = min(k, s.shape[1])
            # Best m of the leaf by score, then by id: rows stand in order of id, so a stable sort keeps ties right.
            if s.shape[1] > 4 * k:
                edge = -np.partition(-s, m - 1, axis=1)[:, m - 1]
                best = np.argsort(np.where(s >= edge[:, None], -s, np.iinfo(np.int64).max), axis=1, kind="stable")[:, :m]
            else:
                best = np.argsort(-s, axis=1, kind="stable")[:, :m]
            all_s = np.concatenate([score[who], np.take_along_axis(s, best, axis=1)], axis=1)
            all_i = np.concatenate([ids[who], np.where(np.take_along_axis(s, best, axis=1) > none, names[best], np.iinfo(np.int64).max)], axis=1)
            pick = np.lexsort((all_i, -all_s), axis=1)[:, :k]
            score[who], ids[who] = np.take_along_axis(all_s, pick, axis=1), np.take_along_axis(all_i, pick, axis=1)
            full = score[who][:, k - 1]
            kth[who] = np.maximum(least[who], np.where(full > none, full, least[who]))
    i, j = np.nonzero(score > none)
    return i, ids[i, j], score[i, j]


def _whole(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    out, shard, tree = Rows(_FOUND), None, None
    for group in groups_of(batches, ["width", "cell", "part", "block"]):
        here = tuple(group.column(c)[0].as_py() for c in ("width", "cell", "part"))
        x, ids = _whole(group.column("v"), group.num_rows), group.column("vec_id").to_numpy()
        if group.column("block")[0].as_py() < 0:  # the shard's vectors come before the blocks of queries
            shard, tree = here, BallTree(x, ids)
        elif shard == here:
            asked, least = group.column("asked").to_numpy(), group.column("least").to_numpy(zero_copy_only=False)
            i, found, score = search(tree, x, ids, least, k)
            yield from out.add(asked[i], score, found)
    yield from out.flush()


def _centres(x: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """Means of ``n`` clusters of a sample, from its first rows on."""
    centre = np.unique(x[:n], axis=0)
    for _ in range(rounds):
        near = np.argmin((centre**2).sum(axis=1) - 2 * (x @ centre.T), axis=1)
        centre = np.stack([x[near == j].mean(axis=0) if (near == j).any() else centre[j] for j in range(len(centre))])
    return centre


def _cells_of(rows: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Centres for each width that a bounded sample holds, those of smallest hash; other widths are one cell each."""
    cells = int(min(max(n // CELL, 1), MOST_CELLS))
    sample = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id", F.lit(8)), "vec_id").limit(CELL_SAMPLE * cells).select("v").toArrow().column("v").to_pylist()
    by_width: dict[int, list] = {}
    for v in sample:
        by_width.setdefault(len(v), []).append(v)
    return {w: _centres(np.array(x, float), max(cells * len(x) // len(sample), 1)) for w, x in by_width.items()}


def _place(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """Cell of each vector, and its distance to the centre."""
    for batch in batches:
        cell, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
        for rows, x in _by_width(batch):
            if (centres := shared.value.get(x.shape[1])) is None:
                continue
            square = (centres**2).sum(axis=1) - 2 * (x.astype(float) @ centres.T)
            cell[rows] = np.argmin(square, axis=1)
            far[rows] = np.sqrt(((x - centres[cell[rows]]) ** 2).sum(axis=1))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    widths = batch.column("width").to_numpy()
    for w in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == w)
        for at in range(0, len(rows), 4096):
            some = rows[at : at + 4096]
            yield some, _whole(batch.column("v").take(pa.array(some)), len(some))


def _visits(batches: Iterator[pa.RecordBatch], shared: Broadcast, first: bool) -> Iterator[pa.RecordBatch]:
    """The cells that a query visits: the one of highest bound at ``first``, then those whose bound reaches its k-th score."""
    for batch in batches:
        least = batch.column("least").to_numpy(zero_copy_only=False)
        cells: list = [None] * batch.num_rows
        for rows, x in _by_width(batch):
            cell, centres, radii = shared.value.get(x.shape[1], ([0], np.zeros((1, x.shape[1])), np.array([np.inf])))
            q = x.astype(float)
            norm = np.sqrt((q * q).sum(axis=1))
            reach = norm[:, None] * radii
            bound = q @ centres.T + np.where(np.isnan(reach), 0, reach)
            bound += 1e-9 * np.abs(bound) + 1e-6  # for rounding: scores are whole numbers
            best = np.argmax(bound, axis=1)
            go = np.zeros(bound.shape, bool)
            if first:
                go[np.arange(len(q)), best] = True
            else:
                go = bound >= least[rows][:, None]
                go[np.arange(len(q)), best] = False
            for r, own in zip(rows.tolist(), go, strict=True):
                cells[r] = [cell[j] for j in np.flatnonzero(own).tolist()]
        rest = [c for c in batch.schema.names if c != "cells"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(cells, pa.list_(pa.int32()))], names=[*rest, "cells"])


def scaled(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of each component as a whole number; null where a component is null or not finite."""
    x = embedding.cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(sound & (F.size(x) > 0), F.transform(x, lambda v: F.floor(v * scale)))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest integer inner product for each query row.

    ``vectors`` has vec_id and embedding; ``is_query`` is true for the query rows, candidates are all rows of the
    query's width but those of its own vec_id. Scores are inner products of floor(scale * x), ties go to the smaller
    vec_id; a query with fewer candidates gets them all. Rows without vec_id, and vectors that are null, empty
    or hold null or non-finite components take no part. Rows that repeat a vec_id are candidates each, and each
    repeated query row has ranks of its own from 1; equal ones are searched once and their answer is repeated.
    Other columns are not read. An empty table gives no rows. A scaled component that no 64-bit integer holds, or
    whose scores might pass one, is an error.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = cut(rows.filter("vec_id is not null and v is not null").withColumn("width", F.size("v")), "scaled")
    largest = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))).alias("x"), F.max("width").alias("width")).first()
    if not largest.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if largest.x**2 * largest.width >= 2**63:
        raise ValueError(f"scores of components up to {largest.x:g} in {largest.width} dimensions pass 64 bits")
    centres = _cells_of(rows, largest.n)
    placed = cut(rows.select("vec_id", "v", "q", "width").mapInArrow(lean(partial(_place, shared=spark.sparkContext.broadcast(centres))), "vec_id long, v array<long>, q boolean, width int, cell int, far double"), "cells")
    sizes = placed.groupBy("width", "cell").agg(F.max("far").alias("far"), F.ceil(F.count("*") / SHARD).cast("int").alias("parts"))
    # At most MOST_CELLS + the sample's widths are known to the driver; a cell of another width is always visited.
    sizes = cut(sizes, "sizes")
    known, few = sizes.filter(F.col("width").isin(list(centres))).collect(), sizes.count() <= BROADCAST_CELLS
    parts = sizes.select("width", "cell", "parts")
    parts = F.broadcast(parts) if few else parts
    roots = {}
    for w in centres:
        own = sorted((r.cell, r.far) for r in known if r.width == w)
        roots[w] = ([c for c, _ in own], centres[w][[c for c, _ in own]], np.array([1.0001 * far + 1e-6 for _, far in own]))
    shared_roots = spark.sparkContext.broadcast(roots)
    # A query is a vec_id with a vector; equal rows ask once.
    asked = placed.filter("q").groupBy("vec_id", "v", "width").agg(F.count("*").alias("times"))
    asked = cut(asked.withColumn("asked", F.xxhash64("vec_id", "v")), "queries")
    blocks = max(-(-asked.count() // QUERIES), 1)
    parted = placed.join(parts, ["width", "cell"])
    shards = parted.select("width", "cell", F.pmod(F.xxhash64("vec_id", F.lit(5)), "parts").cast("int").alias("part"), F.lit(-1).alias("block"), "vec_id", "v", F.lit(0.0).alias("least"), F.lit(0).cast("long").alias("asked"))
    tasks = max(sum(r.parts for r in known), 1)

    def searched(queries: DataFrame, first: bool) -> DataFrame:
        visits = queries.mapInArrow(lean(partial(_visits, shared=shared_roots, first=first)), "vec_id long, v array<long>, width int, least double, asked long, cells array<int>")
        dealt = visits.withColumn("cell", F.explode("cells")).join(parts, ["width", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        block = F.pmod(F.xxhash64("asked", F.lit(6)), F.lit(blocks)).cast("int").alias("block")
        both = shards.unionByName(dealt.select("width", "cell", "part", block, "vec_id", "v", "least", "asked"))
        keys = ["width", "cell", "part"]
        return cut(both.repartition(min(tasks, 4096), *keys).sortWithinPartitions(*keys, "block", "vec_id").mapInArrow(lean(partial(_search, k=k)), FOUND), "found")

    start = asked.select("vec_id", "v", "width", F.lit(float("-inf")).alias("least"), "asked")
    found = searched(start, True)
    # The k-th score so far, or nothing where there were fewer candidates.
    kth = found.groupBy("asked").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("asked", F.when(F.size("s") >= k, F.get("s", F.lit(k - 1))).cast("double").alias("kth"))
    others = start.join(kth, "asked", "left").select("vec_id", "v", "width", F.coalesce("kth", "least").alias("least"), "asked")
    found = found.unionByName(searched(others, False))
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    out = best.join(asked.select("asked", F.col("vec_id").alias("query_id"), "times"), "asked").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
