"""Connected components of a graph given by its edges, and forests of links inside groups.

No step collects links or labels to the driver and no step emits all pairs of a group: what leaves a group is
a forest, at most one edge per member.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Rows, cut, groups_of, lean

EDGES = "a long, b long"
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


#: Most vertices whose rows meet their smallest neighbour by broadcast; a row is a pair of longs.
MOST_HOT = 100_000


def _with_least(rows: DataFrame, key: str, least: Column, edges: int, hot_degree: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with m, the value of ``least`` over all rows of the same ``key``; and (key, m) of each key.

    Rows of a vertex of many edges stay where they are: its m is broadcast. Degrees sum to twice the edges at most,
    so the limit leaves no more than MOST_HOT such vertices. All other rows are shuffled by the vertex.
    """
    found = rows.groupBy(key).agg(least.alias("m"), F.count("*").alias("degree"))
    every = found.filter("degree > 0").select(key, "m")  # keeps the count, so that the plan has one aggregation
    if edges < hot_degree:
        return rows.join(every, key), every
    limit = max(hot_degree, -(-2 * edges // MOST_HOT))
    hot = F.broadcast(found.filter(F.col("degree") >= limit).select(key, "m"))
    usual = found.filter(F.col("degree") < limit).select(key, "m")
    names = [*rows.columns, "m"]
    return rows.join(hot, key).select(*names).union(rows.join(hot, key, "left_anti").join(usual, key).select(*names)), every


def connected_components(edges: DataFrame, hot_degree: int = 100_000) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (a, b): component is the smallest id it reaches.

    Alternates large-star and small-star contractions until every edge leads to its component's smallest id.
    Each round is two aggregations and two joins on the vertex and is written to the shared folder; a vertex of
    ``hot_degree`` edges and more (two megabytes), such as a star's centre, does not meet in one task. Loops and repeated edges are
    allowed; vertices without edges have no row; an edge with a null end is left out.
    """
    step = cut(edges.filter("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    seen, n = None, step.count()
    while True:
        # Large star: each vertex hands its larger neighbours to its smallest one. The small star that follows
        # does so with its smaller neighbours and itself.
        both = step.select("u", "v").union(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near, _ = _with_least(both, "u", F.least(F.min("v"), F.first("u")), n, hot_degree)
        large = near.filter("v > u").select(F.col("m").alias("u"), "v").filter("u != v").distinct()
        down = large.select(F.col("v").alias("h"), F.col("u").alias("w"))
        held, low = _with_least(down, "h", F.min("w"), n, hot_degree)
        moved = held.filter("w > m").select(F.col("m").alias("u"), F.col("w").alias("v"))
        step = cut(moved.union(low.select(F.col("m").alias("u"), F.col("h").alias("v"))).distinct(), "edges")
        now = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("v")).first()
        if now[0] == now[2] and now == seen:  # a star forest that no longer changes
            break
        seen, n = now, now[0]
    return step.select(F.col("v").alias("id"), F.col("u").alias("component")).union(step.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())


class Links:
    """Finds the links among the members of one group; subclasses know what a payload is."""

    def load(self, batch: pa.RecordBatch) -> object:
        """The members' payloads in a form that ``row`` takes."""
        raise NotImplementedError

    def row(self, members: object, i: int, n: int) -> np.ndarray:
        """Indices of those members below ``n`` that link with member i."""
        raise NotImplementedError


def forest(links: Links, members: object, n: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) that connect what is linked among n members; at most n - 1.

    With ``first``, the members from it on are compared with those before it, and no others.
    """
    root = np.arange(n)
    from_, to = [], []
    for i in range(max(first, 1), n):
        near = links.row(members, i, first or i)
        if not len(near):
            continue
        roots = root[near]
        for r in np.unique(roots[roots != root[i]]).tolist():
            from_.append(i)
            to.append(int(near[np.argmax(roots == r)]))
            root[root == r] = root[i]
    return np.array(from_, np.int64), np.array(to, np.int64)


def _group_edges(batches: Iterator[pa.RecordBatch], links: Callable[[], Links], keys: list[str]) -> Iterator[pa.RecordBatch]:
    made, out = links(), Rows(_EDGES)
    for group in groups_of(batches, keys):
        if group.num_rows < 2:
            continue
        ids = group.column("id").to_numpy()
        first = 0
        if group.column("x")[0] != group.column("y")[0]:  # the second block's members come last
            second = group.column("second").to_numpy(zero_copy_only=False).astype(bool)
            order = np.argsort(second, kind="stable")
            group, ids, first = group.take(pa.array(order)), ids[order], int((~second).sum())
            if not 0 < first < len(ids):
                continue
        i, j = forest(made, made.load(group), len(ids), first)
        yield from out.add(ids[i], ids[j])
    yield from out.flush()


def group_forests(rows: DataFrame, links: Callable[[], Links], block: int = 1500, block_bytes: int = 12_000_000) -> DataFrame:
    """Edges (a, b) that connect all linked members of each group of ``rows`` (grp, id, weight, payload columns).

    A group of up to ``block`` members and ``block_bytes`` of payload is one unit of a task. A larger one is
    dealt in blocks of about that size by a hash of the id, and each pair of blocks is a unit, whatever task it
    lands in: no group, however large, meets in one task, and nothing is left out. In a unit of two blocks each
    member of the second is compared with those of the first; links inside a block are the work of its own unit.
    """
    payload = [c for c in rows.columns if c not in ("grp", "id", "weight")]
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n"), F.sum("weight").alias("bytes")).filter("n > 1")
    sized = rows.join(sizes, "grp")
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("bytes") / block_bytes)).cast("int")
    b = F.pmod(F.xxhash64("id", F.lit(7)), blocks).cast("int")
    # A member of block b goes to the units (x, b) for x < b, as one of the second block, to (b, b), and to (b, y).
    units = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda x: F.struct(F.least(x, b).alias("x"), F.greatest(x, b).alias("y"), (x < b).alias("second")),
    )
    dealt = sized.select("grp", "id", *payload, F.explode(units).alias("unit")).select("grp", "id", *payload, "unit.x", "unit.y", "unit.second")
    keys = ["grp", "x", "y"]
    in_order = dealt.repartition(*keys).sortWithinPartitions(*keys, "id")
    return in_order.mapInArrow(lean(partial(_group_edges, links=links, keys=keys)), EDGES)
