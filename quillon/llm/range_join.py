"""Near-duplicate vectors by an exact metric range join.

Pivots partition the unit vectors: a vector belongs to the cell of its nearest pivot. A link within distance r
can cross a cell's boundary, so a vector is also sent to each earlier cell whose boundary and whose farthest member it
is near enough to; how near follows from the triangle inequality. Cells are then joined independently. In directions
without structure nearly all cells are near, and the join becomes one of all pairs in blocks.

On unit vectors a cosine of at least c is a distance of at most r = sqrt(2 - 2c).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import Rows, cut, groups_of, lean

#: Vectors that a cell should hold; the number of pivots follows from it, and the driver samples four for each.
CELL = 6000
MOST_PIVOTS = 2048
#: Cells up to this count (a row each) are broadcast; only a table of very many widths has more.
BROADCAST_CELLS = 100_000
#: Vectors of a block: a cell larger than that is joined block by block, and so many other blocks pass a block in a unit.
BLOCK, PASSING = 6000, 8
_CELLS = pa.schema([("width", pa.int32()), ("cell", pa.int32()), ("own", pa.bool_()), ("far", pa.float64()), ("id", pa.int64()), ("copies", pa.int64()), ("unit", pa.binary())])
_FOUND = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])


def unit_rows(column: pa.Array, width: int) -> np.ndarray:
    """The vectors in double precision, at unit length."""
    x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _assign(batches: Iterator[pa.RecordBatch], shared: Broadcast, radius: float) -> Iterator[pa.RecordBatch]:
    out = Rows(_CELLS)
    for batch in batches:
        widths = batch.column("width").to_numpy()
        for w in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == w)
            for at in range(0, len(rows), 2000):
                part = batch.take(pa.array(rows[at : at + 2000]))
                yield from _assigned(part, w, shared.value.get(w), radius, out)
    yield from out.flush()


def _assigned(part: pa.RecordBatch, width: int, pivots: np.ndarray | None, radius: float, out: Rows) -> Iterator[pa.RecordBatch]:
    x = unit_rows(part.column("embedding"), width)
    ids, copies, n = part.column("id").to_numpy(), part.column("copies").to_numpy(), part.num_rows
    raw = np.empty(n, object)
    raw[:] = [v.tobytes() for v in x]
    if pivots is None:  # a rare width: one cell
        yield from out.add(np.full(n, width), np.zeros(n, int), np.ones(n, bool), np.zeros(n), ids, copies, raw)
        return
    square = np.maximum(2 - 2 * (x @ pivots.T), 0)
    own = np.argmin(square, axis=1)
    nearest = square[np.arange(n), own]
    yield from out.add(np.full(n, width), own, np.ones(n, bool), np.sqrt(nearest), ids, copies, raw)
    # If y of cell j lies within r of x, then x is within r of the plane between the two pivots:
    # d(x, pj)^2 - d(x, pi)^2 <= 2 r d(pi, pj). The triangle inequality gives that and no pair is lost;
    # the small term is for rounding. The pair is found in the earlier cell alone.
    gap = square - nearest[:, None]
    span = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))[own] if len(pivots) <= 256 else np.sqrt(np.maximum(2 - 2 * (pivots[own] @ pivots.T), 0))
    i, j = np.nonzero((gap <= 2 * radius * span + 1e-9) & (np.arange(len(pivots)) < own[:, None]))
    yield from out.add(np.full(len(i), width), j, np.zeros(len(i), bool), np.sqrt(square[i, j]), ids[i], copies[i], raw[i])


def _linked(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of a and b have at least that cosine: by single precision where it is clear, else by double."""
    margin = 1e-6 + 2e-7 * a.shape[1]
    out = np.empty((len(a), len(b)), bool)
    b32 = b.astype(np.float32).T
    for at in range(0, len(a), 512):
        near = a[at : at + 512].astype(np.float32) @ b32
        found = near >= cosine - margin
        if found.any():
            i, j = np.nonzero(found & (near <= cosine + margin))
            if len(i) > 20_000:
                found = a[at : at + 512] @ b.T >= cosine
            elif len(i):
                found[i, j] = (a[at + i] * b[j]).sum(axis=1) >= cosine
        out[at : at + 512] = found
    return out


def _join(batches: Iterator[pa.RecordBatch], cosine: float, passing: int) -> Iterator[pa.RecordBatch]:
    """Each unit's own block comes first and is held; the blocks that pass it are joined with it one by one."""
    out, unit, held = Rows(_FOUND), None, None
    for group in groups_of(batches, ["width", "cell", "x", "y", "part"]):
        here = tuple(group.column(c)[0].as_py() for c in ("width", "cell", "x", "y"))
        ids, copies = group.column("id").to_numpy(), group.column("copies").to_numpy()
        x = np.frombuffer(b"".join(group.column("unit").to_pylist())).reshape(len(ids), -1)
        if group.column("part")[0].as_py() < 0:
            unit, held = here, (x, ids, copies)
            if here[3] == here[2] // passing:
                yield from _pairs(held, held, cosine, out)
        elif unit == here:
            yield from _pairs(held, (x, ids, copies), cosine, out)
    yield from out.flush()


def _pairs(first: tuple, second: tuple, cosine: float, out: Rows) -> Iterator[pa.RecordBatch]:
    inside = first is second
    linked = _linked(first[0], second[0], cosine)
    if inside:
        np.fill_diagonal(linked, False)
    rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    if not len(rows):
        return
    linked = linked[np.ix_(rows, columns)]
    n = len(first[1])
    ids = first[1] if inside else np.concatenate([first[1], second[1]])
    links = np.zeros(len(ids), np.int64)
    for at in range(0, len(rows), 512):
        some = linked[at : at + 512].astype(float)
        links[rows[at : at + 512]] += (some @ second[2][columns]).astype(np.int64)
        if not inside:
            links[n + columns] += (first[2][rows[at : at + 512]] @ some).astype(np.int64)
    # A forest of what is linked: each vector reached first from a root.
    to = _roots(rows, columns if inside else n + columns, linked)
    some = np.flatnonzero(links)
    yield from out.add(ids[some], links[some], np.array([ids[to.get(k, k)] for k in some.tolist()], np.int64))


def _roots(a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> dict[int, int]:
    """For each member the root of its part of the bipartite graph ``linked`` (the same set twice is fine)."""
    row_at = {int(k): i for i, k in enumerate(a)}
    column_at = {int(k): i for i, k in enumerate(b)}
    root: dict[int, int] = {}
    for start in a.tolist():
        if start in root:
            continue
        root[start], queue = start, [start]
        while queue:
            k = queue.pop()
            near: list[int] = []
            if k in row_at:
                near += b[linked[row_at[k]]].tolist()
            if k in column_at:
                near += a[linked[:, column_at[k]]].tolist()
            for n in near:
                if n not in root:
                    root[n] = start
                    queue.append(n)
    return root


def _pivots(vectors: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Pivots for each width from a bounded sample (four for each pivot, those of smallest hash), farthest first."""
    count = int(min(max(n // CELL, 4), MOST_PIVOTS))
    rows = vectors.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(4 * count).toArrow().column("embedding").to_pylist()
    by_width: dict[int, list] = {}
    for v in rows:
        by_width.setdefault(len(v), []).append(v)
    out = {}
    for width, own in by_width.items():
        x = unit_rows(pa.array(own), width)
        chosen, far = [0], 2 - 2 * (x @ x[0])
        while len(chosen) < min(-(-count * len(own) // len(rows)), len(own)):
            k = int(np.argmax(far))
            if far[k] <= 1e-12:
                break
            chosen.append(k)
            far = np.minimum(far, 2 - 2 * (x @ x[k]))
        out[width] = x[chosen]
    return out


def near_vectors(table: DataFrame, cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``table`` (vec_id, embedding).

    Two rows link if the cosine of their vectors, in double precision, is at least ``cosine`` (above -1). n_links
    counts the other rows linked with; component_id is the smallest vec_id reached over links; kept tells
    whether it is the row's own.

    Equal vectors are joined once and count as often as they come. Vectors of different widths never link. Vectors
    that are null, empty, zero or hold null or non-finite components link with nothing. A row without vec_id takes no
    part: n_links 0, component_id null, kept. Rows that repeat a vec_id count as one vector in components. Other
    columns are not read. An empty table gives no rows.
    """
    spark = table.sparkSession
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = (
        F.col("vec_id").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("embedding", lambda v: v != 0)
    )
    same = F.transform("embedding", lambda v: v + 0.0)  # -0.0 as 0.0
    key = F.struct(F.xxhash64(same).alias("h"), F.hash(same).alias("h2"))
    keyed = rows.filter(F.coalesce(sound, F.lit(False))).select("vec_id", "embedding", F.size("embedding").alias("width"), key.alias("key"))
    vectors = cut(keyed.groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"), F.first("width").alias("width")), "vectors")
    n = vectors.count()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    radius = float(np.sqrt(max(2 - 2 * cosine, 0)))
    assign = partial(_assign, shared=spark.sparkContext.broadcast(_pivots(vectors, n)), radius=radius)
    cells = cut(vectors.select("id", "copies", "embedding", "width").mapInArrow(lean(assign), "width int, cell int, own boolean, far double, id long, copies long, unit binary"), "cells")
    # No member of a cell is farther from its pivot than ``reach``, so a visitor from beyond reach + r links with none.
    cell = ["width", "cell"]
    reach = cut(cells.filter("own").groupBy(*cell).agg(F.max("far").alias("reach"), F.count("*").alias("n_own")), "reach")
    by_cell = F.broadcast if reach.count() <= BROADCAST_CELLS else lambda x: x
    near = cells.join(by_cell(reach), cell).filter(F.col("own") | (F.col("far") <= F.col("reach") + radius + 1e-6))
    sized = near.join(by_cell(near.groupBy(*cell).agg(F.count_if(~F.col("own")).alias("n_far"))), cell)
    # A unit (x, y) holds block x of a cell's own vectors, which the blocks of chunk y pass: own ones behind x, or visitors (y < 0).
    nb, nf = F.ceil(F.col("n_own") / BLOCK).cast("int"), F.ceil(F.col("n_far") / BLOCK).cast("int")
    b = F.pmod(F.xxhash64("id", F.lit(3)), F.greatest(F.when(F.col("own"), nb).otherwise(nf), F.lit(1))).cast("int")
    chunk = (b / PASSING).cast("int")
    none = F.array().cast("array<struct<x:int,y:int,part:int>>")
    unit = lambda x, y, part: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), part.cast("int").alias("part"))
    holds = F.transform(F.sequence(chunk, ((nb - 1) / PASSING).cast("int")), lambda y: unit(b, y, F.lit(-1)))
    meets = F.when(nf > 0, F.transform(F.sequence(F.lit(1), F.ceil(nf / PASSING).cast("int")), lambda y: unit(b, -y, F.lit(-1)))).otherwise(none)
    passes = F.when(b > 0, F.transform(F.sequence(F.lit(0), b - 1), lambda x: unit(x, chunk, b))).otherwise(none)
    visits = F.transform(F.sequence(F.lit(0), nb - 1), lambda x: unit(x, -chunk - 1, b))
    dealt = sized.select("width", "cell", "id", "copies", "unit", F.explode(F.when(F.col("own"), F.concat(holds, meets, passes)).otherwise(visits)).alias("u"))
    keys = ["width", "cell", "x", "y"]
    in_order = dealt.select("width", "cell", "u.x", "u.y", "u.part", "id", "copies", "unit").repartition(*keys).sortWithinPartitions(*keys, "part", "id")
    found = cut(in_order.mapInArrow(lean(partial(_join, cosine=cosine, passing=PASSING)), "id long, links long, to long"), "found")
    component = connected_components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    degree = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = vectors.select("key", "id", "copies").filter("copies > 1").join(degree, "id", "left").join(component, "id", "left")
    alone = vectors.filter("copies = 1").select("key", "id", "copies").join(degree, "id").join(component, "id")
    known = classes.unionByName(alone).select("key", F.col("copies") + F.coalesce("links", F.lit(0)) - 1, F.coalesce("component", "id")).toDF("key", "n_links", "component")
    out = rows.withColumn("key", F.when(F.coalesce(sound, F.lit(False)), key)).select("vec_id", "key").join(known, "key", "left")
    component_id = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
