"""Vector operators against brute force, on small cells, blocks, shards and leaves too."""

import numpy as np
import pytest

from quillon.llm import balltree, range_join

SCHEMA = "vec_id long, embedding array<double>, label int, links int"


def vectors(seed, n=260, width=12):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, width))
    for k in range(0, n, 20):  # near copies of every tenth
        x[k : k + 5] = x[k] + 0.12 * r.normal(size=(5, width))
    x[100:160] = x[100]  # one vector holds a large share
    rows = [(int(i), v.tolist()) for i, v in zip(r.permutation(n), x, strict=True)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * width), (1003, [float("nan")] + [1.0] * (width - 1)), (1004, [float("inf")] * width), (1005, [None] + [1.0] * (width - 1)), (1006, [1.0, 2.0]), (1009, [1.0, 2.0]), (1010, [2.0, -1.0]), (1020, [2.0, 4.1]), (1030, [3.0]), (1040, [2.0]), (1050, [2.0, 3.0, 4.0]), (None, [1.0] * width), (1007, [-0.0, *([1.0] * (width - 1))]), (1008, [0.0, *([2.0] * (width - 1))])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA)


def sound(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("small", [False, True])
def test_range_join(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(range_join, "CELL", 20)
        monkeypatch.setattr(range_join, "BLOCK", 9)
        monkeypatch.setattr(range_join, "PASSING", 2)
    rows = vectors(3)
    got = range_join.near_vectors(frame(spark, rows), 0.9).collect()
    own = [(i, np.array(v)) for i, v in rows if i is not None and sound(v) and any(v)]
    ids = np.array([i for i, _ in own])
    u = [v / np.linalg.norm(v) for _, v in own]
    linked = np.array([[len(a) == len(b) and a @ b >= 0.9 for b in u] for a in u])
    np.fill_diagonal(linked, False)
    component = ids.copy()
    while (lower := np.minimum(component, np.where(linked, component[None], ids.max()).min(axis=1))).tolist() != component.tolist():
        component = lower
    expected = {i: (0, i, True) for i, _ in rows if i is not None}
    expected |= {int(i): (int(n), int(c), bool(i == c)) for i, n, c in zip(ids, linked.sum(axis=1), component, strict=True)}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == expected
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]


def test_range_join_of_nothing(spark):
    assert range_join.near_vectors(frame(spark, []), 0.9).collect() == []
    assert [tuple(r) for r in range_join.near_vectors(frame(spark, [(1, None)]), 0.9).collect()] == [(1, 0, 1, True)]
    assert sorted((r.vec_id, r.n_links) for r in range_join.near_vectors(frame(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0])]), 0.9).collect()) == [(1, 1), (1, 1)]


def best(rows, k, every):
    own = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and sound(v)]
    out = []
    for i, q in own:
        if i % every == 0:
            ranked = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in own if j != i and len(v) == len(q))[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize(("shard", "block"), [(16384, 4096), (50, 3)])
def test_top_k(spark, monkeypatch, shard, block):
    monkeypatch.setattr(balltree, "SHARD", shard)
    monkeypatch.setattr(balltree, "CELL", 2 * shard)
    monkeypatch.setattr(balltree, "QUERIES", block)
    from pyspark.sql import functions as F

    rows = vectors(8)
    got = balltree.top_k(frame(spark, rows), F.col("vec_id") % 10 == 0, k=5).collect()
    assert sorted(tuple(r) for r in got) == best(rows, 5, 10)
    few = rows[:3]
    assert sorted(tuple(r) for r in balltree.top_k(frame(spark, few), F.lit(True), k=5).collect()) == best(few, 5, 1)
    assert balltree.top_k(frame(spark, []), F.lit(True)).collect() == []


@pytest.mark.parametrize("shard", [16384, 50])
def test_top_k_of_repeated_query_rows(spark, monkeypatch, shard):
    monkeypatch.setattr(balltree, "SHARD", shard)
    monkeypatch.setattr(balltree, "CELL", shard)
    from pyspark.sql import functions as F

    rows = vectors(8)
    again = [r for r in rows if r[0] is not None and r[0] % 30 == 0 and sound(r[1])]
    rows = [*rows, *again, *again[:2], (again[3][0], rows[1][1]), (again[3][0], rows[1][1])]
    got = balltree.top_k(frame(spark, rows), F.col("vec_id") % 10 == 0, k=5).collect()
    assert sorted(tuple(r) for r in got) == best(rows, 5, 10)
    few = [*rows[:3], rows[0], rows[0]]
    assert sorted(tuple(r) for r in balltree.top_k(frame(spark, few), F.lit(True), k=5).collect()) == best(few, 5, 1)


@pytest.mark.parametrize("leaf", [2, 8, 300])
def test_ball_tree_prunes_nothing_that_counts(monkeypatch, leaf):
    monkeypatch.setattr(balltree, "LEAF", leaf)
    r = np.random.default_rng(leaf)
    x = np.floor(256 * r.normal(size=(240, 6)) * np.where(r.random((240, 1)) < 0.2, 4, 1)).astype(np.int64)
    x[50:130] = x[50]
    ids = r.permutation(240)
    tree = balltree.BallTree(x, ids)
    q, own = x[::7], ids[::7]
    for least in (np.full(len(q), -np.inf), np.full(len(q), 40_000.0)):
        i, found, score = balltree.search(tree, q, own, least, 5)
        for k in range(len(q)):
            expected = sorted((-int(x[j] @ q[k]), int(ids[j])) for j in range(240) if ids[j] != own[k])[:5]
            assert sorted((-int(s), int(f)) for s, f in zip(score[i == k], found[i == k], strict=True)) == [e for e in expected if -e[0] >= least[k]]


def test_top_k_against_its_sql_with_repeated_ids(spark, tmp_path):
    """The registered SQL and the operator hold to one law: each query row has ranks of its own."""
    import duckdb
    from pyspark.sql import functions as F

    from quillon.llm import oracle

    rows = [(i, v) for i, v in vectors(8) if i is None or i < 1000]
    rows = [*rows, *[(0, rows[k][1]) for k in (1, 1, 2)], *[(50, rows[k][1]) for k in (3, 3)], (100, [1.0, 2.0]), (7, [1.0, 3.0])]
    frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    expected = sorted(tuple(map(int, r)) for r in con.sql(oracle.top_sql(50, 5, 256)).fetchall())
    got = balltree.top_k(spark.read.parquet(str(tmp_path / "e")), F.col("vec_id") % 50 == 0, k=5).collect()
    assert sorted(tuple(r) for r in got) == expected and len([r for r in got if r.query_id == 0]) == 20


def test_scores_beyond_long_are_an_error(spark):
    from pyspark.sql import functions as F

    with pytest.raises(ValueError):
        balltree.top_k(frame(spark, [(1, [1e9, 1.0]), (2, [1e9, 2.0])]), F.lit(True)).collect()
