"""Neighbours of rows that share vectors."""

import math

from quillon.operators import knn

VECTORS = [(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [math.nan, 1.0])]


def listed(df):
    return sorted((r.q_id, r["rank"], r.i_id, r.sim) for r in df.collect())


def test_shared_vectors_are_met_once(spark, monkeypatch):
    vectors = spark.createDataFrame(VECTORS, "vec_id long, vec array<double>")
    rows = spark.createDataFrame([(k, k % 6 if k % 6 < 5 else None) for k in range(60)], "id long, vec_id long")
    items = rows.filter("id % 4 <> 1")
    whole = lambda df: df.join(vectors, "vec_id").select("id", "vec")
    met = []
    plain = knn.knn
    monkeypatch.setattr(knn, "knn", lambda q, i, *a, **b: met.append((q.count(), i.count())) or plain(q, i, *a, **b))
    for k in (1, 7, 100):
        for own in (True, False):
            met.clear()
            got = listed(knn.shared_knn(rows.toDF("q_id", "vec_id"), items.toDF("i_id", "vec_id"), vectors, k, exclude_self=own))
            assert met == [(5, 5)]
            assert got == listed(plain(whole(rows).toDF("q_id", "q_vec"), whole(items).toDF("i_id", "i_vec"), k, exclude_self=own))
            assert len({q for q, *_ in got}) == 40  # all but those without a vector or a number


def test_blocks_and_strips_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 16)
    rows = spark.createDataFrame([(k, [math.cos(k), math.sin(k)]) for k in range(100)], "id long, vec array<double>")
    got = listed(knn.knn(rows.toDF("q_id", "q_vec"), rows.toDF("i_id", "i_vec"), 5, exclude_self=True))
    want = [(q, at + 1, i) for q in range(100) for at, (_, i) in enumerate(sorted((-round(math.cos(q - i), 9), i) for i in range(100) if i != q)[:5])]
    assert [x[:3] for x in got] == want


def test_pairs_read_the_orders_once(spark, sf):
    from quillon.plans import bindings as b

    pairs = b.pairs(spark, sf)
    assert pairs._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2

def test_synonyms_read_clicks_once(spark, monkeypatch):
    from quillon.operators import mining

    names = []
    plain = mining.written
    monkeypatch.setattr(mining, "written", lambda df, name: names.append(name) or plain(df, name))
    terms = spark.createDataFrame([(1, "red ring"), (2, "red gear"), (3, "hot ring")], "term_id long, query string")
    near = spark.createDataFrame([(1, 2, 0.95), (2, 1, 0.95), (1, 3, 0.95), (3, 1, 0.95)], "q_id long, i_id long, sim double")
    clicks = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "term_id long, item_id long")
    got = mining.mine_synonyms(near, terms, clicks, support=1).collect()
    assert [(r.tok_a, r.tok_b, r.support) for r in got] == [("gear", "ring", 2)]  # 1 and 3 share no item
    assert names == ["differing", "differing-clicks"]


def test_clickers_meet_by_number(spark, monkeypatch):
    from quillon.operators import graph

    vectors = spark.createDataFrame(VECTORS[:4] + [(-1, [0.0, -1.0])], "vec_id long, vec array<double>")
    places = spark.createDataFrame([(t, t % 5 - 1) for t in range(30)] + [(30, 99), (31, None)], "term_id long, vec_id long")
    clicks = spark.createDataFrame([(t, i) for t in range(32) for i in range(6) if (t * 7 + i) % 3 == 0 and i], "term_id long, item_id long")
    pairs = spark.createDataFrame([(t, i, t + i) for t in range(33) for i in range(8)] + [(1, None, 0), (1, 2, 5)], "term_id long, item_id long, more long")
    whole = places.join(vectors, "vec_id").select("term_id", "vec")
    row = lambda df: sorted((r.term_id, -9 if r.item_id is None else r.item_id, r.more, round(r.item_breadth, 9), round(r.item_maxsim, 9)) for r in df.collect())
    for most in (3, 50):
        for own in (True, False):
            want = row(graph.clicked_by(pairs, clicks, whole, own, most))
            assert row(graph.clicked_by_shared(pairs, clicks, places, vectors, own, most)) == want
            assert any(x[-2] for x in want) and not all(x[-2] for x in want)
    monkeypatch.setattr(knn, "HELD_VECTORS", 0)
    assert row(graph.clicked_by_shared(pairs, clicks, places, vectors, True)) == row(graph.clicked_by(pairs, clicks, whole, True))


def test_all_clickers_count(spark, monkeypatch):
    """An item of 400 clickers, who share 40 vectors, and items of few, against the products themselves."""
    import numpy as np

    from quillon.operators import graph

    matrix = np.random.default_rng(5).normal(size=(40, 4)).round(3)
    place = {t: 39 if t == 7 else t % 39 for t in range(400)}  # no other term has that of 7
    clicks = sorted({(t, 0) for t in range(400)} | {(t, 1) for t in range(0, 400, 5)} | {(3, 2)})
    asked = [(t, i) for t in range(0, 400) for i in range(4)]

    def want(own):
        out = []
        for t, i in asked:
            who = [place[o] for o, x in clicks if x == i and not (own and o == t)]
            out.append((t, i, round(float(np.log1p(len(who))), 9), round(float((matrix[who] @ matrix[place[t]]).max()), 9) if who else 0.0))
        return out

    row = lambda df: sorted((r.term_id, r.item_id, round(r.item_breadth, 9), round(r.item_maxsim, 9)) for r in df.collect())
    vectors = spark.createDataFrame([(k, v) for k, v in enumerate(matrix.tolist())], "vec_id long, vec array<double>")
    places = spark.createDataFrame(sorted(place.items()), "term_id long, vec_id long")
    pairs, clicked = spark.createDataFrame(asked, "term_id long, item_id long"), spark.createDataFrame(clicks, "term_id long, item_id long")
    monkeypatch.setattr(knn, "CHUNK", 150)
    monkeypatch.setattr(knn, "BLOCK", 16)
    for own in (True, False):
        told = want(own)
        assert row(graph.clicked_by_shared(pairs, clicked, places, vectors, own)) == told and max(x[2] for x in told) > 5.9
        assert row(graph.clicked_by(pairs, clicked, places.join(vectors, "vec_id").select("term_id", "vec"), own)) == told


def test_terms_of_the_same_neighbours_are_summed_once(spark):
    from quillon.operators import graph

    near = spark.createDataFrame([(t, i, 0.5, at + 1) for t in range(10, 30) for at, i in enumerate((1, 2))], "q_id long, i_id long, sim double, rank int")
    assert {r.profile for r in graph.profiles(near).collect()} == {10}
    clicks = spark.createDataFrame([(1, 100), (1, 101), (2, 100)], "term_id long, item_id long")
    items = spark.createDataFrame([(100, "a", ""), (101, None, "x")], "item_id long, leaf string, side string")
    got = {(r.term_id, r.dim, r.value): r.p for r in graph.histograms(near, clicks, items, {"leaf": "leaf", "side": "side"}).collect()}
    assert got == {(t, d, v): p for t in range(10, 30) for d, v, p in [("leaf", "a", 2 / 3), ("leaf", None, 1 / 3), ("side", "x", 1 / 3)]}
