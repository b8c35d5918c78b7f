"""Every registered query of the reference tables against its SQL, or its invariants where there is none."""

from functools import partial

import duckdb
import pytest

from quillon.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cell(x):
    return (x is None, round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else int(x) if isinstance(x, bool) else x)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(tuple(cell(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, duck, sf, name):
    df, sql = registry.QUERIES[name](spark, sf), duck.sql(registry.SQL[name])
    assert table(df.columns, df.collect()) == table(sql.columns, sql.fetchall())


def test_all_are_covered():
    assert set(registry.QUERIES) - set(registry.SQL) == {"expanded_match", "typo_correction", "mined_negatives", "balanced_folds", "ensemble_scores", "correction_chain_models"}


def test_mined_negatives(spark, sf):
    from quillon.operators import mining
    from quillon.plans import bindings as b

    got = registry.QUERIES["mined_negatives"](spark, sf).collect()
    clicks = {(r.term_id, r.item_id) for r in b.clicks(spark, sf).collect()}
    quota = {r.term_id: r for r in mining.quotas(b.clicks(spark, sf)).collect()}
    assert len({(r.term_id, r.item_id) for r in got}) == len(got) and not {(r.term_id, r.item_id) for r in got} & clicks
    per = {}
    for r in got:
        per[r.term_id, r.neg_source] = per.get((r.term_id, r.neg_source), 0) + 1
    assert all(n <= quota[t][s] for (t, s), n in per.items() if s != "popularity_random")
    assert all(sum(n for (t, _), n in per.items() if t == k) <= q.quota for k, q in quota.items())


def test_mined_negatives_come_from_all_sources(spark, sf, monkeypatch):
    from quillon.operators import mining
    from quillon.plans import bindings as b

    monkeypatch.setattr(mining, "quotas", partial(mining.quotas, rare=10_000))  # no term of the tables is rare
    got = registry.QUERIES["mined_negatives"](spark, sf).collect()
    assert {r.neg_source for r in got} == {"dense_ann", "lexical", "category_sibling", "llm_guided", "popularity_random"}
    full = {r.term_id: r.quota for r in mining.quotas(b.clicks(spark, sf)).collect()}
    n = b.items(spark, sf).count()
    assert len(got) > 0.9 * sum(min(q, n) for q in full.values())


def test_draws_reach_the_whole_catalog_by_weight(spark):
    from quillon.operators import mining

    items = spark.range(1, 1201).toDF("item_id")
    clicks = spark.range(0, 3000).selectExpr("1000 + id as term_id", "1 + id % 6 as item_id")
    ranks = [r["rank"] for r in mining.numbered(items, clicks, buckets=7).collect()]
    assert sorted(ranks) == list(range(1, 1201))
    quota = spark.range(1, 301).selectExpr("id as term_id", "40 as quota")
    none = clicks.limit(0)
    got = mining.catalog_draws(quota, items, clicks, none).collect()
    assert len({(r.term_id, r.item_id) for r in got}) == len(got) and {r.item_id for r in got} == set(range(1, 1201))
    head = [r for r in got if r.order <= 41]
    heavy = sum(r.item_id <= 6 for r in head) / len(head)
    assert 2 * 6 / 1200 < heavy < 0.5 and len(head) > 0.9 * 300 * 40


def test_correction_chains_share_their_first_stages(spark, sf):
    short = {(r.term_id, r.item_id): r for r in registry.QUERIES["correction_chain"](spark, sf).collect()}
    full = {(r.term_id, r.item_id): r for r in registry.QUERIES["correction_chain_full"](spark, sf).collect()}
    assert short.keys() == full.keys()
    late = {"T6a", "T6b", "T8", "T9"}
    assert all(full[k].changed_by in late or (full[k].y, full[k].changed_by) == (short[k].y, short[k].changed_by) for k in short)
    assert {r.changed_by for r in full.values()} & late


def test_correction_by_models(spark, sf):
    from quillon.plans import bindings as b

    got = registry.QUERIES["correction_chain_models"](spark, sf).collect()
    assert sorted((r.term_id, r.item_id) for r in got) == sorted((r.term_id, r.item_id) for r in b.pairs(spark, sf).collect())
    assert {r.changed_by for r in got} <= {None, "T1", "T2a", "T2b", "T3a", "T3b", "T4a", "T4b", "T4c", "T4d", "T6a", "T6b", "T8", "T9"} and len({r.changed_by for r in got}) > 2
