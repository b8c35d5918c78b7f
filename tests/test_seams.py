"""Functions that no registered query reaches: approximate neighbours, samples, seams, optional columns, checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import features, graph, knn, model, scorers
from quillon.sources import tables
from tests.test_fixtures import COUNTS, ITEMS, TERMS


def test_approximate_neighbours_find_most_of_what_is_near(spark):
    """Recall against all pairs, on clusters of near vectors among others."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 12))
    x = np.concatenate([centres + 0.05 * r.normal(size=centres.shape) for _ in range(4)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = knn.lsh_neighbours(rows.toDF("q_id", "q_vec"), rows.toDF("i_id", "i_vec"), 0.3, bucket=0.8, tables=6).collect()
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    near = {(i, j) for i, j in zip(*np.nonzero(far <= 0.3 - 1e-9), strict=True)}
    found = {(p.q_id, p.i_id) for p in got}
    assert len(found & near) >= 0.9 * len(near) and all(far[i, j] <= 0.3 + 1e-9 for i, j in found)


def test_samples_keep_groups_whole_and_repeat(spark):
    df = spark.range(5000).selectExpr("id", "id % 500 as g")
    got = tables.whole_groups(df, "g", 0.3)
    sizes = {p.g: p["count"] for p in got.groupBy("g").count().collect()}
    assert set(sizes.values()) == {10} and 90 <= len(sizes) <= 210
    assert sorted(p.id for p in tables.whole_groups(df.repartition(7), "g", 0.3).collect()) == sorted(p.id for p in got.collect())


def test_numeric_columns_and_neutral_fill(spark):
    df = spark.createDataFrame([(1, "a", 1.5, True, None)], "id int, name string, x double, flag boolean, y long")
    assert features.numeric_features(df, ["id"]) == ["x", "flag", "y"] and features.numeric_features(df, ["id"], ("x",)) == ["flag", "y"]
    filled = features.fill_missing(df, ["x", "z"]).first()
    assert (filled.x, filled.z) == (1.5, 0.5)


def test_importances_name_the_telling_feature(spark):
    rows = spark.createDataFrame([(float(i % 7), float(i % 5), int(i % 7 > 3)) for i in range(300)], "a double, b double, y int")
    told = model.importances(model.fit_member(rows, ["a", "b"], "y", depth=2, rounds=3), ["a", "b"])
    assert told[0][0] == "a" and told[0][1] > 0.9 and len(told) == 2


def test_prompt_and_stand_in_enrichment(spark):
    df = spark.createDataFrame([("kadın ayakkabı", "x" * 500, None), ("bot", "t", "c")], "query string, title string, category string")
    empty = F.lit("")
    prompts = [p[0] for p in df.select(scorers.relevance_prompt(F.col("query"), F.col("title"), F.col("category"), empty, empty)).collect()]
    lines = prompts[0].split("\n")
    assert lines[0] == "query: kadın ayakkabı" and lines[1].startswith("title: xxx") and len(lines[1]) <= len("title: ") + 201 and "query: bot" in prompts[1]
    told = df.select(*(v.alias(k) for k, v in scorers.stand_in_enrichment(F.col("query")).items())).collect()
    assert [(p.gender, p.age_group) for p in told] == [("kadın", "unknown"), ("unknown", "unknown")]


def test_truncated_exports_are_errors(spark):
    tables.check_not_truncated(spark.range(7), limit=8)
    with pytest.raises(ValueError):
        tables.check_not_truncated(spark.range(8), limit=8)


def test_matrix_with_vectors_roots_and_told_labels(spark):
    """51 features for every pair, unknown keys at 0, and the optional columns."""
    items = spark.createDataFrame(ITEMS, tables.SCHEMAS["items"])
    terms = spark.createDataFrame(TERMS, tables.SCHEMAS["terms"])
    pairs = spark.createDataFrame([(t, i) for t, _ in TERMS for i, *_ in ITEMS] + [("T1", "no item"), ("no term", "I1")], "term_id string, item_id string")
    counts = spark.createDataFrame(COUNTS, "item_id string, item_clicks long, cat_mean_log double, brand_clicks long")
    unit = lambda *x: (np.array(x, float) / np.linalg.norm(x)).tolist()
    q = spark.createDataFrame([("T1", unit(1, 2, 2)), ("T2", unit(0, 0, 1))], "term_id string, vec array<double>")
    i = spark.createDataFrame([("I1", unit(2, 1, 2)), ("I2", unit(1, 0, 0))], "item_id string, vec array<double>")
    g = spark.createDataFrame([("I1", unit(0, 1, 0))], "item_id string, vec array<double>")
    roots = spark.createDataFrame([("ayakkabı", "ayak"), ("ayakkabi", "ayak")], "word string, root string")
    told = spark.createDataFrame([("T1", "kadın", None), ("T3", "erkek", "bebek")], "term_id string, told_gender string, told_age string")
    got = {(p.term_id, p.item_id): p for p in features.pair_matrix(pairs, terms, items, counts, q, i, g, short=2, roots=roots, told=told).collect()}
    assert len(got) == 18 and len(got["T1", "I1"]) == 2 + 51 + 3
    assert all(x is not None for p in got.values() for x in p)
    assert got["T1", "I1"].sim_title == pytest.approx(8 / 9) and got["T1", "I1"].sim_category == pytest.approx(2 / 3) and got["T1", "I3"].sim_title == 0
    assert got["T1", "I1"].sim_attr == pytest.approx(4 / 5)
    assert all(x == 0 for x in got["T1", "no item"][2:53]) and all(x == 0 for x in got["no term", "I1"][2:53])
    assert got["T3", "I1"].word_overlap_n == 0 and got["T3", "I1"].root_overlap_n == 1
    assert {k[1]: p.llm_gender_conflict for k, p in got.items() if k[0] == "T1"} == {"I1": 0, "I2": 1, "I3": 0, "I4": 0, "no item": 0}


def test_priors_by_hand(spark):
    pairs = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "term_id long, item_id long")
    items = spark.createDataFrame([(10, "red", "a"), (11, "", "b")], "item_id long, color string, l1 string")
    hist = spark.createDataFrame([(1, "color", "red", 0.7), (1, "color", "blue", 0.3), (1, "l1", "b", 0.2)], "term_id long, dim string, value string, p double")
    got = {(p.term_id, p.item_id): (p.c, p.l) for p in graph.value_priors(pairs, hist, items, {"c": "color", "l": "l1"}).collect()}
    assert got == {(1, 10): (0.7, 0.0), (1, 11): (0.0, 0.2), (2, 10): (0.0, 0.0)}


def test_small_limits_of_texts_and_draws(spark):
    from quillon.functions import text
    from quillon.operators import enrich, mining

    one = spark.createDataFrame([(1, "  ab\ncdef  ", "unknown"), (2, None, "x" * 300), (3, "", None)], "k int, a string, b string")
    made = one.select("k", text.labelled_text({"": F.col("a"), "b": F.col("b")}, limit=4).alias("t"), text.labelled_text({"b": F.col("b")}).alias("u"))
    assert {r.k: (r.t, len(r.u)) for r in made.collect()} == {1: ("ab c", 0), 2: ("b: xxxx", 203), 3: ("", 0)}

    items = spark.createDataFrame([(i, "red ring", "c", "b", "g", "y" * 9) for i in range(1, 8)], "item_id long, title string, category string, brand string, gender string, attributes string")
    terms = spark.createDataFrame([(1, "red ring"), (2, "blue")], "term_id long, query string")
    got = mining.lexical_candidates(terms, items, "title", per_token=2).collect()
    assert {r.term_id for r in got} == {1} and len(got) == 2  # both words draw the same items
    short = enrich.items_with_queries(items, terms, spark.createDataFrame([(1, 1)], "term_id long, item_id long"), clip=3).filter("item_id = 1").first().text
    assert short == "red ring | c | b | g | yyy | aranan: red ring"
    scored = spark.createDataFrame([(1, i, i / 10.0, 0) for i in range(1, 10)], "term_id long, item_id long, score double, is_positive int")
    assert sorted(r.item_id for r in mining.hard_negatives(scored, 0.5, 3).collect()) == [7, 8, 9]


def test_corrector_and_distilled_labels(spark):
    from quillon.operators import corrections

    rows = [(t, i, (t * 7 + i) % 2 == 0) for t in range(60) for i in range(20)]
    df = spark.createDataFrame(rows, "term_id long, item_id long, truth boolean")
    noisy = (F.col("term_id") * 20 + F.col("item_id")) % 97 == 5
    df = df.withColumn("y", F.when(noisy, ~F.col("truth")).otherwise(F.col("truth"))).withColumn("label", F.col("truth").cast("int"))
    df = df.withColumn("cos", F.when(F.col("truth"), 0.7).otherwise(0.6)).withColumn("recall", F.when(F.col("truth"), 0.6).otherwise(0.2))
    df = df.withColumns({"contain": F.lit(False), "catw": F.lit(0.25), "brandw": F.lit(0.1), "top1": F.lit(0.1), "tts": F.lit(0.0)})
    df = df.withColumns({"query": F.lit("abcd"), "title": F.concat(F.lit("xyz "), "item_id"), "title_key": F.concat(F.lit("xyz "), "item_id"), "item_text": F.lit("zzz"), "query_brands": F.array().cast("array<string>")})
    fitted, area = model.fit_corrector(df, ["cos", "recall"], "label", "term_id")
    assert area == 1.0
    got = corrections.correct_by_models(df, fitted, ["cos", "recall"]).collect()
    wrong = [r for r in got if (r.term_id * 20 + r.item_id) % 97 == 5]
    assert len(got) == 1200 and wrong and all(r.y == r.truth for r in got) and all((r.changed_by == "T8") == (r in wrong) for r in got)
    kept = tables.share_of_rows(df, ["term_id", "item_id"], 300).count()
    assert 220 < kept < 380 and tables.share_of_rows(df, ["term_id", "item_id"], 1200).count() == 1200
    with pytest.raises(ValueError):
        corrections.correct_by_models(df.withColumn("prediction", F.lit(1)), fitted, ["cos", "recall"])


def test_the_second_model_learns_from_every_row(spark, monkeypatch):
    """Also where the table is said to have three million rows."""
    from quillon.operators import corrections

    df = spark.createDataFrame([(t, i, (t + i) % 2 == 0) for t in range(30) for i in range(10)], "term_id long, item_id long, y boolean")
    df = df.withColumn("cos", F.when(F.col("y"), 0.7).otherwise(0.6)).withColumn("label", F.col("y").cast("int"))
    df = df.withColumns({"recall": F.lit(0.6), "contain": F.lit(False), "catw": F.lit(0.25), "brandw": F.lit(0.1), "top1": F.lit(0.1), "tts": F.lit(0.0)})
    df = df.withColumns({"query": F.lit("abcd"), "title": F.lit("xyz"), "title_key": F.lit("xyz"), "item_text": F.lit("zzz"), "query_brands": F.array().cast("array<string>")})
    fitted, _ = model.fit_corrector(df, ["cos", "recall"], "label", "term_id", rounds=1, judged=False)
    seen, fit = [], model.fit_member
    monkeypatch.setattr(corrections, "fit_member", lambda rows, *a, **b: seen.append(rows.agg(F.count("*")).first()[0]) or fit(rows, *a, **b | {"rounds": 1}))
    monkeypatch.setattr(type(df), "count", lambda self: 3_000_000)
    assert len(corrections.correct_by_models(df, fitted, ["cos", "recall"]).collect()) == 300 and seen == [300]


def test_one_class_is_learned(spark):
    df = spark.createDataFrame([(k, 1) for k in range(20)], "x long, label int")
    assert min(r.p for r in model.predict(model.fit_member(df, ["x"], "label", rounds=2), df, ["x"], "p").collect()) > 0.5
