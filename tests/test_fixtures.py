"""Toy catalog and scalar cases."""

import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import attrs, text, vocab
from quillon.operators import corrections, features, knn, metrics, mining, model, popularity, rules, scorers, sets, typo, windows
from quillon.sources import tables

ITEMS = [
    ("I1", "Kadın Spor Ayakkabı Beyaz", "ayakkabı/spor ayakkabı/sneaker", "Beyaz Milla", "kadın", "yetiskin", "renk: beyaz, materyal: pamuklu"),
    ("I2", "Erkek Kot Pantolon Mavi", "giyim/pantolon/kot pantolon", "Mavi Kot Evi", "erkek", "yetiskin", "renk: mavi, materyal: kot"),
    ("I3", "Multivitamin 60 Tablet", "süpermarket/sağlık/vitamin", "Solgar", "unknown", "unknown", None),
    ("I4", "Nike Air Force Sneaker Beyaz", "ayakkabı/spor ayakkabı/sneaker", "Nike", "unisex", "yetiskin", "renk: beyaz"),
]
TERMS = [("T1", "kadın ayakkabı"), ("T2", "multi vitamin"), ("T3", "nike ayakkabi"), ("T4", "erkek kadın ayakkabı")]
COUNTS = [("I1", 5, 1.0, 5), ("I2", 2, 0.5, 2), ("I3", 0, 0.0, 0), ("I4", 10, 1.0, 10)]


@pytest.fixture(scope="module")
def matrix(spark):
    items = spark.createDataFrame(ITEMS, tables.SCHEMAS["items"])
    terms = spark.createDataFrame(TERMS, tables.SCHEMAS["terms"])
    pairs = spark.createDataFrame([(t, i) for t, _ in TERMS for i, *_ in ITEMS], "term_id string, item_id string")
    counts = spark.createDataFrame(COUNTS, "item_id string, item_clicks long, cat_mean_log double, brand_clicks long")
    got = features.pair_features(pairs, terms, items, counts, least_brand_items=1).collect()
    return {(r.term_id, r.item_id): r for r in got}


def test_toy_catalog(matrix):
    assert len(matrix) == 16 and all(v is not None for r in matrix.values() for v in r)
    assert matrix["T2", "I3"].expanded_overlap_n > matrix["T2", "I3"].word_overlap_n >= 0
    assert matrix["T1", "I1"].cat_word_overlap_n > 0
    assert matrix["T1", "I2"].gender_contradiction == 1 and matrix["T1", "I1"].gender_contradiction == 0
    assert matrix["T3", "I4"].brand_contradiction == 0 and matrix["T3", "I1"].brand_contradiction == 1
    assert matrix["T3", "I1"].word_overlap_n == 0
    assert math.isclose(matrix["T1", "I1"].item_click_log, math.log(6))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("made", "expected"),
    [
        (lambda: text.tokenize(F.lit("Kadın Ayakkabı")), ["kadın", "ayakkabı"]),
        (lambda: text.tokenize(F.lit("İstanbul")), ["istanbul"]),
        (lambda: text.normalize(F.lit("IŞIK i̇")), "ışık i"),
        (lambda: text.normalize(F.lit(None).cast("string")), ""),
        (lambda: text.stem(F.lit("kitaplar")), "kitap"),
        (lambda: text.stem(F.lit("eve")), "eve"),
        (lambda: text.category_levels(F.lit("a/b/c")), ["a", "b", "c"]),
        (lambda: text.category_levels(F.lit(None).cast("string")), []),
        (lambda: text.char_ngrams(F.lit("ab")), ["ab"]),
        (lambda: text.char_ngrams(F.lit("")), []),
        (lambda: text.deasciify(F.lit("KIRMIZI ŞAPKA çığ")), "kirmizi sapka cig"),
        (lambda: text.expanded_match(F.array(F.lit("multi"), F.lit("vitamin")), F.array(F.lit("multivitamin"))), 2),
        (lambda: text.expanded_match(F.array(F.lit("ayakkabi"), F.lit("kitaplar")), F.array(F.lit("sneaker"), F.lit("kitaplik"))), 2),
        (lambda: text.stem_match(F.lit("abc"), F.lit("abcd")), False),
        (lambda: text.json_block(F.lit('so {"a": 1} ok'), "a int").a, 1),
        (lambda: text.json_block(F.lit("{broken"), "a int"), None),
        (lambda: F.sort_array(attrs.sizes(F.lit("XL ve 2xl, m beden 42"))), ["m", "n42", "xl", "xxl"]),
        (lambda: attrs.sizes(F.lit("m 42")), []),
        (lambda: attrs.has_collocation(F.lit("Beyaz Eşya seti")), True),
        (lambda: attrs.attribute_words(F.lit("renk: beyaz, mavi <b>gri</b>, materyal: kot"), vocab.COLOR_KEYS, vocab.COLORS), ["beyaz", "mavi", "gri"]),
        (lambda: scorers.answer_probability(F.lit('{"relevant": false, "confidence": 0.9}'), F.lit(0.4)), pytest.approx(0.1)),
        (lambda: scorers.answer_probability(F.lit("no"), F.lit(0.4)), 0.4),
        (lambda: mining.close_spelling(F.lit("kirmizi"), F.lit("kirmzi")), True),
    ],
)
def test_scalars(spark, made, expected):
    assert one(spark, made()) == expected


@pytest.mark.parametrize(("wanted", "item", "expected"), [("kadın", "erkek", 1), ("kadın", "kadın", 0), ("kadın", "unisex", 0), ("kadın", "unknown", 0), ("unisex", "erkek", 0), (None, "erkek", 0)])
def test_gender(spark, wanted, item, expected):
    assert one(spark, attrs.gender_contradiction(F.lit(wanted).cast("string"), F.lit(item))) == expected


@pytest.mark.parametrize(("wanted", "item", "expected"), [("bebek", "bebek_cocuk", 0), ("yetiskin", "bebek_cocuk", 1), ("cocuk", "yetiskin", 1), ("cocuk", "unknown", 0), (None, "cocuk", 0)])
def test_age(spark, wanted, item, expected):
    assert one(spark, attrs.age_contradiction(F.lit(wanted).cast("string"), F.lit(item))) == expected


def test_probabilities_of_two_tokens(spark):
    schema = "tokens array<struct<token string, logprob double>>, greedy string"
    rows = [([("▁1", -0.1), ("Ġ0", -0.1)], ""), ([("1", -1.0)], ""), ([("0", -1.0)], ""), ([], "1"), ([], " 0"), ([], None)]
    got = spark.createDataFrame(rows, schema).select(scorers.two_token_probability(F.col("tokens"), F.col("greedy")).alias("p")).collect()
    assert [round(r.p, 6) for r in got] == [0.5, 0.98, 0.02, 0.98, 0.02, 0.5]


def test_popularity_without_leaks(spark):
    items = spark.createDataFrame([(f"I{k}", "c", "b") for k in range(1, 5)], "item_id string, category string, brand string")
    clicks = spark.createDataFrame([("A", "I1"), ("A", "I2"), ("B", "I1"), ("B", "I3")], "term_id string, item_id string")
    fold = lambda *t: {r.item_id: r.item_clicks for r in popularity.fold_popularity(items, clicks, spark.createDataFrame([(x,) for x in t], "term_id string")).collect()}
    assert fold("A") == {"I1": 1, "I2": 1, "I3": 0, "I4": 0} and fold("A", "B")["I1"] == 2
    log = popularity.popularity_features(F.lit(3), F.lit(0.0), F.lit(3), F.lit(1))[0]
    assert math.isclose(one(spark, log), math.log(3))


def test_rules_in_order(spark):
    row = lambda q, t, c="", g="": one(spark, rules.reason(*map(F.lit, (q, t, c, g))))
    assert row("uzun kol kışlık", "kolsuz yazlık") == "kol_boyu"
    assert row("3. sınıf", "3.sınıf, 4.sınıf", "kitap") is None and row("5. sınıf", "3.sınıf, 4.sınıf", "kitap") == "sinif"
    assert row("10w-40 yağ", "5w-30 yağ") is None and row("60 watt", "100w ampul") == "watt"
    assert row("çift kişilik", "tek kişilik") == "kisilik" and row("iphone 13", "kılıf") is None


def test_typo(spark):
    known = typo.vocabulary(spark.createDataFrame([("kırmızı kırmızı siyah nike",)], "t string"), "t")
    asked = spark.createDataFrame([("kirmizi",), ("siyahh",), ("nike",), ("zzzzzz",)], "word string")
    assert {r.word: r.corrected for r in typo.correct(asked, known).collect()} == {"kirmizi": "kırmızı", "siyahh": "siyah", "nike": "nike", "zzzzzz": "zzzzzz"}


def test_ties_and_empty_groups(spark):
    df = spark.createDataFrame([("g", 1, 5.0), ("g", 2, 5.0), ("g", 3, 1.0), ("h", 4, 0.0)], "g string, id int, v double")
    assert [(r.g, r.id) for r in windows.top_k(df, ["g"], [F.desc("v"), F.col("id")], 1).orderBy("g").collect()] == [("g", 1), ("h", 4)]
    got = {r.id: r for r in windows.group_features(df, "g", ["v"], "v").collect()}
    assert got[1].v_pct == got[2].v_pct == pytest.approx(2.5 / 3) and got[4].v_z == 0 and got[4].v_pct == 1
    assert metrics.auc(df.withColumn("y", F.lit(0)), "y", "v").first().auc is None
    assert knn.knn(df.limit(0).selectExpr("id as q_id", "array(v) as q_vec"), df.limit(0).selectExpr("id as i_id", "array(v) as i_vec"), 3).count() == 0


def test_thresholds_against_brute_force(spark):
    rows = [(int((k * 7919) % 10 < 3), ((k * 104729) % 50) / 50) for k in range(500)]
    df = spark.createDataFrame(rows, "y int, p double")

    def f1(t):
        tp = sum(y and p >= t for y, p in rows)
        fp, fn = sum(not y and p >= t for y, p in rows), sum(y and p < t for y, p in rows)
        tn = len(rows) - tp - fp - fn
        return (2 * tp / max(2 * tp + fp + fn, 1) + 2 * tn / max(2 * tn + fp + fn, 1)) / 2

    best = metrics.best_threshold(df, "y", "p").first()
    assert best.macro_f1 == pytest.approx(max(f1(t) for _, t in rows)) and f1(best.threshold) == pytest.approx(best.macro_f1)
    assert metrics.best_threshold(df.withColumn("y", F.lit(0)), "y", "p").first().macro_f1 >= 0


def test_first_source_wins(spark):
    a = spark.createDataFrame([(1, "a"), (2, "a")], "id int, source string")
    b = spark.createDataFrame([(2, "b"), (3, "b")], "id int, source string")
    assert sorted(map(tuple, sets.union_first([a, b], ["id"]).collect())) == [(1, "a"), (2, "a"), (3, "b")]
    assert sets.same_ids(a, a, "id") and not sets.same_ids(a, b, "id")


def test_folds_hold_whole_terms(spark):
    rows = spark.createDataFrame([(t, k) for t in range(40) for k in range(1 + t % 5)], "term_id int, k int")
    got = rows.join(model.balanced_folds(rows, "term_id"), "term_id").groupBy("fold").agg(F.count("*").alias("n"), F.collect_set("term_id").alias("t")).collect()
    assert len(got) == 5 and sum(len(r.t) for r in got) == 40 and max(r.n for r in got) - min(r.n for r in got) <= 5


def test_sources(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(10).withColumn("s", F.col("id") * 2)
    assert tables.read_optional(spark, path) is None
    assert tables.write_resumable(df.filter("id < 4"), path, "id") == 0 and tables.write_resumable(df, path, "id") == 4
    assert spark.read.parquet(path).count() == 10
    swap = str(tmp_path / "s")
    df.write.parquet(swap)
    tables.write_swapped(spark.read.parquet(swap).filter("id < 3"), swap)
    assert spark.read.parquet(swap).count() == 3
    tables.restore_backup(spark, swap)
    assert spark.read.parquet(swap).count() == 10 and tables.read_first(spark, [path + "x", swap]).count() == 10
    tables.write_json(spark, {"a": [1, 2]}, str(tmp_path / "j"))
    assert tables.read_json(spark, str(tmp_path / "j")) == {"a": [1, 2]}
    terms = spark.createDataFrame([("T1", 'a, "b"'), ("T2", "c")], tables.SCHEMAS["terms"])
    tables.write_csv(terms, str(tmp_path / "c"))
    assert tables.read_csv(spark, str(tmp_path / "c"), "terms").orderBy("term_id").first().query == 'a, "b"'
    tables.check_output(df, df, "id")
    with pytest.raises(ValueError):
        tables.check_output(df.limit(3), df, "id")


def test_scorer_seam(spark):
    df = spark.createDataFrame([(k, "x" * k) for k in range(20)], "id int, prompt string")
    got = scorers.score_with(df, lambda: lambda prompts: [float(len(p)) for p in prompts], "prompt", "score", size=7).collect()
    assert all(r.score == r.id for r in got)


def test_ensemble(spark):
    rows = [(t, int((t * 7 + k) % 10 < 3), ((t * 7 + k) % 10) / 10, ((t * 3 + k * 5) % 10) / 10) for t in range(40) for k in range(10)]
    df = spark.createDataFrame(rows, "term_id int, y int, a double, b double").withColumn("a", 1 - F.col("a"))
    got = model.choose_ensemble(df, ["a", "b"], "y", "term_id")
    assert got["method"] in ("blend", "stack") and got["held_out"] > 0.9


def chain_row(**k):
    base = {"term_id": 1, "item_id": 1, "y": False, "cos": 0.6, "recall": 0.5, "contain": False, "catw": 0.1, "brandw": 0.1, "top1": 0.5, "tts": 0.0, "query": "mavi kot", "title": "uzun elbise", "title_key": "uzun elbise", "item_text": "uzun elbise giyim", "query_brands": []}
    return base | k


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([chain_row(y=True, cos=0.4, recall=0.0, catw=0.0), chain_row(item_id=2, y=True, title_key="b")], {1: (False, "T1"), 2: (True, None)}),
        ([chain_row(y=True, cos=0.4, recall=0.0, catw=0.0, title="mavi kot x"), chain_row(item_id=2, y=True, title_key="b")], {1: (True, None), 2: (True, None)}),
        ([chain_row(cos=0.8, contain=True, catw=0.4), chain_row(item_id=2, y=True, title_key="b")], {1: (True, "T1"), 2: (True, None)}),
        ([chain_row(cos=0.8, contain=True, catw=0.4, query="mavi 42", item_text="mavi 40"), chain_row(item_id=2, y=True, title_key="b")], {1: (False, None), 2: (True, None)}),
        ([chain_row(item_id=k, cos=0.65 + k / 100, catw=0.2, title_key=str(k)) for k in (1, 2, 3)], {1: (False, None), 2: (True, "T2b"), 3: (True, "T2b")}),
        ([chain_row(tts=0.9, query_brands=["nike"]), chain_row(item_id=2, y=True, title_key="b")], {1: (False, None), 2: (True, None)}),
        ([chain_row(y=True, cos=0.5), chain_row(item_id=2, cos=0.55)], {1: (False, "T3b"), 2: (True, "T3b")}),
        ([chain_row(tts=0.95, cos=0.6, query_brands=["nike"]), chain_row(item_id=2, y=True, title_key="b")], {1: (True, "T4d"), 2: (True, None)}),
        ([chain_row(y=True, top1=0.95, catw=0.0, brandw=0.0, recall=0.4, cos=0.55, query="kırmızı gömlek"), chain_row(item_id=2, y=True, title_key="b")], {1: (False, "T4c"), 2: (True, None)}),
    ],
)
def test_correction_stages(spark, rows, expected):
    schema = "term_id int, item_id int, y boolean, cos double, recall double, contain boolean, catw double, brandw double, top1 double, tts double, query string, title string, title_key string, item_text string, query_brands array<string>"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    assert {r.item_id: (r.y, r.changed_by) for r in corrections.correct(df).collect()} == expected


def test_widened_texts(spark):
    from quillon.operators import enrich

    terms = spark.createDataFrame([(1, "red bolt"), (2, "Bolt  screw"), (3, None), (4, "")], "term_id long, query string")
    synonyms = spark.createDataFrame([("bolt", "screw"), ("bolt", "nut"), ("pin", "bolt"), ("axle", "bolt")], "tok_a string, tok_b string")
    got = {r.term_id: r.text for r in enrich.widened_queries(terms, synonyms).collect()}
    assert got == {1: "red bolt | axle nut pin", 2: "bolt  screw | axle nut pin", 3: "", 4: ""}
    items = spark.createDataFrame([(1, "A  b", "x/y", "Z", None, "k: v"), (2, "a B", None, None, "", None), (3, None, "c", "d", "e", "f")], "item_id long, title string, category string, brand string, gender string, attributes string")
    clicks = spark.createDataFrame([(2, 2), (1, 1), (1, 2), (3, 1)], "term_id long, item_id long")
    got = {r.item_id: r.text for r in enrich.items_with_queries(items, terms, clicks).collect()}
    asked = "aranan: red bolt ; red bolt ; bolt  screw"
    assert got == {1: f"a  b | x/y | z |  | k: v | {asked}", 2: f"a b |  |  |  |  | {asked}", 3: " | c | d | e | f"}
    assert enrich.widened_queries(terms.limit(0), synonyms.limit(0)).count() == 0


def test_contributions_and_search(spark):
    from quillon.operators import metrics, model

    rows = spark.createDataFrame([(k, k % 40, float(k % 7), float(k % 3) if k % 5 else None, int(k % 7 > 3)) for k in range(400)], "id long, g long, a double, b double, y int")
    told = model.contributions(rows, {"a": 1.0, "b": -1.0}, 1).filter("id = 6").first().contributions
    assert told[0].feature == "a" and abs(told[0].contribution - (6.0 - sum(k % 7 for k in range(400)) / 400)) < 1e-9 and told[0].value == 6.0
    found = model.search_member(rows, ["a"], "y", "g", [{"depth": 1, "rounds": 1}, {"depth": 2, "rounds": 2}])
    assert [f for f, _ in found] == sorted((f for f, _ in found), reverse=True) and found[0][0] == 1.0
    assert metrics.decide_at_rate(rows, "a", 0.3).agg({"prediction": "avg"}).first()[0] >= 0.28


def test_override_update_and_folds_by_hand(spark):
    from quillon.operators import metrics, model, rules, sets

    df = spark.createDataFrame([(1, 0.99, 1, 0, 0), (2, 0.99, 0, 1, 0), (3, 0.99, 0, 0, 1), (4, 0.5, None, None, 1)], "id int, p double, gender_contradiction int, age_contradiction int, brand_contradiction int")
    assert {r.id: r.p for r in rules.hard_override(df, "p").collect()} == {1: 0.0, 2: 0.0, 3: 0.99, 4: 0.5}
    changes = spark.createDataFrame([(1, 0.1), (2, None), (9, 0.3)], "id int, p double")
    assert {r.id: r.p for r in sets.update_by_key(df, changes, ["id"], ["p"]).collect()} == {1: 0.1, 2: None, 3: 0.99, 4: 0.5}
    assert sets.without_columns(df, "p", "nothing").columns == ["id", "gender_contradiction", "age_contradiction", "brand_contradiction"]
    assert sets.as_member(df, ["id"], "p", "lgb").columns == ["id", "lgb"]
    sizes = [7, 7, 7, 5, 4, 4, 3, 1, 1, 1, 1]
    rows = spark.createDataFrame([(g,) for g, n in enumerate(sizes) for _ in range(n)], "g int")
    got = {r.g: r.fold for r in model.balanced_folds(rows, "g", 3).collect()}
    load, dealt = [0, 0, 0], {}
    for n in sizes:
        fold = load.index(min(load))
        dealt[n, fold] = dealt.get((n, fold), 0) + 1
        load[fold] += n
    assert {(n, f): sum(1 for g, x in got.items() if sizes[g] == n and x == f) for n, f in dealt} == dealt and len(got) == len(sizes)
    assert model.balanced_folds(rows.limit(0), "g").count() == 0
    scored = spark.createDataFrame([(x / 10,) for x in (1, 2, 2, 3, 5, 8, 8, 8, 9, 10)], "p double")
    assert [metrics.density_threshold(scored, "p", r).first().threshold for r in (0.01, 0.2, 0.3, 1.0)] == [1.0, 0.9, 0.8, 0.1]
    assert metrics.quantiles(scored, "p", [0.0, 0.25, 0.5, 1.0]).first().q == [0.1, 0.225, 0.65, 1.0]
    none = metrics.preflight(spark.createDataFrame([], "p double, a int, k boolean"), "p", "a", "k").first()
    assert none.head is None and not none.head_ok and not none.click_ok
