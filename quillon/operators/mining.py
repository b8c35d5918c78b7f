"""Negative pairs from several sources, their cleaning, and mined synonyms.

Draws are made by hashes of the keys, so they repeat whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contained, ngrams, token_set, tokenize
from ..sources.tables import written
from .held_texts import with_contained
from .metrics import quantiles
from .sets import without
from .windows import top_k

#: Shares of the sources in a term's quota.
SHARES = {"dense_ann": 0.35, "lexical": 0.25, "category_sibling": 0.20, "popularity_random": 0.20}
KEYS = ["term_id", "item_id"]


def draw(seed: int, *keys: str) -> Column:
    """A number for each key that orders them as if at random; arithmetic, so that other engines find it too."""
    mixed = F.lit(seed).cast("long")
    for k in keys:
        mixed = (mixed * 31 + F.col(k).cast("long")) % 4294967291 * 1103515245 % 4294967291
    return mixed


def quotas(positives: DataFrame, per_positive: int = 6, low: int = 20, high: int = 150, guided: float = 0.15, rare: int = 2) -> DataFrame:
    """term_id, n_pos, quota and one column per source: how many negatives a term gets from where.

    Halves are rounded to even; the last source takes the rest. Terms of few positives give a share to the guided
    source first.
    """
    n = positives.groupBy("term_id").agg(F.countDistinct("item_id").alias("n_pos"))
    n = n.withColumn("quota", F.least(F.greatest(F.col("n_pos") * per_positive, F.lit(low)), F.lit(high)).cast("int"))
    n = n.withColumn("llm_guided", F.when(F.col("n_pos") <= rare, F.bround(F.col("quota") * guided)).otherwise(0).cast("int"))
    left = F.col("quota") - F.col("llm_guided")
    *named, last = SHARES
    for s in named:
        n = n.withColumn(s, F.bround(left * SHARES[s]).cast("int"))
    return n.withColumn(last, (left - sum(F.col(s) for s in named)).cast("int"))


def veto(candidates: DataFrame, terms: DataFrame, items: DataFrame, text: str) -> DataFrame:
    """Candidates whose item does not hold all of the query's tokens; an empty query vetoes nothing."""
    q = terms.select("term_id", F.array_distinct(tokenize(F.col("query"))).alias("q"))
    i = items.select("item_id", F.array_distinct(tokenize(F.col(text))).alias("i"))
    return candidates.join(q, "term_id").join(i, "item_id").filter(~contained(F.col("q"), F.col("i"))).drop("q", "i")


def dense_candidates(neighbours: DataFrame, positives: DataFrame) -> DataFrame:
    """term_id, item_id, order: the nearest items that are no positives (neighbours: q_id, i_id, sim)."""
    found = neighbours.select(F.col("q_id").alias("term_id"), F.col("i_id").alias("item_id"), (-F.col("sim")).alias("order"))
    return without(found, positives, keys=KEYS)


def lexical_candidates(terms: DataFrame, items: DataFrame, text: str, per_token: int = 400, seed: int = 42) -> DataFrame:
    """term_id, item_id, order: items that share a token with the query, ``per_token`` drawn for each token.

    The draw is part of the operator. It is made once per token, before terms meet items, so a frequent token
    brings no more than that to any term.
    """
    posts = items.select("item_id", F.explode(F.array_distinct(tokenize(F.col(text)))).alias("token"))
    drawn = top_k(posts.withColumn("order", draw(seed, "item_id")), ["token"], [F.col("order"), F.col("item_id")], per_token).drop("rank")
    asked = terms.select("term_id", F.explode(F.array_distinct(tokenize(F.col("query")))).alias("token"))
    return asked.join(drawn, "token").select("term_id", "item_id").distinct().withColumn("order", draw(seed + 1, "term_id", "item_id"))


def category_siblings(positives: DataFrame, items: DataFrame, per_category: int, seed: int = 42) -> DataFrame:
    """term_id, item_id, order: items drawn from the categories of a term's positives, some per category."""
    drawn = top_k(items.select("category", "item_id").withColumn("order", draw(seed, "item_id")), ["category"], [F.col("order"), F.col("item_id")], per_category).drop("rank", "order")
    own = positives.join(items.select("item_id", "category"), "item_id").select("term_id", "category").distinct()
    found = own.join(drawn, "category").select("term_id", "item_id").distinct()
    return without(found, positives, keys=KEYS).withColumn("order", draw(seed + 2, "term_id", "item_id"))


def guided_candidates(guesses: DataFrame, positives: DataFrame, items: DataFrame, per_category: int, seed: int = 42) -> DataFrame:
    """term_id, item_id, order: items of a guessed category (term_id, category) in which the term has no positive."""
    own = positives.join(items.select("item_id", "category"), "item_id").select("term_id", "category").distinct()
    fresh = guesses.select("term_id", "category").join(own, ["term_id", "category"], "left_anti")
    drawn = top_k(items.select("category", "item_id").withColumn("order", draw(seed, "item_id")), ["category"], [F.col("order"), F.col("item_id")], per_category).drop("rank", "order")
    return fresh.join(drawn, "category").select("term_id", "item_id").distinct().withColumn("order", draw(seed + 3, "term_id", "item_id"))


def popularity_draw(items: DataFrame, clicks: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """item_id, weight, key, rank: n items drawn without replacement, by log1p(clicks) + 1."""
    count = clicks.groupBy("item_id").agg(F.count("*").alias("n"))
    u = (draw(seed, "item_id").cast("double") + 1) / 4294967292.0
    keyed = items.select("item_id").join(count, "item_id", "left").withColumn("weight", F.log1p(F.coalesce("n", F.lit(0))) + 1).withColumn("key", F.round(-F.log(u) / F.col("weight"), 9))
    best = keyed.orderBy("key", "item_id").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("key", "item_id")))  # n rows


def random_candidates(terms: DataFrame, pool: DataFrame, n_pool: int, positives: DataFrame, per_term: int = 40, seed: int = 42) -> DataFrame:
    """term_id, item_id, order: ``per_term`` draws of each term from a pool ranked from 1 to ``n_pool``, without repeats.

    A draw names a rank, so terms and pool meet in an equi-join and never all with all.
    """
    draws = terms.select("term_id", F.explode(F.sequence(F.lit(1), F.lit(per_term))).alias("try"))
    at = draws.withColumn("rank", (draw(seed + 4, "term_id", "try") % n_pool + 1).cast("int"))
    found = at.join(pool.select("rank", "item_id"), "rank").groupBy("term_id", "item_id").agg(F.min("try").alias("order"))
    return without(found, positives, keys=KEYS)


def numbered(items: DataFrame, clicks: DataFrame, buckets: int = 1024) -> DataFrame:
    """item_id, weight (log1p(clicks) + 1), rank: every item with a number from 1, whatever the partitioning."""
    count = clicks.groupBy("item_id").agg(F.count("*").alias("n"))
    at = items.select("item_id", F.pmod(F.xxhash64("item_id"), F.lit(buckets)).alias("bucket"))
    sizes = at.groupBy("bucket").agg(F.count("*").alias("size"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))  # a row per bucket
    own = F.row_number().over(Window.partitionBy("bucket").orderBy("item_id"))
    ranked = at.withColumn("own", own).join(F.broadcast(starts), "bucket").select("item_id", (F.col("start") + F.col("own")).alias("rank"))
    return ranked.join(count, "item_id", "left").select("item_id", (F.log1p(F.coalesce("n", F.lit(0))) + 1).alias("weight"), "rank")


def catalog_draws(quota: DataFrame, items: DataFrame, clicks: DataFrame, positives: DataFrame, tries: int = 5, seed: int = 42) -> DataFrame:
    """term_id, item_id, order: draws from all items, by log1p(clicks) + 1 and uniformly in turns, without repeats.

    A term draws ``tries`` times its quota of either kind at most. A draw names an item's number, so terms and items
    meet in an equi-join; a weighted draw is kept with the share that its item's weight is of the greatest one.
    """
    catalog = numbered(items, clicks)
    size = catalog.agg(F.count("*").alias("n_items"), F.max("weight").alias("most"))  # one row
    kinds = F.explode(F.array(F.lit(0), F.lit(1))).alias("uniform")
    draws = quota.select("term_id", F.col("quota"), kinds).withColumn("try", F.explode(F.sequence(F.lit(1), F.col("quota") * tries)))
    chance = lambda k: F.pmod(F.xxhash64("term_id", "uniform", "try", F.lit(seed + k)), F.lit(1 << 53))
    at = draws.crossJoin(F.broadcast(size)).withColumn("rank", chance(4) % F.col("n_items") + 1).withColumn("u", chance(5) / float(1 << 53))
    kept = at.join(catalog, "rank").filter((F.col("uniform") == 1) | (F.col("u") * F.col("most") < F.col("weight")))
    first = kept.groupBy("term_id", "item_id", "uniform").agg(F.min("try").alias("try"))
    turn = F.row_number().over(Window.partitionBy("term_id", "uniform").orderBy("try", "item_id"))
    found = without(first, positives, keys=KEYS).withColumn("order", 2 * turn + F.col("uniform"))
    return found.groupBy("term_id", "item_id").agg(F.min("order").alias("order"))


def choose(sources: list[tuple[str, DataFrame]], quota: DataFrame, positives: DataFrame) -> DataFrame:
    """term_id, item_id, neg_source: each source fills its column of the quota with what no earlier one took.

    Sources follow one another; each step is an anti join and a ranking of what is left, and is written once, so that
    no later step repeats it. What sources fail to fill goes to the last one.
    """
    taken, last = None, sources[-1][0]
    for name, candidates in sources:
        left = without(candidates, positives, keys=KEYS)
        left = left if taken is None else without(left, taken, keys=KEYS)
        room = quota.select("term_id", F.col(name).alias("room"), "quota")
        if name == last and taken is not None:
            had = taken.groupBy("term_id").agg(F.count("*").alias("had"))
            room = room.join(had, "term_id", "left").select("term_id", (F.col("quota") - F.coalesce("had", F.lit(0))).alias("room"), "quota")
        picked = top_k(left.join(room, "term_id"), ["term_id"], [F.col("order"), F.col("item_id")], F.col("room")).select("term_id", "item_id", F.lit(name).alias("neg_source"))
        picked = written(picked, name)
        taken = picked if taken is None else taken.unionByName(picked)
    return taken


def clean_negatives(pairs: DataFrame, terms: DataFrame, items: DataFrame, text: str, percent: float = 0.75) -> DataFrame:
    """``pairs`` (label, cos) without negatives that look positive: the item holds all of the query's tokens, or the
    cosine reaches that percentile of the positives'."""
    q = terms.select("term_id", token_set(F.col("query")).alias("q"))
    i = items.select("item_id", token_set(F.col(text)).alias("i"))
    limit = quantiles(pairs.filter("label = 1"), "cos", [percent]).select(F.get("q", F.lit(0)).alias("limit"))
    rows = with_contained(pairs, q, i, "_held")
    if rows is None:
        rows = pairs.join(q, "term_id", "left").join(i, "item_id", "left").withColumn("_held", contained(F.col("q"), F.col("i"))).drop("q", "i")
    doubtful = (F.col("label") == 0) & (F.coalesce("_held", F.lit(False)) | F.coalesce(F.col("cos") >= F.col("limit"), F.lit(False)))
    return rows.join(F.broadcast(limit)).filter(~doubtful).drop("_held", "limit")


def hard_negatives(scored: DataFrame, threshold: float = 0.5, per_term: int = 30) -> DataFrame:
    """The highest-scored candidates of each term above a threshold that are no positives (term_id, item_id, score,
    is_positive)."""
    return top_k(scored.filter((F.col("is_positive") == 0) & (F.col("score") >= threshold)), ["term_id"], [F.desc("score"), F.col("item_id")], per_term)


def close_spelling(a: Column, b: Column) -> Column:
    """Whether two words differ by a slip: half of their letter pairs are shared and lengths differ by two at most."""
    x, y = ngrams(a, 2), ngrams(b, 2)
    return (F.abs(F.length(a) - F.length(b)) <= 2) & (F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)) >= 0.5)


def mine_synonyms(neighbours: DataFrame, terms: DataFrame, clicks: DataFrame, twin: float = 0.90, support: int = 3) -> DataFrame:
    """tok_a, tok_b, support, kind: words by which near-equal queries differ, one on each side.

    Both have three characters and more; where both terms have clicks, they share an item. The terms that differ so, and
    their clicks, are written once.
    """
    tokens = terms.select("term_id", F.array_distinct(tokenize(F.col("query"))).alias("t"))
    pairs = neighbours.filter(F.col("sim") >= twin).select(F.col("q_id").alias("a"), F.col("i_id").alias("b"))
    told = pairs.join(tokens.toDF("a", "ta"), "a").join(tokens.toDF("b", "tb"), "b")
    only_a, only_b = F.array_except("ta", "tb"), F.array_except("tb", "ta")
    one = told.filter((F.size(only_a) == 1) & (F.size(only_b) == 1)).select("a", "b", F.get(only_a, 0).alias("x"), F.get(only_b, 0).alias("y"))
    one = one.filter((F.length("x") >= 3) & (F.length("y") >= 3))
    one = written(one, "differing")
    asked = one.select(F.col("a").alias("term_id")).union(one.select("b")).distinct()
    own = written(clicks.select("term_id", "item_id").join(asked, "term_id", "left_semi"), "differing-clicks")
    shared = one.select("a", "b").distinct().join(own.toDF("a", "item"), "a").join(own.toDF("b", "item"), ["b", "item"]).select("a", "b").distinct().withColumn("shared", F.lit(True))
    active = own.select("term_id").distinct()
    known = one.join(active.select(F.col("term_id").alias("a"), F.lit(True).alias("has_a")), "a", "left").join(active.select(F.col("term_id").alias("b"), F.lit(True).alias("has_b")), "b", "left").join(shared, ["a", "b"], "left")
    kept = known.filter(F.col("has_a").isNull() | F.col("has_b").isNull() | F.col("shared").isNotNull())
    counted = kept.groupBy(F.least("x", "y").alias("tok_a"), F.greatest("x", "y").alias("tok_b")).agg(F.count("*").alias("support")).filter(F.col("support") >= support)
    return counted.withColumn("kind", F.when(close_spelling(F.col("tok_a"), F.col("tok_b")), "typo").otherwise("synonym"))
