"""Texts of terms and items widened by what is known about them: synonyms, and the queries that led to an item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize, squeeze
from .windows import top_k


def _first_texts(df: DataFrame, group: str, order: list[str], text: str, k: int, between: str, name: str) -> DataFrame:
    """group, name: the texts of the first k rows of each group, joined in their order."""
    best = top_k(df, [group], [F.col(c) for c in order], k)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", text))), lambda x: x[text])
    return best.groupBy(group).agg(F.array_join(listed, between).alias(name))


def widened_queries(terms: DataFrame, synonyms: DataFrame, most: int = 3) -> DataFrame:
    """term_id, text: the query, and after a bar the first synonyms of its words by name that it does not hold itself.

    ``synonyms`` holds tok_a, tok_b in either direction. A query without synonyms, or an empty one, stays as it is.
    """
    q = terms.select("term_id", normalize(F.col("query")).alias("q")).withColumn("words", F.array_distinct(F.filter(F.split("q", r"\s+"), lambda w: w != "")))
    both = synonyms.select(F.col("tok_a").alias("w"), F.col("tok_b").alias("s")).union(synonyms.select("tok_b", "tok_a")).distinct()
    told = q.select("term_id", "words", F.explode("words").alias("w")).join(both, "w").filter(~F.array_contains("words", F.col("s"))).select("term_id", "s").distinct()
    extra = _first_texts(told, "term_id", ["s"], "s", most, " ", "extra")
    return q.join(extra, "term_id", "left").select("term_id", F.concat_ws(" | ", "q", "extra").alias("text"))


def items_with_queries(items: DataFrame, terms: DataFrame, clicks: DataFrame, most: int = 3, clip: int = 180) -> DataFrame:
    """item_id, text: title, category, brand, gender and clipped attributes, then the first queries, by term and item,
    that clicked an item of the same title. A title that many items and clicks share costs ``most`` rows a task."""
    named = items.withColumn("title_key", squeeze(normalize(F.col("title"))))
    asked = clicks.join(named.select("item_id", "title_key"), "item_id").join(terms.select("term_id", normalize(F.col("query")).alias("asked")), "term_id")
    by_title = _first_texts(asked, "title_key", ["term_id", "item_id"], "asked", most, " ; ", "queries")
    told = named.join(by_title, "title_key", "left")
    parts = [normalize(F.col(c)) for c in ("title", "category", "brand", "gender")] + [F.left(normalize(F.col("attributes")), F.lit(clip))]
    return told.select("item_id", F.concat_ws(" | ", *parts, F.concat(F.lit("aranan: "), F.col("queries"))).alias("text"))
