"""Spelling correction of query words toward the words of the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import deasciify, words


def vocabulary(texts: DataFrame, column: str) -> DataFrame:
    """word, n: how often each word stands in the catalog's texts. Queries must not be among them: a slip that is
    counted as known is never corrected."""
    return texts.select(F.explode(words(F.col(column))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def deletions(word: Column, most: int = 2) -> Column:
    """The word and what is left of it when up to two characters go: words within that many edits share one."""

    def without_one(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))

    one = F.when(F.length(word) > 1, without_one(word)).otherwise(F.array().cast("array<string>"))
    out = F.concat(F.array(word), one)
    if most > 1:
        out = F.concat(out, F.flatten(F.transform(F.filter(one, lambda w: F.length(w) > 1), without_one)))
    return F.array_distinct(out)


def correct(asked: DataFrame, known: DataFrame, least: int = 1, distance: int = 2) -> DataFrame:
    """``asked`` (word) with ``corrected``: the word if it is known; else the most frequent one of the same ASCII
    letters; else the closest known word within ``distance`` edits (ties: more frequent, then first); else itself.

    Near words are found by shared deletions, an equi-join, and confirmed by their distance.
    """
    w = asked.select("word").distinct()
    frequent = known.filter(F.col("n") >= least)
    by_fold = known.groupBy(deasciify(F.col("word")).alias("fold")).agg(F.max(F.struct("n", F.col("word"))).alias("best")).select("fold", F.col("best.word").alias("by_fold"))
    step = w.join(frequent.select("word", F.lit(True).alias("is_known")), "word", "left").withColumn("fold", deasciify(F.col("word"))).join(by_fold, "fold", "left")
    open_ = step.filter(F.col("is_known").isNull() & F.col("by_fold").isNull()).select("word")
    keys = known.select(F.col("word").alias("near"), "n", F.explode(deletions(F.col("word"), distance)).alias("key"))
    met = open_.select("word", F.explode(deletions(F.col("word"), distance)).alias("key")).join(keys, "key").select("word", "near", "n").distinct()
    scored = met.withColumn("d", F.levenshtein("word", "near")).filter(F.col("d") <= distance)
    closest = scored.groupBy("word").agg(F.min(F.struct("d", (-F.col("n")).alias("n"), "near")).alias("best")).select("word", F.col("best.near").alias("by_edit"))
    done = step.join(closest, "word", "left").select("word", F.when(F.col("is_known"), F.col("word")).otherwise(F.coalesce("by_fold", "by_edit", "word")).alias("corrected"))
    return asked.join(done, "word", "left")
