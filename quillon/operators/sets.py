"""Unions in which the first source wins, and differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_first(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of all sources, one per key: that of the first source that has it.

    Within a source the smallest row in column order stays. An aggregation with a partial step, not a window.
    """
    tagged = [s.select(*keys, F.struct(F.lit(k).alias("_rank"), *(F.col(c) for c in sources[0].columns if c not in keys)).alias("rest")) for k, s in enumerate(sources)]
    best = reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(F.min("rest").alias("rest"))
    return best.select(*(F.col(c) if c in keys else F.col(f"rest.{c}") for c in sources[0].columns))


def without(df: DataFrame, *others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is in none of the others."""
    return reduce(lambda left, other: left.join(other.select(*keys), keys, "left_anti"), others, df)


def same_ids(a: DataFrame, b: DataFrame, key: str) -> bool:
    """Whether both have the same ids, as often."""
    x, y = a.select(key), b.select(key)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def left_score(df: DataFrame, scores: DataFrame, keys: list[str], score: str, fill: float = 0.5) -> DataFrame:
    """``df`` with a score by key; one row per key counts, that of the lowest score; a missing one is ``fill``."""
    one = scores.groupBy(*keys).agg(F.min(score).alias(score))
    return df.drop(score).join(one, keys, "left").withColumn(score, F.coalesce(score, F.lit(fill)))


def update_by_key(df: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``df`` with the given columns taken from ``changes`` (keys and columns) where it has the row's keys, nulls included.

    Each key stands once in ``changes``; keys that ``df`` does not have add nothing.
    """
    new = changes.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_has"))
    met = df.join(new, keys, "left")
    return met.select(*(F.when(F.col("_has"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))


def without_columns(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` without the columns; those it does not have are passed over."""
    return df.drop(*columns)


def as_member(df: DataFrame, keys: list[str], score: str, member: str) -> DataFrame:
    """keys and one score under the name that an ensemble knows its member by."""
    return df.select(*keys, F.col(score).cast("double").alias(member))
