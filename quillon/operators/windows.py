"""Values relative to their group, and the best rows of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import quantiles


def percent_rank(group: list[str], value: str) -> Column:
    """Rank over group size, ties on average: not Spark's percent_rank, which starts at 0."""
    ties = F.count("*").over(Window.partitionBy(*group, value))
    size = F.count("*").over(Window.partitionBy(*group))
    return (F.rank().over(Window.partitionBy(*group).orderBy(value)) + (ties - 1) / 2) / size


def z_score(group: list[str], value: str, eps: float = 1e-6) -> Column:
    """Distance from the group's mean in sample deviations; a group of one has none, so its score is 0."""
    w = Window.partitionBy(*group)
    return (F.col(value) - F.avg(value).over(w)) / (F.coalesce(F.stddev_samp(value).over(w), F.lit(0.0)) + eps)


def group_features(df: DataFrame, group: str, values: list[str], mean_of: str) -> DataFrame:
    """``df`` with v_pct and v_z for each value, n_candidates and the group's mean of one of them.

    The moments of a group come from an aggregation joined back, which a large group does not slow; ranks
    need the group in order.
    """
    stats = df.groupBy(group).agg(
        F.count("*").alias("n_candidates"),
        F.avg(mean_of).alias(f"{mean_of}_mean"),
        *(x for v in values for x in (F.avg(v).alias(f"_{v}_avg"), F.stddev_samp(v).alias(f"_{v}_std"))),
    )
    out = df.join(stats, group)
    for v in values:
        out = out.withColumn(f"{v}_pct", percent_rank([group], v)).withColumn(f"{v}_z", (F.col(v) - F.col(f"_{v}_avg")) / (F.coalesce(f"_{v}_std", F.lit(0.0)) + 1e-6))
    return out.drop(*(f"_{v}_{x}" for v in values for x in ("avg", "std")))


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int | Column) -> DataFrame:
    """The first k rows of each group in a total order. Each task keeps k rows of a group before the shuffle."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def least_positives(df: DataFrame, group: str, score: str, label: str, key: str, k: int, forbidden: Column | None = None) -> DataFrame:
    """Labels with at least k positives per group: the best-scored others are raised; forbidden rows never are."""
    free = F.lit(True) if forbidden is None else ~forbidden
    w = Window.partitionBy(group)
    open_ = (F.col(label) == 0) & free
    order = Window.partitionBy(group, open_).orderBy(F.desc(score), key)
    missing = F.greatest(F.lit(k) - F.sum(label).over(w), F.lit(0))
    return df.withColumn(label, F.when(open_ & (F.row_number().over(order) <= missing), 1).otherwise(F.col(label)))


def top_share(df: DataFrame, score: str, key: str, share: float) -> DataFrame:
    """The best-scored share of all rows, rounded down, found by a threshold: only its ties are put in order."""
    n = int(df.count() * share)
    if not n:
        return df.limit(0)
    cut = quantiles(df, score, [1.0 - (n - 1) / max(df.count() - 1, 1)]).first().q
    cut = cut[0] if cut else None
    above = df.filter(F.col(score) > cut + 1e-12)
    ties = df.filter(F.abs(F.col(score) - cut) <= 1e-12).orderBy(key).limit(n - above.count())
    return above.unionByName(ties)
