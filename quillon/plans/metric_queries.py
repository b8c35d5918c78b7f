"""Queries over scores, thresholds, checks and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, model
from ..sources.tables import written
from . import bindings as b
from .bindings import SCORED, table
from .pair_queries import feature_rows


def _six(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if kind in ("double", "float") else c for c, kind in df.dtypes))


def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(metrics.confusion(b.scored(spark, sf_dir).withColumn("d", (F.col("p") >= 0.3).cast("int")), "y", "d"))


def threshold_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(metrics.threshold_scan(b.scored(spark, sf_dir), "y", "p"))


def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(metrics.best_threshold(b.scored(spark, sf_dir), "y", "p"))


def rate_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(metrics.rate_threshold(b.scored(spark, sf_dir), "p", 0.3))


def density_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(metrics.density_threshold(b.scored(spark, sf_dir), "p", 0.18))


def quantile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(metrics.quantile_grid(b.scored(spark, sf_dir), "p").select(F.round("threshold", 6).alias("threshold")).distinct())


def decile_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(metrics.decile_rates(b.scored(spark, sf_dir), "y", "p"))


def auc_rank_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(metrics.auc(b.scored(spark, sf_dir), "y", "p"))


def blend_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.scored(spark, sf_dir).withColumn("r", (F.col("doc_id") % 10) / 10.0)
    return _six(metrics.blend_grid(rows, ["p", "q", "r"], "y", 0.45))


def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores p against an anchor that follows q, with every third document's item clicked."""
    rows = b.scored(spark, sf_dir).select("p", ((F.col("p") + F.col("q")) >= 1.2).cast("int").alias("anchor"), (F.col("doc_id") % 3 == 0).alias("clicked"))
    return _six(metrics.preflight(rows, "p", "anchor", "clicked"))


def rate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions at one half, and those of the highest 30% of the scores."""
    rows = metrics.decide_at_rate(b.scored(spark, sf_dir).select("doc_id", "p"), "p", 0.3, "by_rate")
    return rows.select("doc_id", (F.col("p") >= 0.5).cast("int").alias("by_half"), "by_rate")


def top_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two features of three that move each document's linear score most."""
    rows = b.scored(spark, sf_dir).select("doc_id", "p", "q", (F.col("doc_id") % 10 / 10.0).alias("r"))
    told = model.contributions(rows, {"p": 1.5, "q": -2.0, "r": 0.5}, 2).select("doc_id", F.posexplode("contributions").alias("at", "c"))
    return _six(told.select("doc_id", (F.col("at") + 1).alias("rank"), "c.feature", "c.contribution", "c.value"))


def rates_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return _six(e.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.median("value").alias("median")))


def reciprocal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", (F.col("event_type") == "error").cast("int").alias("hit"))
    from ..operators.windows import top_k

    return _six(metrics.reciprocal_rank(top_k(e, ["user_id"], [F.desc("value"), F.col("event_id")], 10), "user_id", "rank", "hit"))


def click_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many positives and how many pairs of each label a fold of terms holds."""
    rows = b.pairs(spark, sf_dir).withColumn("fold", F.col("term_id") % 5)
    return _six(rows.groupBy("fold").agg(F.count("*").alias("n"), F.avg("label").alias("rate")))


def balanced_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each fold: no two folds differ by more than a term."""
    rows = b.pairs(spark, sf_dir)
    return rows.join(model.balanced_folds(rows, "term_id"), "term_id").groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("term_id").alias("terms"))


def ensemble_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores of one member over the feature matrix."""
    names = ["word_recall", "char_jaccard", "brand_contradiction", "item_click_log", "brand_click_log", "len_ratio"]
    rows = feature_rows(spark, sf_dir, names).withColumn("fold", model.hash_folds("term_id", 2))
    rows = written(rows.select("term_id", "item_id", "label", "fold", *names), "features")  # a fit reads them many times
    return model.out_of_fold(rows, names, "label", "fold", "p", folds=2, depth=3, rounds=5).select("term_id", "item_id", "label", F.round("p", 6).alias("p"))


QUERIES = {f.__name__: f for f in (macro_f1, threshold_scan, best_threshold, rate_threshold, density_threshold, quantile_grid, decile_rates, auc_rank_sum, blend_grid, preflight, rate_decisions, top_contributions, rates_by_source, reciprocal_rank, click_distribution, balanced_folds, ensemble_scores)}

_F1 = "CASE WHEN 2 * {0} + {1} + {2} > 0 THEN 2 * {0} / (2 * {0} + {1} + {2})::DOUBLE ELSE 0 END"


def _macro(tp: str, fp: str, fn: str, tn: str) -> str:
    return f"(({_F1.format(tp, fp, fn)}) + ({_F1.format(tn, fn, fp)})) / 2"


_W = f"WITH {SCORED}"
_SCAN = f"""{_W}, t AS (SELECT DISTINCT p AS threshold FROM scored), c AS (SELECT threshold, count(*) FILTER (p >= threshold AND y = 1) AS tp, count(*) FILTER (p >= threshold AND y = 0) AS fp, count(*) FILTER (p < threshold AND y = 1) AS fn, count(*) FILTER (p < threshold AND y = 0) AS tn FROM t, scored GROUP BY threshold),
  s AS (SELECT threshold, {_macro('tp', 'fp', 'fn', 'tn')} AS macro_f1 FROM c)"""
_GRID = ", ".join(repr(0.02 + 0.96 * i / 96) for i in range(97))
SQL = {
    "macro_f1": f"{_W}, c AS (SELECT count(*) FILTER (p >= 0.3 AND y = 1) AS tp, count(*) FILTER (p >= 0.3 AND y = 0) AS fp, count(*) FILTER (p < 0.3 AND y = 1) AS fn, count(*) FILTER (p < 0.3 AND y = 0) AS tn FROM scored) SELECT *, round({_macro('tp', 'fp', 'fn', 'tn')}, 6) AS macro_f1 FROM c",
    "threshold_scan": f"{_SCAN} SELECT threshold, round(macro_f1, 6) AS macro_f1 FROM s",
    "best_threshold": f"{_SCAN} SELECT threshold, round(macro_f1, 6) AS macro_f1 FROM s ORDER BY round(macro_f1, 12) DESC, threshold DESC LIMIT 1",
    "rate_threshold": f"{_W} SELECT round(quantile_cont(p, 0.7), 6) AS threshold FROM scored",
    "density_threshold": f"{_W} SELECT round(min(p), 6) AS threshold FROM (SELECT p, row_number() OVER (ORDER BY p DESC) AS pos FROM scored) WHERE pos <= greatest(floor((SELECT count(*) FROM scored) * 0.18), 1)",
    "quantile_grid": f"{_W} SELECT DISTINCT round(x, 6) AS threshold FROM (SELECT unnest(quantile_cont(p, [{_GRID}])) AS x FROM scored)",
    "decile_rates": f"""{_W}, e AS (SELECT quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM scored), d AS (SELECT unnest(range(1, 11))::INT AS decile)
      SELECT decile, count(*) AS n, round(avg(y), 6) AS rate FROM d, e, scored WHERE p BETWEEN e[decile] AND e[decile + 1] GROUP BY decile""",
    "auc_rank_sum": f"{_W} SELECT round(avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END::DOUBLE), 6) AS auc FROM scored a, scored b WHERE a.y = 1 AND b.y = 0",
    "blend_grid": f"""{_W}, g AS (SELECT a, b, 10 - a - b AS c FROM (SELECT unnest(range(11)) AS a) x, (SELECT unnest(range(11)) AS b) z WHERE a + b <= 10),
      d AS (SELECT a, b, c, y, round(0.0::DOUBLE + p * a / 10 + q * b / 10 + (doc_id % 10) / 10.0::DOUBLE * c / 10, 12) >= 0.45 AS d FROM g, scored), n AS (SELECT a, b, c, count(*) FILTER (d AND y = 1) AS tp, count(*) FILTER (d AND y = 0) AS fp, count(*) FILTER (NOT d AND y = 1) AS fn, count(*) FILTER (NOT d AND y = 0) AS tn FROM d GROUP BY a, b, c)
      SELECT a || '/' || b || '/' || c AS weights, round({_macro('tp', 'fp', 'fn', 'tn')}, 6) AS macro_f1 FROM n""",
    "preflight": f"""{_W}, r AS (SELECT p, (p + q >= 1.2)::INT AS a, doc_id % 3 = 0 AS k FROM scored),
      h AS (SELECT avg(a) AS head FROM r WHERE p >= (SELECT min(p) FROM (SELECT p, row_number() OVER (ORDER BY p DESC) AS pos FROM r) WHERE pos <= greatest(floor((SELECT count(*) FROM r) * 0.08), 1))),
      e AS (SELECT quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e, quantile_cont(p, 0.72) AS t FROM r),
      d AS (SELECT i, avg(a) AS rate FROM (SELECT unnest(range(1, 11)) AS i), e, r WHERE p BETWEEN e[i] AND e[i + 1] GROUP BY i),
      m AS (SELECT max(x.rate - y.rate) AS fall FROM d x JOIN d y ON y.i = x.i + 1),
      c AS (SELECT avg((p >= t)::INT) AS rate, avg(((p >= t)::INT = a)::INT) AS agreement, median(p) FILTER (a = 1 AND k) / (median(p) FILTER (a = 1 AND NOT k) + 1e-9) AS click_ratio FROM r, e)
      SELECT round(head, 6) AS head, coalesce(fall <= 0.03, false) AS monotone_ok, round(rate, 6) AS rate, round(agreement, 6) AS agreement, round(click_ratio, 6) AS click_ratio,
        coalesce(head >= 0.8, false) AS head_ok, coalesce(rate BETWEEN 0.26 AND 0.30, false) AS rate_ok, coalesce(agreement BETWEEN 0.80 AND 0.95, false) AS agreement_ok, coalesce(click_ratio >= 0.6, false) AS click_ok FROM h, m, c""",
    "rate_decisions": f"{_W} SELECT doc_id, (p >= 0.5)::INT AS by_half, (p >= (SELECT quantile_cont(p, 0.7) FROM scored))::INT AS by_rate FROM scored",
    "top_contributions": f"""{_W}, r AS (SELECT doc_id, p, q, (doc_id % 10) / 10.0::DOUBLE AS r FROM scored), m AS (SELECT avg(p) AS mp, avg(q) AS mq, avg(r) AS mr FROM r),
      c AS (SELECT doc_id, 'p' AS feature, 1.5::DOUBLE * (p - mp) AS x, p AS v FROM r, m UNION ALL SELECT doc_id, 'q', -2.0::DOUBLE * (q - mq), q FROM r, m UNION ALL SELECT doc_id, 'r', 0.5::DOUBLE * (r - mr), r FROM r, m)
      SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY abs(x) DESC, feature)::INT AS rank, feature, round(x, 6) AS contribution, round(v, 6) AS value FROM c) WHERE rank <= 2""",
    "rates_by_source": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM events GROUP BY event_type",
    "reciprocal_rank": """WITH r AS (SELECT user_id, event_type = 'error' AS hit, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events), f AS (SELECT user_id, min(rank) FILTER (hit AND rank <= 10) AS first FROM r WHERE rank <= 10 GROUP BY user_id)
      SELECT round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr_10, round(avg((coalesce(first, 0) = 1)::INT), 6) AS accuracy_1, round(avg((first IS NOT NULL)::INT), 6) AS accuracy_10 FROM f""",
    "click_distribution": f"WITH {b.CLICKS}, {b.PAIRS} SELECT term_id % 5 AS fold, count(*) AS n, round(avg(label), 6) AS rate FROM pairs GROUP BY fold",
}
