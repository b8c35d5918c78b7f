"""Scores from outside models: one seam for any scorer of batches, and deterministic stand-ins for tests."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import attrs, vocab
from ..functions.text import clip, json_block, tokenize

Scorer = Callable[[Sequence[str]], Sequence[float]]


def _score(batches: Iterator[pd.DataFrame], make: Callable[[], Scorer], prompt: str, output: str, size: int) -> Iterator[pd.DataFrame]:
    scorer = make()
    for batch in batches:
        prompts = batch[prompt].tolist()
        scores = [s for at in range(0, len(prompts), size) for s in scorer(prompts[at : at + size])]
        if len(scores) != len(prompts):
            raise ValueError(f"{len(scores)} scores for {len(prompts)} prompts")
        yield batch.assign(**{output: pd.Series(scores, index=batch.index, dtype="float64")})


def score_with(df: DataFrame, make: Callable[[], Scorer], prompt: str, output: str, size: int = 64) -> DataFrame:
    """``df`` with a scorer's value of the prompt column. ``make`` runs once per task and loads the model there."""
    rest = df.drop(output)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInPandas(partial(_score, make=make, prompt=prompt, output=output, size=size), f"{schema}, `{output}` double")


def relevance_prompt(query: Column, title: Column, category: Column, brand: Column, attributes: Column, short: int = 200, long: int = 300) -> Column:
    parts = {"query": clip(query, short), "title": clip(title, short), "category": clip(category, short), "brand": clip(brand, short), "attributes": clip(attributes, long)}
    return F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), v) for k, v in parts.items()))


def stand_in_relevance(n_tokens: Column) -> Column:
    """A score by token count alone, for tests: spread over 0.05 to 0.95 by a multiplicative hash."""
    return F.lit(0.05) + F.lit(0.9) * ((n_tokens.cast("bigint") * 2654435761) % 1000) / 1000.0


def stand_in_enrichment(query: Column) -> dict[str, Column]:
    """gender and age_group by the word lists."""
    t = tokenize(query)
    return {"gender": F.coalesce(attrs.intent(t, vocab.GENDER_WORDS), F.lit("unknown")), "age_group": F.coalesce(attrs.intent(t, vocab.AGE_WORDS), F.lit("unknown"))}


def answer_probability(answer: Column, model: Column) -> Column:
    """Probability of relevance from an answer with a JSON object of ``relevant`` and ``confidence``: the confidence or
    what it lacks to one; the model's own where the answer does not parse."""
    got = json_block(answer, "relevant boolean, confidence double")
    sure = F.least(F.greatest(got.confidence, F.lit(0.0)), F.lit(1.0))
    told = got.relevant.isNotNull() & got.confidence.isNotNull()
    return F.when(told, F.when(got.relevant, sure).otherwise(1 - sure)).otherwise(model)


def two_token_probability(tokens: Column, greedy: Column, fill: float = 0.5, sure: float = 0.98) -> Column:
    """P(one) from the log-probabilities of the tokens ``1`` and ``0`` (array of token, logprob; word-start marks are
    dropped). With one of the two: nearly sure of it. With none: by the greedy text, else ``fill``."""
    bare = lambda t: F.trim(F.translate(t, "▁Ġ", ""))
    lp = lambda v: F.array_max(F.transform(F.filter(tokens, lambda x: bare(x.token) == v), lambda x: x.logprob))
    one, zero, said = lp("1"), lp("0"), F.trim(F.coalesce(greedy, F.lit("")))
    return (
        F.when(one.isNotNull() & zero.isNotNull(), 1 / (1 + F.exp(zero - one)))
        .when(one.isNotNull(), sure)
        .when(zero.isNotNull(), 1 - sure)
        .when(said.startswith("1"), sure)
        .when(said.startswith("0"), 1 - sure)
        .otherwise(fill)
    )


def rescore_band(df: DataFrame, key: str, proba: str, rescored: DataFrame, low: float = 0.35, high: float = 0.65, blend: float | None = None) -> DataFrame:
    """``df`` with the probability of rows in the band replaced by ``rescored`` (key, score), or blended with it by
    a weight. Rows without a new score, and those outside the band, keep theirs."""
    one = rescored.groupBy(key).agg(F.min("score").alias("_new"))
    joined = df.join(one, key, "left")
    new = F.col("_new") if blend is None else blend * F.col("_new") + (1 - blend) * F.col(proba)
    return joined.withColumn(proba, F.when(F.col(proba).between(low, high) & F.col("_new").isNotNull(), new).otherwise(F.col(proba))).drop("_new")
