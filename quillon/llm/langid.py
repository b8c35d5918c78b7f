"""Language identification by nearest centroid over TF-IDF vectors of character n-grams.

Each language has several centroids, found by clustering its own labelled texts on the sphere. A text takes
the language of the centroid of highest cosine and is rejected when even that one is too far.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import groups_of, lean, plain_strings, text_bytes, text_runs

#: Hashed n-grams of the normalised text: letters in lower case, every other run as one blank.
DIMENSIONS = 8192
ORDERS = (2, 3)
UNKNOWN = "und"
#: The floor of a best cosine, as a share of what all but one in 500 training texts reach: clean texts of a few words
#: lie at less than half of it, texts of other scripts at less than a tenth.
FLOOR, FAR_SHARE = 0.3, 0.002
#: Bins of cosines from 0 to 1 in which training texts are counted for the floor.
BINS = 4001


@dataclass
class Model:
    langs: list[str]
    lang_of: np.ndarray  # of each centroid
    centroids: np.ndarray  # unit rows
    idf: np.ndarray
    floor: float  # a best cosine below it is a rejection


def nothing_learned() -> Model:
    return Model([], np.zeros(0, int), np.zeros((0, DIMENSIONS)), np.ones(DIMENSIONS), 0.0)


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its lower case where it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def counts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-gram counts of each text (a row per text), and how many letters each has."""
    n = len(offsets) - 1
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]  # code points before each text
    # Each text gets a blank on either side; runs of blanks count once.
    letters = np.zeros(len(points) + 2 * n, np.uint32)
    letters[np.arange(len(points)) + np.repeat(2 * np.arange(n) + 1, np.diff(before))] = _letters()[points]
    begins = before[:-1] + 2 * np.arange(n)
    keep = letters > 0
    keep[1:] |= letters[:-1] > 0
    keep[begins] = True
    owner = np.zeros(len(letters), np.int64)
    owner[begins[1:]] = 1
    owner = np.cumsum(owner)[keep]
    letters = letters[keep].astype(np.uint64)
    out = np.zeros(n * DIMENSIONS)
    for k in ORDERS:
        m = len(letters) - k + 1
        if m <= 0:
            continue
        h = np.full(m, k, np.uint64)
        for j in range(k):
            h = (h ^ letters[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        own = owner[:m]
        whole = owner[k - 1 :] == own
        out += np.bincount((own * DIMENSIONS + (h >> np.uint64(20)).astype(np.int64) % DIMENSIONS)[whole], minlength=n * DIMENSIONS)
    return out.reshape(n, DIMENSIONS), np.bincount(owner[letters > 0], minlength=n)


def _chunks(texts: pa.Array, most_rows: int = 400) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, b in text_runs(texts, 1_000_000):
        for x in range(a, b, most_rows):
            y = min(x + most_rows, b)
            yield x, y, *counts(*text_bytes(texts, x, y))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def centres_of(texts: pa.Array, idf: np.ndarray, clusters: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of one language's texts. Starts from texts at even ranks of nearness to their mean, so it is
    deterministic and no few odd texts make a centroid of their own."""
    rows = [_unit(np.log1p(m.astype(np.float32)) * idf.astype(np.float32))[n > 0] for _, _, m, n in _chunks(texts)]
    own = np.concatenate(rows) if rows else np.zeros((0, DIMENSIONS), np.float32)
    if not len(own):
        return own
    ranked = np.argsort(own @ own.sum(axis=0), kind="stable")
    k = min(clusters, len(own))
    centre = own[ranked[(2 * np.arange(k) + 1) * len(own) // (2 * k)]]
    for _ in range(rounds):
        near = np.argmax(own @ centre.T, axis=1)
        centre = _unit(np.stack([own[near == j].sum(axis=0) if (near == j).any() else centre[j] for j in range(len(centre))]))
    # A cluster of a few odd texts is not a way of writing the language.
    near = np.argmax(own @ centre.T, axis=1)
    solid = np.bincount(near, minlength=len(centre)) >= max(2, 0.02 * len(own))
    return centre[solid] if solid.any() else centre


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of this task hold each n-gram, and at -1 how many have letters."""
    held, n = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for _, _, matrix, letters in _chunks(plain_strings(batch.column("text"))):
            held += (matrix[letters > 0] > 0).sum(axis=0)
            n += int((letters > 0).sum())
    some = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(held[some], n))], names=["gram", "n"])


def _fit_task(batches: Iterator[pa.RecordBatch], shared: Broadcast, clusters: int) -> Iterator[pa.RecordBatch]:
    for group in groups_of(batches, ["lang"]):
        centre = centres_of(plain_strings(group.column("text")), shared.value, clusters)
        if len(centre):
            yield pa.RecordBatch.from_arrays([pa.array([group.column("lang")[0].as_py()]), pa.array([centre.astype(np.float32).tobytes()])], names=["lang", "centroids"])


def _nearness(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """How many texts of this task have their language's best cosine in each bin."""
    model, held = shared.value, np.zeros(BINS, np.int64)
    number = {name: k for k, name in enumerate(model.langs)}
    for batch in batches:
        own = np.array([number.get(x, -1) for x in batch.column("lang").to_pylist()])
        for a, b, matrix, letters in _chunks(plain_strings(batch.column("text"))):
            cosine = np.where(model.lang_of == own[a:b, None], cosines(model, matrix), -1).max(axis=1, initial=-1)
            held += np.bincount((np.clip(cosine[(letters > 0) & (cosine >= 0)], 0, 1) * (BINS - 1)).astype(int), minlength=BINS)
    some = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(held[some])], names=["bin", "n"])


def train(labelled: DataFrame, per_language: int = 400, clusters: int = 4, most_languages: int = 500) -> Model:
    """Fit on rows (text, lang); rows without a language or text are not learned from.

    Document frequencies and the floor are taken over all of them. The centroids of each language come from at most
    ``per_language`` of its distinct texts, those of smallest hash; each language is fitted in a task of its own. Only
    the ``most_languages`` of most texts are learned (ties in order of name), so that a noisy column gives no model
    beyond that size. Both bounds are parameters. No usable rows: nothing is learned.
    """
    spark = labelled.sparkSession
    rows = labelled.filter("lang is not null and text is not null").select("text", "lang", F.xxhash64("text").alias("order"))
    grams = dict(rows.select("text").mapInArrow(lean(_frequencies), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect())  # at most DIMENSIONS + 1
    if not grams.get(-1):
        return nothing_learned()
    df = np.array([grams.get(k, 0) for k in range(DIMENSIONS)])
    idf = np.log((1 + grams[-1]) / (1 + df)) + 1
    # A row per language: hashes up to the bound hold four times the sample, so few rows meet to be ranked.
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("order").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    bound = F.least(F.lit(1.0), F.lit(4.0 * per_language) / F.col("n")) * 2.0**64 - 2.0**63
    low = rows.select("lang", "order").join(F.broadcast(sizes), "lang").filter(F.col("order") <= bound).select("lang", "order")
    # Copies of a text count once, or one large group of them would be all of the sample.
    ranked = low.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order")))
    chosen = ranked.filter(F.col("rank") <= per_language).drop("rank")  # per_language rows of each language: broadcast
    sample = rows.join(F.broadcast(chosen), ["lang", "order"]).dropDuplicates(["lang", "order"])
    fit = partial(_fit_task, shared=spark.sparkContext.broadcast(idf), clusters=clusters)
    got = sample.repartition("lang").sortWithinPartitions("lang", "order").mapInArrow(lean(fit), "lang string, centroids binary").orderBy("lang").collect()
    if not got:
        return nothing_learned()
    each = [np.frombuffer(r.centroids, np.float32).reshape(-1, DIMENSIONS) for r in got]
    model = Model([r.lang for r in got], np.repeat(np.arange(len(got)), [len(x) for x in each]), np.concatenate(each).astype(np.float64), idf, 0.0)
    near = rows.select("text", "lang").mapInArrow(lean(partial(_nearness, shared=spark.sparkContext.broadcast(model))), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").collect()
    # Clean texts of a few words lie far out too: the floor is well below what nearly all training texts reach.
    total, before = sum(r.n for r in near), 0
    for r in near:
        before += r.n
        if before > FAR_SHARE * total:
            model.floor = FLOOR * r.bin / (BINS - 1)
            break
    return model


def cosines(model: Model, matrix: np.ndarray) -> np.ndarray:
    """Cosine of each row of n-gram counts with each centroid."""
    weights = np.log1p(matrix) * model.idf
    norm = np.sqrt((weights * weights).sum(axis=1))
    return (weights @ model.centroids.T) / np.where(norm > 0, norm, 1)[:, None]


def score(model: Model, matrix: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine and rejection of each row of n-gram counts."""
    if not len(model.langs):
        return [UNKNOWN] * len(matrix), np.zeros(len(matrix)), np.ones(len(matrix), bool)
    cosine = cosines(model, matrix)
    best = np.argmax(cosine, axis=1)
    top = np.clip(cosine[np.arange(len(best)), best], 0, 1)
    known = letters > 0
    return [model.langs[k] if ok else UNKNOWN for k, ok in zip(model.lang_of[best], known, strict=True)], np.where(known, top, 0), ~known | (top < model.floor)


def _predict(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        for a, b, matrix, letters in _chunks(plain_strings(batch.column("text"))):
            part = batch.slice(a, b - a)
            names, cosine, rejected = score(model, matrix, letters)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(cosine), pa.array(rejected)], names=[*part.schema.names, "lang_pred", "lang_score", "lang_rejected"])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred (a learned language, or ``und``), lang_score (cosine, 0 to 1) and lang_rejected.

    A null text, or one without letters, is ``und`` with score 0 and rejected; so is every text if nothing was
    learned. Among languages of equal cosine the first in order of name wins. Whole texts count, whatever
    their length. Only ``text`` is read for the decision; the other columns pass, columns of the three names
    are replaced.
    """
    rest = docs.drop("lang_pred", "lang_score", "lang_rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(lean(partial(_predict, shared=shared)), f"{schema}, lang_pred string, lang_score double, lang_rejected boolean")


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text divides by 5. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0, F.lit(False))
