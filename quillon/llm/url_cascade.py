"""URL filters by a cascade of Bloom filters.

A rule is a host and a path prefix with a verdict. Every key that could decide a url (each suffix of its host
with each prefix of its path of a length that rules have) is looked up in a cascade: its first level encodes the
listed keys, the second those keys of the corpus that the first lets through wrongly, the third the listed
keys that the second lets through, and so on until none are left. Over the corpus's keys, membership is exact,
and looking up takes no join. Levels grow with the list, not with the corpus: the first level's error rate is
set so that about as many false keys pass as are listed. A list whose levels would be too large to broadcast is cut
by a hash of the key into parts; each part has a cascade of its own, and the pages pass them one after another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, lean

#: Bits of a level that are broadcast at most, 32 MB; a longer list is cut into parts.
MOST_BITS = 2**28
_SEEDS = (0x51ED270B, 0x7FEB352D)
HASHED = "h1 long, h2 long"


@dataclass
class Level:
    bits: int
    hashes: int
    words: np.ndarray  # u64


@dataclass
class Cascade:
    levels: list[Level]

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Exact membership of keys of the universe the cascade was made for, by their two hashes."""
        inside = np.zeros(len(h1), bool)
        live = np.arange(len(h1))
        for depth, level in enumerate(self.levels):
            passed = _probe(level, depth, h1[live], h2[live])
            # Who stops at an even depth is not listed, at an odd one it is; so is who passes a last listed level.
            inside[live] = depth % 2 == 0
            inside[live[~passed]] = depth % 2 == 1
            live = live[passed]
        return inside


def _positions(bits: int, hashes: int, depth: int, h1: np.ndarray, h2: np.ndarray) -> Iterator[np.ndarray]:
    a = h1.view(np.uint64) ^ (np.uint64(depth * 0x9E3779B97F4A7C15 % 2**64))
    b = h2.view(np.uint64) | np.uint64(1)
    for i in range(hashes):
        x = a + np.uint64(i) * b
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        yield x % np.uint64(bits)


def _probe(level: Level, depth: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    passed = np.ones(len(h1), bool)
    for p in _positions(level.bits, level.hashes, depth, h1, h2):
        passed &= (level.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return passed


def _bits(batches: Iterator[pa.RecordBatch], bits: int, hashes: int, depth: int) -> Iterator[pa.RecordBatch]:
    """(word, mask) for the bits of the keys of each batch."""
    for batch in batches:
        h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
        every = np.unique(np.concatenate([*_positions(bits, hashes, depth, h1, h2), np.zeros(0, np.uint64)]))
        word, mask = (every >> np.uint64(6)).astype(np.int64), np.uint64(1) << (every & np.uint64(63))
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], names=["word", "mask"])


def _bits_for(n: int, rate: float) -> int:
    return max(64, ceil(-n * log(rate) / log(2) ** 2))


def _first_rate(n: int, universe: int, rate: float = 0.5) -> float:
    """The first level's error rate: about as many false keys pass as are listed."""
    return min(max(0.7 * n / max(universe, 1), 1e-9), rate)


def parts_needed(n: int, universe: int) -> int:
    """Into how many parts a list of n keys is cut, so that each part's first level may be broadcast."""
    return ceil(_bits_for(n, _first_rate(n, universe)) / MOST_BITS)


def part_of(h2: Column, parts: int) -> Column:
    return F.pmod(h2, F.lit(parts))


def _level(keys: DataFrame, n: int, rate: float, depth: int) -> Level:
    hashes, bits = max(1, round(-log2(rate))), _bits_for(n, rate)
    made = keys.mapInArrow(lean(partial(_bits, bits=bits, hashes=hashes, depth=depth)), "word long, mask long")
    words = np.zeros(bits // 64 + 1, np.uint64)
    got = made.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # bounded by the bits of the level
    words[got.column("word").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
    return Level(bits, hashes, words)


def _passing(batches: Iterator[pa.RecordBatch], shared: Broadcast, depth: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        passed = _probe(shared.value, depth, batch.column("h1").to_numpy(), batch.column("h2").to_numpy())
        yield batch.filter(pa.array(passed))


def _size(universe: DataFrame) -> int:
    """Distinct keys, within a few per cent: it sets a rate, nothing more."""
    return universe.agg(F.approx_count_distinct(F.col("h1")).alias("n")).first().n


def build_cascade(listed: DataFrame, universe: DataFrame, rate: float = 0.5) -> Cascade:
    """The cascade of ``listed`` keys over ``universe`` (h1, h2: two hashes of a key, repeats allowed).

    Each pass over the universe is a scan; what survives it, about as many keys as are listed, is kept.
    """
    spark = universe.sparkSession
    here = cut(listed.select("h1", "h2").distinct(), "listed")
    n_here = here.count()
    if not n_here:
        return Cascade([])
    first = _first_rate(n_here, _size(universe), rate)
    levels, other, n_other = [], None, 1
    while n_here:
        depth = len(levels)
        levels.append(_level(here, n_here, first if not depth else rate, depth))
        if depth > 200:
            raise ValueError("two keys have the same hashes")
        shared = spark.sparkContext.broadcast(levels[-1])
        through = (universe.select("h1", "h2") if other is None else other).mapInArrow(lean(partial(_passing, shared=shared, depth=depth)), HASHED)
        if other is None:
            through = through.distinct().join(here, ["h1", "h2"], "left_anti")
        through = cut(through, "passed")
        n_other = through.count()
        here, other, n_here, n_other = through, here, n_other, n_here
    return Cascade(levels)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url: the host stands after the first ``://`` up to ``/``, ``?``,
    ``#`` or the end, the path from there up to ``?``, ``#`` or the end. Null, or no ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Every rule that could fit: for each shape (labels of a host, characters of a path) that rules have, the host's
    last labels with the path's first characters, longest first; of two as long, the one with the longer host."""
    dots = F.length(host) - F.length(F.translate(host, ".", ""))
    own = []
    for n_labels, n in shapes:
        h = F.substring_index(host, ".", -n_labels)
        pair = F.struct((-F.length(h) - n).alias("order"), (-F.length(h)).alias("host"), F.concat(h, F.substring(path, 1, n)).alias("rule"))
        own.append(F.when((dots + 1 >= n_labels) & (F.length(path) >= n), pair))
    pairs = F.filter(F.array(*own), lambda p: p.isNotNull())
    return F.when(host != "", F.transform(F.array_sort(pairs), lambda x: x.rule)).otherwise(F.array().cast("array<string>"))


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key, F.lit(_SEEDS[0])), F.xxhash64(F.lit(_SEEDS[1]), key)


def _judge(batches: Iterator[pa.RecordBatch], shared: Broadcast, part: int, parts: int) -> Iterator[pa.RecordBatch]:
    """The first key of each page that a verdict's list holds, where it lies in this part and before what was found so far."""
    cascades: dict[str, Cascade] = shared.value
    for batch in batches:
        keys = batch.column("keys")
        counts = keys.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = keys.flatten()
        h1, h2 = flat.field("h1").to_numpy(zero_copy_only=False), flat.field("h2").to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(h1)) - np.repeat(np.cumsum(counts) - counts, counts)
        if parts > 1:
            here = np.flatnonzero(h2 % parts == part)
            h1, h2, owner, place = h1[here], h2[here], owner[here], place[here]
        hit = batch.column("rule_at").to_numpy(zero_copy_only=False).astype(np.int64)
        verdict = np.array(batch.column("rule_verdict").to_pylist(), object)
        for name, cascade in cascades.items():
            found = np.flatnonzero(cascade.has(h1, h2))[::-1]  # so that the first of each url is written last
            first = np.full(len(counts), np.iinfo(np.int64).max)
            first[owner[found]] = place[found]
            better = (first < np.iinfo(np.int64).max) & ((hit < 0) | (first < hit))
            hit[better], verdict[better] = first[better], name
        rest = [c for c in batch.schema.names if c not in ("rule_at", "rule_verdict")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in rest), pa.array(hit.astype(np.int32)), pa.array(verdict, pa.string())], names=[*rest, "rule_at", "rule_verdict"]
        )


def judge_urls(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict of each row's ``url``.

    ``rules`` has rule (a host, then a path from its first ``/``; without one, ``/`` is meant) and verdict. A rule
    fits its host and all subdomains where the url's path starts with the rule's; the longest rule that fits
    decides, and ``otherwise`` where none does. Where two verdicts list the same rule, the first in their order
    counts. A url with an empty path has no path that a rule could start. Null urls, and urls without ``://``, have
    an empty host and path and no rule. Columns of pages by these names are replaced. An empty table, or no
    rules, is fine. A url of any length gives at most one key for each shape of a rule (labels of its host,
    characters of its path). The driver holds one row of each shape, and of each verdict.
    """
    spark = pages.sparkSession
    rule = F.when(F.contains("rule", F.lit("/")), F.col("rule")).otherwise(F.concat("rule", F.lit("/")))
    cleaned = cut(rules.filter("rule is not null and verdict is not null").select(rule.alias("rule"), "verdict").distinct(), "rules")
    own = F.substring_index("rule", "/", 1)
    n_labels, length = F.length(own) - F.length(F.translate(own, ".", "")) + 1, F.length("rule") - F.length(own)
    shapes = sorted(tuple(r) for r in cleaned.select(n_labels.alias("labels"), length.alias("length")).distinct().collect())
    host, path = split_url(F.col("url"))
    rest = pages.drop("host", "path", "rule", "verdict", "rule_at", "rule_verdict", "keys")
    split = rest.withColumn("host", host).withColumn("path", path)
    keys = candidate_keys(F.col("host"), F.col("path"), shapes) if shapes else F.array().cast("array<string>")
    h1, h2 = hashes(F.col("key"))
    universe = split.select("host", "path").distinct().select(F.explode(keys).alias("key")).select(h1.alias("h1"), h2.alias("h2"))
    universe = cut(universe.distinct(), "keys")
    h1, h2 = hashes(F.col("rule"))
    listed = cleaned.select("verdict", h1.alias("h1"), h2.alias("h2"))
    counted = {r.verdict: r.n for r in listed.groupBy("verdict").agg(F.count("*").alias("n")).orderBy("verdict").collect()}
    size = _size(universe) if counted else 0
    parts = max([1, *(parts_needed(n, size) for n in counted.values())])
    pairs = F.transform(keys, lambda k: F.struct(hashes(k)[0].alias("h1"), hashes(k)[1].alias("h2")))
    judged = split.withColumn("keys", pairs).withColumn("rule_at", F.lit(-1)).withColumn("rule_verdict", F.lit(None).cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in judged.schema if f.name not in ("rule_at", "rule_verdict"))
    for part in range(parts):
        here = [x if parts == 1 else x.filter(part_of(F.col("h2"), parts) == part) for x in (listed, universe)]
        cascades = {v: build_cascade(here[0].filter(F.col("verdict") == v), here[1]) for v in counted}
        shared = spark.sparkContext.broadcast(cascades)
        judged = judged.mapInArrow(lean(partial(_judge, shared=shared, part=part, parts=parts)), f"{schema}, rule_at int, rule_verdict string")
        if parts > 1:  # one part's cascades are held at a time
            judged = cut(judged, "judged")
            shared.unpersist()
    found = F.when(F.col("rule_at") >= 0, F.get(keys, F.col("rule_at")))
    return judged.select(*split.columns, found.alias("rule"), F.coalesce("rule_verdict", F.lit(otherwise)).alias("verdict"))
