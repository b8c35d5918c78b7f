"""Near-duplicate documents by a signature-coordinate inverted join of MinHash signatures.

Each distinct set of word shingles has a signature of ``COORDINATES`` minima. A document is posted under its
(coordinate, value) pairs; two sets of similarity s share a binomial number of pairs around s * COORDINATES,
so pairs with fewer than ``matches`` collisions are not candidates. Lists are merged with prefixes: with pairs
ordered from rare to frequent, two documents with that many collisions share one among the first
COORDINATES - matches + 1 of each, so only those are posted and lists of frequent pairs are skipped.

Candidates are confirmed on the full shingle sets. What leaves a posting list or a group of candidates is a
forest of links, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Links, connected_components, group_forests
from .shared import as_batch, cut, lean, plain_strings, text_bytes, text_runs

COORDINATES = 48
SIGNED = "doc_id long, n_shingles long, set_key binary, sig array<long>"
_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("sig", pa.list_(pa.int64()))])
_SETS = pa.schema([("grp", pa.int64()), ("id", pa.int64()), ("weight", pa.int64()), ("members", pa.binary())])
#: Candidate ids up to this count are broadcast to find their texts; beyond it the texts are joined by a shuffle.
BROADCAST_IDS = 400_000


def matches_needed(similarity: float, coordinates: int = COORDINATES, loss: float = 2e-6) -> int:
    """The largest collision count that a pair of ``similarity`` misses with a chance of at most ``loss``."""
    missed = 0.0
    for i in range(coordinates):
        missed += comb(coordinates, i) * similarity**i * (1 - similarity) ** (coordinates - i)
        if missed > loss:
            return max(i, 1)
    return coordinates


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _odd(seed: int, n: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A random number for each byte, the same for both cases of A-Z, none for white space.
_BYTE = _odd(1, 256)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BYTE[_SPACE] = 0
_BASE = np.uint64(0xD6E8FEB86659FD93)
_PLACE, _SHORT = _odd(2, 64), _odd(3, 64)
_TIMES, _PLUS = _odd(4, COORDINATES), _odd(5, COORDINATES)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text, and where each text's words begin (one more than texts).

    Words are runs of other bytes than white space; A-Z count as a-z.
    """
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(raw)]
    begins[firsts] |= solid[firsts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    spans = np.diff(np.append(starts, len(raw)))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, spans)
    powers = np.ones(int(spans.max()), np.uint64)
    powers[1:] = _BASE
    powers = np.multiply.accumulate(powers)
    hashed = np.add.reduceat(_BYTE[raw[starts[0] :]] * powers[place], starts - starts[0])
    return _mixed(hashed), np.searchsorted(starts, offsets)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles, with repeats, and where each text's begin. A text of fewer words than
    ``width`` has one shingle of them all; one without words has none."""
    words, at = word_hashes(raw, offsets)
    counts = np.diff(at)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(ends[-1], np.uint64)
    n = max(len(words) - width + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled += words[k : k + n] * _PLACE[k]
    full = counts >= width
    take = np.repeat(at[:-1][full], sizes[full]) + _within(sizes[full])
    out[np.repeat(ends[:-1][full], sizes[full]) + _within(sizes[full])] = rolled[take]
    for d in np.flatnonzero((counts > 0) & ~full).tolist():
        own = words[at[d] : at[d + 1]]
        out[ends[d]] = (own * _PLACE[: len(own)]).sum(keepdims=True)[0] ^ _SHORT[len(own)]
    return _mixed(out), ends


def _within(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def signatures(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The minima of each text that has shingles, a row per text; each value also tells its coordinate."""
    some = np.flatnonzero(np.diff(ends))
    out = np.empty((len(some), COORDINATES), np.uint64)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat(hashes * _TIMES[k] + _PLUS[k], ends[some]) ^ _PLACE[k] if len(some) else 0
    return out.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ids = plain_strings(batch.column("text")), batch.column("doc_id").to_pylist()
        for a, b in text_runs(texts):
            hashes, ends = shingle_sets(*text_bytes(texts, a, b), width)
            sig, row = signatures(hashes, ends), 0
            out: dict[str, list] = {f.name: [] for f in _SIGNED}
            for d in range(b - a):
                own = np.unique(hashes[ends[d] : ends[d + 1]])
                out["doc_id"].append(ids[a + d])
                out["n_shingles"].append(len(own))
                out["set_key"].append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                out["sig"].append(sig[row] if len(own) else None)
                row += bool(len(own))
            yield as_batch(_SIGNED, out)


def _members(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ids, groups = plain_strings(batch.column("text")), batch.column("id"), batch.column("grp")
        for a, b in text_runs(texts):
            hashes, ends = shingle_sets(*text_bytes(texts, a, b), width)
            sets = [np.unique(hashes[ends[d] : ends[d + 1]]).tobytes() for d in range(b - a)]
            yield pa.RecordBatch.from_arrays([groups.slice(a, b - a), ids.slice(a, b - a), pa.array([len(x) for x in sets], pa.int64()), pa.array(sets, pa.binary())], schema=_SETS)


class SignatureLinks(Links):
    """Members link if at least ``matches`` coordinates collide."""

    def __init__(self, matches: int):
        self.matches = matches

    def load(self, batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("sig").flatten().to_numpy().reshape(batch.num_rows, -1)

    def row(self, members: np.ndarray, i: int, n: int) -> np.ndarray:
        return np.flatnonzero((members[:n] == members[i]).sum(axis=1) >= self.matches)


class SetLinks(Links):
    """Members link if 100 * intersection >= percent * union of their sets, counted by an inverted index."""

    def __init__(self, percent: int):
        self.percent = percent

    def load(self, batch: pa.RecordBatch) -> tuple:
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column("members")]
        sizes = np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        begins = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        spans = np.diff(np.append(begins, len(ranked)))
        term = np.empty(len(every), np.int64)
        term[order] = np.repeat(np.arange(len(begins)), spans)
        owners = np.repeat(np.arange(len(sets)), sizes)[order]  # of each term, in rising order
        return np.split(term, np.cumsum(sizes)[:-1]), sizes, begins, spans, owners

    def row(self, members: tuple, i: int, n: int) -> np.ndarray:
        terms, sizes, begins, spans, owners = members
        own = terms[i][spans[terms[i]] > 1]
        lengths = spans[own]
        found = owners[np.repeat(begins[own], lengths) + _within(lengths)]
        shared = np.bincount(found[found < n], minlength=n)
        return np.flatnonzero((shared > 0) & (100 * shared >= self.percent * (sizes[:n] + sizes[i] - shared)))


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text).

    Documents link if 100 * intersection >= percent * union of their sets of ``width``-word shingles.
    component_id is the smallest doc_id reached over links, kept tells whether it is the document's own. A
    link of similarity ``percent`` is missed with a chance below 2e-6, a closer one with less; what is found is
    confirmed on full sets and is always a link.

    A text without words, or null, has an empty set and links with nothing. Documents of equal sets are one
    vertex. Rows that repeat an id count as one document that holds all their links. A row without an id takes
    no part: its component_id is null and it is kept. Other columns are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut(rows.mapInArrow(lean(partial(_sign, width=width)), SIGNED), "signatures")
    classes = cut(
        signed.filter("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.min_by("sig", "doc_id").alias("sig")),
        "classes",
    )
    found = cut(connected_components(_candidates(classes, matches_needed(percent / 100))), "candidates")
    few = found.count() <= BROADCAST_IDS
    texts = rows.join((F.broadcast if few else lambda x: x)(found.select(F.col("id").alias("doc_id"), F.col("component").alias("grp"))), "doc_id")
    sets = texts.select("grp", F.col("doc_id").alias("id"), "text").mapInArrow(lean(partial(_members, width=width)), "grp long, id long, weight long, members binary")
    links = cut(group_forests(sets.filter("weight > 0"), partial(SetLinks, percent), block=1000), "links")
    component = connected_components(links)
    shared = classes.filter("copies > 1").select("set_key", F.col("id").alias("first_id"))
    with_class = signed.select("doc_id", "n_shingles", "set_key").join(shared, "set_key", "left").withColumn("id", F.coalesce("first_id", "doc_id"))
    out = with_class.join(component, "id", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _candidates(classes: DataFrame, matches: int) -> DataFrame:
    """A forest over pairs of classes with enough collisions."""
    posts = classes.select("id", F.explode("sig").alias("grp"))
    shared = posts.groupBy("grp").agg(F.count("*").alias("df")).filter("df > 1")
    prefix = (
        posts.join(shared, "grp")
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("df", "grp"))).alias("pairs"))
        .filter(F.size("pairs") >= matches)
        # A pair that no other document has stands first in the order: COORDINATES - size of them are behind us.
        .select("id", F.explode(F.expr(f"slice(pairs, 1, size(pairs) - {matches} + 1)")).alias("pair"))
        .select("id", F.col("pair.grp").alias("grp"))
    )
    with_sig = prefix.join(classes.select("id", "sig"), "id").withColumn("weight", F.lit(8 * COORDINATES))
    return cut(group_forests(with_sig, partial(SignatureLinks, matches)), "collisions")
