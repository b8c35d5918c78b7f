"""Text functions on columns: nulls count as empty text, results are never null unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

Strings = list[str]


def strings(values: Strings) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def lookup(pairs: dict[str, str]) -> Column:
    """A literal map column."""
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def normalize(s: Column) -> Column:
    """Turkish lower case: İ becomes i and I becomes ı before the rest is lowered; a dot over an i is dropped."""
    return F.coalesce(F.replace(F.lower(F.translate(s, "İI", "iı")), F.lit("i\u0307"), F.lit("i")), F.lit(""))


def tokenize(s: Column, min_length: int = 2) -> Column:
    """Tokens in order, repeats kept."""
    return F.filter(F.split(normalize(s), vocab.SEPARATORS), lambda t: F.length(t) >= min_length)


def token_set(s: Column, min_length: int = 2, stop: Strings = vocab.STOP_WORDS) -> Column:
    """Distinct tokens without stop words."""
    return F.array_except(tokenize(s, min_length), strings(stop))


def type_tokens(s: Column, stop: Strings = vocab.TYPE_STOP_WORDS) -> Column:
    """Tokens of any length without the stop words of product types."""
    return F.filter(F.split(normalize(s), vocab.SEPARATORS), lambda t: (F.length(t) > 0) & ~F.array_contains(strings(stop), t))


def type_stem(t: Column) -> Column:
    """Three characters less of a long word, two less of a middling one."""
    n = F.length(t)
    return F.when(n > 6, F.substring(t, F.lit(1), n - 3)).when(n > 4, F.substring(t, F.lit(1), n - 2)).otherwise(t)


def stem(t: Column, suffixes: Strings = vocab.SUFFIXES, keep: int = 3) -> Column:
    """Drops the longest suffix of the list that leaves ``keep`` characters: the shortest such prefix is kept."""
    return F.regexp_replace(t, f"^(.{{{keep},}}?)(?:{'|'.join(suffixes)})$", "$1")


def stems(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: stem(t))


def ngrams(s: Column, n: int = 3) -> Column:
    """Distinct n-grams of a text as it is; a shorter text is one gram of its own, an empty one too."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(s, i, F.lit(n))))


def squeeze(s: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def char_ngrams(s: Column, n: int = 3) -> Column:
    """Distinct n-grams of the normalised, squeezed text; none of an empty one."""
    t = squeeze(normalize(s))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(ngrams(t, n))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(overlap(a, b) / F.size(F.array_union(a, b)))


def contained(a: Column, b: Column) -> Column:
    """Whether a has elements and all of them are in b."""
    return (F.size(a) > 0) & (F.size(F.array_except(a, b)) == 0)


def category_levels(path: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(path, F.lit("")), "/"), lambda x: F.trim(x)), lambda x: x != "")


def last_level(path: Column) -> Column:
    return F.coalesce(F.try_element_at(category_levels(path), F.lit(-1)), F.lit(""))


def neighbours(clusters: list[Strings]) -> dict[str, Strings]:
    """The other words of each word's cluster."""
    return {w: [x for x in c if x != w] for c in clusters for w in c}


def synonyms_of(clusters: list[Strings]) -> Column:
    """A literal map from a word to the others of its cluster."""
    near = neighbours(clusters)
    return F.create_map(*(x for w, others in near.items() for x in (F.lit(w), strings(others))))


def with_synonyms(tokens: Column, clusters: list[Strings]) -> Column:
    """Distinct tokens and the other words of their clusters."""
    near = synonyms_of(clusters)
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(tokens, F.flatten(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(near, t), empty)))))


def bigrams(tokens: Column, between: str = "") -> Column:
    """Each token joined to the next."""
    n = F.size(tokens)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.get(tokens, i - 1), F.lit(between), F.get(tokens, i)))
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<string>"))


def expand_tokens(tokens: Column, clusters: list[Strings] = vocab.SYNONYMS) -> Column:
    """Distinct tokens, their synonyms, and each token joined to the next."""
    return F.array_distinct(F.concat(with_synonyms(tokens, clusters), bigrams(tokens)))


def stem_match(a: Column, b: Column, least: int = 4, drop: int = 2) -> Column:
    """Whether two words of at least ``least`` characters agree on all but the last ``drop`` of the shorter."""
    n = F.greatest(F.lit(least), F.least(F.length(a), F.length(b)) - drop)
    return (F.length(a) >= least) & (F.length(b) >= least) & (F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))


def expanded_match(query: Column, target: Column, clusters: list[Strings] = vocab.SYNONYMS) -> Column:
    """How many query tokens the target covers: two by a joined pair, left to right; else one by itself, a synonym
    or a stem match."""
    near = synonyms_of(clusters)
    n = F.size(query)
    # Greedy pass: the index after the last pair taken decides whether the next may be.
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("taken"))

    def take(state: Column, i: Column) -> Column:
        hit = (i >= state.next) & F.array_contains(target, F.concat(F.get(query, i), F.get(query, i + 1)))
        return F.struct(F.when(hit, i + 2).otherwise(state.next).alias("next"), F.when(hit, F.concat(state.taken, F.array(i, i + 1))).otherwise(state.taken).alias("taken"))

    places = F.when(n > 1, F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    taken = F.aggregate(places, start, take, lambda s: s.taken)
    rest = F.filter(F.transform(query, lambda t, i: F.when(~F.array_contains(taken, i), t)), lambda t: t.isNotNull())

    def covered(t: Column) -> Column:
        by_synonym = F.coalesce(F.arrays_overlap(F.try_element_at(near, t), target), F.lit(False))
        return F.array_contains(target, t) | by_synonym | F.exists(target, lambda x: stem_match(t, x))

    return F.size(taken) + F.size(F.filter(rest, covered))


def deasciify(s: Column) -> Column:
    """Turkish letters folded to ASCII ones, in lower case: a key to look up by."""
    return F.translate(F.lower(F.translate(F.coalesce(s, F.lit("")), "İIŞĞÜÖÇ", "iisguoc")), "ışğüöç", "isguoc")


def words(s: Column) -> Column:
    """Runs of letters."""
    return F.regexp_extract_all(F.lower(F.translate(F.coalesce(s, F.lit("")), "İI", "ii")), F.lit("[a-zçğıöşü]+"), F.lit(0))


def numbers(s: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(s, F.lit(r"\d+"), F.lit(0)))


def one_line(s: Column) -> Column:
    return F.trim(F.translate(F.coalesce(s, F.lit("")), "\n", " "))


def clip(s: Column, n: int) -> Column:
    """The first n characters of a one-line text."""
    return F.substring(one_line(s), 1, n)


def labelled_text(parts: dict[str, Column], empty: Strings = ("unknown",), limit: int = 200) -> Column:
    """``label: value`` segments between bars; empty values and those of ``empty``, taken whole, are left out."""
    segments = []
    for label, value in parts.items():
        whole, v = one_line(value), clip(value, limit)
        segments.append(F.when((v != "") & ~whole.isin(*empty), F.concat(F.lit(f"{label}: ") if label else F.lit(""), v)))
    return F.concat_ws(" | ", *segments)


def json_block(s: Column, schema: str) -> Column:
    """The object from the first brace to the last, parsed; null where there is none or it does not parse."""
    return F.from_json(F.nullif(F.regexp_extract(s, r"(?s)\{.*\}", 0), F.lit("")), schema)
