"""The feature matrix of (term, item) pairs.

Terms and items are prepared once each: token sets, constraints, counts. A pair's features are then expressions
over the joined row, all in the JVM. Counts of a query's tokens are of those that occur in the catalog, as a
vocabulary fitted on the items sees them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import attrs, text, vocab
from ..functions.vectors import dot, head
from .popularity import brands, mentioned_brands, popularity_features

EPS = 1e-6


def item_text(*columns: str) -> Column:
    """The columns joined by blanks, nulls as empty texts."""
    return F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in columns))


def prepare_items(items: DataFrame) -> DataFrame:
    """items (item_id, title, category, brand, gender, age_group, attributes) with everything pair features read."""
    full = text.tokenize(item_text("title", "brand", "category"))
    i = items.withColumn("i_list", full)
    meta_gender, meta_age = attrs.label_of(F.col("gender"), vocab.GENDER_LABELS), attrs.label_of(F.col("age_group"), vocab.AGE_LABELS)
    said_gender = F.coalesce(attrs.intent(F.col("i_list"), vocab.GENDER_WORDS), F.lit("unknown"))
    said_age = F.coalesce(attrs.intent(F.col("i_list"), vocab.AGE_WORDS), F.lit("unknown"))
    return i.select(
        "item_id",
        F.coalesce("brand", F.lit("")).alias("brand"),
        F.array_distinct("i_list").alias("i_words"),
        F.array_distinct(text.stems(F.col("i_list"))).alias("i_stems"),
        text.char_ngrams(F.col("title")).alias("i_chars"),
        F.array_distinct(text.tokenize(F.col("category"))).alias("i_cat"),
        F.array_distinct(text.tokenize(text.last_level(F.col("category")))).alias("i_last"),
        attrs.attribute_words(F.col("attributes"), vocab.COLOR_KEYS, vocab.COLORS).alias("i_colors"),
        attrs.attribute_words(F.col("attributes"), vocab.MATERIAL_KEYS, vocab.MATERIALS).alias("i_materials"),
        attrs.attribute_words(F.col("attributes"), vocab.PATTERN_KEYS, vocab.PATTERNS).alias("i_patterns"),
        attrs.sizes(item_text("title", "attributes")).alias("i_sizes"),
        F.when(meta_gender != "unknown", meta_gender).otherwise(said_gender).alias("i_gender"),
        F.when(meta_age != "unknown", meta_age).otherwise(said_age).alias("i_age"),
        ((meta_gender != "unknown") & (said_gender != "unknown") & (meta_gender != said_gender)).cast("int").alias("item_gender_meta_title_conflict"),
        F.length(F.coalesce("title", F.lit(""))).alias("item_title_char_len"),
        F.size("i_list").alias("item_title_word_len"),
        F.regexp_count(F.coalesce("attributes", F.lit("")), F.lit(":")).alias("item_n_attrs"),
    )


def in_catalog(terms: DataFrame, grams: Column, catalog: DataFrame, catalog_grams: str, name: str) -> DataFrame:
    """term_id and the query's grams that occur in the catalog: a semi join on distinct grams."""
    known = catalog.select(F.explode(catalog_grams).alias("g")).distinct()
    met = terms.select("term_id", F.explode(F.array_distinct(grams)).alias("g")).join(known, "g", "left_semi")
    return met.groupBy("term_id").agg(F.count("*").cast("int").alias(name))


def prepare_terms(terms: DataFrame, prepared: DataFrame, items: DataFrame, least_brand_items: int = 20) -> DataFrame:
    """terms (term_id, query) with everything pair features read; ``prepared`` and ``items`` are the catalog's."""
    q = F.col("query")
    q_list = text.tokenize(q)
    empty = F.array().cast("array<string>")
    t = terms.select(
        "term_id",
        q_list.alias("q_list"),
        F.array_distinct(q_list).alias("q_words"),
        text.expand_tokens(q_list).alias("q_expanded"),
        F.array_distinct(text.stems(q_list)).alias("q_stems"),
        text.char_ngrams(q).alias("q_chars"),
        attrs.query_colors(q, F.array_distinct(q_list)).alias("q_colors"),
        F.array_intersect(F.array_distinct(q_list), text.strings(vocab.MATERIALS)).alias("q_materials"),
        F.array_intersect(F.array_distinct(q_list), text.strings(vocab.PATTERNS)).alias("q_patterns"),
        attrs.sizes(q).alias("q_sizes"),
        attrs.intent(q_list, vocab.GENDER_WORDS).alias("q_gender"),
        attrs.intent(q_list, vocab.AGE_WORDS).alias("q_age"),
        attrs.is_generic(q_list).cast("int").alias("is_generic_query"),
        F.size(q_list).alias("query_n_tokens"),
        F.coalesce(q.rlike(r"\d"), F.lit(False)).cast("int").alias("query_has_digit"),
    )
    t = t.join(in_catalog(terms, q_list, prepared, "i_words", "q_wc"), "term_id", "left").join(in_catalog(terms, text.char_ngrams(q), prepared, "i_chars", "q_cc"), "term_id", "left")
    t = t.join(mentioned_brands(terms, brands(items, least_brand_items)), "term_id", "left")
    colors, materials = text.with_synonyms(F.col("q_colors"), vocab.COLOR_SYNONYMS), text.with_synonyms(F.col("q_materials"), vocab.MATERIAL_SYNONYMS)
    return t.na.fill(0, ["q_wc", "q_cc"]).withColumns(
        {"q_brands": F.coalesce("brands", empty), "q_colors_more": F.array_intersect(colors, text.strings(vocab.COLORS)), "q_materials_more": F.array_intersect(materials, text.strings(vocab.MATERIALS))}
    ).drop("brands")


def _matches(prefix: str, query: str, wider: str | None, item: str) -> dict[str, Column]:
    q, i = F.col(query), F.col(item)
    hit = F.arrays_overlap(q, i)
    out = {f"{prefix}_match": hit.cast("int")}
    any_hit = hit
    if wider:
        any_hit = F.arrays_overlap(F.col(wider), i)
        out[f"{prefix}_match_expanded"] = any_hit.cast("int")
    return out | {f"{prefix}_conflict": ((F.size(q) > 0) & ~any_hit).cast("int")}


def lexical_features() -> dict[str, Column]:
    """Overlaps of words, expansions, stems, characters and category words."""
    c = F.col
    word, more, stem = text.overlap(c("q_words"), c("i_words")), text.overlap(c("q_expanded"), c("i_words")), text.overlap(c("q_stems"), c("i_stems"))
    char, cat = text.overlap(c("q_chars"), c("i_chars")), text.overlap(c("q_words"), c("i_cat"))
    last = text.overlap(c("q_words"), c("i_last"))
    per_query = lambda n: n / (c("q_wc") + EPS)
    return {
        "word_overlap_n": word,
        "word_jaccard": word / (c("q_wc") + F.size("i_words") - word + EPS),
        "word_recall": per_query(word),
        "expanded_overlap_n": more,
        "expanded_recall": per_query(more),
        "expanded_minus_word_overlap": more - word,
        "stem_overlap_n": stem,
        "stem_recall": per_query(stem),
        "char_jaccard": char / (c("q_cc") + F.size("i_chars") - char + EPS),
        "char_recall": char / (c("q_cc") + EPS),
        "has_any_word_overlap": (word > 0).cast("int"),
        "cat_word_overlap_n": cat,
        "cat_word_recall": per_query(cat),
        "cat_expanded_overlap_n": text.overlap(c("q_expanded"), c("i_cat")),
        "cat_last_level_overlap_n": last,
        "cat_last_level_recall": per_query(last),
        "cat_last_level_jaccard": last / (c("q_wc") + F.size("i_last") - last + EPS),
        "has_any_cat_overlap": (cat > 0).cast("int"),
    }


def constraint_features() -> dict[str, Column]:
    """Matches and conflicts of constraints, and what the query and the item say of themselves."""
    c = F.col
    return {
        **_matches("color", "q_colors", "q_colors_more", "i_colors"),
        **_matches("material", "q_materials", "q_materials_more", "i_materials"),
        **_matches("pattern", "q_patterns", None, "i_patterns"),
        **_matches("size", "q_sizes", None, "i_sizes"),
        "gender_contradiction": attrs.gender_contradiction(c("q_gender"), c("i_gender")),
        "age_contradiction": attrs.age_contradiction(c("q_age"), c("i_age")),
        "item_gender_meta_title_conflict": c("item_gender_meta_title_conflict"),
        "query_has_gender_word": c("q_gender").isNotNull().cast("int"),
        "query_has_age_word": c("q_age").isNotNull().cast("int"),
        "brand_contradiction": attrs.brand_contradiction(c("q_brands"), c("brand")),
        "query_has_brand_mention": (F.size("q_brands") > 0).cast("int"),
        "is_generic_query": c("is_generic_query"),
        "query_n_tokens": c("query_n_tokens"),
        "query_has_digit": c("query_has_digit"),
        "item_title_char_len": c("item_title_char_len"),
        "item_title_word_len": c("item_title_word_len"),
        "item_n_attrs": c("item_n_attrs"),
        "len_ratio": c("query_n_tokens") / (c("item_title_word_len") + EPS),
    }


def semantic_features(query: Column, title: Column, category: Column, short_query: Column, attribute: Column) -> dict[str, Column]:
    """Inner products of the vectors and their combinations."""
    t, g = dot(query, title), dot(query, category)
    return {"sim_title": t, "sim_category": g, "sim_attr": dot(short_query, attribute), "sim_title_minus_cat": t - g, "sim_max_title_cat": F.greatest(t, g), "sim_mean_title_cat": (t + g) / 2}


def pair_features(pairs: DataFrame, terms: DataFrame, items: DataFrame, popularity: DataFrame, least_brand_items: int = 20) -> DataFrame:
    """term_id, item_id (and label) with the lexical, constraint and popularity features of each pair.

    Every pair keeps its row: where the term or the item is unknown, all its features are 0. With a label the pair's
    own click is taken out of the counts.
    """
    prepared = prepare_items(items)
    rows = pairs.join(prepare_terms(terms, prepared, items, least_brand_items), "term_id", "left").join(prepared, "item_id", "left").join(popularity, "item_id", "left")
    label = F.col("label") if "label" in pairs.columns else None
    named = {**lexical_features(), **constraint_features()}
    known = F.col("q_wc").isNotNull() & F.col("i_words").isNotNull()
    told = rows.select(*pairs.columns, known.alias("_known"), *(v.alias(k) for k, v in named.items()), *popularity_features(F.col("item_clicks"), F.col("cat_mean_log"), F.col("brand_clicks"), label))
    return told.select(*(c if c in pairs.columns else F.when(F.col("_known") & F.col(c).isNotNull(), F.col(c)).otherwise(0).alias(c) for c in told.columns if c != "_known"))


def pair_matrix(pairs: DataFrame, terms: DataFrame, items: DataFrame, popularity: DataFrame, query_vectors: DataFrame, item_vectors: DataFrame, category_vectors: DataFrame, short: int = 16, roots: DataFrame | None = None, told: DataFrame | None = None) -> DataFrame:
    """All 51 features of each pair in one frame: those of ``pair_features`` and the six of vectors.

    Vectors (term_id, vec), (item_id, vec) and (item_id, vec) of the item's category are at unit length; their first
    ``short`` components stand for the short query's and the attributes' vectors. A pair without a vector has 0 there.

    Optional columns: ``roots`` (word, root), as an analyser gives them, adds root_overlap_n, the words of query and item
    that share a root (a word without a row is its own root); ``told`` (term_id, told_gender, told_age), what a language model read from the
    query, adds llm_gender_conflict and llm_age_conflict with the item's labels.
    """
    t, i, g = query_vectors.toDF("term_id", "_q"), item_vectors.toDF("item_id", "_i"), category_vectors.toDF("item_id", "_g")
    rows = pair_features(pairs, terms, items, popularity).join(t, "term_id", "left").join(i, "item_id", "left").join(g, "item_id", "left")
    named = semantic_features(F.col("_q"), F.col("_i"), F.col("_g"), head(F.col("_q"), short), head(F.col("_i"), short))
    rows = rows.select(*(c for c in rows.columns if c not in ("_q", "_i", "_g")), *(F.coalesce(v, F.lit(0.0)).alias(k) for k, v in named.items()))
    if roots is not None:
        rooted = lambda df, key, words: df.select(key, F.explode(words).alias("word")).join(roots, "word", "left").groupBy(key).agg(F.collect_set(F.coalesce("root", "word")).alias(f"_{key}"))
        rows = rows.join(rooted(terms, "term_id", token_set_of("query")), "term_id", "left").join(rooted(items, "item_id", text.token_set(item_text("title", "brand", "category"))), "item_id", "left")
        rows = rows.withColumn("root_overlap_n", F.coalesce(text.overlap(F.col("_term_id"), F.col("_item_id")), F.lit(0))).drop("_term_id", "_item_id")
    if told is not None:
        labels = items.select("item_id", attrs.label_of(F.col("gender"), vocab.GENDER_LABELS).alias("_gender"), attrs.label_of(F.col("age_group"), vocab.AGE_LABELS).alias("_age"))
        rows = rows.join(told.select("term_id", "told_gender", "told_age"), "term_id", "left").join(labels, "item_id", "left")
        rows = rows.withColumns({"llm_gender_conflict": F.coalesce(attrs.gender_contradiction(F.col("told_gender"), F.col("_gender")), F.lit(0)), "llm_age_conflict": F.coalesce(attrs.age_contradiction(F.col("told_age"), F.col("_age")), F.lit(0))})
        rows = rows.drop("told_gender", "told_age", "_gender", "_age")
    return rows


def channel_texts(pairs: DataFrame, terms: DataFrame, items: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """``pairs`` with recall, contain, qlen, gcon, acon, and with mined synonyms recall_syn and contain_syn.

    An empty query has recall 0 and is not contained.
    """
    empty = F.array().cast("array<string>")
    q = terms.select("term_id", "query", token_set_of("query").alias("q"))
    if synonyms is not None:
        both = synonyms.select("tok_a", "tok_b").union(synonyms.select("tok_b", "tok_a")).toDF("w", "s")
        near = q.select("term_id", F.explode("q").alias("w")).join(both, "w").groupBy("term_id", "w").agg(F.collect_set("s").alias("s"))
        wider = near.groupBy("term_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "s"))).alias("near"))
        q = q.join(wider, "term_id", "left")
    i = items.select("item_id", "title", "gender", "age_group", text.token_set(item_text("title", "category", "brand", "attributes")).alias("i"))
    rows = pairs.join(q, "term_id").join(i, "item_id")
    n, shared = F.size("q"), text.overlap(F.col("q"), F.col("i"))
    asked, had = attrs.coarse_query_gender(F.col("query")), attrs.coarse_gender(F.col("gender"), F.col("title"))
    age, item_age = attrs.coarse_query_age(F.col("query")), attrs.coarse_age(F.col("age_group"), F.col("title"))
    named = {
        "recall": F.when(n > 0, shared / n).otherwise(0.0),
        "contain": (n > 0) & (shared == n),
        "qlen": F.size(F.filter(F.split(text.normalize(F.col("query")), r"\s+"), lambda x: x != "")),
        "gcon": (((asked == 1) & (had == 2)) | ((asked == 2) & (had == 1))).cast("int"),
        "acon": (age.isin(1, 2) & (item_age == 3)).cast("int"),
    }
    if synonyms is not None:
        hit = F.size(F.filter("q", lambda w: F.array_contains("i", w) | F.coalesce(F.arrays_overlap(F.coalesce(F.try_element_at("near", w), empty), "i"), F.lit(False))))
        named |= {"recall_syn": F.when(n > 0, hit / n).otherwise(0.0), "contain_syn": ((n > 0) & (hit == n)).cast("int")}
    return rows.select(*pairs.columns, *(v.alias(k) for k, v in named.items()))


def token_set_of(column: str) -> Column:
    return text.token_set(F.col(column))


def numeric_features(df: DataFrame, keys: list[str], dropped: tuple[str, ...] = ()) -> list[str]:
    """Every numeric column that is no key, in the frame's order."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
    return [n for n, kind in df.dtypes if n not in keys and n not in dropped and (kind in kinds or kind.startswith("decimal"))]


def fill_missing(df: DataFrame, columns: list[str], value: float = 0.5) -> DataFrame:
    """Adds the columns that are not there, at a neutral value."""
    return df.withColumns({c: F.lit(value) for c in columns if c not in df.columns})
