"""Queries over text functions, constraints and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import attrs, text, vocab
from ..operators import features, popularity, rules, scorers, typo
from ..operators.sets import union_first
from . import bindings as b
from .bindings import inter, norm, table, tok, token_set


def _joined(column) -> F.Column:
    return F.array_join(F.sort_array(column), " ")


def cooccurrence_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair is positive if query and item share a token."""
    q = b.terms(spark, sf_dir).select("term_id", text.token_set(F.col("query")).alias("q"))
    i = b.items(spark, sf_dir).select("item_id", text.token_set(features.item_text("title", "brand", "category")).alias("i"))
    rows = b.pairs(spark, sf_dir).join(q, "term_id").join(i, "item_id")
    return rows.select("term_id", "item_id", text.overlap(F.col("q"), F.col("i")).alias("overlap"), F.arrays_overlap("q", "i").cast("int").alias("prediction"))


def tokenize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.tokenize(F.col("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"), text.token_set(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.size("s").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("tokens_md5"), F.md5(_joined("s")).alias("set_md5"))


def stem_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select(F.explode(text.tokenize(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return t.select("token", "n", text.stem(F.col("token")).alias("stem"), text.type_stem(F.col("token")).alias("type_stem"), text.deasciify(F.col("token")).alias("folded"))


def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = text.char_ngrams(F.col("title"))
    return b.items(spark, sf_dir).select("item_id", _joined(grams).alias("grams"), F.size(text.ngrams(text.squeeze(F.col("title")))).alias("n_raw"))


def expand_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.tokenize(F.col("query"))
    return b.terms(spark, sf_dir).select("term_id", _joined(text.expand_tokens(t)).alias("expanded"), _joined(F.array_distinct(text.stems(t))).alias("stems"))


def expanded_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = b.terms(spark, sf_dir).select("term_id", text.tokenize(F.col("query")).alias("q"))
    i = b.items(spark, sf_dir).select("item_id", text.tokenize(features.item_text("title", "category")).alias("i"))
    rows = b.pairs(spark, sf_dir).join(q, "term_id").join(i, "item_id")
    return rows.select("term_id", "item_id", text.expanded_match(F.col("q"), F.col("i")).alias("covered"))


def category_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = text.category_levels(F.col("category"))
    return b.items(spark, sf_dir).select("item_id", F.size(levels).alias("n_levels"), F.array_join(levels, " > ").alias("path"), text.last_level(F.col("category")).alias("last"))


def url_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = text.squeeze(F.regexp_replace("html", "<[^>]+>", " "))
    return table(spark, sf_dir, "pages").select("page_id", F.size(text.category_levels(F.regexp_replace("url", "^[a-z]+://", ""))).alias("n_levels"), F.length(bare).alias("n_chars"))


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = F.concat(F.lit("Sure: "), "props", F.lit(" done"))
    return table(spark, sf_dir, "events").select("event_id", text.json_block(wrapped, "k bigint").k.alias("k"), text.json_block(F.lit("no object"), "k bigint").k.alias("none"))


def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = text.labelled_text({"": F.col("title"), "brand": F.col("brand"), "gender": F.col("gender")})
    return b.items(spark, sf_dir).select("item_id", made.alias("text"), F.length(F.coalesce("title", F.lit(""))).alias("n"))


def attribute_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("attributes")
    return b.items(spark, sf_dir).select(
        "item_id",
        _joined(attrs.attribute_words(a, vocab.COLOR_KEYS, vocab.COLORS)).alias("colors"),
        _joined(attrs.attribute_words(a, vocab.MATERIAL_KEYS, vocab.MATERIALS)).alias("materials"),
        _joined(attrs.attribute_words(a, vocab.PATTERN_KEYS, vocab.PATTERNS)).alias("patterns"),
        attrs.first_attribute(a, "renk").alias("first_color"),
        _joined(attrs.sizes(features.item_text("title", "attributes"))).alias("sizes"),
    )


def query_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("query")
    t = text.tokenize(q)
    d = F.array_distinct(t)
    colors = attrs.query_colors(q, d)
    return b.terms(spark, sf_dir).select(
        "term_id",
        _joined(colors).alias("colors"),
        _joined(F.array_intersect(text.with_synonyms(colors, vocab.COLOR_SYNONYMS), text.strings(vocab.COLORS))).alias("more_colors"),
        _joined(F.array_intersect(d, text.strings(vocab.MATERIALS))).alias("materials"),
        attrs.intent(t, vocab.GENDER_WORDS).alias("gender"),
        attrs.intent(t, vocab.AGE_WORDS).alias("age"),
        attrs.is_generic(t).cast("int").alias("generic"),
        _joined(attrs.sizes(q)).alias("sizes"),
        _joined(text.numbers(q)).alias("numbers"),
    )


#: Queries and titles that meet in every way: each rule fires on some of their pairs and stays silent on others.
RULE_QUERIES = [
    "uzun kol elbise", "kısa kol tişört", "kışlık mont", "yazlık elbise", "205/55 r16 lastik", "fizik soru bankası", "erkek ayakkabı", "kadın çanta",
    "5. sınıf deneme", "128 gb telefon", "iphone 13 kılıf", "galaxy s 21", "galaxy a52", "42 numara bot", "500 ml şampuan", "çift kişilik nevresim", "60 w ampul", "10w-40 yağ 5 w",
]
RULE_TITLES = [
    "kolsuz bluz", "uzun kol gömlek", "yazlık şort", "kışlık çizme", "205/55 r17 lastik", "kimya konu anlatımı", "spor ayakkabı", "6. sınıf matematik, 5. sınıf",
    "7. sınıf test", "256 gb telefon", "iphone 12 kılıf", "galaxy s22 ekran", "galaxy a51 kapak", "40 numara bot", "250 ml krem", "tek kişilik nevresim", "100 w ampul",
]
RULE_GENDERS = ["kadın", "erkek", "unknown"]


def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, j = F.col("term_id"), F.col("item_id")
    return b.pairs(spark, sf_dir).select("term_id", "item_id", b.pick(RULE_QUERIES, k).alias("query"), b.pick(RULE_TITLES, j).alias("title"), b.pick(["kitap/okul", "giyim", "kitap"], F.floor(j / 17)).alias("category"), b.pick(RULE_GENDERS, F.floor(j / 51)).alias("gender"))


def rule_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.reason(*map(F.col, ("query", "title", "category", "gender")))
    return rule_rows(spark, sf_dir).select("term_id", "item_id", found.alias("reason"), found.isNotNull().cast("int").alias("spec_conflict"))


def type_contradiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rule_rows(spark, sf_dir)
    return rows.select("term_id", "item_id", rules.type_contradiction(F.col("query"), F.lit("takı"), F.col("title"), F.col("category")).cast("int").alias("type_conflict"))


def brand_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = b.items(spark, sf_dir)
    known = popularity.brands(i, least=20)
    said = popularity.mentioned_brands(b.terms(spark, sf_dir), known)
    rows = b.pairs(spark, sf_dir).join(said, "term_id").join(i.select("item_id", "brand"), "item_id")
    return rows.select("term_id", "item_id", F.array_join("brands", " ").alias("brands"), attrs.brand_contradiction(F.col("brands"), F.col("brand")).alias("brand_contradiction"))


def typo_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of queries with a letter swapped for another, corrected toward the catalog's words."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(text.words(F.col("text"))).alias("w")).distinct()
    slips = words.filter(F.length("w") >= 6).select(F.col("w").alias("source"), F.concat(F.substring("w", 1, 2), F.lit("q"), F.substring("w", 4, 100)).alias("word"))
    known = typo.vocabulary(table(spark, sf_dir, "benchmark"), "text")
    return typo.correct(slips, known).select("source", "word", "corrected")


def score_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in scores, answers with a confidence, and the band that they replace."""
    rows = b.scored(spark, sf_dir)
    n = F.floor(F.col("p") * 1000).cast("long")
    answer = F.when(F.col("y") == 1, F.concat(F.lit('ok {"relevant": true, "confidence": '), F.col("q").cast("string"), F.lit("}"))).when(F.col("toxic") == 1, F.lit("none")).otherwise(F.lit('{"relevant": false, "confidence": 2}'))
    got = rows.withColumn("score", scorers.answer_probability(answer, F.col("p")))
    banded = scorers.rescore_band(rows.select("doc_id", "p"), "doc_id", "p", got.select("doc_id", "score"), blend=0.5).withColumnRenamed("p", "blended")
    return got.select("doc_id", F.round("score", 6).alias("score"), F.round(scorers.stand_in_relevance(n), 6).alias("stand_in")).join(banded.select("doc_id", F.round("blended", 6).alias("blended")), "doc_id")


def label_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicked pairs and negatives, one row per pair: a click wins."""
    pos = b.clicks(spark, sf_dir).withColumn("label", F.lit(1)).withColumn("source", F.lit("click"))
    neg = b.pairs(spark, sf_dir).select("term_id", (F.col("item_id") % 1000).alias("item_id"), F.lit(0).alias("label"), F.lit("moved").alias("source"))
    return union_first([pos, neg], ["term_id", "item_id"])


QUERIES = {f.__name__: f for f in (cooccurrence_baseline, tokenize_docs, stem_tokens, char_ngrams, expand_tokens, expanded_match, category_levels, url_levels, json_extract, labelled_texts, attribute_constraints, query_constraints, rule_reason, type_contradiction, brand_mentions, typo_correction, score_answers, label_union)}

_SUFFIX = "|".join(vocab.SUFFIXES)


def _stem(t: str) -> str:
    return rf"regexp_replace({t}, '^(.{{3,}}?)(?:{_SUFFIX})$', '\1')"


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _join(x: str) -> str:
    return f"array_to_string(list_sort({x}), ' ')"


def _synonyms(clusters: list[list[str]]) -> str:
    rows = ", ".join(f"('{w}', '{x}')" for w, others in text.neighbours(clusters).items() for x in others)
    return f"(VALUES {rows})"


_ITEM_TEXT = "title || ' ' || brand || ' ' || category"
_SIZE_MAP = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.SIZES.items())


def _sizes(x: str) -> str:
    toks = f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"
    clear = f"list_filter(list_transform({toks}, lambda t: CASE t {_SIZE_MAP} END), lambda t: t IS NOT NULL)"
    more = f"list_concat(list_intersect({toks}, ['s', 'm', 'l']), list_transform(list_filter({toks}, lambda t: regexp_full_match(t, '3[4-9]|4[0-9]|5[0-2]')), lambda t: 'n' || t))"
    return f"list_distinct(CASE WHEN regexp_matches(lower({x}), '\\b(beden|numara|no)\\b') THEN list_concat({clear}, {more}) ELSE {clear} END)"


def _intent(t: str, words: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.items())
    return f"list_filter(list_transform({t}, lambda t: CASE t {whens} END), lambda t: t IS NOT NULL)[1]"


_CTX = f"WITH {b.ITEMS}, {b.TERMS}, {b.CLICKS}, {b.PAIRS}"
_RULE_ROWS = f"""rule_rows AS (SELECT term_id, item_id, {b.sql_pick(RULE_QUERIES, 'term_id')} AS q, {b.sql_pick(RULE_TITLES, 'item_id')} AS t,
  {b.sql_pick(['kitap/okul', 'giyim', 'kitap'], 'item_id // 17')} AS c, {b.sql_pick(RULE_GENDERS, 'item_id // 51')} AS g FROM pairs)"""


def _other(pattern: str) -> str:
    return f"(regexp_extract(q, '{pattern}', 1) <> '' AND len(regexp_extract_all(t, '{pattern}', 1)) > 0 AND NOT list_contains(regexp_extract_all(t, '{pattern}', 1), regexp_extract(q, '{pattern}', 1)))"


def _within(x: str, words: list[str]) -> str:
    return f"list_filter({_list(words)}, lambda w: contains({x}, w))"


def _capacity(x: str) -> str:
    # Word boundaries beside Turkish letters: blanks stand on both sides.
    words = ", ".join(f"CASE WHEN regexp_matches(' ' || {x} || ' ', '[^a-z0-9çğıöşü]{w}[^a-z0-9çğıöşü]') THEN '{n}' END" for w, n in vocab.CAPACITY_WORDS.items())
    return f"list_distinct(list_concat(regexp_extract_all({x}, '(\\d)\\s?kişilik', 1), list_filter([{words}], lambda w: w IS NOT NULL)))"


_TYRE = r"(\d{3})[\s/](\d{2})\s*r\s?(\d{2})"
_SUMMER = r"(^|[^a-z0-9çğıöşü])yaz($|[^a-z0-9çğıöşü])|yazlık|yazlik"


def _tyre(x: str) -> str:
    return f"concat_ws('/', regexp_extract({x}, '{_TYRE}', 1), regexp_extract({x}, '{_TYRE}', 2), regexp_extract({x}, '{_TYRE}', 3))"


_SUBJECTS = [_within("q", vocab.RULE_SUBJECTS), _within("t", vocab.RULE_SUBJECTS)]
_REASON = f"""CASE
  WHEN (contains(q, 'uzun kol') AND regexp_matches(t, 'k[ıi]sa kol|kolsuz')) OR (regexp_matches(q, 'k[ıi]sa kol') AND contains(t, 'uzun kol')) THEN 'kol_boyu'
  WHEN (contains(q, 'kış') AND regexp_matches(t, '{_SUMMER}')) OR (regexp_matches(q, '{_SUMMER}') AND contains(t, 'kış')) THEN 'sezon'
  WHEN regexp_matches(q, '{_TYRE}') AND regexp_matches(t || ' ' || c, '{_TYRE}') AND {_tyre('q')} <> {_tyre("(t || ' ' || c)")} THEN 'lastik_ebadi'
  WHEN contains(c, 'kitap') AND len({_SUBJECTS[0]}) > 0 AND len({_SUBJECTS[1]}) > 0 AND len(list_intersect({_SUBJECTS[0]}, {_SUBJECTS[1]})) = 0 THEN 'kitap_konusu'
  WHEN (contains(q, 'erkek') AND NOT regexp_matches(q, 'kad[ıi]n|unisex') AND g = 'kadın') OR (regexp_matches(q, 'kad[ıi]n') AND NOT regexp_matches(q, 'erkek|unisex') AND g = 'erkek') THEN 'cinsiyet'
  WHEN contains(c, 'kitap') AND {_other(rules.GRADE)} THEN 'sinif'
  {' '.join(f"WHEN {_other(p)} THEN '{name}'" for name, p in rules.VALUES.items())}
  WHEN len({_capacity('q')}) = 1 AND len({_capacity("(t || ' ' || c)")}) > 0 AND len(list_intersect({_capacity('q')}, {_capacity("(t || ' ' || c)")})) = 0 THEN 'kisilik'
  WHEN {_other(r'(\d+)\s?w(?:att)?\b')} AND NOT regexp_matches(q, '\\d+w-\\d') THEN 'watt' END"""
_FOLD = "translate(lower(translate({}, 'İIŞĞÜÖÇ', 'iisguoc')), 'ışğüöç', 'isguoc')"
_TYPE_WORDS = f"list_filter(regexp_split_to_array({norm('q')} || ' takı', '[^0-9a-zçğıöşü]+'), lambda x: x <> '' AND NOT list_contains({_list(vocab.TYPE_STOP_WORDS)}, x))"
_TYPE_STEM = "CASE WHEN length(x) > 6 THEN left(x, length(x) - 3) WHEN length(x) > 4 THEN left(x, length(x) - 2) ELSE x END"

SQL = {
    "cooccurrence_baseline": f"""{_CTX} SELECT term_id, item_id, {inter('q', 'i')} AS overlap, ({inter('q', 'i')} > 0)::INT AS prediction FROM pairs
      JOIN (SELECT term_id, {token_set('query')} AS q FROM terms) USING (term_id) JOIN (SELECT item_id, {token_set(_ITEM_TEXT)} AS i FROM items) USING (item_id)""",
    "tokenize_docs": f"""SELECT doc_id, len(t) AS n_tokens, len(s) AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5, md5({_join('s')}) AS set_md5
      FROM (SELECT doc_id, {tok('text')} AS t, {token_set('text')} AS s FROM documents)""",
    "stem_tokens": f"""SELECT token, count(*) AS n, {_stem('token')} AS stem, CASE WHEN length(token) > 6 THEN left(token, length(token) - 3) WHEN length(token) > 4 THEN left(token, length(token) - 2) ELSE token END AS type_stem,
      {_FOLD.format('token')} AS folded FROM (SELECT unnest({tok('text')}) AS token FROM documents) GROUP BY token""",
    "char_ngrams": f"""{_CTX}, g AS (SELECT item_id, trim(regexp_replace({norm('title')}, '\\s+', ' ', 'g')) AS s, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS r FROM items)
      SELECT item_id, {_join("list_distinct(list_transform(range(1, greatest(length(s) - 1, 2)), lambda i: substring(s, i::BIGINT, 3)))")} AS grams,
      len(list_distinct(list_transform(range(1, greatest(length(r) - 1, 2)), lambda i: substring(r, i::BIGINT, 3)))) AS n_raw FROM g""",
    "expand_tokens": f"""{_CTX}, q AS (SELECT term_id, {tok('query')} AS t FROM terms), s AS (SELECT * FROM {_synonyms(vocab.SYNONYMS)} AS v(w, x)),
      every AS (SELECT term_id, unnest(t) AS w FROM q UNION SELECT term_id, x FROM (SELECT term_id, unnest(t) AS w FROM q) JOIN s USING (w)
      UNION SELECT term_id, t[i] || t[i + 1] FROM (SELECT term_id, t, unnest(range(1, len(t))) AS i FROM q))
      SELECT term_id, string_agg(w, ' ' ORDER BY w) AS expanded, any_value(stems) AS stems FROM every JOIN (SELECT term_id, {_join(f"list_distinct(list_transform(t, lambda x: {_stem('x')}))")} AS stems FROM q) USING (term_id) GROUP BY term_id""",
    "category_levels": f"""{_CTX}, l AS (SELECT item_id, list_filter(list_transform(string_split(category, '/'), lambda x: trim(x)), lambda x: x <> '') AS x FROM items)
      SELECT item_id, len(x) AS n_levels, array_to_string(x, ' > ') AS path, x[-1] AS last FROM l""",
    "url_levels": "SELECT page_id, len(list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: trim(x) <> '')) AS n_levels, length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS n_chars FROM pages",
    "json_extract": "SELECT event_id, (props->>'k')::BIGINT AS k, NULL::BIGINT AS none FROM events",
    "labelled_texts": f"{_CTX} SELECT item_id, concat_ws(' | ', left(trim(title), 200), 'brand: ' || brand, CASE WHEN gender <> 'unknown' THEN 'gender: ' || gender END) AS text, length(title) AS n FROM items",
    "attribute_constraints": f"{_CTX} SELECT item_id, color AS colors, material AS materials, pattern AS patterns, color AS first_color, {_join(_sizes('title'))} AS sizes FROM items",
    "query_constraints": f"""{_CTX}, q AS (SELECT term_id, query, {tok('query')} AS t FROM terms),
      c AS (SELECT *, CASE WHEN {' OR '.join(f"contains(query, '{p}')" for p in vocab.COLOR_COLLOCATIONS)} THEN [] ELSE list_intersect(t, {_list(vocab.COLORS)}) END AS colors FROM q),
      m AS (SELECT term_id, string_agg(DISTINCT x, ' ' ORDER BY x) AS more FROM (SELECT term_id, unnest(colors) AS x FROM c UNION SELECT term_id, x FROM (SELECT term_id, unnest(colors) AS w FROM c) JOIN (SELECT * FROM {_synonyms(vocab.COLOR_SYNONYMS)} AS v(w, x)) USING (w)) WHERE list_contains({_list(vocab.COLORS)}, x) GROUP BY term_id)
      SELECT term_id, {_join('colors')} AS colors, coalesce(more, '') AS more_colors, {_join(f"list_intersect(t, {_list(vocab.MATERIALS)})")} AS materials, {_intent('t', vocab.GENDER_WORDS)} AS gender, {_intent('t', vocab.AGE_WORDS)} AS age,
      (len(list_intersect(t, {_list(vocab.GENERIC_WORDS)})) > 0)::INT AS generic, {_join(_sizes('query'))} AS sizes, {_join("list_distinct(regexp_extract_all(query, '[0-9]+'))")} AS numbers FROM c LEFT JOIN m USING (term_id)""",
    "rule_reason": f"{_CTX}, {_RULE_ROWS} SELECT term_id, item_id, {_REASON} AS reason, ({_REASON} IS NOT NULL)::INT AS spec_conflict FROM rule_rows",
    "type_contradiction": f"""{_CTX}, {_RULE_ROWS}, w AS (SELECT term_id, item_id, lower(t || ' ' || c) AS x_text, {_TYPE_WORDS} AS words FROM rule_rows)
      SELECT term_id, item_id, (len(list_filter(words, lambda x: contains(x_text, x) OR contains(x_text, {_TYPE_STEM}))) = 0)::INT AS type_conflict FROM w""",
    "brand_mentions": f"""{_CTX}, known AS (SELECT lower(brand) AS brand FROM items GROUP BY 1 HAVING count(*) >= 20),
      said AS (SELECT term_id, string_agg(DISTINCT w, ' ' ORDER BY w) AS brands, list(DISTINCT w) AS l FROM (SELECT term_id, unnest({tok('query')}) AS w FROM terms) JOIN known ON w = brand GROUP BY term_id)
      SELECT term_id, item_id, brands, (len(list_filter(l, lambda x: contains(lower(brand), x) OR contains(x, lower(brand)))) = 0)::INT AS brand_contradiction FROM pairs JOIN said USING (term_id) JOIN items USING (item_id)""",
    "score_answers": f"""WITH {b.SCORED}, a AS (SELECT *, CASE WHEN y = 1 THEN least(q, 1.0) WHEN toxic = 1 THEN p ELSE 0.0 END AS s FROM scored)
      SELECT doc_id, round(s, 6) AS score, round(0.05 + 0.9 * ((floor(p * 1000)::BIGINT * 2654435761) % 1000) / 1000.0::DOUBLE, 6) AS stand_in, round(CASE WHEN p BETWEEN 0.35 AND 0.65 THEN 0.5 * s + 0.5 * p ELSE p END, 6) AS blended FROM a""",
    "label_union": f"""{_CTX} SELECT term_id, item_id, max(label) AS label, CASE WHEN max(label) = 1 THEN 'click' ELSE 'moved' END AS source FROM (SELECT term_id, item_id, 1 AS label FROM clicks UNION ALL SELECT term_id, item_id % 1000, 0 FROM pairs) GROUP BY term_id, item_id""",
}

