"""The tables that stand in for a catalog, its search terms and its click log, and the same in SQL.

items come from part, terms from customer, clicks are what customers ordered, vectors come from embeddings. Every
row of those tables takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strings

COLORS = ["siyah", "beyaz", "kırmızı", "altın", "mavi"]
MATERIALS = ["pamuk", "deri", "metal"]
GENDERS = ["kadın", "erkek", "unisex", "unknown"]
AGES = ["yetişkin", "çocuk", "bebek", "unknown"]
PATTERNS = ["düz", "çizgili"]
TITLES = [" kadın", " erkek bot", " 42 numara", "", " xl", " çocuk", ""]
ADJECTIVES = ["red", "blue", "small", "large", "old", "hot"]
NOUNS = ["ring", "widget", "bolt", "gear", "plate", "anvil", "gizmo"]
WISHES = [" kadın", " sarı", "", " 42 numara", " beyaz eşya"]
EXTRAS = [" hediye", " deri", " ayakkabı", " erkek çocuk", "", " xl", " çizgili"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], k: Column) -> Column:
    return F.get(strings(values), (k % len(values)).cast("int"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("item_id"),
        F.concat("p_name", pick(TITLES, k)).alias("title"),
        F.concat(F.lower("p_type"), F.lit("/"), F.element_at(F.split("p_name", " "), 2)).alias("category"),
        F.replace("p_brand", F.lit("#"), F.lit("")).alias("brand"),
        pick(GENDERS, k).alias("gender"),
        pick(AGES, F.floor(k / 4)).alias("age_group"),
        F.concat(F.lit("renk: "), pick(COLORS, k), F.lit(", materyal: "), pick(MATERIALS, k), F.lit(", desen: "), pick(PATTERNS, k)).alias("attributes"),
        F.col("p_size").alias("size"),
    )


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    brand = F.when(k % 5 == 2, F.concat(F.lit(" brand"), (k % 25).cast("string"))).otherwise("")
    return table(spark, sf_dir, "customer").select(k.alias("term_id"), F.concat(pick(ADJECTIVES, k), F.lit(" "), pick(NOUNS, k), pick(WISHES, k), brand, pick(EXTRAS, F.floor(k / 3))).alias("query"))


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """term_id, item_id, dealt by term: what follows by term moves no row again."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    met = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.select(F.col("o_custkey").alias("term_id"), F.col("l_partkey").alias("item_id")).repartition("term_id").distinct()


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicked pairs with label 1, and as many others with label 0; a pair of both is a click. Dealt by term."""
    n = table(spark, sf_dir, "part").count()
    item = F.col("item_id")
    both = F.array(F.struct(item, F.lit(1).alias("label")), F.struct(((item * 7 + 3) % n).alias("item_id"), F.lit(0).alias("label")))
    return clicks(spark, sf_dir).select("term_id", F.explode(both).alias("x")).groupBy("term_id", "x.item_id").agg(F.max("x.label").alias("label"))


def active_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """term_id of those that have clicks."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("term_id")).distinct()


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))


def term_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """term_id, vec_id: which of ``vectors`` is a term's."""
    n = table(spark, sf_dir, "embeddings").count()
    return terms(spark, sf_dir).select("term_id", (F.col("term_id") % n).alias("vec_id"))


def item_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").count()
    return items(spark, sf_dir).select("item_id", ((F.col("item_id") * 3 + 1) % n).alias("vec_id"))


def term_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_places(spark, sf_dir).join(vectors(spark, sf_dir), "vec_id").select("term_id", "vec")


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_places(spark, sf_dir).join(vectors(spark, sf_dir), "vec_id").select("item_id", "vec")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, y, p, q: labelled documents with two scores."""
    docs = table(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") % 1000) / 1000.0).alias("p"), ((F.col("n_chars") * 7 % 500) / 500.0).alias("q"))
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"), "toxic").join(docs, "doc_id")


# The same in SQL.


def sql_pick(values: list[str], k: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[({k}) % {len(values)} + 1]"


def norm(x: str) -> str:
    return f"replace(lower(translate(coalesce({x}, ''), 'İI', 'iı')), 'i̇', 'i')"


def tok(x: str, least: int = 2) -> str:
    return f"list_filter(regexp_split_to_array({norm(x)}, '[^0-9a-zçğıöşü]+'), lambda t: length(t) >= {least})"


def uniq_tok(x: str) -> str:
    return f"list_distinct({tok(x)})"


def token_set(x: str) -> str:
    return f"list_filter(list_distinct({tok(x)}), lambda t: t NOT IN ('ve', 'ile', 'için', 'bir', 'the'))"


def inter(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


ITEMS = f"""items AS (SELECT p_partkey AS item_id, p_name || {sql_pick(TITLES, 'p_partkey')} AS title,
  lower(p_type) || '/' || split_part(p_name, ' ', 2) AS category, replace(p_brand, '#', '') AS brand,
  {sql_pick(GENDERS, 'p_partkey')} AS gender, {sql_pick(AGES, 'p_partkey // 4')} AS age_group,
  'renk: ' || {sql_pick(COLORS, 'p_partkey')} || ', materyal: ' || {sql_pick(MATERIALS, 'p_partkey')} || ', desen: ' || {sql_pick(PATTERNS, 'p_partkey')} AS attributes,
  {sql_pick(COLORS, 'p_partkey')} AS color, {sql_pick(MATERIALS, 'p_partkey')} AS material, {sql_pick(PATTERNS, 'p_partkey')} AS pattern, p_size AS size FROM part)"""
TERMS = f"""terms AS (SELECT c_custkey AS term_id, {sql_pick(ADJECTIVES, 'c_custkey')} || ' ' || {sql_pick(NOUNS, 'c_custkey')} || {sql_pick(WISHES, 'c_custkey')}
  || CASE WHEN c_custkey % 5 = 2 THEN ' brand' || (c_custkey % 25) ELSE '' END || {sql_pick(EXTRAS, 'c_custkey // 3')} AS query FROM customer)"""
CLICKS = "clicks AS (SELECT DISTINCT o_custkey AS term_id, l_partkey AS item_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
PAIRS = """pairs AS (SELECT term_id, item_id, max(label) AS label FROM (SELECT term_id, item_id, 1 AS label FROM clicks
  UNION ALL SELECT term_id, (item_id * 7 + 3) % (SELECT count(*) FROM part), 0 FROM clicks) GROUP BY ALL)"""
VECTORS = """term_vectors AS (SELECT c_custkey AS term_id, embedding AS vec FROM customer JOIN embeddings ON vec_id = c_custkey % (SELECT count(*) FROM embeddings)),
  item_vectors AS (SELECT p_partkey AS item_id, embedding AS vec FROM part JOIN embeddings ON vec_id = (p_partkey * 3 + 1) % (SELECT count(*) FROM embeddings))"""
SCORED = "scored AS (SELECT doc_id, quality AS y, toxic, (n_chars % 1000) / 1000.0::DOUBLE AS p, (n_chars * 7 % 500) / 500.0::DOUBLE AS q FROM labels JOIN documents USING (doc_id))"
BASE = f"WITH {ITEMS}, {TERMS}, {CLICKS}, {PAIRS}, {VECTORS}"


def dot(a: str, b: str) -> str:
    return f"list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"


def knn_sql(k: int = 10, name: str = "knn") -> str:
    """Neighbour terms that have clicks, the term itself left out."""
    return f"""active AS (SELECT DISTINCT term_id FROM clicks),
  {name} AS (SELECT * FROM (SELECT q.term_id AS q_id, i.term_id AS i_id, round({dot('q.vec', 'i.vec')}, 9) AS sim,
    row_number() OVER (PARTITION BY q.term_id ORDER BY round({dot('q.vec', 'i.vec')}, 9) DESC, i.term_id) AS rank
    FROM term_vectors q JOIN (SELECT * FROM term_vectors SEMI JOIN active USING (term_id)) i ON q.term_id <> i.term_id) WHERE rank <= {k})"""
