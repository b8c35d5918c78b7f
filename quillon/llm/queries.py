"""The queries over the ten operators: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balltree, feistel, langid, minhash, oracle, packing, range_join, records, slots, unigram, url_cascade
from .shared import new_folder


#: For the registered queries only: a deployment passes a key of its own.
DEMO_KEY = b"a key that anyone may read"


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: (rule, verdict) of the registered query.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op1_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that decides each page's url: page_id, host, path, rule, verdict."""
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    judged = url_cascade.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules, otherwise="allow")
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document in record files, read back: doc_id, start, n_tokens, ids_crc32, file, offset."""
    folder = new_folder(spark, "records")
    manifest = records.write_token_records(_table(spark, sf_dir, "documents"), folder, tokenizer_file(), end_id=2)
    return records.read_token_records(spark, folder, manifest)


def op3_vector_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every vector at cosine 0.9: vec_id, n_links, component_id, kept."""
    return range_join.near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in windows of 2048: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_file(), end_id=1, window=2048).drop("ids")


def op5_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by unigram Viterbi and back: doc_id, n_tokens, n_bytes, ids_crc32, text_back_crc32."""
    docs, path = _table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model")
    coded = unigram.round_trip(docs, path, scores="rank")  # the file at hand is of another type
    return coded.select("doc_id", "n_tokens", "n_bytes", "ids_crc32", F.crc32(F.encode("decoded", "utf-8")).alias("text_back_crc32"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of every document: doc_id, n_shingles, component_id, kept."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), percent=85, width=5)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those not held out: doc_id, held_out, lang_pred, score, rejected."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~langid.held_out()))
    return langid.identify(docs.select("doc_id", langid.held_out().alias("held_out"), "text"), model).select(
        "doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected")
    )


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 8 shards of nearly equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    placed, _ = slots.shard_documents(_table(spark, sf_dir, "documents"), 8, folder=new_folder(spark, "slot-map"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of each vector whose id 50 divides: query_id, rank, vec_id, score."""
    return balltree.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal numbers and dates as pseudonyms: doc_id, text, n_pii."""
    found = feistel.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
    return found.select("doc_id", "text", F.aggregate(F.map_values("pii"), F.lit(0), lambda a, b: a + b).alias("n_pii"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_cascade": op1_url_cascade,
    "op2_token_records": op2_token_records,
    "op3_vector_range_join": op3_vector_range_join,
    "op4_packing": op4_packing,
    "op5_unigram": op5_unigram,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_language_id": op7_language_id,
    "op8_virtual_slots": op8_virtual_slots,
    "op9_top_k": op9_top_k,
    "op10_pii_pseudonyms": op10_pii_pseudonyms,
}
SQL: dict[str, str] = {
    "op1_url_cascade": oracle.url_sql(URL_RULES, "allow"),
    "op3_vector_range_join": oracle.vector_sql(0.9),
    "op6_minhash_near_dedup": oracle.near_sql(85, 5),
    "op9_top_k": oracle.top_sql(50, 5, 256),
}
