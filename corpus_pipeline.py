"""From raw documents to packed token sequences: four stages over the operators of ``quillon.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; stages are written as
Parquet and read again in between. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import feistel, langid, minhash, packing
from quillon.llm.queries import DEMO_KEY, tokenizer_file
from quillon.llm.shared import cut
from quillon.sources.package import ship_package

#: Ids of dropped documents up to this count are broadcast; beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the language operator rejects: no letters, or too far from every language."""
    model = langid.train(docs.filter(~langid.held_out()))
    return langid.identify(docs, model).filter(~F.col("lang_rejected")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group (five words, similarity 0.8): that of the smallest doc_id.

    Rows that repeat an id are copies of one document, of which one row stays. Rows without an id stay.
    """
    groups = cut(minhash.near_duplicates(docs, percent=80, width=5).filter("doc_id is not null").select("doc_id", "kept"), "groups")
    dropped = groups.filter(~F.col("kept")).select("doc_id").distinct()
    few = dropped.count() <= BROADCAST_IDS
    left = docs.join(F.broadcast(dropped) if few else dropped, "doc_id", "left_anti").select(*docs.columns)
    sizes = groups.agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("ids")).first()
    if sizes.rows == sizes.ids:
        return left
    return left.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(left.filter("doc_id is null"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers and dates become pseudonyms; n_chars follows the new text."""
    return feistel.pseudonymise(docs, DEMO_KEY).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in windows of 2048: a row per piece, with its ids and its place."""
    return packing.pack_documents(docs, tokenizer_file(), end_id=1, window=2048, with_ids=True)


STAGES = [("language", keep_known_languages), ("near-dedup", drop_near_duplicates), ("pii", pseudonymise), ("packing", pack)]
#: Signatures, permutations and packing are not SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written to the shared folder and read again."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
