"""Reading and writing tables: schemas, optional and fallback sources, resumable and swapped outputs.

Paths are Hadoop paths: existence and renames go through Spark's own file system, not the driver's disk.
"""

from __future__ import annotations

import tempfile
import uuid

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "items": "item_id string, title string, category string, brand string, gender string, age_group string, attributes string",
    "terms": "term_id string, query string",
    "training_pairs": "id string, term_id string, item_id string, label bigint",
    "submission_pairs": "id string, term_id string, item_id string",
    "submission": "id string, prediction tinyint",
}


def _path(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def read_csv(spark: SparkSession, path: str, table: str, columns: Iterable[str] | None = None) -> DataFrame:
    """A CSV with a header under a declared schema; only the columns asked for are parsed."""
    df = spark.read.schema(SCHEMAS[table]).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*columns) if columns else df


def read_parquet(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_optional(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame | None:
    """The table, or None where there is none."""
    return read_parquet(spark, path, columns) if exists(spark, path) else None


def read_first(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """The first table that is there."""
    for p in paths:
        if exists(spark, p):
            return spark.read.parquet(p)
    raise FileNotFoundError("none of the sources is there")


def fill_text(df: DataFrame) -> DataFrame:
    """Null texts as empty ones."""
    return df.na.fill("")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", "\"").csv(path)


def write_swapped(df: DataFrame, path: str, keep_backup: bool = True) -> None:
    """Replace a table that ``df`` may itself read: written beside it, then renamed; the old one is kept as ``.bak``."""
    spark = df.sparkSession
    fs, target = _path(spark, path)
    new, old = _path(spark, f"{path}.new")[1], _path(spark, f"{path}.bak")[1]
    df.write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(new, target)
    if not keep_backup:
        fs.delete(old, True)


def restore_backup(spark: SparkSession, path: str) -> None:
    """Undo the last ``write_swapped``."""
    fs, target = _path(spark, path)
    old = _path(spark, f"{path}.bak")[1]
    if not fs.exists(old):
        raise FileNotFoundError(f"{path}.bak")
    fs.delete(target, True)
    fs.rename(old, target)


def write_resumable(df: DataFrame, path: str, key: str, shards: int = 16) -> int:
    """Append the rows whose key is not yet in the table, by shard of the key; returns how many were there before.

    A run that ended early is simply run again: finished rows are found by an anti join.
    """
    spark = df.sparkSession
    done = read_optional(spark, path, [key])
    before = 0 if done is None else done.count()
    left = df if done is None else df.join(done, key, "left_anti")
    left.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards))).write.mode("append").partitionBy("shard").parquet(path)
    return before


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small JSON document, such as a model's metadata."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r.value for r in spark.read.text(path).collect()))


def check_not_truncated(df: DataFrame, limit: int = 2**20) -> None:
    """An export of exactly a spreadsheet's limit of rows was cut."""
    if df.count() == limit:
        raise ValueError(f"the table has exactly {limit} rows: it was cut")


def check_output(result: DataFrame, candidates: DataFrame, key: str) -> None:
    """A result has each candidate's id once and no other."""
    missing = candidates.select(key).exceptAll(result.select(key)).count()
    extra = result.select(key).exceptAll(candidates.select(key)).count()
    if missing or extra:
        raise ValueError(f"{missing} ids are missing, {extra} are extra")


def whole_groups(df: DataFrame, group: str, share: float, seed: int = 42) -> DataFrame:
    """A sample of groups with all their rows, by a hash of the group."""
    return df.filter(F.pmod(F.xxhash64(F.col(group), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))


def some_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows drawn by a hash of the key."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def share_of_rows(df: DataFrame, keys: list[str], most: int, seed: int = 42) -> DataFrame:
    """About ``most`` rows by a hash of their keys, or all where there are no more; no rows are sorted or moved."""
    n = df.count()
    return df if n <= most else df.filter(F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1_000_000_000)) < int(most / n * 1_000_000_000))


_own_folder: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the folder that the cluster shares (``spark.checkpoint.dir``) and read back, for what
    several parts of a plan read: none of them computes it again, and lost executors cost no more than a read.

    A local session without that setting uses a temporary folder; on a cluster it must be set.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="quillon-tables-"))
        folder = _own_folder[0]
    path = f"{folder.rstrip('/')}/quillon-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
