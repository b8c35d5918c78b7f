"""Click counts of a stream against a batch."""

from pyspark.sql import functions as F

from quillon.streaming.clicks import click_counts


def test_counts(spark, tmp_path):
    rows = spark.range(200).select((F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.col("id").cast("int"))).alias("ts"), (F.col("id") % 3).alias("item_id"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = click_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("click_counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = {(r.start, r.item_id): r.clicks for r in spark.table("click_counts").collect()}
    expected = {(r.start, r.item_id): r.n for r in rows.groupBy(F.date_trunc("hour", "ts").alias("start"), "item_id").agg(F.count("*").alias("n")).collect()}
    assert got == expected
