import tempfile

from pyspark.sql import functions as F

from strata.operators.hashing import keep_first
from strata.sources import files
from strata.streaming import feeds

SCHEMA = "item_no bigint, feed_id string, guid string, link string, title string"


def test_incremental_equals_batch(spark):
    base = tempfile.mkdtemp()
    items = [(i, f"f{i % 3}", f"g{i % 7}" if i % 5 else None, f"l{i % 7}", f"t{i % 7}") for i in range(60)]
    df = spark.createDataFrame(items, SCHEMA)
    for lo in (0, 20, 40):
        df.where(F.col("item_no").between(lo, lo + 19)).coalesce(1).write.mode("append").parquet(f"{base}/in")
        feeds.ingest(spark, f"{base}/in", df.schema, f"{base}/store", f"{base}/ckpt").awaitTermination()
    store = spark.read.parquet(f"{base}/store")
    once = keep_first(feeds.stamped(df), ["item_hash"], ["item_no"])
    assert sorted(r.item_no for r in store.collect()) == sorted(r.item_no for r in once.collect())


def test_snapshot_round_trip(spark):
    base = tempfile.mkdtemp()
    df = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k bigint, v string, w string")
    digest = files.export_snapshot(df, f"{base}/snap", ["k"]).first()["digest"]
    none = df.limit(0)
    again = files.import_snapshot(spark, f"{base}/snap", none, df.schema, ["k"], ["k"], digest, None)
    assert sorted(r.k for r in again.collect()) == [1, 2]
    assert files.import_snapshot(spark, f"{base}/snap", df, df.schema, ["k"], ["k"], digest, None).count() == 0
    assert files.import_snapshot(spark, f"{base}/snap", none, df.schema, ["k"], ["k"], digest, digest).count() == 0


def test_host_budget(spark):
    base = tempfile.mkdtemp()
    rows = [("a", f"2026-01-01 00:00:0{i}") for i in (0, 0, 0, 4)] + [("b", "2026-01-01 00:00:00")]
    spark.createDataFrame(rows, "host string, at string").selectExpr("host", "cast(at as timestamp) at").write.parquet(f"{base}/in")
    stream = spark.readStream.schema("host string, at timestamp").parquet(f"{base}/in")
    q = feeds.host_budget(stream, 0.5, 2.0).writeStream.format("memory").queryName("budget").outputMode("append").option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.host, r.at.second, r.allowed) for r in spark.table("budget").collect())
    assert got == [("a", 0, False), ("a", 0, True), ("a", 0, True), ("a", 4, True), ("b", 0, True)]
