import os

from pyspark.sql import functions as F

from cairnfield import streaming


def test_window_means(spark, sf):
    src = spark.read.parquet(f"{sf}/events.parquet")
    os_path = f"{sf}/events.parquet"
    stream = spark.readStream.schema(src.schema).parquet(os.path.dirname(os_path) + "/events.parquet*")
    q = streaming.window_means(stream, "ts", ["event_type"], "value").writeStream.outputMode("complete").format("memory").queryName("means").start()
    q.processAllAvailable()
    q.stop()
    got = {(str(r["start"]), r["event_type"]): (round(r["mean"], 9), r["n"]) for r in spark.table("means").collect()}
    want = src.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("start"), "event_type").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    assert got == {(str(r["start"]), r["event_type"]): (round(r["mean"], 9), r["n"]) for r in want.collect()}


def test_dry_runs_and_ledger(spark, tmp_path):
    schema = "key string, day date, dry boolean"
    parts = [[("a", "2000-01-01", True), ("a", "2000-01-02", True), ("b", "2000-01-01", False)], [("a", "2000-01-03", True), ("a", "2000-01-05", True), ("b", "2000-01-02", True)]]
    src = f"{tmp_path}/in"
    for rows in parts:
        spark.createDataFrame(rows, "key string, day string, dry boolean").withColumn("day", F.to_date("day")).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = streaming.dry_runs(stream, "key", "day", "dry").writeStream.outputMode("append").format("memory").queryName("runs").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["key"], r["day"] - 10957): r["run"] for r in spark.table("runs").collect()}
    assert got == {("a", 0): 1, ("a", 1): 2, ("b", 0): 0, ("a", 2): 3, ("a", 4): 1, ("b", 1): 1}
    for _ in range(2):
        streaming.ledger(spark, src, schema, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6
