"""A stream to its end gives what a batch gives."""

from pyspark.sql import functions as F

from leafmill.plans.build import build
from leafmill.streaming import stream


def test_extract_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("name\tprice\nx\t1\ny\t2")
    (tmp_path / "in/b.zzz").write_text("?")
    config = dict(pipeline=["extract.table", "validate.default"], schema=dict(fields=[dict(name="name"), dict(type="number", name="price")]))
    for _ in range(2):  # a second start finds nothing new
        q = stream.extract_stream(stream.watch_files(spark, str(tmp_path / "in")), build(config), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
    r = spark.read.parquet(str(tmp_path / "out/records"))
    assert sorted(x["values"]["name"]["s"] for x in r.collect()) == ["x", "y"]
    assert spark.read.parquet(str(tmp_path / "out/rejects")).first()["error_class"] == "unknown_type"


def test_dedup_and_windows(spark, tmp_path):
    rows = [("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 00:20:00", 3.0), ("b", "2024-01-01 02:00:00", 5.0)]
    df = spark.createDataFrame(rows, "s string, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream.dedup_stream(src, ["s"], "ts").writeStream.format("memory").queryName("dd").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("dd").count() == 2
    w = {(str(r["window_start"]), r["stage"]): (r["n"], r["mean"]) for r in stream.windowed_metrics(df, "ts", "s", "v").collect()}
    assert w == {("2024-01-01 00:00:00", "a"): (2, 2.0), ("2024-01-01 02:00:00", "b"): (1, 5.0)}
