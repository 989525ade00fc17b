import datetime as dt

from netquarry.streaming.edges import edge_weights, windowed_degrees


def test_stream_equals_batch(spark, tmp_path):
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    rows = [(t(1), "a", "b"), (t(1, 5), "b", "a"), (t(2), "a", "c"), (t(2), "c", "c")]
    spark.createDataFrame(rows, "ts timestamp, src string, dst string").write.parquet(str(tmp_path / "in"))
    for k, f in enumerate((windowed_degrees, edge_weights)):
        stream = spark.readStream.schema("ts timestamp, src string, dst string").parquet(str(tmp_path / "in"))
        q = f(stream).writeStream.outputMode("complete").format("memory").queryName(f"t{k}").start()
        q.processAllAvailable()
        q.stop()
        want = f(spark.read.parquet(str(tmp_path / "in")))
        assert sorted(map(tuple, spark.table(f"t{k}").collect())) == sorted(map(tuple, want.collect()))
