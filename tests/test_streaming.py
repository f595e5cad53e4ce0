from graphloom.streaming.degrees import running_degrees, windowed_degrees


def _drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_running_degrees(spark, tmp_path):
    path = str(tmp_path / "edges")
    spark.createDataFrame([(1, 2), (1, 3), (4, 4)], "src long, dst long").write.parquet(path)
    spark.createDataFrame([(2, 1)], "src long, dst long").write.mode("append").parquet(path)
    stream = spark.readStream.schema("src long, dst long").parquet(path)
    got = _drain(running_degrees(stream), "degrees_now", "complete")
    assert {r["id"]: r["degree"] for r in got.collect()} == {1: 3, 2: 2, 3: 1}


def test_windowed_degrees(spark, tmp_path):
    path = str(tmp_path / "edges")
    spark.sql("SELECT * FROM VALUES (1L, 2L, TIMESTAMP '2024-01-01 00:00:10'), (1L, 3L, TIMESTAMP '2024-01-01 00:00:50'), (1L, 2L, TIMESTAMP '2024-01-01 00:05:00') AS t(src, dst, ts)").write.parquet(path)
    stream = spark.readStream.schema("src long, dst long, ts timestamp").parquet(path)
    got = _drain(windowed_degrees(stream, "ts", "1 minute", "1 minute"), "degrees_window", "append")
    assert {(str(r["window"]["start"])[-8:], r["id"], r["degree"]) for r in got.collect()} == {("00:00:00", 1, 2), ("00:00:00", 2, 1), ("00:00:00", 3, 1)}
