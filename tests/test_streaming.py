from datetime import datetime

from remeasure.streaming.refresh import epoch_counts_by_window


def test_stream_counts_equal_the_batch(spark, tmp_path):
    rows = [(k, 1.0 * k, 1.0 if k % 4 else -1.0, datetime(2021, 5, 1 + k % 3, 12)) for k in range(30)]
    df = spark.createDataFrame([*rows, rows[0]], "OBS_ID long, VRAD double, VRAD_ERR double, ingested_at timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = epoch_counts_by_window(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    found = {(r.window.start, r.n_raw, r.n_good, r.invalid_rv_error) for r in spark.table("counts").collect()}
    assert found == {(r.window.start, r.n_raw, r.n_good, r.invalid_rv_error) for r in epoch_counts_by_window(df).collect()}
    assert sum(x[1] for x in found) == 30
