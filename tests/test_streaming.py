import datetime as dt

from lithoscope.streaming.arrivals import watched


def test_windows_of_arriving_files(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, day + dt.timedelta(minutes=20 * i)) for i in range(6)], "id int, t timestamp")
    df.write.parquet(f"file://{tmp_path}/in")
    query = watched(spark, f"file://{tmp_path}/in", df.schema, "t").writeStream.outputMode("complete").format("memory").queryName("arrivals").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r.n for r in spark.table("arrivals").collect()) == [3, 3]
