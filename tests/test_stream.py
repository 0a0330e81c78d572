from pyspark.sql import functions as F

from threadweave.operators.components import connected_components
from threadweave.streaming import sessions


def test_sessions_on_a_table(spark):
    rows = [("a", 0), ("a", 60), ("a", 7200), ("b", 0)]
    df = spark.createDataFrame(rows, "convo_id string, s bigint").select("convo_id", F.timestamp_seconds("s").alias("created_at"))
    assert sorted(r["n"] for r in sessions.sessions(df).collect()) == [1, 1, 2]


def test_windows_on_a_stream(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    (tmp_path / "in").mkdir()
    table.write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = sessions.windowed_counts(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == table.count()


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (200, 200), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "src bigint, dst bigint")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100 and got[200] == 200 and None not in got
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0
