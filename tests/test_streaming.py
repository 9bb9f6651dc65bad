from datetime import datetime

from pyspark.sql import functions as F

from veridex.sources import records
from veridex.streaming import items as S


def test_first_items_exported_once(spark, tmp_path):
    rows = [("a", datetime(2012, 1, 1, 0, i), i) for i in range(3)] + [("b", datetime(2012, 1, 1, 1), 9), (None, datetime(2012, 1, 1, 2), 5)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "id string, ts timestamp, k int").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("id string, ts timestamp, k int").parquet(src)
    q = S.export(S.first_items(stream, "id", "ts").select("id", "k"), str(tmp_path / "out"), str(tmp_path / "state"), "member")
    q.awaitTermination()
    got = [r.id for r in spark.read.schema("id string, k int").json(str(tmp_path / "out/item_type=member")).collect()]
    assert sorted(map(str, got)) == ["None", "a", "b"]


def test_windowed_activity_and_co_reviews(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(1, 7, datetime(2012, 1, 1)), (2, 7, datetime(2012, 1, 3)), (3, 7, datetime(2012, 1, 20)), (1, 8, datetime(2012, 3, 1))]
    spark.createDataFrame(rows, "m long, p long, ts timestamp").write.parquet(src)
    read = lambda: spark.readStream.schema("m long, p long, ts timestamp").parquet(src)
    q = S.co_reviews(read(), read()).writeStream.format("memory").queryName("pairs").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("pairs").collect()} == {(1, 2, 7)}
    q = S.windowed_activity(read(), "ts", "p").writeStream.format("memory").queryName("activity").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("activity").where("p = 7").agg(F.sum("n")).first()[0] == 3


def test_json_items_and_seeds(spark, tmp_path):
    folder = str(tmp_path / "items")
    df = spark.createDataFrame([("a", None, ["x"]), ("b", 3, None)], "id string, ranking int, badges array<string>")
    records.write_items(df, folder, "member")
    back = records.read_items(spark, folder, "member")
    assert {(r.id, r.ranking) for r in back.collect()} == {("a", None), ("b", 3)} and back.columns[1] == "fullname"
    (tmp_path / "seeds.csv").write_text("Type,ID\nm,A1\np,B1\n")
    assert records.read_seeds(spark, str(tmp_path / "seeds.csv")).count() == 2
