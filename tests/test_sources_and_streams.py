"""Files in and out, and KPIs over a stream against the same KPIs over the whole table."""

import os

import pytest
from pyspark.sql import functions as F

from tallyloom.errors import InvalidArgument
from tallyloom.plans.kpi import kpi
from tallyloom.sources import cache, files
from tallyloom.streaming.incremental import finish, windowed_sums


@pytest.mark.parametrize("separator", [",", ";", "\t"])
def test_csv_by_any_separator(spark, tmp_path, separator):
    (tmp_path / "x.csv").write_text(f"Order Date{separator}Net-Revenue\n2024-01-01{separator}5\n")
    df = files.read_csv(spark, str(tmp_path / "x.csv"))
    assert df.columns == ["order_date", "net_revenue"] and df.first()["net_revenue"] == "5"


def test_one_column_is_refused_and_tables_round_trip(spark, tmp_path):
    (tmp_path / "x.csv").write_text("only\n1\n")
    with pytest.raises(InvalidArgument):
        files.read_csv(spark, str(tmp_path / "x.csv"))
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    assert files.write_canonical(df, str(tmp_path / "t")).collect() == df.collect()
    (tmp_path / "d.md").write_text("# Title\nbody")
    assert files.read_documents(spark, str(tmp_path / "d.md")).first().asDict() == {"document_name": "d.md", "text": "# Title\nbody"}


def write(path, rows, at):
    path.write_text("date,region,revenue\n" + "\n".join(f"2024-01-{d:02},{r},{v}" for d, r, v in rows) + "\n")
    os.utime(path, (at, at))


def test_a_frame_is_kept_until_its_file_changes(spark, tmp_path):
    path, frames = tmp_path / "x.csv", cache.Frames(spark, most=2)
    persisted = lambda: spark._jsparkSession.sharedState().cacheManager().numCachedEntries()
    before = persisted()
    write(path, [(1, "a", 5), (2, "b", 7)], 1_700_000_000)
    first, schema = frames.load(str(path))
    assert first.agg(F.sum("revenue")).first()[0] == 12 and first.storageLevel.useMemory and (schema.date_column, schema.dimensions, schema.measures) == ("date", ["region"], ["revenue"])
    assert frames.load(str(path))[0] is first
    write(path, [(1, "a", 6), (2, "b", 7)], 1_700_000_060)  # as long as before, only later
    second, _ = frames.load(str(path))
    assert second is not first and second.agg(F.sum("revenue")).first()[0] == 13 and persisted() == before + 1
    write(path, [(1, "a", 6), (2, "b", 7), (3, "c", 1)], 1_700_000_060)  # in the same moment, but longer
    third, _ = frames.load(str(path))
    assert third.count() == 3 and frames.load(str(path), preserve_missing=True)[0] is not third
    write(tmp_path / "y.csv", [(1, "a", 1), (2, "b", 2)], 1_700_000_000)
    frames.load(str(tmp_path / "y.csv"))
    assert persisted() == before + 2 and (str(path), False) not in frames._held  # the longest unused is given up
    frames.release(str(path), True)
    frames.release(str(tmp_path / "y.csv"))
    assert persisted() == before and not frames._held


def test_a_folder_of_files_is_one_state(spark, tmp_path):
    for k in range(2):
        write(tmp_path / f"{k}.csv", [(1 + k, "a", k), (3 + k, "b", 7)], 1_700_000_000)
    before = cache.stamp(spark, str(tmp_path))
    assert before.files == 2 and cache.stamp(spark, str(tmp_path)) == before
    write(tmp_path / "2.csv", [(9, "z", 1)], 1_600_000_000)
    assert cache.stamp(spark, str(tmp_path)) != before


def test_a_stream_gives_what_the_table_gives(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").alias("date"), "event_type", "value")
    own = [kpi("total", "sum", "{value}"), kpi("each", "mean", "{value}")]
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = windowed_sums(stream, own, group=["event_type"]).writeStream.outputMode("complete").format("memory").queryName("sums").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = {r["event_type"]: (round(r["total"], 6), round(r["each"], 6), r["rows"]) for r in finish(spark.table("sums"), own, ["event_type"]).collect()}
    want = {r["event_type"]: (round(r["t"], 6), round(r["m"], 6), r["n"]) for r in events.groupBy("event_type").agg(F.sum("value").alias("t"), F.avg("value").alias("m"), F.count("*").alias("n")).collect()}
    assert got == want
