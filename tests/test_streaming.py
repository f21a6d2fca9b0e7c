import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwright.session import fresh_path
from cellwright.streaming import jobs as J

CELLS = T.StructType([
    T.StructField("collection", T.StringType()), T.StructField("granule_id", T.StringType()), T.StructField("ts", T.TimestampType()),
    T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
    T.StructField("value", T.DoubleType()), T.StructField("qa_flag", T.IntegerType()),
])


def _arrive(spark, folder, rows):
    """One file per call, so that each call is a trigger of its own."""
    df = spark.createDataFrame([("C", "g", *r) for r in rows], "collection string, granule_id string, ts string, i int, j int, lat double, lon double, value double, qa_flag int")
    df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)


def test_ingest_keeps_good_cells_once_and_names_the_bad_ones(spark):
    folder, path = fresh_path(spark, "in"), fresh_path(spark, "out")
    _arrive(spark, folder, [("2024-01-01 00:00", 0, 0, 1.0, 1.0, float("nan"), 0), (None, 0, 1, 1.0, 1.0, 5.0, 0)])
    J.stream_ingest_cells(J.read_stream(spark, folder, CELLS, 1), path, f"{path}/checkpoint")
    _arrive(spark, folder, [("2024-01-01 01:00", 0, 0, 1.0, 1.0, 2.0, 0), ("2024-01-01 01:00", 0, 1, 99.0, 1.0, 2.0, 0)])
    J.stream_ingest_cells(J.read_stream(spark, folder, CELLS, 1), path, f"{path}/checkpoint")
    good = spark.read.parquet(f"{path}/cells").orderBy("ts").collect()
    assert [r["value"] for r in good] == [None, 2.0]
    assert sorted(r["reason"] for r in spark.read.parquet(f"{path}/rejects").collect()) == ["no place", "no time"]


def test_dedup_keeps_the_first_granule_whatever_arrives_first(spark):
    folder, path = fresh_path(spark, "in"), fresh_path(spark, "out")
    job = lambda c: J.stream_dedup_granules(c.withColumn("granule_id", F.concat("granule_id", F.col("value").cast("int").cast("string"))))
    arrive = lambda *rows: _arrive(spark, folder, list(rows))
    run = lambda: J.run_bounded(job, J.read_stream(spark, folder, CELLS, 1), spark.read.schema(CELLS).parquet(folder), f"{path}/out", f"{path}/c")
    arrive(("2024-01-01 00:00", 0, 0, 1.0, 1.0, 2.0, 0))
    assert [r["value"] for r in run().collect()] == [2.0]
    arrive(("2024-01-01 00:00", 0, 0, 1.0, 1.0, 1.0, 0), ("2024-01-01 00:00", 0, 1, 1.0, 1.0, 3.0, 0), ("2024-01-04 00:00", 0, 0, 1.0, 1.0, 4.0, 0))
    assert sorted(r["value"] for r in run().collect()) == [1.0, 3.0, 4.0]
    assert sorted(r["value"] for r in spark.read.parquet(f"{path}/out").collect()) == [1.0, 3.0]


def test_a_bounded_run_returns_open_windows_once(spark):
    folder, path = fresh_path(spark, "in"), fresh_path(spark, "out")
    run = lambda: J.run_bounded(J.stream_timeseries, J.read_stream(spark, folder, CELLS, 1), spark.read.schema(CELLS).parquet(folder), f"{path}/out", f"{path}/c", width="1 hour")
    _arrive(spark, folder, [("2024-01-01 00:10", 0, 0, 0.0, 1.0, 1.0, 0), ("2024-01-01 03:30", 0, 0, 0.0, 1.0, 5.0, 0)])
    assert sorted((str(r["ts"])[11:16], r["n"]) for r in run().collect()) == [("00:00", 1), ("03:00", 1)]
    # the first of these is late, the second joins the open window
    _arrive(spark, folder, [("2024-01-01 00:50", 0, 0, 0.0, 1.0, 9.0, 0), ("2024-01-01 03:40", 0, 0, 0.0, 1.0, 7.0, 0)])
    assert sorted((str(r["ts"])[11:16], r["n"]) for r in run().collect()) == [("00:00", 1), ("03:00", 2)]


def test_late_rows_are_dropped_and_counted(spark):
    folder, path = fresh_path(spark, "in"), fresh_path(spark, "out")
    run = lambda: J.run_to_files(J.stream_timeseries(J.read_stream(spark, folder, CELLS, 1)), f"{path}/out", f"{path}/c")
    _arrive(spark, folder, [("2024-01-01 00:10", 0, 0, 0.0, 1.0, 1.0, 0), ("2024-01-01 00:20", 1, 0, 60.0, 1.0, 4.0, 0), ("2024-01-01 06:00", 0, 0, 0.0, 1.0, 7.0, 0)])
    run()
    _arrive(spark, folder, [("2024-01-01 00:30", 0, 0, 0.0, 1.0, 100.0, 0), ("2024-01-01 12:00", 0, 0, 0.0, 1.0, 9.0, 0)])
    progress = run()
    assert J.late_rows(progress) == 1
    got = {str(r["ts"])[11:16]: round(r["value"], 9) for r in spark.read.parquet(f"{path}/out").collect()}
    assert got == {"00:00": 2.0, "06:00": 7.0}


GOOD = ("2024-01-01 00:00", 0, 0, 1.0, 1.0, 2.0, 0)


@pytest.fixture
def folders(spark):
    return fresh_path(spark, "in"), fresh_path(spark, "out")


def _ingest(spark, folders, per_trigger=1):
    J.stream_ingest_files(spark, folders[0], folders[1], f"{folders[1]}/checkpoint", per_trigger)


def _wrong(spark, folder, change):
    rows = spark.createDataFrame([("C", "bad", *GOOD)], "collection string, granule_id string, ts string, i int, j int, lat double, lon double, value double, qa_flag int")
    change(rows.withColumn("ts", F.col("ts").cast("timestamp"))).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("change, said", [
    (lambda df: df.drop("qa_flag"), "qa_flag is missing"),
    (lambda df: df.withColumn("value", F.col("value").cast("float")), "value is float, not double"),
    (lambda df: df.withColumn("extra", F.lit(1)), "extra is not agreed on"),
])
def test_a_batch_that_breaks_the_contract_stores_no_row(spark, folders, change, said):
    _arrive(spark, folders[0], [GOOD])
    _ingest(spark, folders)
    _arrive(spark, folders[0], [("2024-01-01 01:00", 0, 0, 1.0, 1.0, 3.0, 0)])
    _wrong(spark, folders[0], change)
    with pytest.raises(StreamingQueryException, match=said):
        _ingest(spark, folders, 4)  # the good file is in the same batch
    assert J.ingested(spark, folders[1]).count() == 1 and J.manifest(spark, folders[1]).count() == 1
    with pytest.raises(StreamingQueryException, match=said):  # and it stays to be done
        _ingest(spark, folders, 4)
    assert J.ingested(spark, folders[1]).count() == 1


def test_a_batch_that_runs_again_leaves_one_copy(spark, folders, monkeypatch):
    """The driver is lost after the cells of a batch were written: what it left is not read, and the restart stores the batch once."""
    _arrive(spark, folders[0], [GOOD])
    _ingest(spark, folders)
    _arrive(spark, folders[0], [("2024-01-01 01:00", 0, 0, 1.0, 1.0, 3.0, 0), ("2024-01-01 01:00", 0, 1, 99.0, 1.0, 2.0, 0)])
    true = J.reject_reason

    def lost(batch, path, number):
        batch.withColumn("reason", true()).where("reason IS NULL").drop("reason").write.mode("overwrite").parquet(f"{path}/cells/batch={number}")
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(J, "_store", lost)
        with pytest.raises(StreamingQueryException, match="lost"):
            _ingest(spark, folders)
    assert J.ingested(spark, folders[1]).count() == 1
    for _ in range(2):
        _ingest(spark, folders)
    assert sorted(r["value"] for r in J.ingested(spark, folders[1]).collect()) == [2.0, 3.0]
    assert [r["reason"] for r in J.ingested(spark, folders[1], "rejects").collect()] == ["no place"]
    assert {(r["batch"], r["cells"], r["rejects"]) for r in J.manifest(spark, folders[1]).collect()} == {(0, 1, 0), (1, 1, 1)}
