"""File sinks and the versioned table sync."""

from pyspark.sql import functions as F

from intelspark.sinks import merge
from intelspark.sinks.sync import TableSpec, sync


def test_csv_export_has_the_fixed_columns(spark, tmp_path):
    rows = spark.createDataFrame([("s", "2024-01-01", "2024-01-01 00:00:00", "t", "l", "d", "en", "market", True)], ", ".join(f"{c} string" for c in merge.CSV_COLUMNS[:-1]) + ", matched boolean")
    merge.export_csv(rows, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert tuple(back.columns) == merge.CSV_COLUMNS and back.first()["matched"] == "yes"


def test_sync_writes_a_new_version(spark, tmp_path):
    spec = TableSpec("runs", ("run_id",), True, times=("started_at",))
    for run, status in (("r1", "failed"), ("r2", "success")):
        spark.createDataFrame([(run, status, "2024-01-01")], "run_id string, status string, started_at string").write.mode("append").parquet(str(tmp_path / "landed" / "runs"))
    first = sync(spark, str(tmp_path / "landed"), str(tmp_path / "serving"), "v1", tables=(spec,)).first()
    again = sync(spark, str(tmp_path / "landed"), str(tmp_path / "serving"), "v2", previous="v1", run_id="r2", tables=(spec,)).first()
    assert (first["scanned"], first["inserted"]) == (2, 2) and (again["scanned"], again["inserted"], again["skipped"]) == (1, 0, 1)
    state = spark.read.parquet(str(tmp_path / "serving" / "v2" / "runs"))
    assert state.count() == 2 and state.select(F.year("started_at").alias("y")).first()["y"] == 2024


def test_the_last_row_of_a_run_wins_and_null_keys_count_once(spark, tmp_path):
    spec = TableSpec("runs", ("run_id",), True)
    for run, status in (("r1", "2 finished"), (None, "x")):
        spark.createDataFrame([(run, "1 started")], "run_id string, status string").coalesce(1).write.mode("append").parquet(str(tmp_path / "landed" / "runs"))
        spark.createDataFrame([(run, status)], "run_id string, status string").coalesce(1).write.mode("append").parquet(str(tmp_path / "landed" / "runs"))
    first = sync(spark, str(tmp_path / "landed"), str(tmp_path / "serving"), "v1", tables=(spec,)).first()
    assert (first["scanned"], first["inserted"], first["skipped"]) == (4, 2, 2)
    state = spark.read.parquet(str(tmp_path / "serving" / "v1" / "runs"))
    assert {(r.run_id, r.status) for r in state.collect()} == {("r1", "2 finished"), (None, "x")}
    again = sync(spark, str(tmp_path / "landed"), str(tmp_path / "serving"), "v2", previous="v1", tables=(spec,)).first()
    assert again["inserted"] == 0 and spark.read.parquet(str(tmp_path / "serving" / "v2" / "runs")).count() == 2
    kept = TableSpec("runs", ("run_id",))
    sync(spark, str(tmp_path / "landed"), str(tmp_path / "serving"), "v3", tables=(kept,))
    assert {r.status for r in spark.read.parquet(str(tmp_path / "serving" / "v3" / "runs")).collect()} == {"1 started"}
