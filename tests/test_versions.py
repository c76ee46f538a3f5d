"""Commits of several tables at once: all or nothing, replays, and pruned look-ups."""

import pytest
from pyspark.sql import functions as F

from intelspark.sinks.versions import VersionedTable, VersionedTables
from intelspark.streaming import ingest

ROWS = "id int, at timestamp, name string"


@pytest.fixture()
def store(spark, tmp_path):
    schema = spark.createDataFrame([], ROWS).schema
    names = ("facts", "signals", "timeline", "insights", "companies")
    return VersionedTables(spark, str(tmp_path / "store"), *[VersionedTable(n, schema, ("id", "name"), "at") for n in names],
                           VersionedTable("runs", schema, ("id",), update=True, order="at"))


def rows(spark, *values):
    return spark.createDataFrame([(i, at, n) for i, at, n in values], "id int, at string, name string").withColumn("at", F.to_timestamp("at"))


def names(store, table):
    return sorted((r.id, r.name) for r in store.read(table).collect())


def test_a_killed_batch_leaves_nothing(spark, store):
    good = rows(spark, (1, "2024-01-01", "a"), (2, None, "b"), (None, "2024-01-01", None))
    bad = good.withColumn("name", F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="lost"):
        store.commit("s-0", {"facts": good, "signals": good, "timeline": bad, "runs": good})
    assert all(store.read(t).count() == 0 for t in store.tables) and store.manifest().count() == 0
    assert store.commit("s-0", {t: good for t in store.tables}) and not store.commit("s-0", {"facts": good})
    assert all(store.read(t).count() == 3 for t in store.tables)
    assert {(r.table, r.scanned, r.inserted) for r in store.manifest().collect()} == {(t, 3, 3) for t in store.tables}


def test_only_new_keys_are_added_and_null_keys_are_keys(spark, store):
    store.commit("s-0", {"facts": rows(spark, (1, "2024-01-01", "a"), (1, "2024-01-01", "a"), (None, None, None))})
    store.commit("s-1", {"facts": rows(spark, (1, "2024-01-01", "a"), (3, "2024-01-01", "c"), (None, None, None))})
    assert sorted(((r.id or 0), r.name or "") for r in store.read("facts").collect()) == [(0, ""), (1, "a"), (3, "c")]
    assert [(r.scanned, r.inserted) for r in store.manifest().orderBy("batch").collect()] == [(3, 2), (3, 1)]


def test_updates_keep_the_last_version(spark, store):
    store.commit("s-9", {"runs": rows(spark, (1, "2024-01-02", "finished"), (1, "2024-01-01", "started"), (2, "2024-01-01", "started"))})
    store.commit("s-10", {"runs": rows(spark, (2, "2024-01-03", "finished"))})
    assert names(store, "runs") == [(1, "finished"), (2, "finished")]


def test_later_batches_do_not_read_old_days(spark, store):
    store.commit("s-0", {"facts": rows(spark, *[(i, f"2024-01-{i:02d}", "a") for i in range(1, 29)])})
    plan = store.fresh("facts", rows(spark, (7, "2024-01-07", "a"), (8, "2024-02-01", "b")))._jdf.queryExecution().toString()
    scans = [line for line in plan.splitlines() if "PartitionFilters: [" in line and "name" in line and "FileScan" in line]
    assert scans and all("day" in s and "2024-01-07" in s and "2024-01-08" not in s for s in scans)


def test_a_stream_commits_every_batch_once(spark, store, tmp_path):
    schema = spark.createDataFrame([], ROWS).schema
    for part in range(3):
        rows(spark, (part, "2024-01-01", "a"), (9, "2024-01-05", "z")).write.mode("append").parquet(str(tmp_path / "landing"))
    split = lambda df: {"facts": df, "timeline": df.filter("id = 9"), "runs": df}
    for delivery in ("one", "one", "two"):
        stream = ingest.landed_stream(spark, str(tmp_path / "landing"), schema, files_per_batch=1)
        ingest.start_ingestion(stream, store.writer(delivery, split), str(tmp_path / f"check-{delivery}")).awaitTermination()
    assert names(store, "facts") == [(0, "a"), (1, "a"), (2, "a"), (9, "z")] and names(store, "timeline") == [(9, "z")]
    # A lost checkpoint delivers the same batches again under the same numbers: their manifests are there.
    before = store.manifest().count()
    stream = ingest.landed_stream(spark, str(tmp_path / "landing"), schema, files_per_batch=1)
    ingest.start_ingestion(stream, store.writer("one", split), str(tmp_path / "check-lost")).awaitTermination()
    assert store.manifest().count() == before and store.read("runs").count() == 4
