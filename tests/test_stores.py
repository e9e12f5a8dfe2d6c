"""The stores of the writers: exact bytes, day folders that are pruned, versions."""

from datetime import timedelta

from frames import T0, event, frame

from emberwatch.sources import readers, writers


def test_log_lines_keep_their_bytes(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\ntwo \r\r\n\n \t\x0b\nthr\xffee\n\r\nlast")
    rows = readers.read_log_lines(spark, str(tmp_path / "a.log")).collect()
    assert sorted((bytes(r["raw_data"]), r["is_valid_utf8"]) for r in rows) == [
        (b"last", True), (b"one", True), (b"thr\xffee", False), (b"two \r", True),
    ]


def test_record_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"records": ["x", "y\\nz"], "more": 1}')
    (tmp_path / "b.json").write_text('{"records": []}')
    rows = readers.read_record_arrays(spark, str(tmp_path)).collect()
    assert sorted((r["record_no"], bytes(r["raw_data"])) for r in rows) == [(0, b"x"), (1, b"y\nz")]


def test_scan_reads_only_its_days(spark, tmp_path):
    rows = [event(n, 86_400 * (n % 6)) for n in range(60)]
    writers.write_events(frame(spark, rows), str(tmp_path / "ev"), rows_per_file=4)
    stored = spark.read.parquet(str(tmp_path / "ev"))
    found = readers.scan_events(stored, T0 + timedelta(days=1), T0 + timedelta(days=2))
    assert found.count() == 20
    read = {r[0].split("event_date=")[1][:10] for r in found.select("_metadata.file_path").distinct().collect()}
    assert len(read) == 2
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_a_snapshot_is_never_written_over_another(spark, tmp_path):
    one = writers.write_snapshot(spark.range(3), str(tmp_path), "1")
    two = writers.write_snapshot(spark.read.parquet(one).filter("id > 0"), str(tmp_path), "2")
    assert (spark.read.parquet(one).count(), spark.read.parquet(two).count()) == (3, 2)
