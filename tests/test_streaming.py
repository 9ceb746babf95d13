import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from vulnlake import fields
from vulnlake.operators import events as ev
from vulnlake.operators import facets
from vulnlake.operators.versions import ContractViolation, collapse_current
from vulnlake.sources.tables import stream_events, write_events
from vulnlake.spec import QuerySpec
from vulnlake.streaming import changes as st

NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)


@pytest.fixture()
def table(spark, log_rows, tmp_path):
    made = st.FindingsTable(spark, str(tmp_path / "table"), "v1", snapshot_every=2)
    made.create(collapse_current(log_rows(
        {"cve": "a", "ms": 5}, {"cve": "b", "ms": 5}, {"cve": "c", "ms": 5, "severity": "low"})))
    return made


def change_rows(source_rows, ups=(), deletes=()):
    rows = source_rows(*(ups or [{}]))
    if not ups:
        rows = rows.limit(0)
    spark = rows.sparkSession
    up = rows.select(F.lit("upsert").alias("op"), *fields.SOURCE_FIELDS,
                     F.col("cve").alias("requestOrder"))
    gone = spark.createDataFrame([(i, i) for i in deletes] or [("", "")],
                                 "findingId string, requestOrder string")
    gone = gone.where("findingId <> ''").select(F.lit("delete").alias("op"), "*")
    both = up.unionByName(gone, allowMissingColumns=True)
    return both.select(*st.CHANGE_COLUMNS)


def state(df):
    return sorted((r.cve, r.cvss) for r in df.collect())


def id_of(table, cve):
    return table.current().where(F.col("cve") == cve).first().findingId


def test_batches_replays_and_snapshots(table, source_rows):
    first = change_rows(source_rows, [{"cve": "a", "cvss": 1.0}], [id_of(table, "b")])
    second = change_rows(source_rows, [{"cve": "b", "cvss": 2.0}, {"cve": "d"}])
    emitted = table.apply(first, 1, NOW)
    assert [(r.seq, r.type) for r in emitted.orderBy("seq").collect()] == [
        (1, "finding-upserted"), (2, "finding-deleted")]
    assert state(table.current()) == [("a", 1.0), ("c", 0.0)]
    for _ in range(2):  # a repeated batch changes nothing
        table.apply(second, 2, NOW)
        assert state(table.current()) == [("a", 1.0), ("b", 2.0), ("c", 0.0), ("d", 0.0)]
        assert table.events().count() == 1 + 2 + 2
    assert table._numbers("snapshot") == [0, 2]
    assert state(table.current(before=2)) == [("a", 1.0), ("c", 0.0)]
    # Re-created after a delete: a new history starts.
    revived = table.current().where("cve = 'b'").first()
    assert revived.firstSeenAt == NOW.replace(tzinfo=None)
    with pytest.raises(ContractViolation):
        table.apply(change_rows(source_rows, [{"cve": str(n)} for n in range(501)]), 3, NOW)
    with pytest.raises(ContractViolation, match="do not match"):
        table.apply(second, 3, NOW, for_version="v0")


def test_stream_to_table_rejects_and_refreshes(spark, table, source_rows, tmp_path):
    feed, checkpoint = str(tmp_path / "feed"), str(tmp_path / "checkpoint")
    views = {"facets": lambda current: facets.facet(current, QuerySpec(), "severity")}

    def run():
        source = spark.readStream.schema(spark.read.parquet(feed).schema).option(
            "maxFilesPerTrigger", 1).parquet(feed)
        st.stream_to_table(source, table, checkpoint, lambda: NOW, views).awaitTermination()

    change_rows(source_rows, [{"cve": "a", "cvss": 4.0}]).coalesce(1).write.parquet(feed)
    run()
    change_rows(source_rows, deletes=["f" * 32]).coalesce(1).write.mode("append").parquet(feed)
    run()
    change_rows(source_rows, deletes=[id_of(table, "c")]).coalesce(1).write.mode("append").parquet(
        feed)
    run()
    assert state(table.current()) == [("a", 4.0), ("b", 0.0)]
    refused = spark.read.parquet(f"{table.root}/rejected/2").first()
    assert "unknown finding ids" in refused.refusal
    shown = {r.value: r["count"] for r in spark.read.parquet(f"{table.root}/view/facets/3").collect()}
    assert shown == {"high": 2}


def deletions(numbers):
    base = {"v": 1, "datasetVersion": "v1", "at": "2024-01-01T00:00:00Z", "type": "finding-deleted"}
    return [(f"{n}-0", json.dumps({**base, "id": f"{n:032x}"})) for n in numbers]


def test_each_trigger_is_one_arrival_window(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    schema = "log_id string, event string"
    for numbers in (range(1, 12), range(20, 23)):
        rows = deletions(numbers)
        if numbers[0] == 20:
            rows.append(("23-0", "{"))
        write_events(spark.createDataFrame(rows, schema).coalesce(1), log)
        st.stream_coalesce(
            stream_events(spark, log), out, str(tmp_path / "checkpoint"), "v1", threshold=10
        ).awaitTermination()
    burst = spark.read.parquet(f"{out}/events/0").orderBy("ord", "ms").collect()
    assert [(r.type, r.ms) for r in burst] == [("aggregates-invalidated", 1), ("findings-changed", 11)]
    calm = spark.read.parquet(f"{out}/events/1").orderBy("ms").collect()
    assert [r.ms for r in calm] == [20, 21, 22]
    assert [r.reason for r in spark.read.parquet(f"{out}/rejected/1").collect()] == ["malformed JSON"]


def test_streaming_equals_batch(spark, tmp_path):
    log = str(tmp_path / "log")
    entries = spark.createDataFrame(deletions(range(1, 40)), "log_id string, event string")
    write_events(entries, log)
    st.stream_coalesce(
        stream_events(spark, log), str(tmp_path / "out"), str(tmp_path / "checkpoint"), "v1",
        width="1 day", threshold=10,
    ).awaitTermination()
    out = str(tmp_path / "out")
    assert spark.read.parquet(f"{out}/events/0").isEmpty()  # the window is still open
    st.drain_windows(spark, out, lambda held: ev.coalesce(held, "1 day", 10))
    streamed = spark.read.parquet(f"{out}/events/drained")
    batch = ev.coalesce(ev.valid_events(entries, "v1"), "1 day", 10)
    assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.collect()))


def test_windows_are_final_after_the_watermark(spark, tmp_path):
    log, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "checkpoint"))
    base = {"v": 1, "datasetVersion": "v1", "type": "finding-deleted", "id": "a" * 32}

    def write(*seconds):
        rows = [(f"{s}-0", json.dumps({**base, "at": f"2024-01-01T00:00:{s:02d}Z"}))
                for s in seconds]
        write_events(spark.createDataFrame(rows, "log_id string, event string").coalesce(1), log)
        load = st.stream_window_load(stream_events(spark, log), "v1", "10 seconds", 2, "5 seconds")
        st.append_batches(load, out, checkpoint).awaitTermination()

    write(1, 2, 3, 11)
    write(26)
    write(4, 27)  # 4 is late: its window was already final
    rows = spark.read.parquet(*[str(p) for p in (tmp_path / "out").iterdir()])
    assert sorted((r.window_start.second, r.events, r.open) for r in rows.collect()) == [
        (0, 3, True), (10, 1, False)]


def windowed(spark, tmp_path, emit, *files, **settings):
    """Entries given as lists of (second, number), one file and one trigger after another."""
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    base = {"v": 1, "datasetVersion": "v1", "type": "finding-deleted"}
    for rows in files:
        entries = [
            (f"{1000 * s}-{n}", json.dumps({**base, "at": f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}Z", "id": f"{n:032x}"}))
            for s, n in rows
        ]
        write_events(spark.createDataFrame(entries, "log_id string, event string").coalesce(1), log)
        emit(stream_events(spark, log), out, str(tmp_path / "checkpoint"), "v1", **settings).awaitTermination()
    return out


def test_a_burst_window_over_two_files_is_one(spark, tmp_path):
    out = windowed(
        spark, tmp_path, st.stream_coalesce, [(1, n) for n in range(80)], [(2, n) for n in range(80, 160)], [(60, 999)],
        width="10 seconds", delay="5 seconds",
    )
    rows = spark.read.parquet(f"{out}/events/*").orderBy("ord").collect()
    assert [r.type for r in rows] == ["aggregates-invalidated", "findings-changed"]
    assert len(rows[1].ids) == 160
    st.drain_windows(spark, out, lambda held: ev.coalesce(held, "10 seconds"))
    assert [r.id for r in spark.read.parquet(f"{out}/events/drained").collect()] == [f"{999:032x}"]


def test_late_events_are_rejected_and_none_is_lost(spark, tmp_path):
    files = [[(1, 1), (12, 2)], [(30, 3), (3, 4)], [(4, 5), (29, 6), (31, 7)], [(100, 8), (11, 9)]]
    out = windowed(spark, tmp_path, st.stream_window_counts, *files, width="10 seconds", delay="5 seconds")
    st.drain_windows(spark, out, lambda held: ev.window_load(held, "10 seconds"))
    load = {r.window_start.minute * 60 + r.window_start.second: r.events for r in spark.read.parquet(f"{out}/events/*").collect()}
    late = spark.read.parquet(f"{out}/rejected/*").collect()
    # The mark stands at 12 when 3 arrives, at 30 when 4 and 29 arrive, at 31 when 11 arrives.
    assert load == {0: 2, 10: 1, 20: 1, 30: 2, 100: 1}
    assert sorted((r.log_id, r.reason) for r in late) == [("11000-9", "late"), ("4000-5", "late")]


def test_a_repeated_trigger_starts_from_the_one_before(spark, tmp_path, monkeypatch):
    files = [[(1, n) for n in range(3)], [(2, n) for n in range(3, 6)]]
    windowed(spark, tmp_path, st.stream_window_counts, files[0], width="10 seconds")
    real = st.write_small

    def broken(*args):
        raise RuntimeError("lost before the mark")

    monkeypatch.setattr(st, "write_small", broken)
    with pytest.raises(Exception, match="lost before the mark"):
        windowed(spark, tmp_path, st.stream_window_counts, files[1], width="10 seconds")
    monkeypatch.setattr(st, "write_small", real)
    out = windowed(spark, tmp_path, st.stream_window_counts, [(90, 9)], width="10 seconds")
    assert [r.events for r in spark.read.parquet(f"{out}/events/*").collect()] == [6]
