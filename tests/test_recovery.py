"""What repeats, restarts, clocks and hostile values must not lose or change."""

import glob
import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from test_streaming import change_rows, id_of
from vulnlake.operators import events as ev
from vulnlake.operators import export, facets, maintained, overview
from vulnlake.operators.versions import ContractViolation, collapse_current
from vulnlake.session import scratch_path, scratch_scope
from vulnlake.plans.ingest import ingest
from vulnlake.sources import corpus, tables
from vulnlake.spec import QuerySpec
from vulnlake.streaming import changes as st

NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)


@pytest.fixture()
def table(spark, log_rows, tmp_path):
    made = st.FindingsTable(spark, str(tmp_path / "table"), "v1", snapshot_every=2)
    made.create(collapse_current(log_rows({"cve": "a", "ms": 5}, {"cve": "b", "ms": 5})))
    return made


def test_a_recreated_finding_lives_and_ids_only_grow(table, source_rows):
    id = id_of(table, "a")
    many = [{"cve": f"n{k}"} for k in range(30)]
    table.apply(change_rows(source_rows, many, [id]), 1, NOW)
    # The clock has not reached the stamps of the first batch, then steps back.
    table.apply(change_rows(source_rows, [{"cve": "a", "cvss": 3.0}]), 2, NOW + timedelta(milliseconds=5))
    table.apply(change_rows(source_rows, [{"cve": "b", "cvss": 4.0}]), 3, NOW - timedelta(hours=1))
    found = {r.cve: r.cvss for r in table.current().where("cve in ('a', 'b')").collect()}
    assert found == {"a": 3.0, "b": 4.0}
    # The creating event carries today's clock, so all later ids follow it.
    entries = table.events()
    ms, seq = ev.log_id_parts(F.col("log_id"))
    ids = [tuple(r) for r in entries.select(ms, seq).collect()]
    assert len(set(ids)) == len(ids) == 1 + 31 + 1 + 1
    by_batch = [
        [tuple(r) for r in tables.read_events(table.spark, f"{table.root}/events/{n}").select(ms, seq).collect()]
        for n in range(4)
    ]
    assert all(max(a) < min(b) for a, b in zip(by_batch, by_batch[1:]))


def test_a_second_checkpoint_takes_its_own_numbers(spark, table, source_rows, tmp_path):
    source = str(tmp_path / "feed")
    change_rows(source_rows, [{"cve": "x"}]).coalesce(1).write.mode("append").parquet(source)

    def run(checkpoint):
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        st.stream_to_table(stream, table, str(tmp_path / checkpoint), lambda: NOW).awaitTermination()

    run("one")
    change_rows(source_rows, [{"cve": "y"}], ["0" * 32]).coalesce(1).write.mode("append").parquet(source)
    run("two")
    assert {r.cve for r in table.current().collect()} >= {"a", "b", "x"}
    refused = spark.read.parquet(f"{table.root}/rejected/2")
    assert [r.findingId for r in refused.where("unknown").collect()] == ["0" * 32]


def test_old_snapshots_and_logs_go(table, source_rows):
    for n in range(1, 8):
        table.apply(change_rows(source_rows, [{"cve": "a", "cvss": float(n)}]), n, NOW)
    assert table._manifests() == [4, 6] and min(table._numbers("log")) == 5
    # Only the bucket of "b" was never written again.
    kept = tables.children(table.spark, f"{table.root}/snapshot/0")
    assert len([c for c in kept if c.startswith("bucket=")]) == 1
    assert table._numbers("snapshot") == [0, 4, 6]
    assert table.current().where("cve = 'a'").first().cvss == 7.0


def test_a_refusal_names_every_unknown_id(table, source_rows):
    unknown = [f"{k:032x}" for k in range(30)]
    with pytest.raises(ContractViolation) as refusal:
        table.apply(change_rows(source_rows, deletes=unknown), 1, NOW)
    assert all(id in str(refusal.value) for id in unknown)
    assert sorted(r.findingId for r in refusal.value.ids.collect()) == unknown


def test_a_feed_of_another_version_is_refused(table, source_rows):
    changes = change_rows(source_rows, [{"cve": "z"}]).withColumn("datasetVersion", F.lit("v2"))
    with pytest.raises(ContractViolation):
        table.apply(changes, 1, NOW)


def test_a_run_keeps_all_its_ids(spark):
    rows = spark.range(12_001).select(
        *ev.blank_event(
            ms=F.col("id"), seq=F.lit(0), type=F.lit("finding-deleted"), datasetVersion=F.lit("v1"),
            at=F.lit(NOW), id=F.format_string("%032x", "id"),
        )
    )
    merged = ev.coalesce(rows, None).where("type = 'findings-changed'").orderBy("ord").collect()
    assert [len(r.ids) for r in merged] == [5_000, 5_000, 2_001] and [r.ord for r in merged] == [2, 3, 4]
    assert [id for r in merged for id in r.ids] == [f"{k:032x}" for k in range(12_001)]


def test_csv_cells_keep_their_spaces(spark, log_rows, tmp_path):
    cells = ["  =1+1", "x ", " y", 'a "b", c', "two\nlines", "=2"]
    rows = log_rows(*[{"cve": f"CVE-{k}", "status": c} for k, c in enumerate(cells)])
    export.write_csv(export.export_rows(rows, QuerySpec()), str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "out"))
    found = {r.status for r in back.collect()}
    assert found == {"x ", " y", 'a "b", c', "two\nlines", "'=2", "  =1+1"} or found == {"x ", " y", 'a "b", c', "two\nlines", "'=2", "'  =1+1"}
    text = "".join(open(f, newline="").read() for f in glob.glob(f"{tmp_path}/out/*.csv"))
    assert "x ," in text and "\n=1+1" not in text


def test_finished_expired_and_broken_jobs(spark, log_rows, tmp_path):
    store = export.ExportStore(spark, str(tmp_path / "exports"))
    assert store.manifest().count() == 0
    current = log_rows({"cve": "CVE-1"})
    job = store.create(QuerySpec(), NOW)
    done = store.run(job, current, NOW)
    assert done["status"] == "READY"
    again = store.run(job, current.limit(0), NOW)  # a finished job stays as it is
    assert again["status"] == "READY" and again["rowCount"] == 1
    assert spark.read.option("header", True).csv(f"{store.root}/{done['artifactName']}").count() == 1
    late = store.create(QuerySpec(), NOW)
    assert store.run(late, current, NOW + timedelta(hours=2))["status"] == "PENDING"
    crashed = store.create(QuerySpec(), NOW)
    (tmp_path / "exports" / f"{crashed['id']}.csv").mkdir()  # left by a lost attempt
    assert store.run(crashed, current, NOW)["status"] == "READY"
    unbounded = export.ExportStore(spark, str(tmp_path / "wide"), max_rows=None)
    assert export.checked_count(3_000_000_000, unbounded.max_rows) == 3_000_000_000


def test_export_events_have_their_own_ids(spark):
    jobs = spark.createDataFrame([("b", "READY"), ("a", "READY"), ("c", "FAILED")], "id string, status string")
    ms = int(NOW.timestamp() * 1000)
    rows = export.ready_events(jobs, "v1", NOW, (ms, 7)).orderBy("seq").collect()
    assert [(r.ms, r.seq, r.jobId) for r in rows] == [(ms, 8, "a"), (ms, 9, "b")]


def test_an_empty_replacement_empties_the_version(log_rows, tmp_path):
    rows, path = log_rows({"cve": "a"}), str(tmp_path / "log")
    tables.load_initial(rows, path, "v 1")
    tables.load_initial(rows.limit(0), path, "v 1", replace=True)
    assert tables.read_log(rows.sparkSession, path, "v 1").count() == 0
    dead = log_rows({"cve": "a", "ms": 9, "isDeleted": True})
    tables.write_log(dead, path, "v 1")
    tables.load_initial(rows, path, "v 1")  # tombstones alone are no findings


def test_line_breaks_and_big_ids(spark):
    for bad in ("15-0\n", "1-1\n"):
        with pytest.raises(ValueError):
            ev.parse_log_id(bad)
    assert spark.range(1).select(ev.log_id_parts(F.lit("15-0\n"))[0].isNull().alias("x")).first().x
    events = spark.createDataFrame([(5, 0)], "ms long, seq long")
    start = ev.start_position(events, f"{2**64}-0").first()
    assert start.resync and start.cursor == "5-0"
    assert ev.replay_after(events, f"{2**64}-0").count() == 0
    with pytest.raises(ValueError):
        export.job_id("9b2f6c1e-0a4d-4c3b-8e21-7f5d3a9c0b64\n")


def test_scratch_goes_with_its_scope(spark):
    with scratch_scope(spark):
        path = scratch_path(spark, "gone")
        spark.range(3).write.parquet(path)
        assert tables.exists(spark, path)
    assert not tables.exists(spark, path)


def report(*records):
    image = {"name": "i", "vulnerabilities": list(records)}
    return {"groups": {"g": {"repos": {"r": {"images": {"i": image}}}}}}


def test_unreadable_documents_are_counted_and_refused(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "good.json").write_text(json.dumps(report({"cve": "A"})))
    (folder / "twice.json").write_text(json.dumps(report({"cve": "B"}, {"cve": "C"})).replace('"cve": "B"', '"cve": "x", "cve": "B"'))
    (folder / "cut.json").write_text(json.dumps(report({"cve": "D"}))[:-9])
    read = corpus.read_source(spark, str(folder))
    with pytest.raises(ContractViolation):
        ingest(read, str(tmp_path / "no"), "v1", NOW)
    told = ingest(read, str(tmp_path / "yes"), "v1", NOW, allow_corrupt=True).first()
    assert (told.corruptDocuments, told.sourceRowsWritten) == (1, 3)
    found = st.FindingsTable.open(spark, str(tmp_path / "yes"), "v1").current()
    assert {r.cve for r in found.collect()} == {"A", "B", "C"}


@pytest.mark.parametrize("longer", ["a", "b"])
def test_the_later_file_wins_whatever_its_size(spark, tmp_path, longer):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in "ab":
        filler = [{"cve": f"F{k}"} for k in range(400 if name == longer else 1)]
        (folder / f"{name}.json").write_text(json.dumps(report({"cve": "A", "status": name}, *filler)))
    ingest(corpus.read_source(spark, str(folder)), str(tmp_path / "t"), "v1", NOW, batch_rows=5)
    current = st.FindingsTable.open(spark, str(tmp_path / "t"), "v1").current()
    assert current.where("cve = 'A'").first().status == "b"


def content(folder):
    """Every file below a folder with its bytes."""
    return {str(f.relative_to(folder)): f.read_bytes() for f in sorted(folder.rglob("*")) if f.is_file()}


class Killed(BaseException):
    """The driver is gone."""


STEPS = {
    "source": (st.FindingsTable, "create"),
    "snapshot": (st, "write_events"),
    "events": (st.FindingsTable, "_write_state"),
    "state": (tables, "ingest_report"),
    "commit": (tables, "put_if_absent"),
}


def test_a_load_that_dies_after_any_step_changes_nothing(spark, tmp_path, monkeypatch):
    folder, root = tmp_path / "in", tmp_path / "lake"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(report({"cve": "A"}, {"cve": "B"})))
    ingest(corpus.read_source(spark, str(folder)), str(root), "v1", NOW)
    (folder / "b.json").write_text(json.dumps(report({"cve": "C"})))
    published = tables.Generations(spark, str(root)).published("v1")
    before = content(tmp_path / published.removeprefix(f"{tmp_path}/"))

    def dies(*args, **kwargs):
        raise Killed

    for step, target in STEPS.items():
        with monkeypatch.context() as patch:
            patch.setattr(tables.Generations, "discard", lambda *args: None)  # a dead driver tidies nothing
            patch.setattr(*target, dies)
            with pytest.raises(Killed):
                ingest(corpus.read_source(spark, str(folder)), str(root), "v1", NOW, replace=True)
        assert tables.Generations(spark, str(root)).published("v1") == published, step
        assert content(tmp_path / published.removeprefix(f"{tmp_path}/")) == before, step
    assert len(tables.children(spark, f"{root}/generation")) == 1 + len(STEPS)
    told = ingest(corpus.read_source(spark, str(folder)), str(root), "v1", NOW, replace=True).first()
    assert told.currentFindings == 3
    loaded = st.FindingsTable.open(spark, str(root), "v1")
    ids = sorted(r.log_id for r in loaded.events().collect())
    assert len(ids) == len(set(ids)) == 2 and loaded.last_stamp() > NOW.timestamp() * 1000
    assert len(tables.children(spark, f"{root}/generation")) == 2  # dead loads' folders are gone as well


def test_of_two_loads_at_once_one_is_refused(spark, log_rows, tmp_path):
    one, two = (tables.Generations(spark, str(tmp_path)) for _ in range(2))
    first, second = one.begin(), two.begin()
    one.publish(first, "v1")
    with pytest.raises(tables.ConcurrentLoad):
        two.publish(second, "v1")
    assert two.published("v1") == first and two.published("v2") is None
    assert not tables.put_if_absent(spark, f"{tmp_path}/commits/1", "x")


def test_a_loaded_table_takes_changes(spark, tmp_path, source_rows):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(report({"cve": "A"}, {"cve": "B"})))
    ingest(corpus.read_source(spark, str(folder)), str(tmp_path / "lake"), "v1", NOW)
    findings = st.FindingsTable.open(spark, str(tmp_path / "lake"), "v1")
    findings.apply(change_rows(source_rows, [{"cve": "new"}]), 1, NOW)
    assert {r.cve for r in st.FindingsTable.open(spark, str(tmp_path / "lake"), "v1").current().collect()} == {"A", "B", "new"}


def test_a_batch_reads_only_the_buckets_it_names(spark, log_rows, source_rows, tmp_path):
    made = st.FindingsTable(spark, str(tmp_path / "many"), "v1", snapshot_every=2, buckets=16)
    made.create(collapse_current(log_rows(*({"cve": f"CVE-{k}", "ms": 5} for k in range(200)))))
    whole = made.current()
    assert len(made._manifest(0)[1]) == 16 and len(whole.inputFiles()) >= 16
    id = id_of(made, "CVE-7")
    asked = made.named(spark.createDataFrame([(id,)], "findingId string"))
    bucket = f"bucket={int(id[:8], 16) % 16}/"
    assert asked.inputFiles() and all(bucket in f for f in asked.inputFiles())
    assert made.find(id).count() == 1 and made.find("0" * 32).count() == 0
    state = {r.cve: r.cvss for r in whole.collect()}
    for n, cve in enumerate(("CVE-7", "CVE-8", "new"), 1):
        made.apply(change_rows(source_rows, [{"cve": cve, "cvss": float(n)}]), n, NOW)
        state[cve] = float(n)
        assert {r.cve: r.cvss for r in made.current().collect()} == state
    where = made._manifest(2)[1]
    assert 1 <= sum(n == 2 for n in where.values()) <= 2  # the others lie where they lay


def test_maintained_aggregates_equal_a_recompute(spark, log_rows, source_rows, tmp_path):
    made = st.FindingsTable(spark, str(tmp_path / "counted"), "v1", snapshot_every=2, buckets=4, counts=True)
    start = [{"cve": f"CVE-{k % 3}", "packageName": f"p{k}", "ms": 5, "riskFactors": ["Has fix"] * (k % 2)} for k in range(6)]
    made.create(collapse_current(log_rows(*start)))
    id = made.current().where("packageName = 'p0'").first().findingId
    batches = [
        ([{"cve": "CVE-0", "packageName": "p3", "cvss": 4.5, "status": "Fixed in 2", "kaiStatus": "x"}], [id]),
        ([{"cve": "CVE-0", "packageName": "p0", "severity": "low"}, {"cve": "new", "packageName": "q"}], []),  # re-created
        ([{"cve": "CVE-1", "packageName": "p1", "cvss": 9.0, "published": "2024-01-02"}], [id]),  # gone again
        ([{"cve": "CVE-0", "packageName": "p0"}], [id]),  # created and deleted by one batch
    ]
    for n, (ups, gone) in enumerate(batches, 1):
        for _ in range(2 if n == 2 else 1):  # a repeated batch counts once
            made.apply(change_rows(source_rows, ups, gone), n, NOW)
    assert set(map(tuple, made.cells().collect())) == set(map(tuple, maintained.cells(made.current()).collect()))
    assert maintained.overview_core(made.cells()).collect() == overview.overview_core(made.current(), QuerySpec()).collect()
    assert sorted(maintained.facets(made.cells()).collect()) == sorted(facets.facets(made.current(), QuerySpec()).collect())


def test_a_log_that_a_scan_tells_about_is_not_collapsed(log_rows, tmp_path, monkeypatch):
    def collapse(log):
        raise AssertionError("collapsed")

    path = str(tmp_path / "log")
    live, dead = log_rows({"cve": "a", "ms": 1}, {"cve": "b", "ms": 5}), log_rows({"cve": "a", "ms": 3, "isDeleted": True})
    with monkeypatch.context() as patched:
        patched.setattr(tables, "collapse_current", collapse)
        tables.load_initial(live, path, "v")
        for more in (live.limit(0), dead):  # the newest row of all is live
            tables.write_log(more, path, "v")
            with pytest.raises(tables.TableNotEmpty):
                tables.load_initial(live, path, "v")
        tables.load_initial(dead, path, "v", replace=True)
        tables.load_initial(live, path, "v")
    tables.write_log(log_rows({"cve": "a", "ms": 9, "isDeleted": True}), path, "v")
    with pytest.raises(tables.TableNotEmpty):  # b is older than the newest tombstone, but current
        tables.load_initial(live, path, "v")
    tables.write_log(log_rows({"cve": "b", "ms": 8, "isDeleted": True}), path, "v")
    tables.load_initial(live, path, "v")
