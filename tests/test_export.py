import glob
from datetime import datetime, timedelta, timezone

import pytest

from vulnlake.operators import export
from vulnlake.spec import QuerySpec, Sort, resolve_time_range

NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)
JOB = "9b2f6c1e-0a4d-4c3b-8e21-7f5d3a9c0b64"


@pytest.fixture(scope="module")
def current(log_rows):
    return log_rows(
        {"cve": "CVE-1", "cvss": 9.5, "status": "=cmd()", "kaiStatus": None,
         "published": "2024-01-02T03:04:05Z"},
        {"cve": "CVE-2", "cvss": 1.0, "status": 'say "hi", twice', "repo": "@r"},
        {"cve": "CVE-3", "cvss": 5.0, "status": "two\nlines", "severity": "low"},
        *[{"cve": f"CVE-9{n}", "cvss": 0.0, "packageVersion": str(n)} for n in range(50)],
    ).cache()


def test_job_ids_and_names():
    assert export.job_id(JOB) == JOB
    assert export.artifact_name(JOB) == f"{JOB}.csv"
    assert export.download_url(JOB) == f"/api/exports/{JOB}"
    for bad in ("", "../" + JOB, JOB.replace("4c3b", "1c3b"), JOB.replace("8e21", "ce21"),
                JOB + ".csv"):
        with pytest.raises(ValueError):
            export.job_id(bad)


def test_count_bound():
    assert export.checked_count(2_147_483_647) == 2_147_483_647
    with pytest.raises(export.ExportTooLarge):
        export.checked_count(2_147_483_648)


def test_request_survives_freezing():
    spec = QuerySpec(
        filters={"severity": ("=HYPERLINK(1)",)}, mode="aiAnalysis", search="@AVERAGE(2)",
        time_range=resolve_time_range("5y", NOW), sort=Sort("fixedAt", "asc"),
    )
    assert export.restore_request(export.freeze_request(spec)) == spec


def test_csv_parts_hold_every_row_in_order(spark, current, tmp_path):
    spec = QuerySpec(sort=Sort("cvss", "desc"))
    rows = export.export_rows(current.repartition(6), spec)
    path = str(tmp_path / "out")
    export.write_csv(rows, path)
    text = ""
    for part in sorted(glob.glob(path + "/part-*.csv")):
        header, _, body = open(part).read().partition("\n")
        assert header.startswith("id,cve,severity,cvss,status,")
        text += body
    assert text.index("CVE-1") < text.index("CVE-3") < text.index("CVE-2") < text.index("CVE-90")
    assert "'=cmd()" in text and "'@r" in text
    assert '"say ""hi"", twice"' in text
    assert "2024-01-02 03:04:05" in text
    read = spark.read.csv(path, header=True, escape='"', multiLine=True)
    assert read.count() == 53


def test_run_success_failure_and_expiry(spark, current, tmp_path):
    store = export.ExportStore(spark, str(tmp_path / "exports"))
    waiting = store.create(QuerySpec(), NOW)
    job = store.run(store.create(QuerySpec(filters={"severity": ("low",)}), NOW), current, NOW)
    assert (job["status"], job["rowCount"]) == ("READY", 1)
    failed = store.run(store.create(QuerySpec(), NOW), current.drop("image"), NOW)
    assert (failed["status"], failed["errorMessage"]) == ("FAILED", export.FAILURE_TEXT)
    assert not glob.glob(str(tmp_path / "exports" / failed["id"]) + "*")
    jobs = {r.id: r for r in export.export_jobs(store.manifest(), NOW).collect()}
    assert jobs[job["id"]].downloadUrl == export.download_url(job["id"])
    assert jobs[failed["id"]].downloadUrl is None
    assert [r.id for r in export.unfinished_jobs(store.manifest(), NOW).collect()] == [waiting["id"]]
    late = NOW + timedelta(seconds=3600)
    assert export.export_jobs(store.manifest(), late).count() == 0
    assert export.export_job(store.manifest(), job["id"], NOW).first().rowCount == 1
    events = export.ready_events(export.export_jobs(store.manifest(), NOW), "v1", NOW).collect()
    assert [(e.type, e.jobId, e.url) for e in events] == [
        ("export-ready", job["id"], export.download_url(job["id"]))]
