import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from vulnlake.functions.values import private_hosts
from vulnlake.operators.versions import ContractViolation
from vulnlake.plans.ingest import ingest, source_log
from vulnlake.sources import corpus, tables
from vulnlake.streaming.changes import FindingsTable

NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)

DOCUMENT = {
    "meta": {"groups": {"fake": {}}},
    "groups": {
        "g1": {
            "extra": {"repos": {"no": {}}},
            "repos": {
                "r1": {
                    "name": "repo one",
                    "images": {
                        "i1": {
                            "buildType": "container",
                            "vulnerabilities": [
                                {"cve": "CVE-1", "group": "wrong", "repo": "wrong",
                                 "image": "wrong", "buildType": None,
                                 "riskFactors": {"reachable": True, "Has fix": False},
                                 "applicableRules": ["no-root", 3], "kaiStatus": "",
                                 "cvss": "7.5", "published": "2024-01-02T03:04:05Z"},
                                "junk", None, [1],
                                {"cve": "CVE-2", "buildType": "", "kaiStatus": None},
                                {"cve": "CVE-2", "buildType": "own", "status": "newer"},
                            ],
                        },
                        "i2": {"name": None, "vulnerabilities": []},
                    },
                },
                "r2": {},
            },
        },
        "g2": {"name": "group two", "repos": {}},
        "g3": {"name": {"not": "a scalar"}, "repos": {"r": {"images": {"i": {
            "name": 7, "vulnerabilities": [{"cve": 3}]}}}}},
    },
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("reports")
    (path / "a.json").write_text(json.dumps(DOCUMENT, indent=2))
    return str(path)


def test_flatten_and_normalize(spark, folder):
    read = corpus.read_source(spark, folder)
    rows = corpus.normalize(corpus.flatten_source(read)).orderBy("place").collect()
    assert [(r.group, r.repo, r.image, r.cve, r.buildType) for r in rows] == [
        ("g1", "repo one", "i1", "CVE-1", "container"),
        ("g1", "repo one", "i1", "CVE-2", ""),
        ("g1", "repo one", "i1", "CVE-2", "own"),
        ("g3", "r", "7", "3", ""),
    ]
    first = rows[0]
    assert first.riskFactors == ["Has fix", "reachable"]
    assert first.applicableRules == ["no-root", "3"]
    assert (first.kaiStatus, first.cvss) == ("", 7.5)
    assert rows[1].kaiStatus is None


def test_json_lines_and_text_agree_with_files(spark, folder, tmp_path):
    (tmp_path / "lines.json").write_text("\n".join([json.dumps(DOCUMENT)] * 3))
    lines = corpus.flatten_source(
        corpus.read_source(spark, str(tmp_path), multi_line=False)
    )
    assert lines.count() == 12
    text = spark.createDataFrame([("d", json.dumps(DOCUMENT))], "doc string, text string")
    parsed = corpus.flatten_source(corpus.parse_documents(text, "text"))
    assert parsed.columns[0] == "doc"
    assert parsed.count() == corpus.flatten_source(corpus.read_source(spark, folder)).count()


def test_census_and_empty_groups(spark, folder):
    read = corpus.read_source(spark, folder)
    assert corpus.census(read).first().asDict() == {
        "groups": 3, "repos": 3, "imageKeys": 3, "imageNames": 0,
        "vulnArrays": 3, "nonEmptyVulnArrays": 2, "vulnTotal": 4,
    }
    assert [tuple(r) for r in corpus.empty_groups(read).collect()] == [(3, "g2")]


def test_sample_prefix_matches_a_walk(spark):
    rows = [(i, "x" * (i % 13 + 1)) for i in range(500)]
    df = spark.createDataFrame(rows, "n int, t string").repartition(7)
    sample = corpus.sample_prefix(df, ["n"], budget=1000, size=F.octet_length("t"))
    expected, total = [], 0
    for n, t in rows:
        if total >= 1000:
            break
        expected.append(n)
        total += len(t)
    assert sorted(r.n for r in sample.collect()) == expected
    assert tuple(corpus.sample_manifest(sample).first()) == (len(expected), total)


def test_sanitize_covers_strings_arrays_and_keys(spark):
    rules = {private_hosts("priv"): "hidden.example", "acme": "example"}
    df = spark.createDataFrame([("a.priv", ["ACME", "b"], 1)], "t string, l array<string>, n int")
    assert tuple(corpus.sanitize(df, rules).first()) == (
        "hidden.example", ["example", "b"], 1
    )
    text = spark.createDataFrame([('{"acme": "x.y.priv"}',)], "text string")
    cleaned = corpus.sanitize_documents(text, "text", rules).first().text
    assert cleaned == '{"example": "hidden.example"}'


def test_ingest_end_to_end(spark, folder, tmp_path):
    root = str(tmp_path / "lake")
    read = corpus.read_source(spark, folder)
    report = ingest(read, root, "v1", NOW, batch_rows=2, expected_rows=4, expected_findings=3)
    assert report.first().asDict() == {
        "batchesWritten": 2, "sourceRowsWritten": 4, "currentFindings": 3,
        "rowsAsExpected": True, "findingsAsExpected": True, "corruptDocuments": 0,
    }
    findings = FindingsTable.open(spark, root, "v1")
    current = findings.current()
    # The two CVE-2 records share an identity; the later one wins.
    assert current.where("cve = 'CVE-2'").first().status == "newer"
    assert current.where("cve = 'CVE-1'").first().publishedAt == datetime(2024, 1, 2, 3, 4, 5)
    assert findings.events().count() == 1
    with pytest.raises(tables.TableNotEmpty):
        ingest(read, root, "v1", NOW)
    ingest(read, root, "v1", NOW, replace=True)
    assert source_log(spark, root, "v1").count() == 4
    assert FindingsTable.open(spark, root, "v1").events().count() == 2
    with pytest.raises(ContractViolation):
        ingest(read, str(tmp_path / "other"), "v1", NOW, expected_rows=5)
    empty = corpus.parse_documents(spark.createDataFrame([("{}",)], "t string"), "t")
    with pytest.raises(ContractViolation, match="at least one batch"):
        ingest(empty, str(tmp_path / "none"), "v1", NOW)


def test_texts_are_parsed_once(spark):
    texts = spark.range(3).select(F.format_string('{"groups": {"g%s": {"repos": {}}}}', "id").alias("t"))
    rows = corpus.flatten_source(corpus.parse_documents(texts, "t"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
    assert rows.count() == 0
