"""What loads and stored tables leave on disk."""

import os

from pyspark.sql import functions as F

from vulnlake import fields
from vulnlake.operators import versions
from vulnlake.operators.versions import collapse_current, newest_version
from vulnlake.plans.ingest import ingest
from vulnlake.session import _scratch_root, brief_shuffles, write_out
from vulnlake.sources import corpus, star_schema, tables
from vulnlake.streaming import changes

from conftest import T0

REPORT = '{"groups": {"g": {"repos": {"r": {"images": {"i": {"vulnerabilities": [{"cve": "C-%d"}]}}}}}}}'
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = tracker.getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    before = spark.conf.get(CLEANUP), shuffle_files(spark)
    rows = write_out(spark.range(100).repartition(3, "id"), "shuffled")
    assert shuffle_files(spark) <= before[1]
    assert rows.count() == 100
    with brief_shuffles(spark):
        assert spark.conf.get(CLEANUP) == "true"
    assert spark.conf.get(CLEANUP) == before[0]


def test_a_load_leaves_no_scratch(spark, tmp_path):
    root = _scratch_root(spark)
    before = set(os.listdir(root))
    texts = spark.createDataFrame([(REPORT % n,) for n in range(5)] + [('{"groups"',)], "text string")
    read = corpus.parse_documents(texts, "text")
    told = ingest(read, str(tmp_path / "lake"), "v1", T0, batch_rows=2, allow_corrupt=True).first()
    assert (told.sourceRowsWritten, told.currentFindings, told.corruptDocuments) == (5, 5, 1)
    assert {n for n in set(os.listdir(root)) - before if n.startswith(("records", "numbered"))} == set()


def test_current_findings_are_finished_after_their_sort(spark, log_rows, tmp_path):
    log = log_rows({"ms": 1}, {"ms": 2, "severity": "low"}, {"cve": "CVE-2", "ms": 3}, {"cve": "CVE-3", "isDeleted": True})
    made = ["severity", "description"]
    narrow = log.withColumn("level", F.col("severity")).drop(*made)
    tables.write_current(
        collapse_current(narrow), str(tmp_path / "current"),
        finish=lambda rows: rows.select("*", F.col("level").alias("severity"), F.lit("").alias("description")),
    )
    found = tables.read_current(spark, str(tmp_path / "current")).select(*fields.LOG_COLUMNS)
    assert sorted(map(str, found.collect())) == sorted(map(str, collapse_current(log).collect()))


def test_a_change_set_leaves_its_results_only(spark, log_rows):
    current = write_out(log_rows({"ms": 1}, {"cve": "CVE-2", "ms": 2}), "current")
    root = _scratch_root(spark)
    before = set(os.listdir(root))
    asked = current.select(*fields.SOURCE_FIELDS, F.col("findingId").alias("requestOrder"))
    gone = current.where("cve = 'CVE-2'").select("findingId", F.col("findingId").alias("requestOrder"))
    rows, events = changes.apply_changes(current, asked, gone, "v1", T0, 1)
    left = sorted(n.rsplit("-", 1)[0] for n in set(os.listdir(root)) - before)
    assert not {"ordered", "deletes-live", "missing"} & set(left)
    assert (rows.count(), rows.where("isDeleted").count(), events.count()) == (3, 1, 3)


def star_tables(spark, folder):
    """Line items whose identities are shared: by nulls, by equal names, by repeated keys."""
    day = "2024-01-0"
    lines = [(n, p, s, 1, 50.0 if n == 7 else 5.0, float(n), 0.1, 0.0, "N", "F") for n, (p, s) in enumerate(
        [(1, 1), (1, 2), (1, 1), (2, 1), (3, 3), (4, 1), (4, 4), (5, 1), (5, 2), (None, 1), (6, 1), (9, 9)]
    )]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, " \
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    made = {
        "lineitem": spark.createDataFrame(lines, names).withColumn(
            "l_shipdate", F.concat(F.lit(day), (F.col("l_orderkey") % 4 + 1).cast("string")).cast("timestamp_ntz")),
        "orders": spark.createDataFrame([(n, "1-URGENT", "F") for n in range(11)], "o_orderkey long, o_orderpriority string, o_orderstatus string")
        .withColumn("o_orderdate", F.lit(day + "1").cast("timestamp_ntz")),
        "part": spark.createDataFrame(
            [(1, "a b", "B", "T", 3), (2, "a b", "B", "T", 3), (3, "c", "B", "T", None), (4, "c", "B", "T", None),
             (5, "d", "B", None, 3), (5, "d", "B", None, 3), (6, None, "B", "T", 1), (6, "e", "B", "T", 1)],
            "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        "supplier": spark.createDataFrame([(1, "s", 0), (2, "s", 0), (3, None, 0), (4, "t", 1), (4, "u", 1)], "s_suppkey long, s_name string, s_nationkey int"),
        "nation": spark.createDataFrame([(0, "x"), (1, None)], "n_nationkey int, n_name string"),
    }
    for name, rows in made.items():
        rows.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_current_findings_are_named_after_the_collapse(spark, tmp_path):
    folder = star_tables(spark, tmp_path)
    made = star_schema.current_findings(spark, folder).select(*fields.LOG_COLUMNS)
    plain = collapse_current(star_schema.findings_log(spark, folder)).select(*fields.LOG_COLUMNS)
    assert sorted(map(str, made.collect())) == sorted(map(str, plain.collect()))
    assert plain.count() > 5
    # Names travel in no shuffle of line items but those of parts that others are named like.
    plan = star_schema._newest(spark, folder).where("cve = 'CVE-2000-00002'")._jdf.queryExecution().optimizedPlan().toString()
    collapse = plan[plan.index("Window"):]
    assert "l_extendedprice" in collapse and "_owner" in collapse.splitlines()[0]


def test_newest_versions_are_collapsed_once_and_stored(spark, tmp_path):
    folder = star_tables(spark, tmp_path)
    newest = star_schema.newest_findings(spark, folder)
    plain = newest_version(star_schema.findings_log(spark, folder)).select(*fields.LOG_COLUMNS)
    assert sorted(map(str, newest.select(*fields.LOG_COLUMNS).collect())) == sorted(map(str, plain.collect()))
    assert newest.where("isDeleted").count() == 1
    assert "Window" not in newest._jdf.queryExecution().optimizedPlan().toString()
    files = {f.rsplit("/", 2)[0] for f in newest.inputFiles()}
    assert files == {f.rsplit("/", 2)[0] for f in star_schema.current_findings(spark, folder).inputFiles()}
    for file in newest.inputFiles():
        rows = spark.read.parquet(file).select(*fields.IDENTITY)
        assert rows.collect() == rows.coalesce(1).sortWithinPartitions(*fields.IDENTITY).collect()


def test_upserts_are_numbered_without_their_columns(spark, log_rows):
    current = write_out(log_rows({"ms": 1}, {"cve": "CVE-2", "ms": 2}), "current")
    root = _scratch_root(spark)
    before = set(os.listdir(root))
    asked = current.select(*fields.SOURCE_FIELDS, F.col("cve").alias("requestOrder"))
    rows = versions.apply_upserts(current, asked.unionByName(asked.withColumn("cve", F.lit("CVE-0")).limit(1)), T0, 7)
    ordered = [n for n in set(os.listdir(root)) - before if n.startswith("ordered")]
    assert ordered and all("description" not in spark.read.parquet(f"{root}/{n}").columns for n in ordered)
    assert sorted((r.position, r.batch) for r in rows.collect()) == [(1, 7), (2, 7), (3, 7)]
    assert {r.cve: r.firstSeenAt == T0.replace(tzinfo=None) for r in rows.collect()} == {"CVE-0": True, "CVE-1": False, "CVE-2": False}


def test_lookups_drop_rows_before_they_travel(spark, monkeypatch):
    rows = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("findingId"), "id")
    rows = rows.unionByName(spark.createDataFrame([(None, -1)], "findingId string, id long"))
    asked = rows.where("id % 100 = 0 OR id < 0")
    plain = rows.join(asked.select("findingId"), "findingId", "left_semi").collect()
    monkeypatch.setattr(versions, "MARKED", 1)
    assert sorted(versions.lookup_by_ids(rows, asked).collect()) == sorted(plain)
    assert 30 <= versions._likely(rows, asked).count() < 600
    monkeypatch.setattr(versions, "MARK_BITS", 64)
    assert sorted(versions.lookup_by_ids(rows, asked).collect()) == sorted(plain)
    assert versions.lookup_by_ids(rows, asked.limit(0)).isEmpty()


def test_lines_are_dealt_by_part_once(spark, tmp_path):
    folder = star_tables(spark, tmp_path)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = star_schema._newest(spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # One branch for parts with a name of their own, one for those that share theirs.
    assert plan.count("hashpartitioning(l_partkey") == 2


def test_buckets_are_written_where_rows_are_read(spark, log_rows, tmp_path):
    rows = log_rows(*({"cve": f"CVE-{n}", "position": n} for n in range(60))).repartition(3, "cve")
    rows = write_out(rows.withColumn("batch", F.spark_partition_id().cast("long")), "dealt")
    task = rows.withColumn("batch", F.spark_partition_id().cast("long"))
    parts = tables.write_buckets(task, str(tmp_path / "few"), 4)
    stored = spark.read.parquet(str(tmp_path / "few"))
    assert parts == [0, 1, 2, 3] and stored.count() == 60
    assert stored.where(F.col("bucket") != tables.bucket_of(F.col("findingId"), 4)).isEmpty()
    for file in stored.inputFiles():
        read = spark.read.parquet(file)
        # All of a file's rows were read by the task that wrote it, and a small file has a small filter.
        assert read.select("batch").distinct().count() == 1
        assert [r.cve for r in read.collect()] == sorted(r.cve for r in read.collect())
        assert os.path.getsize(file.removeprefix("file://")) < 200_000
    tables.write_buckets(task, str(tmp_path / "many"), tables.LOCAL_BUCKETS + 1)
    assert spark.read.parquet(str(tmp_path / "many")).drop("bucket").exceptAll(task.select(*fields.LOG_COLUMNS)).isEmpty()
