import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from vulnlake import fields, session
from vulnlake.operators import versions as v
from vulnlake.operators.ordered import number_rows, running, with_running
from vulnlake.streaming.changes import apply_changes

NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)
NOW_MS = int(NOW.timestamp() * 1000)


def keyed(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def upserts(source_rows, *changes):
    """Upsert rows whose request order is their place in the call."""
    order = [(c["cve"], n) for n, c in enumerate(changes)]
    rows = source_rows(*changes)
    spark = rows.sparkSession
    numbers = spark.createDataFrame(order, "cve string, requestOrder int").distinct()
    return rows.join(numbers, "cve").select(*fields.SOURCE_FIELDS, "requestOrder")


def requested(spark, ids):
    return spark.createDataFrame(
        [(i, n) for n, i in enumerate(ids)], "findingId string, requestOrder int"
    )


def test_collapse_prefers_stamp_then_batch_then_position(log_rows):
    log = log_rows(
        {"cve": "a", "ms": 1, "status": "old"},
        {"cve": "a", "ms": 2, "batch": 1, "status": "x"},
        {"cve": "a", "ms": 2, "batch": 2, "position": 0, "status": "y"},
        {"cve": "a", "ms": 2, "batch": 2, "position": 1, "status": "z"},
        {"cve": "b", "ms": 1},
        {"cve": "b", "ms": 2, "isDeleted": True},
        {"cve": "c", "ms": 1, "isDeleted": True},
        {"cve": "c", "ms": 2, "status": "back"},
    )
    assert keyed(v.collapse_current(log), "cve", "status") == [("a", "z"), ("c", "back")]
    audit = v.version_audit(log).first()
    assert (audit.log_rows, audit.identities, audit.superseded) == (8, 3, 5)
    assert (audit.tombstoned, audit.current_findings, audit.collapsed_identities) == (1, 2, 3)


def test_older_versions_change_nothing(log_rows):
    log = log_rows({"cve": "a", "ms": 5, "status": "x"}, {"cve": "b", "ms": 5, "isDeleted": True})
    older = log_rows({"cve": "a", "ms": 4}, {"cve": "b", "ms": 1})
    assert keyed(v.collapse_current(log.union(older)), "cve", "status") == [("a", "x")]


def test_collapse_of_a_hot_identity_matches_a_model(log_rows):
    rng = random.Random(3)
    entries = [
        {"cve": "hot" if rng.random() < 0.5 else f"c{rng.randrange(40)}", "ms": rng.randrange(50),
         "batch": n // 10, "position": n, "status": str(n), "isDeleted": rng.random() < 0.2}
        for n in range(600)
    ]
    newest = {}
    for e in entries:
        key = (e["ms"], e["batch"], e["position"])
        if e["cve"] not in newest or key > newest[e["cve"]][0]:
            newest[e["cve"]] = (key, e)
    expected = sorted((c, e["status"]) for c, (_, e) in newest.items() if not e["isDeleted"])
    log = log_rows(*entries)
    assert keyed(v.collapse_current(log), "cve", "status") == expected
    early = log.where("batch < 30")
    merged = v.merge_current(
        v.collapse_current(early.withColumn("updatedAt", F.timestamp_millis(F.lit(-1)))),
        early.unionByName(log.where("batch >= 30")),
    )
    assert keyed(merged, "cve", "status") == expected


def test_upserts_carry_first_seen_and_move_the_stamp(spark, source_rows, log_rows):
    ahead = NOW_MS + 10_000
    log = log_rows(
        {"cve": "old", "ms": 5, "first": 1},
        {"cve": "future", "ms": ahead, "first": 2},
        {"cve": "dead", "ms": 5, "first": 3, "isDeleted": True},
    )
    current = v.collapse_current(log)
    rows = v.apply_upserts(
        current,
        upserts(source_rows, {"cve": "old", "cvss": 9.0}, {"cve": "future"}, {"cve": "dead"},
                {"cve": "new"}),
        NOW, 7,
    )
    got = {r.cve: r for r in rows.select(
        "cve", "cvss", "position", F.unix_millis("updatedAt").alias("u"),
        F.unix_millis("firstSeenAt").alias("f")).collect()}
    assert [got[c].position for c in ("old", "future", "dead", "new")] == [1, 2, 3, 4]
    assert [got[c].u for c in ("old", "future", "dead", "new")] == [
        NOW_MS, ahead + 1, ahead + 2, ahead + 3
    ]
    # A re-created finding starts a new history.
    assert [got[c].f for c in ("old", "future", "dead", "new")] == [1, 2, NOW_MS, NOW_MS]
    after = v.collapse_current(log.unionByName(rows))
    assert keyed(after, "cve", "cvss") == [("dead", 0.0), ("future", 0.0), ("new", 0.0), ("old", 9.0)]


def test_stamps_match_the_sequential_rule(spark, source_rows, log_rows):
    rng = random.Random(5)
    previous = {f"c{n:03d}": NOW_MS + rng.randrange(-50, 60) for n in range(0, 120, 2)}
    current = v.collapse_current(log_rows(*[{"cve": c, "ms": m} for c, m in previous.items()]))
    asked = [f"c{n:03d}" for n in range(120)]
    rng.shuffle(asked)
    rows = v.apply_upserts(
        current, upserts(source_rows, *[{"cve": c} for c in asked]), NOW, 1, last_issued_ms=NOW_MS + 4
    )
    last, expected = NOW_MS + 4, {}
    for c in asked:
        last = max(NOW_MS, previous.get(c, 0) + 1, last + 1)
        expected[c] = last
    got = {r.cve: r.u for r in rows.select("cve", F.unix_millis("updatedAt").alias("u")).collect()}
    assert got == expected


def test_deletes_and_refusals(spark, source_rows, log_rows):
    log = log_rows({"cve": "a", "ms": 5, "first": 2}, {"cve": "b", "ms": 5})
    current = v.collapse_current(log)
    ids = {r.cve: r.findingId for r in current.collect()}
    gone = v.apply_deletes(current, requested(spark, [ids["a"]]), NOW, 2)
    row = gone.first()
    assert row.isDeleted and row.firstSeenAt == datetime(1970, 1, 1) + timedelta(milliseconds=2)
    assert keyed(v.collapse_current(log.unionByName(gone)), "cve") == [("b",)]
    unknown = "f" * 32
    with pytest.raises(v.ContractViolation, match=unknown):
        v.apply_deletes(current, requested(spark, [ids["a"], unknown]), NOW, 2)
    with pytest.raises(v.ContractViolation, match="unique"):
        v.apply_upserts(current, source_rows({"cve": "x"}, {"cve": "x"}).withColumn(
            "requestOrder", F.lit(1)), NOW, 1)


def test_change_contract(spark, source_rows, log_rows):
    current = v.collapse_current(log_rows({"cve": "a", "ms": 5}))
    id = current.first().findingId
    none = upserts(source_rows, {"cve": "x"}).limit(0)

    def run(ups, ids, limit=500):
        return apply_changes(current, ups, requested(spark, ids) if ids else
                             requested(spark, [id]).limit(0), "v1", NOW, 1, limit)

    for ups, ids, limit in [
        (none, [], 500), (none, [id, id], 500), (none, ["nope"], 500),
        (upserts(source_rows, {"cve": "x"}, {"cve": "y"}), [id], 2),
    ]:
        with pytest.raises(v.ContractViolation):
            run(ups, ids, limit)
    rows, emitted = run(upserts(source_rows, {"cve": "a", "cvss": 1.0}, {"cve": "n"}), [id])
    # An upsert and a delete of one finding in one call leave it absent.
    after = v.merge_current(current, rows)
    assert keyed(after, "cve") == [("n",)]
    assert [(r.seq, r.type) for r in emitted.orderBy("seq").collect()] == [
        (1, "finding-upserted"), (2, "finding-upserted"), (3, "finding-deleted")
    ]


def test_check_batches(spark):
    rows = [("v1", 1, 1)] * 3 + [("v1", 2, 2)] + [("v0", 3, 3)] + [("v1", 4, 2)] + [("v1", 5, 0)]
    df = spark.createDataFrame(rows, "dataset_version string, arrival long, sequence long")
    assert keyed(v.check_batches(df, "v1", max_rows=2), "arrival", "reason") == [
        (1, "too many rows"), (3, "version mismatch"), (4, "sequence must increase"),
        (5, "sequence must increase"),
    ]
    assert v.check_batches(df.limit(0), "v1").first().reason == "no batch"


def test_stamp_initial_batches(spark, source_rows):
    rows = source_rows(*[{"cve": f"c{n:02d}"} for n in range(7)])
    stamped = v.stamp_initial(rows, NOW, ["cve"], batch_rows=3)
    got = keyed(stamped.withColumn("u", F.unix_millis("updatedAt") - NOW_MS),
                "cve", "batch", "position", "u")
    assert got == [(f"c{n:02d}", n // 3 + 1, n % 3, n // 3) for n in range(7)]
    with pytest.raises(v.ContractViolation):
        v.stamp_initial(rows, NOW, ["cve"], batch_rows=10_001)


def test_running_totals_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if n % 3 else f"k{n}", n, rng.randrange(-5, 9)) for n in range(2000)]
    df = spark.createDataFrame(rows, "k string, n int, x long").repartition(5)
    out = with_running(df, ["k", "n"], sums={"s": F.col("x")}, maxima={"m": F.col("x")})
    total, highest, expected = 0, None, []
    for k, n, x in sorted(rows):
        total += x
        highest = x if highest is None else max(highest, x)
        expected.append((k, n, total, highest))
    assert keyed(out, "k", "n", "s", "m") == expected


def test_row_numbers_follow_the_read_order(spark):
    # One partition of each size, an empty one among them.
    parts = spark.range(0, 40, 1, 8).where("id < 10 OR id >= 20")
    out = number_rows(parts, "n").orderBy("id").collect()
    assert [(r.id, r.n) for r in out] == [
        (i, n + 1) for n, i in enumerate([*range(10), *range(20, 40)])
    ]


def test_scratch_tables_stay_below_the_shared_folder(spark):
    path = session.scratch_path(spark, "x")
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert path.startswith(configured.rstrip("/") + "/vulnlake-")
    assert path != session.scratch_path(spark, "x")


def test_running_totals_of_some_ranges_are_those_of_all(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 5 + 1).alias("x")).repartition(5)
    sliced, sums = rows.withColumn("_slice", F.floor(F.col("id") / 100)), {"s": F.col("x")}
    whole = {r.id: r.s for r in running(sliced, ["id"], sums).collect()}
    begun = running(sliced, ["id"], sums, ranges=F.coalesce("_before_s", F.lit(0)) < 100)
    found = {r.id: r.s for r in begun.collect()}
    assert found == {id: whole[id] for id in range(100)}
