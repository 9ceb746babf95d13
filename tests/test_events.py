import json
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from vulnlake.operators import events as ev
from vulnlake.operators.live import patch_page

AT = "2025-03-01T08:15:00.000Z"
ID = "5f" * 16
FINDING = {
    "id": ID, "cve": "CVE-2025-7777", "severity": "high", "cvss": 6.4, "status": "open",
    "packageName": "libsample", "packageVersion": "1.0.0", "group": "core team",
    "repo": "billing", "image": "registry.example/billing:9", "kaiStatus": None,
    "publishedAt": "2025-02-01T00:00:00.000Z",
}
BASE = {"v": 1, "datasetVersion": "set-a", "at": AT}
VARIANTS = [
    {"type": "finding-upserted", "finding": FINDING},
    {"type": "finding-deleted", "id": ID},
    {"type": "findings-changed", "ids": [ID]},
    {"type": "aggregates-invalidated", "scopes": ["overview", "facets", "findings"]},
    {"type": "dataset-version-changed"},
    {"type": "export-ready", "jobId": "job"},
    {"type": "export-ready", "jobId": "job", "url": "/api/exports/job"},
    {"type": "resync-required"},
]


def entries(spark, payloads):
    return spark.createDataFrame(
        [(f"{n}-0", p if isinstance(p, str) else json.dumps(p)) for n, p in enumerate(payloads)],
        "log_id string, event string",
    )


def test_every_variant_round_trips(spark):
    df = entries(spark, [{**BASE, **v, "unknown": {"a": 1}} for v in VARIANTS])
    valid = ev.valid_events(df, "set-a")
    texts = [json.loads(r.event) for r in ev.encode(valid).orderBy(F.col("log_id")).collect()]
    assert texts == [{**BASE, **v} for v in VARIANTS]
    assert ev.rejected_events(df, "set-a").count() == 0


REJECTED = [
    ({**BASE, "type": "finding-moved"}, "unknown type"),
    ({**BASE, "v": 2, "type": "resync-required"}, "unsupported version"),
    ({**BASE, "v": "1", "type": "resync-required"}, "unsupported version"),
    ({"v": 1, "at": AT, "type": "resync-required"}, "bad dataset version"),
    ({**BASE, "datasetVersion": "", "type": "resync-required"}, "bad dataset version"),
    ({**BASE, "datasetVersion": 5, "type": "resync-required"}, "bad dataset version"),
    ({**BASE, "datasetVersion": "x" * 129, "type": "resync-required"}, "bad dataset version"),
    ({**BASE, "at": "noon", "type": "resync-required"}, "bad timestamp"),
    ({**BASE, "at": "2025-03-01T08:15:00", "type": "resync-required"}, "bad timestamp"),
    ({**BASE, "at": "2025-02-30T08:15:00Z", "type": "resync-required"}, "bad timestamp"),
    ({**BASE, "type": "findings-changed", "ids": []}, "bad payload"),
    ({**BASE, "type": "findings-changed", "ids": [ID] * 5001}, "bad payload"),
    ({**BASE, "type": "findings-changed", "ids": [ID, 5]}, "bad payload"),
    ({**BASE, "type": "findings-changed"}, "bad payload"),
    ({**BASE, "type": "aggregates-invalidated", "scopes": ["pages"]}, "bad payload"),
    ({**BASE, "type": "aggregates-invalidated", "scopes": ["facets"] * 4}, "bad payload"),
    ({**BASE, "type": "finding-deleted", "id": ""}, "bad payload"),
    ({**BASE, "type": "export-ready"}, "bad payload"),
    ({**BASE, "type": "export-ready", "jobId": "j", "url": None}, "bad payload"),
    ({**BASE, "type": "export-ready", "jobId": "j", "url": "x" * 2049}, "bad payload"),
    ({**BASE, "type": "finding-upserted"}, "bad payload"),
    ({**BASE, "type": "finding-upserted", "finding": {**FINDING, "id": "x"}}, "bad payload"),
    ({**BASE, "type": "finding-upserted", "finding": {**FINDING, "cvss": "8"}}, "bad payload"),
    ({**BASE, "type": "finding-upserted", "finding": {**FINDING, "cve": None}}, "bad payload"),
    ({**BASE, "type": "finding-upserted",
      "finding": {k: x for k, x in FINDING.items() if k != "kaiStatus"}}, "bad payload"),
    ({**BASE, "type": "finding-upserted", "finding": {**FINDING, "publishedAt": "x"}},
     "bad payload"),
    ({**BASE, "datasetVersion": "set-b", "type": "resync-required"}, "wrong dataset version"),
    ("{", "malformed JSON"),
    ("[1]", "malformed JSON"),
]


def test_rejections_name_the_broken_rule(spark):
    rejected = ev.rejected_events(entries(spark, [p for p, _ in REJECTED]), "set-a").collect()
    got = {int(r.log_id.split("-")[0]): r.reason for r in rejected}
    assert got == {n: reason for n, (_, reason) in enumerate(REJECTED)}
    odd = spark.createDataFrame(
        [("01-0", "{}"), ("$", "{}"), (None, "{}"), ("1-0", None)], "log_id string, event string"
    )
    assert sorted(r.reason for r in ev.rejected_events(odd).collect()) == [
        "malformed log id"] * 3 + ["no payload"]


def test_members_of_other_variants_are_ignored(spark):
    extra = {"ids": "x", "finding": 5, "scopes": {"a": 1}, "jobId": [1], "url": None, "id": 3}
    df = entries(spark, [{**BASE, **extra, "type": "resync-required"}])
    row = ev.valid_events(df, "set-a").first()
    assert (row.type, row.ids, row.finding, row.scopes) == ("resync-required", None, None, None)


def make(spark, rows):
    """Events from (ms, seq, type, payload) tuples; `at` is ms."""
    raw = spark.createDataFrame(
        [(ms, seq, kind, json.dumps(p)) for ms, seq, kind, p in rows],
        "ms long, seq long, type string, p string",
    )
    return raw.select(
        *ev.blank_event(
            ms=F.col("ms"), seq=F.col("seq"), type=F.col("type"),
            datasetVersion=F.lit("v1"), at=F.timestamp_millis("ms"),
            finding=F.when(F.col("type") == "finding-upserted",
                           F.from_json("p", ev.FINDING_SCHEMA)),
            id=F.when(F.col("type") == "finding-deleted", F.get_json_object("p", "$.id")),
            ids=F.when(F.col("type") == "findings-changed",
                       F.from_json(F.get_json_object("p", "$.ids"), "array<string>")),
            scopes=F.when(F.col("type") == "aggregates-invalidated",
                          F.from_json(F.get_json_object("p", "$.scopes"), "array<string>")),
        )
    )


def deletion(n):
    return (1000 + n, 0, "finding-deleted", {"id": f"{n:032x}"})


def test_replay_positions(spark):
    log = make(spark, [(10, 0, "resync-required", {}), (15, 0, "resync-required", {}),
                       (20, 0, "resync-required", {})])

    def position(last):
        return tuple(ev.start_position(log, last).first())

    assert position(None) == (None, False, None)
    assert position("15-0") == ("15-0", False, None)
    for last in ("9-0", "16-0", "21-0"):
        assert position(last) == ("20-0", True, "20-0")
    assert tuple(ev.start_position(log.limit(0), "15-0").first()) == (None, True, None)
    assert [r.ms for r in ev.replay_after(log, "10-0").orderBy("ms").collect()] == [15, 20]
    assert [r.ms for r in ev.retain_last(log, 2).orderBy("ms").collect()] == [15, 20]
    for invalid in ("$", "01-0", "1", "1--0", "-1-0", "later"):
        with pytest.raises(ValueError):
            ev.start_position(log, invalid)


def test_order_is_numeric(spark):
    log = make(spark, [(9, 10, "resync-required", {}), (10, 2, "resync-required", {}),
                       (10, 11, "resync-required", {})])
    assert ev.retain_last(log, 1).first().seq == 11


def merged(events, width=None, threshold=100, **more):
    return ev.coalesce(events, width, threshold, **more).orderBy("ms", "seq", "ord").collect()


def test_burst_gate_and_order(spark):
    small = merged(make(spark, [deletion(0), deletion(1)]))
    assert [r.type for r in small] == ["finding-deleted"] * 2
    at_threshold = merged(make(spark, [deletion(n) for n in range(100)]))
    assert len(at_threshold) == 100
    burst = merged(make(spark, [deletion(n) for n in range(101)]))
    assert [(r.type, r.ms) for r in burst] == [
        ("aggregates-invalidated", 1000), ("findings-changed", 1100)]
    assert burst[0].scopes == ["overview", "facets", "findings"]
    assert burst[1].ids == [f"{n:032x}" for n in range(101)]
    assert all(r.at == datetime(1970, 1, 1, 0, 0, 1, 100000) for r in burst)


def test_ids_beyond_the_cap_are_dropped(spark):
    burst = merged(make(spark, [deletion(n) for n in range(60)]), threshold=10, max_ids=25)
    assert burst[1].ids == [f"{n:032x}" for n in range(25)]


def model(entries, threshold):
    """The sequential rule for one window, over (ms, seq, type, payload)."""
    coalescible = [e for e in entries if e[2] in ev.COALESCIBLE]
    if len(coalescible) <= threshold:
        return [(e[0], e[1], e[2], None, None) for e in entries]
    out, run = [], []

    def flush():
        if not run:
            return
        ids, scopes = [], set()
        for _, _, kind, p in run:
            changed = {"finding-upserted": [p.get("id")], "finding-deleted": [p.get("id")],
                       "findings-changed": p.get("ids")}.get(kind, [])
            ids += [i for i in dict.fromkeys(changed) if i not in ids]
            if kind == "aggregates-invalidated":
                scopes |= set(p["scopes"])
        scopes = set(ev.SCOPES) if ids else scopes
        place = run[0] if ids else run[-1]
        if scopes:
            out.append((place[0], place[1], "aggregates-invalidated",
                        [s for s in ev.SCOPES if s in scopes], None))
        if ids:
            out.append((run[-1][0], run[-1][1], "findings-changed", None, ids))
        run.clear()

    for e in entries:
        if e[2] in ev.COALESCIBLE:
            run.append(e)
        else:
            flush()
            out.append((e[0], e[1], e[2], None, None))
    flush()
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_coalescing_matches_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    rows, windows = [], {}
    for n in range(500):
        # A third of all events share one window.
        window = 0 if rng.random() < 0.34 else rng.randrange(1, 9)
        kind = rng.choice(ev.COALESCIBLE + ("dataset-version-changed",))
        payload = {"id": f"{rng.randrange(30):032x}",
                   "ids": [f"{rng.randrange(30):032x}" for _ in range(3)],
                   "scopes": rng.sample(ev.SCOPES, rng.randrange(1, 4))}
        row = (window * 1000 + rng.randrange(1000), n, kind, payload)
        rows.append(row)
        windows.setdefault(window, []).append(row)
    expected = []
    for window in windows.values():
        expected += model(sorted(window, key=lambda e: e[:2]), threshold=35)
    got = []
    for r in merged(make(spark, rows).repartition(6), "1 second", 35):
        kept = r.ord == 2 or (r.type == "aggregates-invalidated" and r.scopes is not None)
        got.append((r.ms, r.seq, r.type,
                    r.scopes if kept and r.type == "aggregates-invalidated" else None,
                    r.ids if r.type == "findings-changed" else None))
    passed = {(r[0], r[1]): r for r in rows}

    def full(e):
        # Events that pass through keep their own payload.
        ms, seq, kind, scopes, ids = e
        own = passed[ms, seq][3]
        if kind == "aggregates-invalidated" and scopes is None:
            scopes = own["scopes"]
        if kind == "findings-changed" and ids is None:
            ids = own["ids"]
        return (ms, seq, kind, tuple(scopes or ()), tuple(ids or ()))

    assert sorted(full(e) for e in got) == sorted(full(e) for e in expected)


def test_refetch_scopes_pending_and_recent(spark):
    log = make(spark, [
        (1, 0, "finding-deleted", {"id": "a" * 32}),
        (2, 0, "resync-required", {}),
        (3, 0, "findings-changed", {"ids": ["a", "b"]}),
        (4, 0, "aggregates-invalidated", {"scopes": ["facets"]}),
        (5, 0, "export-ready", {}),
        (6, 0, "finding-deleted", {"id": "b" * 32}),
        (7, 0, "finding-upserted", {**FINDING, "id": "a" * 32}),
    ])
    assert ev.pending_updates(log).first().pending == 5
    assert ev.pending_updates(log.where("type <> 'resync-required'")).first().pending == 6
    assert ev.pending_updates(log.where("ms < 3")).first().pending == 0
    assert {r.scope for r in ev.stale_scopes(log.where("ms = 4")).collect()} == {"facets"}
    assert ev.stale_scopes(log.where("ms IN (2, 5)")).count() == 0
    assert ev.stale_scopes(log.where("ms = 3")).count() == 3
    recent = ev.recent_changes(log).orderBy("ms").collect()
    assert [(r.id[0], r.change) for r in recent] == [("b", "deleted"), ("a", "upserted")]
    assert [r.id[0] for r in ev.recent_changes(log, 1).collect()] == ["a"]


def test_patch_page(spark):
    rows = [{**FINDING, "id": f"{n:032x}", "cvss": 1.0} for n in range(3)]
    page = spark.createDataFrame([tuple(r.values()) for r in rows], ev.FINDING_SCHEMA)
    log = make(spark, [
        (1, 0, "finding-upserted", {**rows[0], "cvss": 2.0}),
        (2, 0, "finding-upserted", {**rows[0], "cvss": 3.0, "publishedAt": None}),
        (3, 0, "finding-deleted", {"id": rows[1]["id"]}),
        (4, 0, "finding-upserted", {**rows[1], "cvss": 4.0}),
        (5, 0, "finding-upserted", {**FINDING, "id": "f" * 32}),
    ])
    got = patch_page(page, log).orderBy("id").collect()
    assert [(r.id[-1], r.cvss, r.publishedAt is None) for r in got] == [
        ("0", 3.0, True), ("2", 1.0, False)]


def test_dataset_info_without_events(spark, log_rows):
    current = log_rows({"cve": "a"}, {"cve": "b"})
    none = make(spark, [(1, 0, "resync-required", {})]).limit(0)
    assert tuple(ev.dataset_info(current, none, "v9").first()) == ("v9", 2, None)


def test_version_changed_event(spark):
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    only = ev.version_changed_event(spark.range(5), "v1", now).collect()
    assert [(r.type, r.datasetVersion) for r in only] == [("dataset-version-changed", "v1")]
