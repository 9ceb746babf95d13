"""Change events and their coalescing."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.functions import values as fv
from vulnlake.operators import events
from vulnlake.plans.catalog.registry import BURST, on_events, query
from vulnlake.plans.relations import iso, over_events
from vulnlake.session import scratch_path
from vulnlake.sources import star_events, tables
from vulnlake.sources.star_schema import DATASET_VERSION

_EMIT_SQL = (
    over_events(
        "SELECT log_id, type, md5(event) AS text_md5 FROM (SELECT log_id, type, "
        "'{\"v\":1,\"type\":\"' || type || '\",\"datasetVersion\":\"star-1\",\"at\":\"' || " + iso("ts") + " || '\"' || "
        "CASE type WHEN 'finding-upserted' THEN ',\"finding\":{\"id\":\"' || id1 || '\",\"cve\":\"CVE-2024-' "
        "|| lpad(CAST(user_id AS VARCHAR), 5, '0') || '\",\"severity\":\"' || CASE WHEN value > 50 THEN 'high' ELSE 'low' END "
        "|| '\",\"cvss\":' || CAST(round(value / 100, 1) AS VARCHAR) || ',\"status\":\"open\",\"packageName\":\"pkg-' || user_id "
        "|| '\",\"packageVersion\":\"1.0\",\"group\":\"events\",\"repo\":\"stream\",\"image\":\"registry.example/stream:1\"' "
        "|| ',\"kaiStatus\":' || CASE WHEN value > 20 THEN '\"reviewed\"' ELSE 'null' END "
        "|| ',\"publishedAt\":\"' || " + iso("ts") + " || '\"}' "
        "WHEN 'finding-deleted' THEN ',\"id\":\"' || id1 || '\"' "
        "WHEN 'findings-changed' THEN ',\"ids\":[\"' || id1 || '\",\"' || id2 || '\"]' "
        "WHEN 'aggregates-invalidated' THEN CASE WHEN value < 50 THEN ',\"scopes\":[\"facets\"]' "
        "ELSE ',\"scopes\":[\"findings\",\"overview\"]' END "
        "WHEN 'export-ready' THEN ',\"jobId\":\"job-' || event_id || '\"' ELSE '' END || '}' AS event "
        "FROM ev)"
    )
)


def _emitted(spark: SparkSession, d: str) -> DataFrame:
    """All seven variants with their full text."""
    return events.encode(star_events.events_of(spark, d)).select(
        "log_id",
        F.get_json_object("event", "$.type").alias("type"),
        F.md5("event").alias("text_md5"),
    )


query("event_emit", _EMIT_SQL)(_emitted)
query("event_emit_all", _EMIT_SQL)(_emitted)


_BROKEN = """
checked AS (SELECT *, CASE
    WHEN value > 150 THEN 'unsupported version'
    WHEN value > 120 THEN 'malformed JSON'
    WHEN value > 90 THEN 'bad dataset version'
    WHEN value > 70 THEN 'bad timestamp'
    WHEN value > 60 THEN 'unknown type'
    WHEN value > 55 THEN 'wrong dataset version'
    WHEN value > 45 AND value < 50 AND event_type = 'purchase' THEN 'bad payload' END AS reason FROM ev)
"""

query(
    "event_valid",
    over_events(
        "SELECT ms, seq, type, coalesce(CASE WHEN type IN ('finding-upserted', 'finding-deleted') THEN id1 END, '') AS id, "
        "CASE WHEN type = 'finding-upserted' THEN round(value / 100, 1) ELSE -1 END AS cvss, "
        f"{iso('ts')} AS at FROM checked WHERE reason IS NULL",
        _BROKEN,
    ),
)(
    lambda spark, d: events.valid_events(
        star_events.mixed_entries(spark, d), DATASET_VERSION
    ).select(
        "ms",
        "seq",
        "type",
        F.coalesce("finding.id", "id", F.lit("")).alias("id"),
        F.coalesce("finding.cvss", F.lit(-1.0)).alias("cvss"),
        fv.iso_ms(F.col("at")).alias("at"),
    )
)

query(
    "event_rejects",
    over_events("SELECT log_id, reason FROM checked WHERE reason IS NOT NULL", _BROKEN),
)(
    lambda spark, d: events.rejected_events(
        star_events.mixed_entries(spark, d), DATASET_VERSION
    ).select("log_id", "reason")
)


@query("event_log", over_events('SELECT type, count(*) AS "rows", min(ms) AS first_ms FROM ev GROUP BY ALL'))
def _event_log(spark: SparkSession, d: str) -> DataFrame:
    """Events written to the log, read back and validated."""
    path = scratch_path(spark, "event-log")
    tables.write_events(events.encode(star_events.events_of(spark, d)), path)
    return (
        events.valid_events(tables.read_events(spark, path), DATASET_VERSION)
        .groupBy("type")
        .agg(F.count("*").alias("rows"), F.min("ms").alias("first_ms"))
    )


_REPLAY_MS = int(datetime(2024, 1, 15, tzinfo=timezone.utc).timestamp() * 1000)

on_events("event_replay", f"SELECT ms, seq, type FROM ev WHERE ms > {_REPLAY_MS}")(
    lambda log: events.replay_after(log, f"{_REPLAY_MS}-{2**53}").select("ms", "seq", "type")
)
on_events(
    "event_resync",
    "SELECT log_id AS cursor, 1 AS resync, log_id AS resync_id FROM ev ORDER BY ms DESC, seq DESC LIMIT 1",
)(
    lambda log: events.start_position(log, f"{_REPLAY_MS}-0").withColumn(
        "resync", F.col("resync").cast("int")
    )
)
on_events(
    "event_retain",
    "SELECT type, count(*) AS \"rows\" FROM (SELECT * FROM ev ORDER BY ms DESC, seq DESC LIMIT 5000) GROUP BY ALL",
)(lambda log: events.retain_last(log, 5_000).groupBy("type").agg(F.count("*").alias("rows")))

_COALESCIBLE_SQL = "event_type <> 'signup'"
_GATE = (
    f"gates AS (SELECT w, count(*) AS n, count(*) FILTER ({_COALESCIBLE_SQL}) AS c, "
    f"count(*) FILTER ({_COALESCIBLE_SQL}) > 100 AS open FROM ev GROUP BY w)"
)
_RUNS = (
    f"{_GATE}, numbered AS (SELECT ev.*, count(*) FILTER (NOT ({_COALESCIBLE_SQL})) OVER "
    "(PARTITION BY w ORDER BY ms, seq) AS run FROM ev JOIN gates USING (w) WHERE open)"
)
MERGED_SQL = (
    f"{_RUNS}, changed AS (SELECT w, run, id, min((ms, seq, pos)) AS place FROM ("
    "SELECT w, run, ms, seq, 0 AS pos, id1 AS id FROM numbered WHERE event_type IN ('click', 'view', 'error') "
    "UNION ALL SELECT w, run, ms, seq, 1, id2 FROM numbered WHERE event_type = 'view') GROUP BY ALL), "
    "id_lists AS (SELECT w, run, list(id ORDER BY place) AS ids FROM changed GROUP BY ALL), "
    "runs AS (SELECT w, run, min((ms, seq)) AS f, max((ms, seq)) AS l, "
    "bool_or(event_type = 'purchase' AND value < 50) AS facets, "
    "bool_or(event_type = 'purchase' AND value >= 50) AS others "
    f"FROM numbered WHERE {_COALESCIBLE_SQL} GROUP BY ALL), "
    "full_runs AS (SELECT * FROM runs LEFT JOIN id_lists USING (w, run))"
)

on_events(
    "event_burst_gate",
    "SELECT epoch_ms(w) AS window_ms, n AS events, c AS coalescible, CAST(open AS INTEGER) AS open FROM gates",
    _GATE,
)(
    lambda log: events.window_load(log, BURST).select(
        F.unix_millis("window_start").alias("window_ms"),
        "events",
        "coalescible",
        F.col("open").cast("int").alias("open"),
    )
)

_SAME_RUN = (
    "SELECT w, run, min((ms, seq)) AS first_id, count(*) AS n FROM numbered GROUP BY ALL"
)
on_events(
    "event_runs",
    f"SELECT epoch_ms(w) AS window_ms, first_id[1] AS first_ms, n AS events FROM ({_SAME_RUN})".replace(
        "first_id[1]", "struct_extract(first_id, 1)"
    ),
    _RUNS,
)(
    lambda log: events.burst_runs(log, BURST)
    .groupBy("window_start", "run")
    .agg(F.min("ms").alias("first_ms"), F.count("*").alias("events"))
    .select(F.unix_millis("window_start").alias("window_ms"), "first_ms", "events")
)


def flat_events(merged: DataFrame) -> DataFrame:
    ids = F.when(F.col("type") == "findings-changed", F.col("ids"))
    return merged.select(
        "ms",
        "seq",
        "ord",
        "type",
        F.coalesce(F.array_join("scopes", ","), F.lit("")).alias("scopes"),
        F.coalesce(F.size(ids), F.lit(0)).cast("long").alias("n_ids"),
        F.md5(F.coalesce(F.array_join(ids, ","), F.lit(""))).alias("ids_md5"),
    )


COALESCED_SQL = """
SELECT ms, seq, 1::BIGINT AS ord, type,
  CASE WHEN type <> 'aggregates-invalidated' THEN '' WHEN value < 50 THEN 'facets' ELSE 'findings,overview' END AS scopes,
  CASE WHEN type = 'findings-changed' THEN 2 ELSE 0 END AS n_ids,
  md5(CASE WHEN type = 'findings-changed' THEN id1 || ',' || id2 ELSE '' END) AS ids_md5
FROM ev JOIN gates USING (w) WHERE NOT open OR event_type = 'signup'
UNION ALL SELECT struct_extract(CASE WHEN ids IS NULL THEN l ELSE f END, 1), struct_extract(CASE WHEN ids IS NULL THEN l ELSE f END, 2),
  1, 'aggregates-invalidated', CASE WHEN ids IS NOT NULL OR (facets AND others) THEN 'overview,facets,findings'
  WHEN facets THEN 'facets' ELSE 'overview,findings' END, 0, md5('') FROM full_runs
UNION ALL SELECT struct_extract(l, 1), struct_extract(l, 2), 2, 'findings-changed', '', len(ids), md5(array_to_string(ids, ','))
FROM full_runs WHERE ids IS NOT NULL
"""

on_events("event_coalesce", COALESCED_SQL, MERGED_SQL)(
    lambda log: flat_events(events.coalesce(log, BURST))
)

on_events(
    "refetch_scopes",
    "SELECT type, scope, count(*) AS \"rows\" FROM (SELECT type, unnest(CASE "
    "WHEN type = 'aggregates-invalidated' THEN CASE WHEN value < 50 THEN ['facets'] ELSE ['findings', 'overview'] END "
    "WHEN type IN ('resync-required', 'export-ready') THEN [] ELSE ['findings', 'facets', 'overview'] END) AS scope "
    "FROM ev) GROUP BY ALL",
)(
    lambda log: log.select("type", F.explode(events.refetch_scopes()).alias("scope"))
    .groupBy("type", "scope")
    .agg(F.count("*").alias("rows"))
)
on_events(
    "pending_updates",
    "SELECT CAST(sum(CASE type WHEN 'findings-changed' THEN 2 WHEN 'export-ready' THEN 0 ELSE 1 END) AS BIGINT) AS pending "
    "FROM ev WHERE (ms, seq) > (SELECT (ms, seq) FROM ev WHERE type = 'resync-required' ORDER BY ms DESC, seq DESC LIMIT 1)",
)(events.pending_updates)
on_events(
    "recent_changes",
    "SELECT ms, seq, id1 AS id, CASE event_type WHEN 'click' THEN 'upserted' ELSE 'deleted' END AS change, "
    f"{iso('ts')} AS at FROM (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY ms DESC, seq DESC) AS age "
    "FROM ev WHERE event_type IN ('click', 'error')) WHERE age = 1 ORDER BY ms DESC, seq DESC LIMIT 100",
)(lambda log: events.recent_changes(log).withColumn("at", fv.iso_ms(F.col("at"))))
