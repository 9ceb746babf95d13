"""Dataset change events: encoding, validation, order, replay and coalescing.

A validated event row has the columns of EVENT_SCHEMA. `ms` and `seq` are the
two numeric parts of its log id and define the order of the log.
"""

from __future__ import annotations

import re
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnlake import fields
from vulnlake.functions.values import (
    as_number,
    is_number,
    is_text,
    iso_ms,
    nullable_string,
    plain_text,
    whole,
)
from vulnlake.operators.ordered import with_running
from vulnlake.operators.rows import public_column
from vulnlake.session import write_out
from vulnlake.spec import utc

# Event types, scopes, bounds and defaults of the event contract.
EVENT_VERSION = 1
EVENT_TYPES = (
    "finding-upserted",
    "finding-deleted",
    "findings-changed",
    "aggregates-invalidated",
    "dataset-version-changed",
    "export-ready",
    "resync-required",
)
SCOPES = ("overview", "facets", "findings")
COALESCIBLE = (
    "finding-upserted",
    "finding-deleted",
    "findings-changed",
    "aggregates-invalidated",
)
DATA_CHANGES = COALESCIBLE + ("dataset-version-changed",)
MAX_CHANGED_IDS = 5_000
MAX_ID_LENGTH = 128
MAX_URL_LENGTH = 2_048
MAX_LOG_ID_LENGTH = 64
MAX_LONG = 2**63 - 1
RETAINED_EVENTS = 10_000
COALESCE_WINDOW = "250 milliseconds"
COALESCE_THRESHOLD = 100
RECENT_CHANGES = 100
LOG_ID = r"^(0|[1-9]\d*)-(0|[1-9]\d*)$"
ISO_OFFSET = (
    r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?"
    r"(Z|[+-]([01]\d|2[0-3]):[0-5]\d)$"
)

FINDING_SCHEMA = T.StructType(
    [
        T.StructField(f, T.DoubleType() if f in fields.NUMBERS else T.StringType())
        for f in fields.EXPLORE
    ]
)
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("ms", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("datasetVersion", T.StringType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("finding", FINDING_SCHEMA),
        T.StructField("id", T.StringType()),
        T.StructField("ids", T.ArrayType(T.StringType())),
        T.StructField("scopes", T.ArrayType(T.StringType())),
        T.StructField("jobId", T.StringType()),
        T.StructField("url", T.StringType()),
    ]
)
EVENT_COLUMNS = tuple(EVENT_SCHEMA.fieldNames())


def log_id_parts(log_id: Column) -> tuple[Column, Column]:
    """Numeric parts of a log id; NULL when the id is malformed."""
    well_formed = whole(log_id, LOG_ID) & (F.length(log_id) <= MAX_LOG_ID_LENGTH)
    parts = F.split(log_id, "-")
    return (
        F.when(well_formed, parts[0].try_cast("long")),
        F.when(well_formed, parts[1].try_cast("long")),
    )


def log_id(ms: Column | str = "ms", seq: Column | str = "seq") -> Column:
    return F.concat_ws("-", ms, seq)


def parse_log_id(text: str) -> tuple[int, int]:
    """Check a log id given by a client."""
    if len(text) > MAX_LOG_ID_LENGTH or not re.fullmatch(LOG_ID, text):
        raise ValueError(f"not a log id: {text!r}")
    ms, seq = text.split("-")
    return int(ms), int(seq)


def after(ms: int, seq: int) -> Column:
    """Events strictly after a log id; nothing follows an id beyond the range of a long."""
    if max(ms, seq) > MAX_LONG:
        ms, seq = (MAX_LONG, MAX_LONG) if ms > MAX_LONG else (ms, MAX_LONG)
    return (F.col("ms") > ms) | ((F.col("ms") == ms) & (F.col("seq") > seq))


def encode(events: DataFrame) -> DataFrame:
    """Event rows as (log_id, event) with the event as JSON text."""
    base = [
        F.lit(EVENT_VERSION).alias("v"),
        F.col("type"),
        F.col("datasetVersion"),
        iso_ms(F.col("at")).alias("at"),
    ]
    keep_nulls = {"ignoreNullFields": "false"}
    kind = F.col("type")
    text = (
        F.when(kind == "finding-upserted", F.to_json(F.struct(*base, "finding"), keep_nulls))
        .when(kind == "finding-deleted", F.to_json(F.struct(*base, "id")))
        .when(kind == "findings-changed", F.to_json(F.struct(*base, "ids")))
        .when(kind == "aggregates-invalidated", F.to_json(F.struct(*base, "scopes")))
        .when(kind == "export-ready", F.to_json(F.struct(*base, "jobId", "url")))
        .otherwise(F.to_json(F.struct(*base)))
    )
    return events.select(log_id().alias("log_id"), text.alias("event"))


def _iso_ok(text: Column) -> Column:
    return whole(text, ISO_OFFSET) & text.try_cast("timestamp").isNotNull()


def _id_ok(text: Column) -> Column:
    return text.isNotNull() & F.length(text).between(1, MAX_ID_LENGTH)


_RAW_EVENT = (
    "struct<v:variant,type:variant,datasetVersion:variant,at:variant,id:variant,"
    "ids:array<variant>,scopes:array<variant>,jobId:variant,url:variant,finding:struct<"
    + ",".join(f"`{f}`:variant" for f in fields.EXPLORE)
    + ">>"
)


def _text(value: Column) -> Column:
    """Text of a string variant; NULL for any other type."""
    return F.when(is_text(value), plain_text(value))


def _text_list(values: Column) -> Column:
    """Texts of an array of string variants; NULL when an element is not text."""
    all_text = F.forall(values, lambda e: F.coalesce(is_text(e), F.lit(False)))
    return F.when(all_text, F.transform(values, plain_text))


def checked_events(entries: DataFrame, dataset_version: str | None) -> DataFrame:
    """Entries (log_id, event) with event columns and the first broken rule, `reason`."""
    ms, seq = log_id_parts(F.col("log_id"))
    # A generator stops filters from moving down and repeating the work below it.
    parsed = entries.select(
        "log_id",
        "event",
        ms.alias("ms"),
        seq.alias("seq"),
        F.explode(
            F.array(F.try_variant_get(F.try_parse_json("event"), "$", _RAW_EVENT))
        ).alias("_raw"),
    ).select(
        "log_id",
        "event",
        "ms",
        "seq",
        "_raw",
        _text(F.col("_raw.type")).alias("type"),
        _text(F.col("_raw.datasetVersion")).alias("datasetVersion"),
        _text(F.col("_raw.at")).alias("_at"),
        _text(F.col("_raw.id")).alias("id"),
        _text_list(F.col("_raw.ids")).alias("ids"),
        _text_list(F.col("_raw.scopes")).alias("scopes"),
        _text(F.col("_raw.jobId")).alias("jobId"),
        _text(F.col("_raw.url")).alias("url"),
    )

    def raw(name: str) -> Column:
        return F.col(f"_raw.{name}")

    finding = F.struct(
        *[
            (
                as_number(raw(f"finding.{f}"))
                if f in fields.NUMBERS
                else nullable_string(raw(f"finding.{f}"))
            ).alias(f)
            for f in fields.EXPLORE
        ]
    )

    def finding_field_ok(name: str) -> Column:
        value = raw(f"finding.{name}")
        if name == "id":
            return whole(_text(value), fields.FINDING_ID_PATTERN)
        if name in fields.NUMBERS:
            return is_number(value)
        if name in fields.NULLABLE_STRINGS:
            return is_text(value) | F.is_variant_null(value)
        if name in fields.SECOND_DATES:
            return F.is_variant_null(value) | _iso_ok(_text(value))
        return is_text(value)

    finding_ok = reduce(and_, [finding_field_ok(f) for f in fields.EXPLORE])

    version = raw("v")
    version_ok = is_number(version) & (as_number(version) == EVENT_VERSION)
    kind = F.col("type")
    payload_ok = (
        F.when(kind == "finding-upserted", finding_ok)
        .when(kind == "finding-deleted", _id_ok(F.col("id")))
        .when(
            kind == "findings-changed",
            F.size("ids").between(1, MAX_CHANGED_IDS) & F.forall("ids", _id_ok),
        )
        .when(
            kind == "aggregates-invalidated",
            F.size("scopes").between(1, len(SCOPES))
            & F.forall("scopes", lambda s: s.isin(*SCOPES)),
        )
        .when(
            kind == "export-ready",
            _id_ok(F.col("jobId"))
            & (
                raw("url").isNull() | (F.length("url") <= MAX_URL_LENGTH)
            ),
        )
        .otherwise(True)
    )

    def broken(rule: Column, reason: str) -> Column:
        return F.when(~F.coalesce(rule, F.lit(False)), reason)

    rules = [
        broken(F.col("ms").isNotNull() & F.col("seq").isNotNull(), "malformed log id"),
        broken(F.col("event").isNotNull(), "no payload"),
        broken(F.col("_raw").isNotNull(), "malformed JSON"),
        broken(version_ok, "unsupported version"),
        broken(kind.isin(*EVENT_TYPES), "unknown type"),
        broken(_id_ok(F.col("datasetVersion")), "bad dataset version"),
        broken(_iso_ok(F.col("_at")), "bad timestamp"),
        broken(payload_ok, "bad payload"),
    ]
    if dataset_version is not None:
        rules.append(broken(F.col("datasetVersion") == dataset_version, "wrong dataset version"))
    checked = parsed.select(
        "log_id",
        "event",
        F.coalesce(*rules).alias("_reason"),
        "ms",
        "seq",
        "type",
        "datasetVersion",
        F.col("_at").try_cast("timestamp").alias("at"),
        F.when(kind == "finding-upserted", finding).alias("finding"),
        F.when(kind == "finding-deleted", F.col("id")).alias("id"),
        F.when(kind == "findings-changed", F.col("ids")).alias("ids"),
        F.when(kind == "aggregates-invalidated", F.col("scopes")).alias("scopes"),
        F.when(kind == "export-ready", F.col("jobId")).alias("jobId"),
        F.when(kind == "export-ready", F.col("url")).alias("url"),
    )
    return checked.select("*", F.explode(F.array("_reason")).alias("reason"))


def valid_events(entries: DataFrame, dataset_version: str | None = None) -> DataFrame:
    """Validated event rows; unknown keys are dropped."""
    return checked_events(entries, dataset_version).where("reason IS NULL").select(*EVENT_COLUMNS)


def rejected_events(entries: DataFrame, dataset_version: str | None = None) -> DataFrame:
    """(log_id, event, reason) of entries that break a rule."""
    return (
        checked_events(entries, dataset_version)
        .where("reason IS NOT NULL")
        .select("log_id", "event", "reason")
    )


def blank_event(**columns: Column) -> list[Column]:
    """All event columns, NULL where not given."""
    return [
        columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
        for f in EVENT_SCHEMA.fields
    ]


def finding_payload() -> Column:
    return F.struct(*[public_column(f) for f in fields.EXPLORE])


def next_id(now: datetime, last: tuple[int, int] | None) -> tuple[int, int]:
    """The log id after `last` at a time; a clock that stands or steps back goes on from it."""
    ms = int(utc(now).timestamp() * 1000)
    return (ms, 0) if last is None or ms > last[0] else (last[0], last[1] + 1)


def change_events(upserts: DataFrame, deletes: DataFrame, dataset_version: str,
                  now: datetime, last: tuple[int, int] | None = None) -> DataFrame:
    """One event per applied upsert, then one per delete, in request order.

    Both inputs are new log rows whose `position` is the request order, from 1.
    Ids follow `last`, the newest id of the log.
    """
    at = F.lit(utc(now))
    ms, seq = next_id(now, last)
    offset = seq if last is not None and ms == last[0] else 1
    common = {
        "ms": F.lit(ms),
        "datasetVersion": F.lit(dataset_version),
        "at": at,
    }
    written = upserts.select(
        *blank_event(
            **common,
            seq=F.col("position") + (offset - 1),
            type=F.lit("finding-upserted"),
            finding=finding_payload(),
        )
    )
    upserted = F.coalesce(upserts.agg(F.max("position")).scalar(), F.lit(0))
    removed = deletes.select(
        *blank_event(
            **common,
            seq=F.col("position") + upserted + (offset - 1),
            type=F.lit("finding-deleted"),
            id=F.col("findingId"),
        )
    )
    return written.unionByName(removed)


def version_changed_event(frame: DataFrame, dataset_version: str, now: datetime,
                          last_event: tuple[int, int] | None = None) -> DataFrame:
    """The one terminal event of an initial load; its id follows `last_event`."""
    at = F.lit(utc(now))
    ms, seq = next_id(now, last_event)
    return frame.sparkSession.range(1).select(
        *blank_event(
            ms=F.lit(ms).cast("long"),
            seq=F.lit(seq),
            type=F.lit("dataset-version-changed"),
            datasetVersion=F.lit(dataset_version),
            at=at,
        )
    )


def retain_last(events: DataFrame, n: int = RETAINED_EVENTS) -> DataFrame:
    """The newest n events of the log.

    Only log ids are ranked; the events are filtered by the oldest id kept.
    """
    newest = events.select("ms", "seq").orderBy(F.desc("ms"), F.desc("seq")).limit(n)
    key = F.struct("ms", "seq")
    return events.where(key >= newest.agg(F.min(key)).scalar())


def replay_after(events: DataFrame, last_id: str) -> DataFrame:
    return events.where(after(*parse_log_id(last_id)))


def start_position(events: DataFrame, last_id: str | None) -> DataFrame:
    """Where a client resumes: one row (cursor, resync, resync_id).

    No id starts at the tail (cursor NULL). An id that is not retained resumes
    from the last event after a resync; an empty log resyncs at the tail.
    """
    order = F.struct("ms", "seq")
    bounds = events.agg(F.max(order).alias("last"), F.count("*").alias("n"))
    if last_id is None:
        return bounds.select(
            F.lit(None).cast("string").alias("cursor"),
            F.lit(False).alias("resync"),
            F.lit(None).cast("string").alias("resync_id"),
        )
    ms, seq = parse_log_id(last_id)
    known = F.lit(False)  # no event has an id beyond the range of a long
    if max(ms, seq) <= MAX_LONG:
        known = (F.col("ms") == ms) & (F.col("seq") == seq)
    newest = log_id(F.col("last.ms"), F.col("last.seq"))
    return events.agg(
        F.max(order).alias("last"), F.coalesce(F.bool_or(known), F.lit(False)).alias("retained")
    ).select(
        F.when(F.col("retained"), F.lit(last_id))
        .when(F.col("last").isNotNull(), newest)
        .alias("cursor"),
        (~F.col("retained")).alias("resync"),
        F.when(~F.col("retained") & F.col("last").isNotNull(), newest).alias("resync_id"),
    )


def is_coalescible() -> Column:
    return F.col("type").isin(*COALESCIBLE)


def changed_ids() -> Column:
    """Ids one event changes, in its own order."""
    return (
        F.when(F.col("type") == "finding-upserted", F.array("finding.id"))
        .when(F.col("type") == "finding-deleted", F.array("id"))
        .when(F.col("type") == "findings-changed", F.col("ids"))
        .otherwise(F.array().cast("array<string>"))
    )


def with_window(events: DataFrame, width: str | None) -> DataFrame:
    """Add the start of the tumbling window of `at`; None makes one window."""
    if width is None:
        return events.withColumn("window_start", F.lit(None).cast("timestamp"))
    return events.withColumn("window_start", F.window("at", width).getField("start"))


def window_load(events: DataFrame, width: str | None = COALESCE_WINDOW,
                threshold: int = COALESCE_THRESHOLD) -> DataFrame:
    """(window_start, events, coalescible, open): which windows are bursts."""
    if width is None:
        keyed = with_window(events, None).groupBy("window_start")
        start = F.col("window_start")
    else:
        keyed = events.groupBy(F.window("at", width).alias("w"))
        start = F.col("w.start").alias("window_start")
    counted = keyed.agg(
        F.count("*").alias("events"), F.count_if(is_coalescible()).alias("coalescible")
    )
    return counted.select(start, "events", "coalescible").withColumn(
        "open", F.col("coalescible") > threshold
    )


def _in_windows(events: DataFrame, width: str | None, threshold: int, state: str) -> DataFrame:
    """Events of the windows in one state; a single window is gated by one number."""
    if width is None:
        gate = window_load(events, None, threshold).where(state).agg(F.count("*")).scalar()
        return with_window(events, None).where(gate > 0)
    windows = window_load(events, width, threshold).where(state).select("window_start")
    same = F.col("e.window_start").eqNullSafe(F.col("w.window_start"))
    return with_window(events, width).alias("e").join(windows.alias("w"), same).select("e.*")


def burst_runs(events: DataFrame, width: str | None = COALESCE_WINDOW,
               threshold: int = COALESCE_THRESHOLD) -> DataFrame:
    """Events of burst windows with their run number.

    Within a window, events that cannot be coalesced end a run. The number of
    such events before an event, in window and log order, names its run.
    """
    return with_running(
        _in_windows(events, width, threshold, "open"),
        ["window_start", "ms", "seq"],
        sums={
            "run": F.when(is_coalescible(), 0).otherwise(1).cast("long"),
            "place": F.lit(1).cast("long"),
        },
    )


def coalesce(events: DataFrame, width: str | None = COALESCE_WINDOW,
             threshold: int = COALESCE_THRESHOLD, max_ids: int = MAX_CHANGED_IDS) -> DataFrame:
    """Events after coalescing bursts, with `ord` for events that share an id.

    Runs of a burst window become one aggregates-invalidated event and, when
    ids changed, findings-changed events of at most `max_ids` ids each that
    together name all of them in the order they were first seen. Everything else
    passes through.
    """
    calm = _in_windows(events, width, threshold, "NOT open")
    # Several results read the runs, so what they need is stored once.
    kept = ("ms", "seq", "type", "datasetVersion", "at", "jobId", "url")
    numbered = write_out(
        burst_runs(events, width, threshold).select(
            "window_start", "run", "place", *kept, "scopes", changed_ids().alias("changed_ids")
        ),
        "runs",
    )
    through = numbered.where(~is_coalescible())
    passed = calm.select(*EVENT_COLUMNS).unionByName(
        through.select(*blank_event(**{c: F.col(c) for c in kept}))
    )

    members = numbered.where(is_coalescible())
    run_key = ["window_start", "run"]
    order = F.struct("ms", "seq")
    has_scope = {
        s: F.coalesce(F.array_contains("scopes", s), F.lit(False)) for s in SCOPES
    }
    runs = members.groupBy(*run_key).agg(
        F.min(order).alias("first"),
        F.max(order).alias("last"),
        F.max_by("at", order).alias("at"),
        F.max_by("datasetVersion", order).alias("datasetVersion"),
        F.bool_or(F.size("changed_ids") > 0).alias("any_id"),
        *[F.bool_or(has).alias(f"scope_{s}") for s, has in has_scope.items()],
    )
    scopes = F.array_compact(
        F.array(*[F.when(F.col("any_id") | F.col(f"scope_{s}"), F.lit(s)) for s in SCOPES])
    )
    invalidated = runs.where(F.size(scopes) > 0).select(
        *blank_event(
            ms=F.when(F.col("any_id"), F.col("first.ms")).otherwise(F.col("last.ms")),
            seq=F.when(F.col("any_id"), F.col("first.seq")).otherwise(F.col("last.seq")),
            type=F.lit("aggregates-invalidated"),
            datasetVersion=F.col("datasetVersion"),
            at=F.col("at"),
            scopes=scopes,
        )
    )
    changed = _first_seen_ids(members, run_key, max_ids)
    same_run = (F.col("r.run") == F.col("c.run")) & F.col("r.window_start").eqNullSafe(
        F.col("c.window_start")
    )
    updated = (
        runs.alias("r")
        .join(changed.alias("c"), same_run)
        .select(
            *blank_event(
                ms=F.col("r.last.ms"),
                seq=F.col("r.last.seq"),
                type=F.lit("findings-changed"),
                datasetVersion=F.col("r.datasetVersion"),
                at=F.col("r.at"),
                ids=F.col("c.first_ids"),
            ),
            (F.col("c.part") + 2).alias("ord"),
        )
    )
    one = F.lit(1).cast("long")
    return (
        passed.withColumn("ord", one)
        .unionByName(invalidated.withColumn("ord", one))
        .unionByName(updated)
    )


def _first_seen_ids(members: DataFrame, run_key: list[str], max_ids: int) -> DataFrame:
    """Distinct ids of each run in first-seen order, `max_ids` to a part.

    Repeats of an id are folded before the shuffle, and the ids are numbered over
    ranges of the order, so a run may have any number of them.
    """
    seen = (
        members.select(*run_key, "place", F.posexplode("changed_ids").alias("pos", "changed"))
        .groupBy(*run_key, "changed")
        .agg(F.min("place").alias("place"), F.min_by("pos", F.struct("place", "pos")).alias("pos"))
    )
    numbered = write_out(
        with_running(seen, [*run_key, "place", "pos"], sums={"n": F.lit(1).cast("long")}), "ids"
    )
    starts = numbered.groupBy(*run_key).agg(F.min("n").alias("start")).alias("s")
    same_run = (F.col("i.run") == F.col("s.run")) & F.col("i.window_start").eqNullSafe(
        F.col("s.window_start")
    )
    placed = numbered.alias("i").join(starts, same_run).select("i.*", (F.col("n") - F.col("start")).alias("at"))
    return (
        placed.groupBy(*run_key, F.floor(F.col("at") / max_ids).alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("at", "changed"))).alias("listed"))
        .select(*run_key, "part", F.col("listed.changed").alias("first_ids"))
    )


def refetch_scopes() -> Column:
    """Which views an event makes stale."""
    return (
        F.when(F.col("type") == "aggregates-invalidated", F.col("scopes"))
        .when(
            F.col("type").isin(*DATA_CHANGES),
            F.array(F.lit("findings"), F.lit("facets"), F.lit("overview")),
        )
        .otherwise(F.array().cast("array<string>"))
    )


def stale_scopes(events: DataFrame) -> DataFrame:
    """Distinct views to recompute after a set of events."""
    return events.select(F.explode(refetch_scopes()).alias("scope")).distinct()


def pending_weight() -> Column:
    return (
        F.when(F.col("type") == "findings-changed", F.size("ids"))
        .when(F.col("type").isin(*DATA_CHANGES), 1)
        .otherwise(0)
        .cast("long")
    )


def pending_updates(events: DataFrame) -> DataFrame:
    """Updates since the last resync that a fixed time range has not shown."""
    resync = events.where(F.col("type") == "resync-required").agg(
        F.max(F.struct("ms", "seq")).alias("at")
    )
    since = resync.scalar()
    newer = since.isNull() | (F.struct("ms", "seq") > since)
    return events.where(newer).agg(
        F.coalesce(F.sum(pending_weight()), F.lit(0).cast("long")).alias("pending")
    )


def recent_changes(events: DataFrame, n: int = RECENT_CHANGES) -> DataFrame:
    """The last n changed findings, newest event per id; show them by (ms, seq)."""
    one_finding = events.where(F.col("type").isin("finding-upserted", "finding-deleted")).select(
        F.coalesce("finding.id", "id").alias("id"),
        F.struct(
            "ms", "seq", F.substring_index("type", "-", -1).alias("change"), "at"
        ).alias("e"),
    )
    return (
        one_finding.groupBy("id")
        .agg(F.max("e").alias("e"))
        .orderBy(F.desc("e"))
        .limit(n)
        .select("e.ms", "e.seq", "id", "e.change", "e.at")
    )


def dataset_info(current: DataFrame, events: DataFrame, dataset_version: str) -> DataFrame:
    """One row: version, current findings, last event id."""
    last = events.agg(F.max(F.struct("ms", "seq")).alias("e")).select(
        F.when(F.col("e").isNotNull(), log_id(F.col("e.ms"), F.col("e.seq")))
    )
    return current.agg(F.count("*").alias("totalCount")).select(
        F.lit(dataset_version).alias("version"), "totalCount", last.scalar().alias("lastEventId")
    )
