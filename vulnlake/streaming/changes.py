"""Structured Streaming: applying changes, refreshing views, coalescing events."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vulnlake import fields
from vulnlake.functions.values import epoch_ms, finding_id
from vulnlake.operators import events as ev
from vulnlake.operators import maintained
from vulnlake.operators.ordered import placed
from vulnlake.operators.predicates import by_id
from vulnlake.operators.versions import (
    MAX_CHANGES,
    ContractViolation,
    apply_deletes,
    apply_upserts,
    check_changes,
    join_by_identity,
    lookup_by_ids,
    merge_current,
    newest_version,
)
from vulnlake.session import scratch_scope, write_out, write_out_alone
from vulnlake.sources.tables import (
    Generations,
    bucket_of,
    children,
    exists,
    read_current,
    read_events,
    read_small,
    remove,
    write_buckets,
    write_events,
    write_small,
)

#: States of batches kept for repeats.
KEPT_STATES = 100
#: Buckets of a new table; some thousands suit a large one.
BUCKETS = 32
# The change feed: one row per change. `op` is upsert or delete; upserts fill
# the source columns, deletes fill findingId; requestOrder is unique per op.
CHANGE_COLUMNS = ("op", *fields.SOURCE_FIELDS, "findingId", "requestOrder")


def apply_changes(current: DataFrame, upserts: DataFrame, ids: DataFrame, dataset_version: str,
                  now: datetime, batch: int,
                  max_changes: int | None = MAX_CHANGES, last_issued_ms: int = 0,
                  last_event: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Upserts, then deletes: (new log rows, change events).

    Deletes see the upserts of the same call. Pass `max_changes=None` for bulk
    loads. Stamps follow `last_issued_ms` and event ids follow `last_event`, so
    that neither goes back however the clock does.
    """
    # Read several times; as files they also have a size for the join planner.
    upserts, ids = placed(upserts), write_out(ids, "deletes-asked")
    check_changes(upserts, ids, max_changes)
    spark = current.sparkSession
    written = write_out_alone(
        spark, lambda: apply_upserts(current, upserts, now, batch, last_issued_ms), "upserts"
    )
    last_stamp = written.agg(F.max(epoch_ms(F.col("updatedAt"))).alias("ms")).first().ms
    last_stamp = last_issued_ms if last_stamp is None else last_stamp
    # Deletes see the upserts; only findings they name need to be merged.
    named = merge_current(lookup_by_ids(current, ids), lookup_by_ids(written, ids))
    tombstones = write_out_alone(
        spark, lambda: apply_deletes(named, ids, now, batch + 1, last_issued_ms=last_stamp), "tombstones"
    )
    emitted = ev.change_events(written, tombstones, dataset_version, now, last_event)
    return written.unionByName(tombstones), emitted


class FindingsTable:
    """A findings table on storage that takes change batches.

    Layout below `root`: current findings lie in `buckets` by their id. `snapshot/<n>`
    holds the buckets that batches up to n changed, `manifest/<n>` names for every bucket
    the snapshot that has it, `log/<n>` and `events/<n>` hold what batch n added. Readers
    merge the buckets of the newest manifest with the log rows after it. A change batch
    reads only the buckets of the findings it names; every `snapshot_every` batches the
    buckets changed since are written anew, and what only manifests before the last two
    need is deleted. With `counts`, `counts/<n>` holds what batch n adds to the cells of
    maintained aggregates and `totals/<n>` their sum at a manifest; a batch finds the
    versions it replaces in the buckets it reads anyway. `state/<n>` keeps the highest stamp and event id after batch n
    and which batch of which stream has which number, so that stamps and ids
    only grow and a second stream or checkpoint takes numbers of its own. A
    repeated batch overwrites its own folders, so replaying after a failure
    changes nothing. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, dataset_version: str,
                 snapshot_every: int = 20, max_changes: int | None = MAX_CHANGES,
                 buckets: int = BUCKETS, counts: bool = False):
        self.spark = spark
        self.root = root.rstrip("/")
        self.dataset_version = dataset_version
        self.snapshot_every = snapshot_every
        self.max_changes = max_changes
        self.new_buckets = buckets
        self.counts = counts

    def _numbers(self, kind: str) -> list[int]:
        names = children(self.spark, f"{self.root}/{kind}")
        return sorted(
            int(n) for n in names
            if n.isdigit() and exists(self.spark, f"{self.root}/{kind}/{n}/_SUCCESS")
        )

    @classmethod
    def open(cls, spark: SparkSession, root: str, dataset_version: str, **settings) -> FindingsTable:
        """The table that the newest load below `root` published."""
        folder = Generations(spark, root).published(dataset_version)
        if folder is None:
            raise FileNotFoundError(f"no load of {dataset_version} below {root}")
        return cls(spark, folder, dataset_version, **settings)

    def create(self, current: DataFrame, now: datetime | None = None,
               replaced: FindingsTable | None = None) -> None:
        """Batch 0: the findings of an initial load and its one event.

        Events, stamps and ids go on from those of a table that is `replaced`.
        """
        parts = write_buckets(current, f"{self.root}/snapshot/0", self.new_buckets)
        if self.counts:
            maintained.cells(current).write.mode("overwrite").parquet(f"{self.root}/totals/0")
        self._write_manifest(0, self.new_buckets, dict.fromkeys(parts, 0))
        state = replaced._state() if replaced else {"stamp": 0, "event": None}
        event = ev.version_changed_event(
            current, self.dataset_version, now or datetime.now(timezone.utc),
            tuple(state["event"]) if state["event"] else None,
        )
        entries = ev.encode(event)
        if replaced:
            # As many as the event log keeps at most.
            ms, seq = ev.log_id_parts(F.col("log_id"))
            before = replaced.events().select("log_id", "event", ms.alias("ms"), seq.alias("seq"))
            kept = ev.retain_last(before, ev.RETAINED_EVENTS - 1)
            entries = entries.select("log_id", "event").unionByName(kept.select("log_id", "event"))
        write_events(entries, f"{self.root}/events/0", "overwrite")
        state = {"streams": {}, "stamp": state["stamp"], "event": state["event"]}
        self._write_state(0, state, self.current())

    def last_stamp(self) -> int:
        """The highest stamp given to a row, in milliseconds."""
        return self._state()["stamp"]

    def _state(self, before: int | None = None) -> dict:
        """The newest state, or the newest before a batch."""
        names = children(self.spark, f"{self.root}/state")
        numbers = [int(n) for n in names if n.isdigit() and (before is None or int(n) < before)]
        for n in sorted(numbers, reverse=True):
            row = self.spark.read.text(f"{self.root}/state/{n}").first()
            if row is not None:
                return json.loads(row.value)
        return {"number": 0, "stamp": 0, "event": None, "streams": {}}

    def _write_state(self, number: int, state: dict, rows: DataFrame | None) -> None:
        """Keep the state after a batch; `rows` are its log rows, if it wrote any."""
        if rows is not None:
            stamp = rows.agg(F.max(epoch_ms(F.col("updatedAt"))).alias("ms")).first().ms
            entries = read_events(self.spark, f"{self.root}/events/{number}")
            ms, seq = ev.log_id_parts(F.col("log_id"))
            last = entries.agg(F.max(F.struct(ms.alias("ms"), seq.alias("seq"))).alias("e")).first().e
            state = {
                **state,
                "stamp": max(stamp or 0, state.get("stamp", 0)),
                "event": list(last) if last is not None else state.get("event"),
            }
        text = json.dumps({**state, "number": number})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(
            "overwrite"
        ).text(f"{self.root}/state/{number}")
        remove(self.spark, f"{self.root}/state/{number - KEPT_STATES}")

    def number_for(self, stream: str, batch_id: int) -> int:
        """The number of a stream's batch: its own if it is a repeat, else the next free one."""
        state = self._state()
        known = state["streams"].get(stream)
        return known[1] if known and known[0] == batch_id else state["number"] + 1

    def skip(self, number: int, stream: str, batch_id: int) -> None:
        """Use up a number for a batch that was refused."""
        state = self._state(before=number)
        streams = {**state["streams"], stream: [batch_id, number]}
        self._write_state(number, {**state, "streams": streams}, None)

    def _manifests(self, before: int | None = None) -> list[int]:
        names = children(self.spark, f"{self.root}/manifest")
        return sorted(int(n) for n in names if n.isdigit() and (before is None or int(n) < before))

    def _manifest(self, number: int) -> tuple[int, dict[int, int]]:
        """How many buckets there are, and the snapshot that has each one with rows."""
        stored = json.loads(read_small(self.spark, f"{self.root}/manifest/{number}"))
        return stored["buckets"], {k: int(n) for n, parts in stored["parts"].items() for k in parts}

    def _write_manifest(self, number: int, buckets: int, where: dict[int, int]) -> None:
        parts: dict[int, list[int]] = {}
        for k, n in sorted(where.items()):
            parts.setdefault(n, []).append(k)
        write_small(self.spark, f"{self.root}/manifest/{number}", json.dumps({"buckets": buckets, "parts": parts}))

    def _snapshot(self, number: int) -> None:
        """Write the buckets that batches since the last manifest changed, as they are after batch `number`."""
        last = self._manifests(number)[-1]
        buckets, where = self._manifest(last)
        newer = self.log_rows(last, number + 1)
        changed = self._touched(newer.select("findingId"), buckets)
        # From the manifest before, as a repeated batch must not read the files that it writes.
        rows = self._merged(last, number + 1, changed)
        written = write_buckets(rows, f"{self.root}/snapshot/{number}", buckets)
        where = {k: n for k, n in where.items() if k not in changed} | dict.fromkeys(written, number)
        if self.counts:
            self.cells(number + 1).write.mode("overwrite").parquet(f"{self.root}/totals/{number}")
        self._write_manifest(number, buckets, where)
        self._prune()

    def _touched(self, ids: DataFrame, buckets: int) -> set[int]:
        """Buckets of some findings, which are `buckets` at most."""
        named = ids.select(bucket_of(F.col("findingId"), buckets).alias("bucket")).distinct()
        return {row.bucket for row in named.collect()}

    def _prune(self) -> None:
        manifests = self._manifests()
        if len(manifests) < 3:
            return
        needed = {(n, k) for m in manifests[-2:] for k, n in self._manifest(m)[1].items()}
        for m in manifests[:-2]:
            remove(self.spark, f"{self.root}/manifest/{m}")
            remove(self.spark, f"{self.root}/totals/{m}")
        for n in self._numbers("snapshot"):
            folder = f"{self.root}/snapshot/{n}"
            parts = [c for c in children(self.spark, folder) if c.startswith("bucket=")]
            spare = [c for c in parts if (n, int(c.removeprefix("bucket="))) not in needed]
            for path in [folder] if len(spare) == len(parts) and n < manifests[-1] else [f"{folder}/{c}" for c in spare]:
                remove(self.spark, path)
        for n in self._numbers("log"):
            if n <= manifests[-2]:
                remove(self.spark, f"{self.root}/log/{n}")
                remove(self.spark, f"{self.root}/counts/{n}")

    def log_rows(self, after: int, before: int | None = None) -> DataFrame | None:
        numbers = [n for n in self._numbers("log") if n > after and (before is None or n < before)]
        if not numbers:
            return None
        return read_current(self.spark, [f"{self.root}/log/{n}" for n in numbers])

    def current(self, before: int | None = None, only: set[int] | None = None) -> DataFrame:
        """Current findings, optionally as they were before a batch, and of some buckets only."""
        return self._merged(self._manifests(before)[-1], before, only)

    def _merged(self, last: int, before: int | None, only: set[int] | None) -> DataFrame:
        """The buckets of a manifest with the log rows after it."""
        buckets, where = self._manifest(last)
        paths = [
            f"{self.root}/snapshot/{n}/bucket={k}" for k, n in sorted(where.items()) if only is None or k in only
        ]
        base = read_current(self.spark, paths) if paths else self.spark.createDataFrame([], fields.LOG_SCHEMA)
        newer = self.log_rows(last, before)
        if newer is None:
            return base
        if only is not None:
            newer = newer.where(bucket_of(F.col("findingId"), buckets).isin(sorted(only)))
        return merge_current(base, newer)

    def cells(self, before: int | None = None) -> DataFrame:
        """Cells of the maintained aggregates (metric, key, n), optionally as before a batch."""
        if not self.counts:
            raise ValueError("this table keeps no counts")
        last = self._manifests(before)[-1]
        later = [n for n in self._numbers("counts") if n > last and (before is None or n < before)]
        read = self.spark.read.schema(maintained.CELLS)
        parts = [read.parquet(f"{self.root}/totals/{last}")]
        if later:
            parts.append(read.parquet(*[f"{self.root}/counts/{n}" for n in later]))
        return maintained.added_up(parts)

    def named(self, ids: DataFrame, before: int | None = None) -> DataFrame:
        """Current findings of the buckets that hold the given ids."""
        buckets, _ = self._manifest(self._manifests(before)[-1])
        return self.current(before, self._touched(ids, buckets))

    def find(self, id: str) -> DataFrame:
        """The finding of an id, if it is current; reads its bucket only."""
        asked = self.spark.createDataFrame([(id,)], "findingId string")
        return by_id(self.named(asked), id)

    def apply(self, changes: DataFrame, number: int, now: datetime,
              for_version: str | None = None, stream: str | None = None,
              batch_id: int | None = None) -> DataFrame:
        """Apply one batch (number 1 and up) and return its events.

        A batch made for another dataset version is refused; a change feed may
        name the version in a column `datasetVersion`.
        """
        if for_version not in (None, self.dataset_version):
            raise ContractViolation(
                f"changes for {for_version} do not match {self.dataset_version}"
            )
        if "datasetVersion" in changes.columns:
            same = F.col("datasetVersion").eqNullSafe(self.dataset_version)
            if not changes.where(~same).isEmpty():
                raise ContractViolation(f"changes do not match {self.dataset_version}")
        state = self._state(before=number)
        # Read several times, first for the buckets it names.
        changes = write_out(changes, "changes")
        own = F.when(F.col("op") == "upsert", finding_id()).otherwise(F.col("findingId"))
        before = self.named(changes.select(own.alias("findingId")), before=number)
        upserts = changes.where("op = 'upsert'").select(*fields.SOURCE_FIELDS, "requestOrder")
        ids = changes.where("op = 'delete'").select("findingId", "requestOrder")
        rows, events = apply_changes(
            before, upserts, ids, self.dataset_version, now, 2 * number, self.max_changes,
            state["stamp"], tuple(state["event"]) if state["event"] else None,
        )
        rows.select(*fields.LOG_COLUMNS).write.mode("overwrite").parquet(
            f"{self.root}/log/{number}"
        )
        write_events(ev.encode(events), f"{self.root}/events/{number}", "overwrite", "gzip")
        if self.counts:
            written = newest_version(read_current(self.spark, f"{self.root}/log/{number}"))
            # Of one batch, an upserted and then deleted finding replaces the version before both.
            replaced = join_by_identity(before, written.select(*fields.IDENTITY), "left_semi")
            change = maintained.change_of(replaced, written.where(~F.col("isDeleted")))
            change.write.mode("overwrite").parquet(f"{self.root}/counts/{number}")
        if number % self.snapshot_every == 0:
            self._snapshot(number)
        if stream is not None:
            state = {**state, "streams": {**state["streams"], stream: [batch_id, number]}}
        self._write_state(number, state, rows)
        entries = read_events(self.spark, f"{self.root}/events/{number}")
        return ev.valid_events(entries, self.dataset_version)

    def events(self) -> DataFrame:
        return read_events(
            self.spark, [f"{self.root}/events/{n}" for n in self._numbers("events")]
        )


def stream_to_table(changes: DataFrame, table: FindingsTable, checkpoint: str,
                    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
                    views: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
                    trigger: dict | None = None, stream: str | None = None,
                    counted: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> StreamingQuery:
    """Apply a stream of changes; recompute the views each batch makes stale.

    Batches take the table's next numbers; `stream` names the stream among those
    that feed the table and is the checkpoint's path by default.

    `views` maps a scope (findings, facets, overview) to a function of current
    findings, `counted` to one of the cells of a table that keeps counts, which costs no
    scan of the findings; results go to `view/<scope>/<n>`. A batch that breaks the change
    contract is kept in `rejected/<n>` and changes nothing.
    """
    name = stream or checkpoint

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        with scratch_scope(table.spark):
            number = table.number_for(name, batch_id)
            try:
                emitted = table.apply(batch, number, clock(), stream=name, batch_id=batch_id)
            except ContractViolation as refusal:
                refused = batch.withColumn("refusal", F.lit(str(refusal)))
                if refusal.ids is not None:
                    named = refusal.ids.select("findingId", F.lit(True).alias("unknown"))
                    refused = refused.join(named, "findingId", "left")
                refused.write.mode("overwrite").parquet(f"{table.root}/rejected/{number}")
                table.skip(number, name, batch_id)
                return
            if views or counted:
                refresh_views(table, emitted, number, views or {}, counted or {})

    return (
        changes.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(handle)
        .start()
    )


def refresh_views(table: FindingsTable, emitted: DataFrame, number: int,
                  views: dict[str, Callable[[DataFrame], DataFrame]],
                  counted: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> None:
    """Recompute only the views that the events of a batch invalidate."""
    stale = {row.scope for row in ev.stale_scopes(emitted).collect()}  # at most three scopes
    counted = counted or {}
    for scope in sorted(stale & (set(views) | set(counted))):
        if scope in counted:
            view = counted[scope](table.cells(number + 1))
        else:
            view = views[scope](table.current(before=number + 1))
        view.write.mode("overwrite").parquet(
            f"{table.root}/view/{scope}/{number}"
        )


def stream_coalesce(entries: DataFrame, out: str, checkpoint: str,
                    dataset_version: str | None = None, width: str | None = None,
                    threshold: int = ev.COALESCE_THRESHOLD, delay: str = "10 seconds",
                    trigger: dict | None = None) -> StreamingQuery:
    """Validate and coalesce a stream of (log_id, event) entries.

    With `width=None` each micro-batch is one window: the entries that arrived
    since the last trigger, so a 250 ms processing-time trigger collects for
    250 ms. With a width, windows tumble over the event time, whatever the
    triggers; a window goes to `events/<n>` of the batch that closes it (see
    `stream_windows`). Invalid and late entries go to `rejected/<n>` below `out`.
    """
    if width is not None:
        return stream_windows(
            entries, out, checkpoint, lambda rows: ev.coalesce(rows, width, threshold),
            width, dataset_version, delay, trigger,
        )

    def handle(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            checked = write_out(ev.checked_events(batch, dataset_version), "entries")
            merged = ev.coalesce(_valid(checked), None, threshold)
            merged.write.mode("overwrite").parquet(f"{out}/events/{batch_id}")
            _rejected(checked).write.mode("overwrite").parquet(f"{out}/rejected/{batch_id}")

    return _each_batch(entries, checkpoint, handle, trigger)


def stream_window_counts(entries: DataFrame, out: str, checkpoint: str,
                         dataset_version: str | None = None, width: str = ev.COALESCE_WINDOW,
                         threshold: int = ev.COALESCE_THRESHOLD, delay: str = "10 seconds",
                         trigger: dict | None = None) -> StreamingQuery:
    """Load per event-time window in `events/<n>`, late and invalid entries in `rejected/<n>`.

    Each entry is counted in its window or rejected, never both and never neither.
    """
    return stream_windows(
        entries, out, checkpoint, lambda rows: ev.window_load(rows, width, threshold),
        width, dataset_version, delay, trigger,
    )


def stream_windows(entries: DataFrame, out: str, checkpoint: str,
                   emit: Callable[[DataFrame], DataFrame], width: str,
                   dataset_version: str | None = None, delay: str = "10 seconds",
                   trigger: dict | None = None) -> StreamingQuery:
    """Hand whole event-time windows of a stream of (log_id, event) entries to `emit`.

    The stream's high-water mark is the newest `at` of its valid entries; what is `delay`
    older closes. Events of open windows wait in `held/<n>`, so a window that triggers cut
    is emitted once, whole, by the batch whose mark closes it. Entries of windows that were
    closed before their batch go to `rejected/<n>` as late. The mark after batch n is kept
    in `mark/<n>`; a repeated batch starts from what the batch before it left and
    overwrites its own folders. `drain_windows` emits what waits when the stream has ended.
    """
    spark = entries.sparkSession
    patience = _micros(spark, delay)

    def handle(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(spark):
            checked = write_out(ev.checked_events(batch, dataset_version), "entries")
            before = _mark(spark, out, batch_id)
            valid = checked.where("reason IS NULL")
            newest = valid.agg(F.max(F.unix_micros("at")).alias("at")).first().at
            mark = max((m for m in (before, newest) if m is not None), default=None)
            end = F.unix_micros(F.window("at", width).getField("end"))
            late = valid.where(end <= before - patience) if before is not None else valid.limit(0)
            fresh = valid.where(end > before - patience) if before is not None else valid
            waiting = fresh.select(*ev.EVENT_COLUMNS)
            held = _held(spark, out, batch_id)
            if held is not None:
                waiting = waiting.unionByName(held)
            # Read by both the closed and the open windows.
            waiting = write_out(waiting, "waiting")
            closed = end <= mark - patience if mark is not None else F.lit(False)
            emit(waiting.where(closed)).write.mode("overwrite").parquet(f"{out}/events/{batch_id}")
            told = late.select("log_id", "event", F.lit("late").alias("reason"))
            _rejected(checked).unionByName(told).write.mode("overwrite").parquet(
                f"{out}/rejected/{batch_id}"
            )
            waiting.where(~closed).write.mode("overwrite").parquet(f"{out}/held/{batch_id}")
            write_small(spark, f"{out}/mark/{batch_id}", "" if mark is None else str(mark))
            for n in _batches(spark, out, "held", batch_id)[:-1]:
                remove(spark, f"{out}/held/{n}")
                remove(spark, f"{out}/mark/{n}")

    return _each_batch(entries, checkpoint, handle, trigger)


def drain_windows(spark: SparkSession, out: str, emit: Callable[[DataFrame], DataFrame]) -> None:
    """Emit the windows of an ended stream that still wait, to `events/drained`.

    The stream must not go on after it: its next batch would emit them again.
    """
    held = _held(spark, out, None)
    if held is not None:
        emit(held).write.mode("overwrite").parquet(f"{out}/events/drained")


def _valid(checked: DataFrame) -> DataFrame:
    return checked.where("reason IS NULL").select(*ev.EVENT_COLUMNS)


def _rejected(checked: DataFrame) -> DataFrame:
    return checked.where("reason IS NOT NULL").select("log_id", "event", "reason")


def _micros(spark: SparkSession, interval: str) -> int:
    epoch = F.timestamp_micros(F.lit(0))
    later = epoch + F.expr(f"INTERVAL '{interval}'")
    return spark.range(1).select(F.unix_micros(later).alias("n")).first().n


def _batches(spark: SparkSession, out: str, kind: str, before: int | None) -> list[int]:
    """Numbers of finished folders, those before a batch if one is given."""
    numbers = sorted(int(n) for n in children(spark, f"{out}/{kind}") if n.isdigit())
    return [n for n in numbers if before is None or n < before]


def _mark(spark: SparkSession, out: str, batch_id: int) -> int | None:
    numbers = _batches(spark, out, "mark", batch_id)
    text = read_small(spark, f"{out}/mark/{numbers[-1]}") if numbers else ""
    return int(text) if text else None


def _held(spark: SparkSession, out: str, batch_id: int | None) -> DataFrame | None:
    """Events that wait after the batch before; a batch counts once its mark is written."""
    numbers = _batches(spark, out, "mark", batch_id)
    if not numbers:
        return None
    return spark.read.schema(ev.EVENT_SCHEMA).parquet(f"{out}/held/{numbers[-1]}")


def _each_batch(rows: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None],
                trigger: dict | None) -> StreamingQuery:
    return (
        rows.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(handle)
        .start()
    )


def stream_window_load(entries: DataFrame, dataset_version: str | None = None,
                       width: str = ev.COALESCE_WINDOW, threshold: int = ev.COALESCE_THRESHOLD,
                       delay: str = "10 seconds") -> DataFrame:
    """Streaming load per event-time window, to watch for bursts.

    A window is final once events `delay` newer have arrived; append output
    gives it then, update output gives its counts as they grow. Later events are
    dropped; `stream_window_counts` keeps them apart instead.
    """
    valid = ev.valid_events(entries, dataset_version).withWatermark("at", delay)
    return ev.window_load(valid, width, threshold)


def append_batches(rows: DataFrame, out: str, checkpoint: str, mode: str = "append",
                   trigger: dict | None = None) -> StreamingQuery:
    """Write what each micro-batch gives to `out/<n>`; a repeat overwrites."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{batch_id}")

    return (
        rows.writeStream.option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(handle)
        .start()
    )
