"""The version log: collapse to current rows, upserts, deletes and audits."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vulnlake import fields
from vulnlake.functions.values import epoch_ms, finding_id, parse_date, whole
from vulnlake.operators.ordered import cut_ranges, number_rows, placed, running, with_running
from vulnlake.session import write_out
from vulnlake.spec import utc

IDENTITY = list(fields.IDENTITY)

# Bounds of the ingest contract.
BATCH_ROWS = 2_000
MAX_BATCH_ROWS = 10_000
MAX_CHANGES = 500

#: Asked ids from which a lookup marks them first; Spark sends fewer to every task by itself.
MARKED = 10_000
#: Bits for each marked id, and bits for all of them at most: a million words.
BITS_EACH, MARK_BITS = 16, 1 << 26


class ContractViolation(ValueError):
    """Input breaks the ingest or change contract; `ids` holds all findings it names."""

    def __init__(self, text: str, ids: DataFrame | None = None):
        super().__init__(text)
        self.ids = ids


def join_by_identity(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on the identity columns, led by their hash, which sorts much faster.

    Rows of `keyed` at the left keep their hash, and stay where one join put them for the next.
    """
    joined = keyed(left).join(keyed(right), ["_key", *IDENTITY], how)
    return joined if "_key" in left.columns else joined.drop("_key")


def keyed(df: DataFrame) -> DataFrame:
    return df if "_key" in df.columns else df.withColumn("_key", F.xxhash64(*IDENTITY))


def derive(rows: DataFrame) -> DataFrame:
    """Add the id and the parsed dates to normalised source rows."""
    return rows.select(
        "*",
        finding_id().alias("findingId"),
        parse_date(F.col("published")).alias("publishedAt"),
        parse_date(F.col("fixDate")).alias("fixedAt"),
    )


def stamp_initial(rows: DataFrame, base: datetime, order_by: list[str] | None = None,
                  batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Number source rows into batches; each batch has one stamp, 1 ms apart.

    Rows are taken in the given total order, or else in the order they are read.
    """
    if not 1 <= batch_rows <= MAX_BATCH_ROWS:
        raise ContractViolation(f"a batch holds 1..{MAX_BATCH_ROWS} rows")
    if order_by is None:
        numbered = number_rows(rows, "_n")
    else:
        numbered = with_running(rows, order_by, sums={"_n": F.lit(1).cast("long")})
    zero_based = F.col("_n") - 1
    batch = F.floor(zero_based / batch_rows).cast("long")
    stamp = F.timestamp_millis(F.unix_millis(F.lit(utc(base))) + batch)
    return numbered.select(
        *[c for c in numbered.columns if c != "_n"],
        stamp.alias("updatedAt"),
        stamp.alias("firstSeenAt"),
        F.lit(False).alias("isDeleted"),
        (batch + 1).alias("batch"),
        (zero_based - batch * batch_rows).alias("position"),
    )


def newest_version(log: DataFrame, by: Sequence[str] = fields.IDENTITY) -> DataFrame:
    """Newest version per identity, or per other columns, tombstones included.

    A rank filter lets every map task keep one row per identity before the
    shuffle, so an identity with very many versions stays small. Rows are sorted
    by the identity itself: neighbours share most of it, so the shuffle packs well.
    """
    newest_first = W.partitionBy(*by).orderBy(
        F.col("updatedAt").desc(), F.col("batch").desc(), F.col("position").desc()
    )
    return (
        log.withColumn("_rank", F.row_number().over(newest_first))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )


def collapse_current(log: DataFrame) -> DataFrame:
    """Current findings: newest version per identity unless it is a tombstone."""
    return live(newest_version(log))


def live(newest: DataFrame) -> DataFrame:
    """Newest versions that are no tombstones."""
    return newest.where(~F.col("isDeleted"))


def merge_current(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Current findings after more log rows, without collapsing the log again.

    `changes` are log rows newer than `current`. Only rows of changed
    identities are replaced, so the cost over `current` is one anti-join.
    """
    newest = newest_version(changes)
    kept = join_by_identity(current, newest.select(*IDENTITY), "left_anti")
    return kept.unionByName(live(newest).select(*current.columns))


def version_audit(log: DataFrame) -> DataFrame:
    """One row: log rows, identities, superseded versions, tombstoned, current."""
    newest = F.struct("updatedAt", "batch", "position")
    return (
        log.groupBy(F.xxhash64(*IDENTITY), *IDENTITY)
        .agg(F.count("*").alias("versions"), F.max_by("isDeleted", newest).alias("tombstone"))
        .agg(
            F.sum("versions").alias("log_rows"),
            F.count("*").alias("identities"),
            F.sum(F.col("versions") - 1).alias("superseded"),
            F.count_if(F.col("versions") > 1).alias("collapsed_identities"),
            F.count_if(F.col("tombstone")).alias("tombstoned"),
            F.count_if(~F.col("tombstone")).alias("current_findings"),
        )
    )


def collapsed_identities(log: DataFrame) -> DataFrame:
    """Identities that have more than one version, with their newest stamp."""
    return (
        log.groupBy(*IDENTITY)
        .agg(F.count("*").alias("versions"), F.max("updatedAt").alias("updatedAt"))
        .where(F.col("versions") > 1)
    )


def check_batches(rows: DataFrame, dataset_version: str,
                  max_rows: int = MAX_BATCH_ROWS) -> DataFrame:
    """Contract violations of arriving batches: (arrival, sequence, reason).

    `rows` has one row per source row with dataset_version, arrival (place of
    its batch in the stream) and sequence. Zero batches are a violation too.
    """
    batches = rows.groupBy("dataset_version", "arrival", "sequence").agg(
        F.count("*").alias("row_count")
    )
    seen = with_running(batches, ["arrival"], sums={"_order": F.lit(1).cast("long")},
                        maxima={"_highest": F.col("sequence")})
    previous = seen.select(
        (F.col("_order") + 1).alias("_order"), F.col("_highest").alias("_previous")
    )
    checked = seen.join(previous, "_order", "left").select(
        "arrival",
        "sequence",
        F.filter(
            F.array(
                F.when(F.col("dataset_version") != dataset_version, F.lit("version mismatch")),
                F.when(
                    F.col("sequence") <= F.coalesce("_previous", F.lit(0)),
                    F.lit("sequence must increase"),
                ),
                F.when(F.col("row_count") > max_rows, F.lit("too many rows")),
            ),
            lambda reason: reason.isNotNull(),
        ).alias("reasons"),
    )
    violations = checked.select("arrival", "sequence", F.explode("reasons").alias("reason"))
    none_at_all = batches.agg(F.count("*").alias("n")).where("n = 0").select(
        F.lit(None).cast("long").alias("arrival"),
        F.lit(None).cast("long").alias("sequence"),
        F.lit("no batch").alias("reason"),
    )
    return violations.unionByName(none_at_all)


def lookup_previous(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Current versions of the identities in a change set."""
    return join_by_identity(current, changes.select(*IDENTITY), "left_semi")


def lookup_by_ids(current: DataFrame, ids: DataFrame) -> DataFrame:
    return _likely(current, ids).join(ids.select("findingId"), "findingId", "left_semi")


def _likely(current: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `current` that have one of the ids, with few others, chosen where they are read.

    Each id marks the bit that its hash points to. Tasks get the marked words and drop rows
    without a mark, so that rows which no id names do not travel to be compared.
    """
    asked = ids.count()
    if asked < MARKED:
        return current
    place = F.pmod(F.xxhash64("findingId"), F.lit(min(MARK_BITS, BITS_EACH * asked)))
    word, bit = F.shiftright(place, 6), F.pmod(place, F.lit(64)).cast("int")
    marks = (
        ids.where("findingId IS NOT NULL")
        .select(word.alias("_word"), bit.alias("_bit"))
        .groupBy("_word")
        .agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_marks"))
    )
    return current.join(F.broadcast(marks), (word == F.col("_word")) & (F.getbit("_marks", bit) == 1), "left_semi")


def unknown_deletes(current: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids to delete that are not current.

    The ids filter `current` first, so a small request never moves the table.
    """
    known = lookup_by_ids(current.select("findingId"), ids)
    return ids.select("findingId").join(known, "findingId", "left_anti")


def read_back_applied(current_after: DataFrame, changes: DataFrame) -> DataFrame:
    """Stored rows of a change set, with its request order in `requestOrder`."""
    return join_by_identity(current_after, changes.select(*IDENTITY, "requestOrder"), "inner")


def duplicate_identities(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*IDENTITY).agg(F.count("*").alias("n")).where("n > 1")


def _stamped(rows: DataFrame, now: datetime, last_issued_ms: int) -> DataFrame:
    """Give rows strictly increasing stamps in request order.

    next = max(now, previous + 1 ms, last issued + 1 ms). Unrolled, the stamp
    of row n is n + the running maximum of (lower bound - n).
    """
    now_ms = int(utc(now).timestamp() * 1000)
    order = ["requestOrder"]
    numbered = running(cut_ranges(rows, order), order, sums={"_n": F.lit(1).cast("long")})
    floor = F.greatest(
        F.lit(max(now_ms, last_issued_ms + 1)).cast("long"),
        F.coalesce(epoch_ms(F.col("previousUpdatedAt")) + 1, F.lit(0).cast("long")),
    )
    lifted = running(numbered, order, maxima={"_lift": floor - F.col("_n")})
    return lifted.withColumn("updatedAt", F.timestamp_millis(F.col("_lift") + F.col("_n"))).drop(
        "_lift", "_slice"
    )


def apply_upserts(current: DataFrame, upserts: DataFrame, now: datetime,
                  batch: int, last_issued_ms: int = 0) -> DataFrame:
    """Log rows that replace or create the given findings.

    `upserts` holds source columns and `requestOrder`. firstSeenAt is carried
    from the live version; a new or re-created finding gets `now`. Previous versions are
    looked up and stamps are given by place, so that whole rows are shuffled only once.
    Rows of `placed` are not written again.
    """
    if duplicate_identities(upserts).limit(1).count():
        raise ContractViolation("upserts must have unique finding identities")
    asked = upserts if "_id" in upserts.columns else placed(upserts.select(*fields.SOURCE_FIELDS, "requestOrder"))
    previous = lookup_previous(keyed(current), asked).select(
        "_key",
        *IDENTITY,
        F.col("firstSeenAt").alias("previousFirstSeenAt"),
        F.col("updatedAt").alias("previousUpdatedAt"),
    )
    rows = join_by_identity(asked.select(*IDENTITY, "requestOrder", "_id"), previous, "left").drop(*IDENTITY)
    stamped = _stamped(rows, now, last_issued_ms).drop("requestOrder")
    return derive(asked.select(*fields.SOURCE_FIELDS, "_id").join(stamped, "_id")).select(
        *fields.SOURCE_FIELDS,
        *fields.DERIVED_COLUMNS,
        "updatedAt",
        F.coalesce("previousFirstSeenAt", F.lit(utc(now))).alias("firstSeenAt"),
        F.lit(False).alias("isDeleted"),
        F.lit(batch).cast("long").alias("batch"),
        F.col("_n").alias("position"),
    )


def apply_deletes(current: DataFrame, ids: DataFrame, now: datetime,
                  batch: int, last_issued_ms: int = 0) -> DataFrame:
    """Tombstones for current findings; `ids` holds findingId and requestOrder."""
    # `current` may itself be a merge, so its rows for the request are kept.
    live = write_out(
        current.join(ids.select("findingId", "requestOrder"), "findingId").withColumn(
            "previousUpdatedAt", F.col("updatedAt")
        ),
        "deletes-live",
    )
    missing = write_out(
        ids.select("findingId").join(live.select("findingId"), "findingId", "left_anti"), "missing"
    )
    unknown = missing.count()
    if unknown:
        # The text names a whole change set; `ids` holds those of larger, bulk requests too.
        named = [r.findingId for r in missing.orderBy("findingId").limit(MAX_CHANGES).collect()]
        raise ContractViolation(
            f"cannot delete {unknown} unknown finding ids: {', '.join(named)}", missing
        )
    return _stamped(live.drop("updatedAt"), now, last_issued_ms).select(
        *fields.SOURCE_FIELDS,
        *fields.DERIVED_COLUMNS,
        "updatedAt",
        "firstSeenAt",
        F.lit(True).alias("isDeleted"),
        F.lit(batch).cast("long").alias("batch"),
        F.col("_n").alias("position"),
    )


def invalid_ids(ids: DataFrame) -> DataFrame:
    """Delete ids that are malformed or given more than once."""
    shaped = F.coalesce(whole(F.col("findingId"), fields.FINDING_ID_PATTERN), F.lit(False))
    return (
        ids.groupBy("findingId")
        .agg(F.count("*").alias("n"))
        .where((F.col("n") > 1) | ~shaped)
    )


def check_changes(upserts: DataFrame, ids: DataFrame, max_changes: int | None) -> None:
    """Refuse an empty or oversized change set, and malformed or repeated ids."""
    changes = upserts.select(F.lit(1)).union(ids.select(F.lit(1)))
    # A larger set is refused, so it need not be counted to its end.
    size = changes.limit(1 if max_changes is None else max_changes + 1).count()
    if size == 0:
        raise ContractViolation("at least one change is required")
    if max_changes is not None and size > max_changes:
        raise ContractViolation(f"at most {max_changes} changes are accepted")
    if invalid_ids(ids).limit(1).count():
        raise ContractViolation("delete ids must be unique and well formed")
