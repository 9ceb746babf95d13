"""Conversation structure repair by integer shortest paths.

A repaired conversation has role initials `(s?(ua)+)?`: nothing, or an optional system turn
and then user and assistant in turn. Rows are kept, given another role, deleted, or preceded
by inserted empty turns. A node of the graph is a row of the conversation with the initial
that stands last; an edge is one edit. The weight of a path is one integer: its high digits
are the cost of the edits, its low digits spell the audit from the left, one digit of fixed
width per edit (D < I < K < R), with zeros after the last one. So the smallest integer is the
cheapest repair and, among those, the one whose audit is least in ASCII order; taking minima
of integers from the last row to the first decides everything, and the audit is read off the
digits of the result. The initial that an edit gives follows from the audit, so do the rows.

Audits of a very long conversation would make long integers: it is solved `SEGMENT` rows at
a time. Costs alone, without audits, are found from the end first; a segment then starts
from the initial that the one before it ended with and adds the cost of all rows after it.
No two audits of a segment are prefixes of each other, as both end with its last row, so
what follows it cannot change its choice. Work is in proportion to the number of rows.

Rows are dealt by conversation and sorted inside Spark; a task streams through them. It
holds the flags of one conversation, some 200 bytes a row, and its texts up to `HELD` signs;
the texts of longer ones are read a second time in order, beside their audit.

Faults: a row's first one of blank (no sign but white space), duplicate (role and text of an
earlier row), truncated (last sign not `.`, `!` or `?`). Blank and duplicate rows must go;
a truncated row that stays costs one more.

Defined cases: rows of one turn are ordered by role and text, null turns come first; null
roles and texts are one space; a conversation without rows has an empty audit; rows without
a conversation id are one conversation of their own; a role that is empty or starts with
another letter cannot be kept; repeated rows are duplicates; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.llm.common import map_batches, table
from vulnlake.session import write_out

#: Costs of edits and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Digits of edits in ASCII order of their initials; 0 stands after the last one.
LETTERS = " DIKR"
DIGIT = {letter: k for k, letter in enumerate(LETTERS)}
#: Which initial may follow which; "" is the start. "" and "a" may be last.
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}
#: Rows whose audit is one integer.
SEGMENT = 512
BITS = 3
#: Signs of text that a task holds of one conversation.
HELD = 1 << 25

Row = tuple[str, bool, bool]  # the role's initial, whether it must go, whether it is truncated


def steps(row: Row, last: str) -> Iterator[tuple[str, int, str]]:
    """Edits of a row behind an initial: letter, cost, the initial that is last then."""
    initial, must_go, truncated = row
    yield "D", DELETE, last
    if must_go:
        return
    for following in NEXT[last]:
        if initial == following:
            yield "K", truncated * TRUNCATED, following
        if following in ROLES:
            yield "R", REROLE + truncated * TRUNCATED, following


def inserts(last: str) -> Iterator[tuple[int, str]]:
    for following in NEXT[last]:
        if following in ROLES:
            yield INSERT, following


def inserted(best: dict[str, int], weigh: Callable[[int, int, str], int]) -> dict[str, int]:
    """Weights of what follows when turns may be inserted first.

    More than two in a row would make a pair that can be left out.
    """
    for _ in range(2):
        more = {last: [weigh(best[q], cost, "I") for cost, q in inserts(last) if q in best] for last in NEXT}
        best = {last: min([*more[last], *([best[last]] if last in best else [])]) for last in NEXT if more[last] or last in best}
    return best


def costs_after(rows: list[Row]) -> list[dict[str, int]]:
    """For each row and the end, the least cost of it and all after it, by the initial before."""

    def weigh(rest: int, cost: int, letter: str) -> int:
        return rest + cost

    best = inserted({"": 0, "a": 0}, weigh)
    table = [best]
    for row in reversed(rows):
        best = {last: min(best[q] + cost for _, cost, q in steps(row, last) if q in best) for last in NEXT}
        best = inserted(best, weigh)
        table.append(best)
    return table[::-1]


def audit_of(rows: list[Row], last: str, after: dict[str, int], ends: bool) -> str:
    """The least audit of some rows behind an initial; `after` has the cost of what follows them.

    Only at the conversation's end may turns be inserted behind the last row.
    """
    letters = 3 * len(rows) + 2
    low = BITS * letters
    mask, top = (1 << low) - 1, low - BITS

    def weigh(rest: int, cost: int, letter: str) -> int:
        """The edit's cost is added above, its digit is set before the digits of the rest."""
        return (((rest >> low) + cost) << low) | (DIGIT[letter] << top) | ((rest & mask) >> BITS)

    best = {q: cost << low for q, cost in after.items()}
    if ends:
        best = inserted(best, weigh)
    for row in reversed(rows):
        best = {q: min(weigh(best[n], cost, letter) for letter, cost, n in steps(row, q) if n in best) for q in NEXT}
        best = inserted(best, weigh)
    digits = best[last] & mask
    spelled = (LETTERS[(digits >> (top - BITS * k)) & 7] for k in range(letters))
    return "".join(spelled).rstrip()


def replay(audit: str, rows: list[Row], last: str) -> list[tuple[str, int | None, str]]:
    """Edits as (letter, number of the row or none, initial that is last then)."""
    made, at = [], 0
    for letter in audit:
        row = None if letter == "I" else at
        at += letter != "I"
        if letter == "K":
            last = rows[row][0]
        elif letter != "D":
            last = next(q for q in NEXT[last] if q in ROLES)
        made.append((letter, row, last))
    return made


def repair(rows: list[Row], segment: int = SEGMENT) -> tuple[int, list[tuple[str, int | None, str]]]:
    """The least cost and the edits that make it, in order."""
    costs = costs_after(rows)
    made: list[tuple[str, int | None, str]] = []
    last = ""
    for a in range(0, max(len(rows), 1), segment):
        part = rows[a : a + segment]
        b = a + len(part)
        ends = b == len(rows)
        after = {"": 0, "a": 0} if ends else costs[b]
        edits = replay(audit_of(part, last, after, ends), part, last)
        made += [(letter, None if k is None else a + k, q) for letter, k, q in edits]
        last = made[-1][2] if made else last
    return costs[0][""], made


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) with faults set by a hash of conversation and turn.

    One in twenty rows each is dropped (it stays as a mark, `gone`), emptied, stripped of its
    final stops, repeated, or given to the user.
    """
    space = F.lit(" ")
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
        F.pmod(
            F.crc32(
                F.concat_ws(
                    ":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)
                )
            ),
            F.lit(20),
        ).alias("fault"),
    )
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (F.col("fault") == 0).alias("gone"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


#: ASCII white space.
BLANK = " \t\n\v\f\r"


class Conversation:
    """Rows of one conversation in order, read one after another."""

    def __init__(self, conv_id: int | None, held: int):
        self.conv_id = conv_id
        self.lines: list[tuple[str, str]] | None = []
        self.room = held
        self.turns, self.rows = [], []
        self.seen: set[bytes] = set()
        self.blank = self.duplicate = self.truncated = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        signs = text.rstrip(BLANK)
        size = len(role.encode("utf-8", "surrogatepass"))
        mark = hashlib.sha256(f"{size}:{role}{text}".encode("utf-8", "surrogatepass")).digest()
        blank = not signs
        duplicate = not blank and mark in self.seen
        truncated = not blank and not duplicate and signs[-1] not in ".!?"
        self.seen.add(mark)
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        self.turns.append(turn)
        self.rows.append((role[:1], blank or duplicate, truncated))
        self.room -= len(role) + len(text)
        if self.room < 0:
            self.lines = None
        elif self.lines is not None:
            self.lines.append((role, text))

    def result(self) -> tuple:
        turns = [t for t in self.turns if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = zip(self.rows, self.rows[1:])
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in pairs)
        cost, edits = repair(self.rows)
        audit = "".join(letter for letter, _, _ in edits)
        digest = None
        if self.lines is not None:
            repaired = Repaired(audit)
            for role, text in self.lines:
                repaired.add(role, text)
            digest = repaired.digest()
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, illegal, cost, audit, digest


class Repaired:
    """The hash of a repaired conversation, from its audit and its rows in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last, self.empty = audit, 0, "", True
        self.hash = hashlib.sha256()

    def _line(self, role: str, text: str) -> None:
        line = f"{role}:{text}" if self.empty else f"\n{role}:{text}"
        self.hash.update(line.encode("utf-8", "surrogatepass"))
        self.empty = False

    def _turn(self, text: str) -> None:
        self.last = next(q for q in NEXT[self.last] if q in ROLES)
        self._line(ROLES[self.last], text)

    def _inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._turn("")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self._inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.last = role[0]
            self._line(role, text)
        elif letter == "R":
            self._turn(text)

    def digest(self) -> str:
        self._inserted()
        return self.hash.hexdigest()


RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)


def in_order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def repair_conversations(rows: DataFrame, held: int = HELD) -> DataFrame:
    """One row per conversation: its faults, the cheapest repair and a hash of the outcome.

    `rows` has conv_id, turn, role, text and `gone`, true for rows that only mark that the
    conversation exists.
    """
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", "gone")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", *in_order())
    names = [part.split()[0] for part in RESULT.split(", ")]
    schema = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names])

    def batch_of(results: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*results), schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        for batch in batches:
            done = []
            for conv_id, turn, role, text, gone in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        done.append(now.result())
                    now = Conversation(conv_id, held)
                if not gone:
                    now.add(turn, role, text)
            if done:
                yield batch_of(done)
        if now is not None:
            yield batch_of([now.result()])

    results = write_out(map_batches(dealt, run, RESULT), "repairs")
    long = results.where("repaired_sha256 IS NULL")
    if long.isEmpty():
        return results
    hashes = hash_long(rows, long).select(F.col("conv_id").alias("c"), F.col("hash"))
    joined = results.join(hashes, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return joined.withColumn("repaired_sha256", F.coalesce("repaired_sha256", "hash")).drop("c", "hash")


def hash_long(rows: DataFrame, long: DataFrame) -> DataFrame:
    """(conv_id, hash) of repaired conversations whose texts no task holds: they stream by."""
    audits = long.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.col("audit").alias("role"), F.lit("").alias("text"))
    ids = long.select(F.col("conv_id").alias("c"))
    asked = rows.where("NOT gone").join(ids, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    both = audits.unionByName(asked.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text"))
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *in_order())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv = None, None
        for batch in batches:
            done = []
            for conv_id, kind, _, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    if now is not None:
                        done.append((conv, now.digest()))
                    now, conv = Repaired(role), conv_id
                else:
                    now.add(role, text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done])], ["conv_id", "hash"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([now.digest()])], ["conv_id", "hash"])

    return map_batches(dealt, run, "conv_id long, hash string")


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))
