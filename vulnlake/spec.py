"""Validated query parameters: filters, time range, search, sort, page size."""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from vulnlake import fields

# Bounds of the query contract.
MAX_FILTER_VALUES = 50
MAX_TEXT_LENGTH = 256
MAX_CURSOR_LENGTH = 512
DEFAULT_FIRST = 50
MAX_FIRST = 200
DEFAULT_SUGGESTIONS = 10
MAX_SUGGESTIONS = 50

PRESET_SPANS = {
    "24h": {"hours": 24},
    "7d": {"days": 7},
    "30d": {"days": 30},
    "1y": {"years": 1},
    "5y": {"years": 5},
}

_ISO_OFFSET = re.compile(
    r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)$"
)
_CURSOR_TOKEN = re.compile(r"^[A-Za-z0-9_-]+$")
# Fixed value: the date text of a cursor.
_CURSOR_DATE = re.compile(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,3})?$")
_FINDING_ID = re.compile(fields.FINDING_ID_PATTERN)


def parse_instant(text: str) -> datetime:
    """ISO 8601 text with an offset to a UTC instant of millisecond precision."""
    if not isinstance(text, str) or not _ISO_OFFSET.fullmatch(text):
        raise ValueError(f"not an ISO 8601 instant with offset: {text!r}")
    moment = datetime.fromisoformat(text).astimezone(timezone.utc)
    return moment.replace(microsecond=moment.microsecond // 1000 * 1000)


def utc(moment: datetime) -> datetime:
    """Read a naive datetime as UTC."""
    if moment.tzinfo is None:
        return moment.replace(tzinfo=timezone.utc)
    return moment.astimezone(timezone.utc)


@dataclass(frozen=True)
class TimeRange:
    """Inclusive bounds on publishedAt; None leaves a side open."""

    start: datetime | None = None
    end: datetime | None = None


def _years_back(moment: datetime, years: int) -> datetime:
    # 29 February rolls over to 1 March in a common year.
    try:
        return moment.replace(year=moment.year - years)
    except ValueError:
        return moment.replace(year=moment.year - years, month=3, day=1)


def resolve_time_range(
    preset: str,
    now: datetime,
    start: str | None = None,
    end: str | None = None,
) -> TimeRange:
    """Turn a preset or custom bounds into absolute UTC bounds."""
    if preset == "custom":
        if start is None or end is None:
            raise ValueError("a custom range needs both bounds")
        bounds = TimeRange(parse_instant(start), parse_instant(end))
        if bounds.start > bounds.end:
            raise ValueError("range start is after its end")
        return bounds
    if start is not None or end is not None:
        raise ValueError("bounds are only allowed with the custom preset")
    if preset == "live":
        return TimeRange()
    if preset not in PRESET_SPANS:
        raise ValueError(f"unknown time range preset: {preset!r}")
    now = utc(now)
    span = dict(PRESET_SPANS[preset])
    begin = _years_back(now, span.pop("years", 0)) - timedelta(**span)
    return TimeRange(begin, now)


def _bounded_text(value, label: str) -> str:
    if not isinstance(value, str) or len(value) > MAX_TEXT_LENGTH:
        raise ValueError(f"{label} must be text of at most {MAX_TEXT_LENGTH} characters")
    return value


def _positive_int(value, label: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ValueError(f"{label} must be an integer of at least 1")
    return value


@dataclass(frozen=True)
class Sort:
    field: str = "cvss"
    direction: str = "desc"

    def __post_init__(self):
        if self.field not in fields.SORTABLE:
            raise ValueError(f"cannot sort by {self.field!r}")
        if self.direction not in ("asc", "desc"):
            raise ValueError(f"unknown sort direction {self.direction!r}")


@dataclass(frozen=True)
class Cursor:
    """Position after one row: its sort value (None in the NULL tail) and id."""

    value: str | float | None
    id: str


def decode_cursor(token: str, sort: Sort) -> Cursor:
    """Validate an opaque page token against the sort it will be used with."""
    try:
        return _decode_cursor(token, sort)
    except (ValueError, TypeError, binascii.Error, UnicodeDecodeError) as error:
        raise ValueError("the page token cannot be read") from error


def _decode_cursor(token: str, sort: Sort) -> Cursor:
    if not 1 <= len(token) <= MAX_CURSOR_LENGTH or not _CURSOR_TOKEN.fullmatch(token):
        raise ValueError("malformed token")
    padded = token + "=" * (-len(token) % 4)
    payload = json.loads(base64.urlsafe_b64decode(padded).decode("utf-8"))
    if not isinstance(payload, dict) or set(payload) != {"s", "id"}:
        raise ValueError("unexpected keys")
    value, row_id = payload["s"], payload["id"]
    if not isinstance(row_id, str) or not _FINDING_ID.fullmatch(row_id):
        raise ValueError("malformed id")
    if value is None:
        if sort.field not in fields.NULLABLE_SORTS:
            raise ValueError("NULL does not match the sort field")
    elif sort.field in fields.NUMBERS:
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise ValueError("sort value must be a number")
        value = float(value)
        if not math.isfinite(value):
            raise ValueError("sort value must be finite")
    else:
        _bounded_text(value, "sort value")
        if sort.field in fields.DATES and not _CURSOR_DATE.fullmatch(value):
            raise ValueError("malformed date")
    return Cursor(value, row_id)


@dataclass(frozen=True)
class QuerySpec:
    """One validated query scope; a `first` above `MAX_FIRST` asks for that many rows."""

    filters: dict[str, tuple[str, ...]] = field(default_factory=dict)
    time_range: TimeRange = TimeRange()
    mode: str = "all"
    search: str | None = None
    sort: Sort = Sort()
    after: str | None = None
    first: int = DEFAULT_FIRST

    def __post_init__(self):
        checked = {}
        for name, values in self.filters.items():
            if name not in fields.FILTERABLE:
                raise ValueError(f"cannot filter by {name!r}")
            if isinstance(values, str) or len(values) > MAX_FILTER_VALUES:
                raise ValueError(f"{name}: a list of at most {MAX_FILTER_VALUES} values")
            if values:
                checked[name] = tuple(_bounded_text(v, name) for v in values)
        object.__setattr__(self, "filters", checked)
        if self.mode not in fields.ANALYSIS_EXCLUSIONS:
            raise ValueError(f"unknown analysis mode {self.mode!r}")
        if self.search is not None:
            object.__setattr__(self, "search", _bounded_text(self.search, "search") or None)
        object.__setattr__(self, "first", min(_positive_int(self.first, "first"), MAX_FIRST))

    @property
    def cursor(self) -> Cursor | None:
        return None if self.after is None else decode_cursor(self.after, self.sort)


def suggestion_arguments(prefix: str, limit: int | None = None) -> tuple[str, int]:
    """Check a suggestion request and clamp its size."""
    if not _bounded_text(prefix, "prefix"):
        raise ValueError("prefix must not be empty")
    size = DEFAULT_SUGGESTIONS if limit is None else _positive_int(limit, "limit")
    return prefix, min(size, MAX_SUGGESTIONS)


def finding_id(value: str) -> str:
    """Check the shape of a finding id."""
    if not isinstance(value, str) or not _FINDING_ID.fullmatch(value):
        raise ValueError(f"not a finding id: {value!r}")
    return value
