import base64
import json
from datetime import datetime, timezone

import pytest

from vulnlake.spec import (
    QuerySpec,
    Sort,
    decode_cursor,
    finding_id,
    resolve_time_range,
    suggestion_arguments,
)

NOW = datetime(2025, 3, 14, 21, 17, 8, 250000, tzinfo=timezone.utc)
ID = "5f" * 16


def token(payload):
    raw = payload if isinstance(payload, bytes) else json.dumps(payload).encode()
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


@pytest.mark.parametrize(
    "preset, start",
    [
        ("24h", "2025-03-13T21:17:08.250"),
        ("7d", "2025-03-07T21:17:08.250"),
        ("30d", "2025-02-12T21:17:08.250"),
        ("1y", "2024-03-14T21:17:08.250"),
        ("5y", "2020-03-14T21:17:08.250"),
    ],
)
def test_presets_end_now(preset, start):
    bounds = resolve_time_range(preset, NOW)
    assert bounds.start.isoformat(timespec="milliseconds") == start + "+00:00"
    assert bounds.end == NOW


def test_live_is_unbounded_and_leap_day_rolls_over():
    assert resolve_time_range("live", NOW).start is None
    leap = datetime(2024, 2, 29, tzinfo=timezone.utc)
    assert resolve_time_range("1y", leap).start == datetime(2023, 3, 1, tzinfo=timezone.utc)
    later = datetime(2028, 2, 29, tzinfo=timezone.utc)
    assert resolve_time_range("5y", later).start == datetime(2023, 3, 1, tzinfo=timezone.utc)


def test_custom_bounds_are_instants():
    bounds = resolve_time_range(
        "custom", NOW, "2025-01-31T22:30:00-03:00", "2025-02-10T06:00:00+05:30"
    )
    assert bounds.start == datetime(2025, 2, 1, 1, 30, tzinfo=timezone.utc)
    assert bounds.end == datetime(2025, 2, 10, 0, 30, tzinfo=timezone.utc)


@pytest.mark.parametrize(
    "preset, start, end",
    [
        ("custom", None, None),
        ("custom", "2025-03-01T00:00:00Z", None),
        ("custom", "2025-03-02T00:00:00Z", "2025-03-01T00:00:00Z"),
        ("24h", "2025-03-01T00:00:00Z", None),
        ("custom", "not-iso", "2025-03-01T00:00:00Z"),
        ("custom", "2025-03-01T00:00:00", "2025-03-02T00:00:00Z"),
        ("century", None, None),
    ],
)
def test_invalid_ranges(preset, start, end):
    with pytest.raises(ValueError):
        resolve_time_range(preset, NOW, start, end)


@pytest.mark.parametrize(
    "arguments",
    [
        {"filters": {"isDeleted": ("x",)}},
        {"filters": {"findingId": ("x",)}},
        {"filters": {"severity": ("x",) * 51}},
        {"filters": {"severity": ("x" * 257,)}},
        {"filters": {"severity": "high"}},
        {"mode": "none"},
        {"search": "x" * 257},
        {"first": 0},
        {"first": 1.5},
        {"first": True},
    ],
)
def test_invalid_specs(arguments):
    with pytest.raises(ValueError):
        QuerySpec(**arguments)


def test_defaults_and_clamping():
    assert QuerySpec().first == 50
    assert QuerySpec(first=10_000).first == 200
    assert QuerySpec(search="").search is None
    assert QuerySpec(filters={"severity": ()}).filters == {}
    assert QuerySpec().sort == Sort("cvss", "desc")
    with pytest.raises(ValueError):
        Sort("image", "asc")
    with pytest.raises(ValueError):
        Sort("cvss", "up")


def test_cursor_round_trip():
    published = Sort("publishedAt", "asc")
    assert decode_cursor(token({"s": 8.7, "id": ID}), Sort()).value == 8.7
    assert decode_cursor(token({"s": None, "id": ID}), published).value is None
    value = decode_cursor(token({"s": "2025-03-01 08:15:00.125", "id": ID}), published).value
    assert value == "2025-03-01 08:15:00.125"


@pytest.mark.parametrize(
    "text, sort",
    [
        ("%%%", Sort()),
        ("_w", Sort()),
        (token(b"{"), Sort()),
        (token({"s": 8.7, "id": ID, "extra": 1}), Sort()),
        (token({"s": 8.7, "id": ID[:-1] + "z"}), Sort()),
        (token({"s": "8.7", "id": ID}), Sort()),
        (token({"s": True, "id": ID}), Sort()),
        (token({"s": None, "id": ID}), Sort("severity", "asc")),
        (token({"s": "tomorrow", "id": ID}), Sort("publishedAt", "asc")),
        (token({"s": 3, "id": ID}), Sort("repo", "asc")),
        ("a" * 513, Sort()),
        ("", Sort()),
    ],
)
def test_malformed_cursors(text, sort):
    with pytest.raises(ValueError, match="page token"):
        decode_cursor(text, sort)


def test_suggestion_arguments_and_ids():
    assert suggestion_arguments("cve") == ("cve", 10)
    assert suggestion_arguments("cve", 99) == ("cve", 50)
    for prefix, limit in [("", 1), ("x" * 257, 1), ("x", 0)]:
        with pytest.raises(ValueError):
            suggestion_arguments(prefix, limit)
    assert finding_id(ID) == ID
    with pytest.raises(ValueError):
        finding_id(ID.upper())
