"""Column expressions: coercion of raw values, dates, ids and cell safety."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vulnlake import fields

# Accepted date shapes and the characters that start a formula.
DATE_SHAPE = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?"
    r"\s?(Z|UTC|[+-]\d{2}:?\d{2})?$"
)
UNIX_SECONDS_SHAPE = r"^\d{9,10}$"
COMPACT_DATE_FORMATS = {
    r"^\d{8}$": "yyyyMMdd",
    r"^\d{14}$": "yyyyMMddHHmmss",
    r"^\d{4}/\d{2}/\d{2}$": "yyyy/MM/dd",
    r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$": "yyyy/MM/dd HH:mm:ss",
    r"^\d{1,2} [A-Z][a-z]{2} \d{4}$": "d MMM yyyy",
    r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$": "MMM d, yyyy",
}
NUMBER_SHAPE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
FORMULA_START = r"^[=+\-@\t\r]"
IDENTITY_SEPARATOR = chr(31)


def is_text(value: Column) -> Column:
    """Whether a variant is a string; NULL when it is missing."""
    return F.schema_of_variant(value) == "STRING"


def is_number(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL"))


def is_array(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("ARRAY"))


def is_nested(value: Column) -> Column:
    return F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)")


def is_object(value: Column, member: str = "id") -> Column:
    """Whether a variant is an object; looks one member up instead of typing all."""
    return F.try_variant_get(value, "$", f"struct<`{member}`:variant>").isNotNull()


def plain_text(value: Column) -> Column:
    """Text of a variant; objects and arrays give their JSON."""
    return F.try_variant_get(value, "$", "string")


def as_string(value: Column) -> Column:
    """Scalar variant as text; missing, null, objects and arrays become ''."""
    text = plain_text(value)
    # Only text that looks like JSON needs the value's type.
    suspect = F.startswith(text, F.lit("{")) | F.startswith(text, F.lit("["))
    return F.when(suspect & is_nested(value), F.lit("")).otherwise(F.coalesce(text, F.lit("")))


def as_number(value: Column) -> Column:
    """Finite number or numeric text as double; everything else is 0."""
    text = plain_text(value)
    number = F.when(is_number(value), F.try_variant_get(value, "$", "double")).when(
        is_text(value) & text.rlike(NUMBER_SHAPE), F.trim(text).try_cast("double")
    )
    finite = F.abs(number) < float("inf")
    return F.when(finite & ~F.isnan(number), number).otherwise(F.lit(0.0))


def as_string_array(value: Column) -> Column:
    """Array variant with every element as text; anything else is empty."""
    elements = F.try_variant_get(value, "$", "array<variant>")
    return F.coalesce(
        F.when(is_array(value), F.transform(elements, as_string)),
        F.array().cast("array<string>"),
    )


def nullable_string(value: Column) -> Column:
    """NULL for a missing or null value; blank text stays blank."""
    return F.when(value.isNotNull() & ~F.is_variant_null(value), as_string(value))


def object_keys_or_array(value: Column) -> Column:
    """Keys of an object in binary order, or the elements of an array as text."""
    entries = F.try_variant_get(value, "$", "map<string,variant>")
    return F.when(entries.isNotNull(), F.array_sort(F.map_keys(entries))).otherwise(
        as_string_array(value)
    )


def inherit(own: Column, inherited: Column) -> Column:
    """The record's own value unless missing or null; blank text does not inherit."""
    return F.when(
        own.isNotNull() & ~F.is_variant_null(own), as_string(own)
    ).otherwise(F.coalesce(inherited, F.lit("")))


def finding_id(columns: dict[str, Column] | None = None) -> Column:
    """32 hex digits that name one finding identity."""
    parts = [columns[c] if columns else F.col(c) for c in fields.IDENTITY]
    return F.md5(F.concat_ws(IDENTITY_SEPARATOR, *parts))


def parse_date(text: Column) -> Column:
    """Date text to a timestamp of whole seconds; NULL when absent or unreadable."""
    trimmed = F.trim(text)
    readings = [
        F.when(trimmed.rlike(DATE_SHAPE), trimmed.try_cast("timestamp")),
        F.when(
            trimmed.rlike(UNIX_SECONDS_SHAPE),
            F.timestamp_seconds(trimmed.try_cast("long")),
        ),
    ]
    readings += [
        F.when(trimmed.rlike(shape), F.try_to_timestamp(trimmed, F.lit(pattern)))
        for shape, pattern in COMPACT_DATE_FORMATS.items()
    ]
    return F.date_trunc("second", F.coalesce(*readings))


def iso_ms(moment: Column) -> Column:
    """ISO 8601 UTC text with milliseconds; the session time zone is UTC."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def text_ms(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss.SSS")


def text_seconds(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


def epoch_ms(moment: Column) -> Column:
    return F.unix_millis(moment)


def whole(text: Column, pattern: str) -> Column:
    """Whether a pattern matches all of a text; a final line break is not left out."""
    return text.rlike(f"^(?:{pattern.removeprefix('^').removesuffix('$')})\\z")


def sanitize_text(text: Column, replacements: dict[str, str]) -> Column:
    """Apply case-insensitive pattern replacements in the given order."""
    return reduce(
        lambda value, rule: F.regexp_replace(value, f"(?i){rule[0]}", rule[1]),
        replacements.items(),
        text,
    )


def private_hosts(suffix: str) -> str:
    """Pattern for host names that end in a private top-level name."""
    return rf"\b[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?\.{suffix}\b"


def formula_safe(text: Column) -> Column:
    """Text cell for a spreadsheet: NULL is blank, formula starts are quoted."""
    cell = F.coalesce(text, F.lit(""))
    return F.when(cell.rlike(FORMULA_START), F.concat(F.lit("'"), cell)).otherwise(cell)


def ordered_rank(key: Column, order: tuple[str, ...]) -> Column:
    """Position of a key in a fixed order; unknown keys come last."""
    found = F.array_position(F.array(*[F.lit(k) for k in order]), key)
    return F.when(found > 0, found).otherwise(F.lit(len(order) + 1)).cast("long")
