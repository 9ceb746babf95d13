"""Coercion of raw values, dates and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.functions import values as fv
from vulnlake.plans.catalog.ingest_queries import flattened
from vulnlake.plans.catalog.registry import on_current, query
from vulnlake.plans.relations import iso
from vulnlake.sources import corpus
from vulnlake.sources.star_schema import table


def _raw_records(spark: SparkSession, d: str) -> DataFrame:
    """One JSON record per event, holding every kind of value."""
    user = F.col("user_id").cast("string")
    own = (
        F.when(F.col("event_type") == "click", '"own":null,')
        .when(F.col("event_type") == "view", "")
        .when(F.col("event_type") == "error", '"own":"",')
        .otherwise(F.concat(F.lit('"own":'), user, F.lit(",")))
    )
    text = F.concat(
        F.lit("{"), own, F.lit('"int":'), user, F.lit(',"text":"'), F.col("event_type"),
        F.lit('","numText":"'), F.col("value").cast("string"),
        F.lit('","blank":" ","flag":'), (F.col("value") > 10).cast("string"),
        F.lit(',"none":null,"object":'), F.col("props"),
        F.lit(',"list":["'), F.col("event_type"), F.lit('",'), user,
        F.lit(',null,{"a":1}]}'),
    )
    return table(spark, d, "events").select(
        "event_id", "event_type", "ts", "value", F.parse_json(text).alias("record")
    )


def _in_record(member: str) -> Column:
    return F.try_variant_get("record", f"$.{member}", "variant")


_MEMBERS = ("int", "text", "flag", "none", "missing", "object", "list")

query(
    "as_string",
    "SELECT event_id, CAST(user_id AS VARCHAR) AS \"int\", event_type AS \"text\", "
    "CASE WHEN value > 10 THEN 'true' ELSE 'false' END AS flag, '' AS \"none\", '' AS missing, "
    "'' AS object, '' AS list FROM events",
)(
    lambda spark, d: _raw_records(spark, d).select(
        "event_id", *[fv.as_string(_in_record(m)).alias(m) for m in _MEMBERS]
    )
)

query(
    "as_number",
    "SELECT event_id, CAST(user_id AS DOUBLE) AS \"int\", value AS \"numText\", 0.0::DOUBLE AS \"text\", "
    "0.0::DOUBLE AS blank, 0.0::DOUBLE AS flag, 0.0::DOUBLE AS \"none\", 0.0::DOUBLE AS missing, "
    "0.0::DOUBLE AS object FROM events",
)(
    lambda spark, d: _raw_records(spark, d).select(
        "event_id",
        *[
            fv.as_number(_in_record(m)).alias(m)
            for m in ("int", "numText", "text", "blank", "flag", "none", "missing", "object")
        ],
    )
)

query(
    "as_string_array",
    "SELECT event_id, event_type || '|' || user_id || '||' AS list, 4 AS n, 0 AS of_text, 0 AS of_missing "
    "FROM events",
)(
    lambda spark, d: _raw_records(spark, d).select(
        "event_id",
        F.array_join(fv.as_string_array(_in_record("list")), "|").alias("list"),
        F.size(fv.as_string_array(_in_record("list"))).alias("n"),
        F.size(fv.as_string_array(_in_record("text"))).alias("of_text"),
        F.size(fv.as_string_array(_in_record("missing"))).alias("of_missing"),
    )
)

query(
    "nullable_string",
    "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN NULL WHEN event_type = 'error' THEN '' "
    "ELSE CAST(user_id AS VARCHAR) END AS own, ' ' AS blank, CAST(NULL AS VARCHAR) AS \"none\" FROM events",
)(
    lambda spark, d: _raw_records(spark, d).select(
        "event_id",
        *[fv.nullable_string(_in_record(m)).alias(m) for m in ("own", "blank", "none")],
    )
)

query(
    "inherit_build_type",
    "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'image-build' "
    "WHEN event_type = 'error' THEN '' ELSE CAST(user_id AS VARCHAR) END AS \"buildType\" FROM events",
)(
    lambda spark, d: _raw_records(spark, d).select(
        "event_id", fv.inherit(_in_record("own"), F.lit("image-build")).alias("buildType")
    )
)

query(
    "risk_factor_keys",
    "SELECT event_id, array_to_string(list_sort(json_keys(props)), '|') AS of_object, "
    "event_type || '|' || user_id || '||' AS of_array, '' AS of_text FROM events",
)(
    lambda spark, d: _raw_records(spark, d).select(
        "event_id",
        *[
            F.array_join(fv.object_keys_or_array(_in_record(m)), "|").alias(f"of_{n}")
            for m, n in (("object", "object"), ("list", "array"), ("text", "text"))
        ],
    )
)

on_current(
    "context_wins",
    'SELECT "group", count(*) AS records, 0::BIGINT AS from_record FROM findings GROUP BY ALL',
)(
    lambda current: corpus.normalize(flattened(current))
    .groupBy("group")
    .agg(
        F.count("*").alias("records"),
        F.count_if(F.col("group") == "wrong-group").alias("from_record"),
    )
)

query(
    "parse_best_effort",
    "SELECT event_id, CASE WHEN event_type = 'signup' THEN NULL "
    "WHEN event_type = 'purchase' THEN strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') "
    "WHEN event_type = 'error' THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') "
    "ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed FROM events",
)(
    lambda spark, d: table(spark, d, "events").select(
        "event_id",
        fv.text_seconds(
            fv.parse_date(
                F.when(F.col("event_type") == "signup", "tomorrow")
                .when(F.col("event_type") == "purchase", F.date_format("ts", "yyyyMMdd"))
                .when(
                    F.col("event_type") == "error",
                    F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'+02:00'"),
                )
                .when(F.col("event_type") == "click", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
                .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
            )
        ).alias("parsed"),
    )
)

query(
    "iso_ms",
    f"SELECT event_id, {iso('ts')} AS at, strftime(CASE WHEN value > 10 THEN ts END, "
    "'%Y-%m-%dT%H:%M:%S.%gZ') AS maybe FROM events",
)(
    lambda spark, d: table(spark, d, "events").select(
        "event_id",
        fv.iso_ms(F.col("ts")).alias("at"),
        fv.iso_ms(F.when(F.col("value") > 10, F.col("ts"))).alias("maybe"),
    )
)

query("text_ms", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS at FROM events")(
    lambda spark, d: table(spark, d, "events").select(
        "event_id", fv.text_ms(F.col("ts")).alias("at")
    )
)

_HOSTS = fv.private_hosts(r"example\.net")
_REPLACEMENTS = {_HOSTS: "hidden.example", "track": "example"}

query(
    "sanitize_text",
    "SELECT page_id, regexp_replace(regexp_replace(url, '{h}', 'hidden.example', 'gi'), 'track', 'example', 'gi') AS url, "
    "md5(regexp_replace(regexp_replace(html, '{h}', 'hidden.example', 'gi'), 'track', 'example', 'gi')) AS html_md5 "
    "FROM pages".format(h=_HOSTS),
)(
    lambda spark, d: corpus.sanitize(
        table(spark, d, "pages").select("page_id", "url", "html"), _REPLACEMENTS
    ).select("page_id", "url", F.md5("html").alias("html_md5"))
)
