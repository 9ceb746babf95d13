"""Change events and reports derived from the order-processing star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake import fields
from vulnlake.functions.values import iso_ms
from vulnlake.operators.events import blank_event, encode
from vulnlake.sources.star_schema import DATASET_VERSION, table


def event_time() -> Column:
    """Event time in whole milliseconds."""
    return F.date_trunc("millisecond", F.col("ts").cast("timestamp"))


def dataset_events(events: DataFrame) -> DataFrame:
    """Rows of the `events` table as dataset change events."""
    kind, value = F.col("event_type"), F.col("value")
    user = F.col("user_id").cast("string")
    first, second = F.md5(user), F.md5((F.col("user_id") + 1).cast("string"))
    type_ = (
        F.when(kind == "click", "finding-upserted")
        .when(kind == "view", "findings-changed")
        .when(kind == "error", "finding-deleted")
        .when(kind == "purchase", "aggregates-invalidated")
        .when(value > 100, "resync-required")
        .when(value > 50, "export-ready")
        .otherwise("dataset-version-changed")
    )
    payload = {
        "id": first,
        "cve": F.concat(F.lit("CVE-2024-"), F.lpad(user, 5, "0")),
        "severity": F.when(value > 50, "high").otherwise("low"),
        "cvss": F.round(value / 100, 1),
        "status": F.lit("open"),
        "packageName": F.concat(F.lit("pkg-"), user),
        "packageVersion": F.lit("1.0"),
        "group": F.lit("events"),
        "repo": F.lit("stream"),
        "image": F.lit("registry.example/stream:1"),
        "kaiStatus": F.when(value > 20, "reviewed"),
        "publishedAt": iso_ms(event_time()),
    }
    finding = F.struct(*[payload[f].alias(f) for f in fields.EXPLORE])
    return events.select(
        *blank_event(
            ms=F.unix_millis(event_time()),
            seq=F.col("event_id"),
            type=type_,
            datasetVersion=F.lit(DATASET_VERSION),
            at=event_time(),
            finding=F.when(kind == "click", finding),
            id=F.when(kind == "error", first),
            ids=F.when(kind == "view", F.array(first, second)),
            scopes=F.when(
                kind == "purchase",
                F.when(value < 50, F.array(F.lit("facets"))).otherwise(
                    F.array(F.lit("findings"), F.lit("overview"))
                ),
            ),
            jobId=F.when(
                type_ == "export-ready",
                F.concat(F.lit("job-"), F.col("event_id").cast("string")),
            ),
        )
    )


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_events(table(spark, sf_dir, "events"))


def mixed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries of which some break one rule each, by the size of `value`."""
    source = table(spark, sf_dir, "events")
    entries = encode(dataset_events(source)).select(
        "log_id", "event", F.substring_index("log_id", "-", -1).cast("long").alias("event_id")
    )
    event = F.col("event")
    broken = (
        F.when(F.col("value") > 150, F.replace(event, F.lit('"v":1'), F.lit('"v":2')))
        .when(F.col("value") > 120, F.left(event, F.lit(20)))
        .when(F.col("value") > 90, F.replace(event, F.lit(DATASET_VERSION), F.lit("")))
        .when(F.col("value") > 70, F.regexp_replace(event, '"at":"[^"]*"', '"at":"today"'))
        .when(F.col("value") > 60, F.regexp_replace(event, '"type":"[^"]*"', '"type":"other"'))
        .when(F.col("value") > 55, F.replace(event, F.lit(DATASET_VERSION), F.lit("star-0")))
        .when(F.col("value") > 45, F.regexp_replace(event, '"facets"', '"corpus"'))
        .otherwise(event)
    )
    return entries.join(source.select("event_id", "value"), "event_id").select(
        "log_id", broken.alias("event")
    )


def report_documents(current: DataFrame) -> DataFrame:
    """One nested report document per finding, as (doc, text).

    Documents are never grouped, so each stays small however many findings a
    group has. Records name a wrong group, which the hierarchy must override;
    some arrays hold elements that are not records.
    """
    record = F.to_json(
        F.struct(
            F.lit("wrong-group").alias("group"),
            *[
                F.col(f)
                for f in fields.SOURCE_FIELDS
                if f not in fields.CONTEXT_STRINGS + ("buildType", "riskFactors")
            ],
            F.when(F.col("severity") == "low", F.col("buildType")).alias("buildType"),
            F.map_from_arrays(
                "riskFactors", F.transform("riskFactors", lambda _: F.lit(True))
            ).alias("riskFactors"),
        )
    )
    bare = {
        c: F.btrim(F.to_json(F.array(c)), F.lit("[]")) for c in ("group", "repo", "image", "buildType")
    }
    records = (
        F.when(F.col("severity") == "high", F.concat(record, F.lit(', "not a record", null, [1]')))
        .otherwise(record)
    )
    text = F.concat(
        F.lit('{"meta": {"groups": [1, 2]}, "groups": {'), bare["group"],
        F.lit(': {"repos": {"key of the repo": {"name": '), bare["repo"],
        F.lit(', "images": {'), bare["image"],
        F.lit(': {"buildType": '), bare["buildType"],
        F.lit(', "layers": {"name": "x"}, "vulnerabilities": ['), records,
        F.lit("]}}}}}}}"),
    )
    return current.select(F.col("findingId").alias("doc"), text.alias("text"))


def census_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with empty levels: one per supplier, part and region."""
    nation = table(spark, sf_dir, "nation")
    supplier = table(spark, sf_dir, "supplier").join(
        nation, F.col("s_nationkey") == F.col("n_nationkey")
    )
    line = table(spark, sf_dir, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    records = (
        F.when(F.col("l_discount") == 0, "")
        .when(F.col("l_tax") == 0, '{"cve": 1}, {"cve": {"vulnerabilities": []}}, 7')
        .otherwise('{"cve": null}')
    )
    named = F.when(
        F.col("l_linenumber") > 3,
        F.concat(F.lit('"name": "image '), F.col("l_returnflag"), F.lit('", ')),
    ).otherwise("")
    images = line.select(
        F.concat(
            F.lit('{"groups": {"'), F.col("n_name"), F.lit('": {"repos": {"'), F.col("s_name"),
            F.lit('": {"images": {"'), F.col("l_returnflag"), F.col("l_linestatus"),
            F.lit('": {'), named, F.lit('"vulnerabilities": ['), records, F.lit("]}}}}}}}"),
        ).alias("text")
    )
    bare_repos = supplier.select(
        F.concat(
            F.lit('{"groups": {"'), F.col("n_name"), F.lit('": {"repos": {"idle '),
            F.col("s_name"), F.lit('": {}}}}}'),
        ).alias("text")
    )
    bare_groups = table(spark, sf_dir, "region").select(
        F.concat(F.lit('{"groups": {"'), F.col("r_name"), F.lit('": {"name": "x"}}}')).alias("text")
    )
    return images.unionByName(bare_repos).unionByName(bare_groups)


def rescored(current: DataFrame) -> DataFrame:
    """Upserts: every critical finding with a new score, by id order."""
    changed = {
        "cvss": F.round(10 - F.col("cvss"), 1),
        "status": F.lit("Fixed upstream"),
    }
    return current.where("severity = 'critical'").select(
        *[changed.get(f, F.col(f)).alias(f) for f in fields.SOURCE_FIELDS],
        F.col("findingId").alias("requestOrder"),
    )


def revived(newest: DataFrame) -> DataFrame:
    """Upserts: every finding whose newest version is a tombstone."""
    return newest.where("isDeleted").select(
        *fields.SOURCE_FIELDS, F.col("findingId").alias("requestOrder")
    )


def dismissed(current: DataFrame) -> DataFrame:
    """Deletes: low findings that were judged to be no risk."""
    return current.where("severity = 'low' AND kaiStatus = 'invalid - norisk'").select(
        "findingId", F.col("findingId").alias("requestOrder")
    )
