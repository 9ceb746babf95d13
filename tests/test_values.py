import json

import pytest
from pyspark.sql import functions as F

from vulnlake.functions import values as fv

RECORD = {
    "int": 42, "yes": True, "no": False, "none": None, "object": {"b": 1, "a": 2},
    "array": ["a", 2, None, {"x": 1}], "text": "x", "blank": "", "space": " ",
    "number": "7.5", "float": 7.5, "nan": "NaN", "infinity": "Infinity", "suffix": "7.5d",
    "exponent": "1e2", "huge": "1e999", "padded": " 3 ",
}


@pytest.fixture(scope="module")
def record(spark):
    return spark.createDataFrame([(json.dumps(RECORD),)], "j string").select(
        F.parse_json("j").alias("v")
    )


def pick(record, function, name):
    member = F.try_variant_get("v", f"$.{name}", "variant")
    return record.select(function(member).alias("x")).first().x


@pytest.mark.parametrize(
    "name, expected",
    [("int", "42"), ("no", "false"), ("yes", "true"), ("none", ""), ("missing", ""),
     ("object", ""), ("array", ""), ("text", "x"), ("blank", ""), ("float", "7.5")],
)
def test_as_string(record, name, expected):
    assert pick(record, fv.as_string, name) == expected


@pytest.mark.parametrize(
    "name, expected",
    [("float", 7.5), ("number", 7.5), ("blank", 0), ("space", 0), ("text", 0), ("yes", 0),
     ("none", 0), ("missing", 0), ("nan", 0), ("infinity", 0), ("suffix", 0), ("int", 42),
     ("exponent", 100), ("huge", 0), ("padded", 3), ("object", 0), ("array", 0)],
)
def test_as_number(record, name, expected):
    assert pick(record, fv.as_number, name) == expected


def test_arrays_keys_and_nulls(record):
    assert pick(record, fv.as_string_array, "array") == ["a", "2", "", ""]
    assert pick(record, fv.as_string_array, "text") == []
    assert pick(record, fv.as_string_array, "none") == []
    assert pick(record, fv.as_string_array, "missing") == []
    assert pick(record, fv.object_keys_or_array, "object") == ["a", "b"]
    assert pick(record, fv.object_keys_or_array, "array") == ["a", "2", "", ""]
    assert pick(record, fv.object_keys_or_array, "text") == []
    assert pick(record, fv.nullable_string, "blank") == ""
    assert pick(record, fv.nullable_string, "none") is None
    assert pick(record, fv.nullable_string, "missing") is None


def test_build_type_inheritance(record):
    inherited = {
        name: pick(record, lambda v: fv.inherit(v, F.lit("image")), name)
        for name in ("none", "missing", "blank", "text")
    }
    assert inherited == {"none": "image", "missing": "image", "blank": "", "text": "x"}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-02-03", "2024-02-03 00:00:00"),
        ("2024-02-03T04:05:06Z", "2024-02-03 04:05:06"),
        ("2024-02-03T04:05:06.789Z", "2024-02-03 04:05:06"),
        ("2024-02-03T04:05:06+02:00", "2024-02-03 02:05:06"),
        ("2024-02-03 04:05:06", "2024-02-03 04:05:06"),
        ("2024/02/03 04:05:06", "2024-02-03 04:05:06"),
        ("20240203", "2024-02-03 00:00:00"),
        ("1706929506", "2024-02-03 03:05:06"),
        ("3 Feb 2024", "2024-02-03 00:00:00"),
        ("Feb 3, 2024", "2024-02-03 00:00:00"),
        ("", None), ("tomorrow", None), ("now", None), ("epoch", None), ("12:30", None),
        ("2026", None), ("2024-02-30", None), (None, None),
    ],
)
def test_parse_date(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(fv.text_seconds(fv.parse_date(F.col("t"))).alias("x")).first().x == expected


def test_date_texts(spark):
    df = spark.sql("SELECT timestamp'2024-02-03 04:05:06.007' AS t, CAST(NULL AS timestamp) AS n")
    row = df.select(
        fv.iso_ms(F.col("t")), fv.text_ms(F.col("t")), fv.iso_ms(F.col("n"))
    ).first()
    assert tuple(row) == ("2024-02-03T04:05:06.007Z", "2024-02-03 04:05:06.007", None)


@pytest.mark.parametrize(
    "cell, expected",
    [("=1", "'=1"), ("+1", "'+1"), ("-1", "'-1"), ("@x", "'@x"), ("\tx", "'\tx"),
     ("\rx", "'\rx"), ("a=1", "a=1"), (None, ""), ("", ""), ("\nx", "\nx")],
)
def test_formula_safe(spark, cell, expected):
    df = spark.createDataFrame([(cell,)], "c string")
    assert df.select(fv.formula_safe(F.col("c")).alias("x")).first().x == expected


def test_sanitize_text(spark):
    df = spark.createDataFrame([("pull A.b-1.PRIV/x by AcmeCo; not.private",)], "t string")
    rules = {fv.private_hosts("priv"): "hidden.example", "acmeco": "example"}
    out = df.select(fv.sanitize_text(F.col("t"), rules).alias("x")).first().x
    assert out == "pull hidden.example/x by example; not.private"


def test_finding_id_shape(source_rows):
    ids = source_rows({}, {"path": "x"}).select(fv.finding_id().alias("id")).collect()
    assert ids[0].id != ids[1].id
    assert all(len(r.id) == 32 and r.id == r.id.lower() for r in ids)
