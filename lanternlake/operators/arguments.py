"""Arguments and results as VARIANT: a table of rules says what each field must be, one pass gives all that is wrong with a record.

A rule is (subject, field, type, required, low, high, allowed): the tool or record kind that it is of, a top-level field, its type (uuid, string, identifier,
integer, number, boolean, array, object), whether it must be there, bounds of its value, of a string's length or of an array's size, and the only
values that a string may have. What is wrong is an error `field:code`; the codes are below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternlake.functions.text import safe_identifier

RULE = "subject string, field string, type string, required boolean, low double, high double, allowed array<string>"

#: Of a record as a whole: it is no JSON, or no object.
NOT_JSON, NOT_OBJECT = "not-json", "not-object"
#: Of a field: it is missing or null, of another type, blank, no UUID, no safe name, below or above its bounds, none of the allowed values.
MISSING, TYPE, BLANK, NOT_UUID, UNSAFE, BELOW, ABOVE, NOT_ALLOWED = "missing", "type", "blank", "not-uuid", "unsafe", "below", "above", "not-allowed"

_UUID = r"^\{?[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\}?$|^[0-9a-fA-F]{32}$"


def rules(spark: SparkSession, *rows: tuple) -> DataFrame:
    """A table of rules (subject, field, type, required, low, high, allowed); what is left off at the end is null."""
    return spark.createDataFrame([(*r, *[None] * (7 - len(r))) for r in rows], RULE)


def _kind(schema: Column) -> Column:
    """string, integer, number, boolean, array, object or null, from the schema of a variant."""
    return (
        F.when(schema == "STRING", "string").when(schema == "BIGINT", "integer").when(schema.rlike(r"^(DECIMAL|DOUBLE|FLOAT)"), "number").when(schema == "BOOLEAN", "boolean")
        .when(schema.startswith("ARRAY"), "array").when(schema.startswith("OBJECT"), "object").otherwise("null")
    )


def _error(rule: Column, field: Column) -> Column:
    """The code of what is wrong with a field (kind, text, size) by a rule, null if nothing is."""
    kind, text = field["kind"], F.trim(field["text"])
    absent = field.isNull() | (kind == "null")
    named = rule["type"].isin("uuid", "string", "identifier")
    fits = F.when(named, kind == "string").when(rule["type"] == "number", kind.isin("integer", "number")).otherwise(kind == rule["type"])
    # What the bounds are of: a trimmed string's length, a number, an array's size.
    measure = F.when(named, F.char_length(text).cast("double")).when(rule["type"].isin("integer", "number"), field["text"].try_cast("double")).when(rule["type"] == "array", field["size"].cast("double"))
    return (
        F.when(absent, F.when(rule["required"], F.lit(MISSING)))
        .when(~fits, F.lit(TYPE))
        .when((rule["type"] == "uuid") & ~text.rlike(_UUID), F.lit(NOT_UUID))
        .when(named & (text == ""), F.lit(BLANK))
        .when((rule["type"] == "identifier") & ~safe_identifier(text), F.lit(UNSAFE))
        .when(measure < rule["low"], F.lit(BELOW))
        .when(measure > rule["high"], F.lit(ABOVE))
        .when(named & rule["allowed"].isNotNull() & ~F.array_contains(rule["allowed"], text), F.lit(NOT_ALLOWED))
    )


def checked(records: DataFrame, known: DataFrame, subject_col: str = "subject", json_col: str = "json") -> DataFrame:
    """records with errors, an array of `field:code` in order of fields, empty if nothing is wrong; null for a subject without rules.

    records: (subject, json). Each JSON text is read once, as a variant; its top-level fields are looked at where they stand, those without a rule
    too, which are not judged. The rules of a subject are one row, so records are joined with few and short rows. Rules that name a field twice both hold.
    Repeated and null records stay rows of their own.
    """
    sets = known.groupBy(F.col("subject").alias("rule_subject")).agg(F.sort_array(F.collect_list(F.struct("field", "type", "required", "low", "high", "allowed"))).alias("rule_set"))
    whole = F.try_parse_json(F.col(json_col))
    fields = F.col("variant_").cast("map<string,variant>")
    opened = records.join(sets, F.col(subject_col) == F.col("rule_subject"), "left").withColumn("variant_", whole).withColumn("kind_", _kind(F.schema_of_variant("variant_")))
    opened = opened.withColumn("fields_", F.when(F.col("kind_") == "object", fields))
    described = F.transform_values("fields_", lambda k, v: F.struct(_kind(F.schema_of_variant(v)).alias("kind"), F.try_variant_get(v, "$", "string").alias("text"), F.size(F.try_variant_get(v, "$", "array<variant>")).alias("size")))
    opened = opened.withColumn("fields_", described)
    judged = F.transform("rule_set", lambda r: F.concat(r["field"], F.lit(":"), _error(r, F.element_at("fields_", r["field"]))))
    errors = F.when(F.col("rule_subject").isNull(), F.lit(None).cast("array<string>")).when(F.col("variant_").isNull(), F.array(F.lit(NOT_JSON))).when(F.col("kind_") != "object", F.array(F.lit(NOT_OBJECT))).otherwise(F.filter(judged, lambda e: e.isNotNull()))
    return opened.withColumn("errors", errors).drop("rule_subject", "rule_set", "variant_", "kind_", "fields_")


def integer_argument(json: Column, field: str, default: int) -> Column:
    """An optional integer of a record: its value, or the default where it is missing, null or no integer."""
    value = F.try_variant_get(F.try_parse_json(json), f"$.{field}", "variant")
    whole = F.when(F.schema_of_variant(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))
    return F.coalesce(whole, F.lit(default).cast("bigint"))


def raw_data(json: Column) -> Column:
    """(data variant, valid boolean) of an event's raw text: null text has no data and is valid, text that is no JSON has none and is not. What stands after a whole value is passed over, as Spark's parser does."""
    data = F.try_parse_json(json)
    return F.struct(data.alias("data"), (json.isNull() | data.isNotNull()).alias("valid"))
