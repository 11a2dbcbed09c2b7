"""Outputs that should be JSON objects: parsed, and where that fails, told apart by why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STRICT = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "columnNameOfCorruptRecord": "_corrupt"}
#: A string that ends; and what opens or closes something outside of strings.
STRING, OPENS, CLOSES = r'"(?:\\.|[^"\\])*"', r"[{\[]", r"[}\]]"


def error_kind(text: Column) -> Column:
    """'' for an object; else empty, truncated (something that was opened isn't closed at the end), malformed or not_object."""
    said = F.trim(F.coalesce(text, F.lit("")))
    # as the value of a field, any value is read; what isn't one leaves the record in the corrupt column
    held = F.from_json(F.concat(F.lit('{"v":'), said, F.lit("}")), "v string, _corrupt string", _STRICT)
    whole = held["_corrupt"].isNull()
    outside = F.regexp_replace(said, STRING, "")
    open_ = F.contains(outside, F.lit('"')) | (F.regexp_count(outside, F.lit(OPENS)) > F.regexp_count(outside, F.lit(CLOSES)))
    return F.when(said == "", "empty").when(whole & said.startswith("{"), "").when(whole, "not_object").when(open_, "truncated").otherwise("malformed")


def parsed(outputs: DataFrame, text: str, schema: str, into: str = "parsed") -> DataFrame:
    """outputs with error_kind and the fields of this schema, null unless the text is an object; unknown fields are left out."""
    kind = error_kind(F.col(text))
    return outputs.withColumn("error_kind", kind).withColumn(into, F.when(F.col("error_kind") == "", F.from_json(text, schema, {"allowSingleQuotes": "false"})))
