"""Records of changing shape: JSON text as VARIANT values, read once, without a schema to be inferred.

A value keeps whatever fields a record has, of whatever types; the paths that a reader needs are taken out as text or
lists, and what is no JSON goes to a quarantine with its line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parsed(rows: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose text is JSON, with value, the VARIANT; the others). Blank and null texts are neither. Text behind
    a whole JSON value is not looked at."""
    kept = rows.filter(F.trim(F.col(text)) != "")
    value = F.try_parse_json(F.col(text))
    return kept.filter(value.isNotNull()).withColumn("value", value), kept.filter(value.isNull())


def text_at(value: Column, *paths: str) -> Column:
    """What stands at the first of the paths that holds anything, as text: numbers and true as JSON writes them,
    objects and lists as JSON text; null where nothing or null stands."""
    return F.coalesce(*[F.try_variant_get(value, path, "string") for path in paths])


def list_at(value: Column, path: str) -> Column:
    """The list at a path as an array of VARIANT values; null where no list stands."""
    return F.try_variant_get(value, path, "array<variant>")


def read_json_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records(value), broken(text)) of a file or folder with a JSON value a line. Only whole lines are read, so
    large files are split; a record may have any fields of any types."""
    good, bad = parsed(spark.read.text(path).select(F.regexp_replace("value", "^\\ufeff", "").alias("text")), "text")
    return good.select("value"), bad


def read_json_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records(value), broken(text)) of files that hold one JSON value each."""
    good, bad = parsed(spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\\ufeff", "").alias("text")), "text")
    return good.select("value"), bad
