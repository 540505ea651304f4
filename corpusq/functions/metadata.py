"""Metadata of any shape: JSON text as VARIANT, its values by path, and the schema that many of them have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """JSON text as VARIANT; null where it is null or no JSON."""
    return F.try_parse_json(text)


def value(variant: Column, path: str, kind: str) -> Column:
    """What is at ``path`` (``$.a[0].b``), cast to ``kind``; null where there is nothing or the cast fails."""
    return F.try_variant_get(variant, path, kind)


def kind(variant: Column) -> Column:
    """``object``, ``array``, ``null`` or ``value``; null where there is no JSON."""
    told = F.schema_of_variant(variant)
    return F.when(told.startswith("OBJECT<"), "object").when(told.startswith("ARRAY<"), "array").when(told == "VOID", "null").otherwise(F.when(told.isNotNull(), "value"))


def schema(rows: DataFrame, text: str = "metadata") -> str:
    """The schema of all JSON texts of a column, as DDL; fields of several types are VARIANT."""
    return rows.agg(F.schema_of_variant_agg(parsed(F.col(text)))).first()[0]


def entries(rows: DataFrame, text: str = "metadata") -> DataFrame:
    """``rows`` with ``key`` and ``value`` (VARIANT): one row for each field of each text that is an object."""
    return rows.withColumn("_v", parsed(F.col(text))).lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_v").outer())).filter("key is not null").drop("_v", "pos")
