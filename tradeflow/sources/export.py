"""Rows as the text records that a client receives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import iso_text


def export_projection(df: DataFrame) -> DataFrame:
    """Decimals and times as text; every other column unchanged."""

    def shown(field: T.StructField):
        column = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            return column.cast("string").alias(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            return iso_text(df, field.name).alias(field.name)
        return column

    return df.select(*[shown(field) for field in df.schema.fields])


def export_json(df: DataFrame) -> DataFrame:
    """One JSON object per row, in the column ``record``. Nulls are written out."""
    return export_projection(df).select(
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record")
    )
