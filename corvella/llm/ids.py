"""Ids on their way through pandas, as text: pandas would make a column of whole numbers with a null one of floats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_text(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


def text_field(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())


def restored(rows: DataFrame, *fields: T.StructField) -> DataFrame:
    """``rows`` with the columns of ``fields`` in their own types again."""
    return rows.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in fields})
