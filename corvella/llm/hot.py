"""Dealing the rows of hot groups over several tasks, by the groups' counted sizes.

A group is hot if it holds more than ``FEW_ROWS`` rows and more than a ``1 / MOST_HOT`` share of all, so there are
fewer than ``MOST_HOT`` hot groups however large the table is: their list may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEW_ROWS = 1000
MOST_HOT = 10_000


def salts(size: Column) -> Column:
    """How many salts a group of ``size`` rows is dealt over."""
    return F.ceil(size / FEW_ROWS).cast("int")


def salt(salts_of_row: Column, *spread: str) -> Column:
    return F.pmod(F.xxhash64(*spread), salts_of_row).cast("int")


def join_groups(rows: DataFrame, groups: DataFrame, by: list[str], size: str, spread: list[str], total: int) -> DataFrame:
    """``rows`` left joined to ``groups`` (distinct in ``by``, with their row count ``size``); ``total`` counts the rows.

    Rows of hot groups meet one copy of their group per salt. ``by`` columns must not be null.
    """
    least = max(FEW_ROWS, total // MOST_HOT)
    hot = groups.filter(F.col(size) > least).select(*by, salts(F.col(size)).alias("_salts"))
    dealt = rows.join(F.broadcast(hot), by, "left").withColumn("_salt", salt(F.coalesce("_salts", F.lit(1)), *spread)).drop("_salts")  # fewer than MOST_HOT rows
    n = F.when(F.col(size) > least, salts(F.col(size))).otherwise(1)
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1)))
    return dealt.join(copies, [*by, "_salt"], "left").drop("_salt")
