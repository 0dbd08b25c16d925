"""Author and journal indices over ranked citation counts: one shuffle by the key for all of them.

Input rows: key column(s), ``citations`` (nulls count as 0) and, where an index needs them, ``year``
and ``n_authors``. ``current_year`` is always an argument, so results are reproducible. Ties are
broken by the columns in ``tie``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def age(year: Column, current_year: int) -> Column:
    """Years since publication, at least 1; unknown years count as 1."""
    return F.coalesce(F.greatest(F.lit(current_year) - year + 1, F.lit(1)), F.lit(1))


def ranked(papers: DataFrame, keys: list[str], value: Column, tie: list[str]) -> DataFrame:
    """``papers`` with value, rank (1 = most) and the running sum of the value, per key."""
    by = Window.partitionBy(*keys).orderBy(F.desc("value"), *tie)
    sofar = by.rowsBetween(Window.unboundedPreceding, 0)
    return papers.withColumn("value", value).withColumn("rank", F.row_number().over(by)).withColumn("running", F.sum("value").over(sofar))


def _h() -> Column:
    return F.coalesce(F.max(F.when(F.col("value") >= F.col("rank"), F.col("rank"))), F.lit(0))


def h_index(papers: DataFrame, keys: list[str], value: Column | None = None, tie: tuple = ()) -> DataFrame:
    """h, g and i10 per key; g never exceeds the number of papers."""
    v = F.coalesce(F.col("citations"), F.lit(0)) if value is None else value
    r = ranked(papers, keys, v, list(tie))
    return r.groupBy(*keys).agg(
        _h().alias("h_index"), F.coalesce(F.max(F.when(F.col("running") >= F.col("rank").cast("long") * F.col("rank"), F.col("rank"))), F.lit(0)).alias("g_index"),
        F.count_if(F.col("value") >= 10).alias("i10_index"),
    )


def h_core(papers: DataFrame, keys: list[str], tie: tuple = ()) -> DataFrame:
    """The core papers (rank <= h) with their rank and h, for core-based indices."""
    r = ranked(papers, keys, F.coalesce(F.col("citations"), F.lit(0)), list(tie))
    whole = Window.partitionBy(*keys)
    return r.withColumn("h", F.max(F.when(F.col("value") >= F.col("rank"), F.col("rank")).otherwise(0)).over(whole)).filter(F.col("rank") <= F.col("h"))


def e_index(papers: DataFrame, keys: list[str], tie: tuple = ()) -> DataFrame:
    """Root of the core's citations beyond h each; 0 if h is 0."""
    every = papers.select(*keys).distinct()
    core = h_core(papers, keys, tie).groupBy(*keys).agg(F.sqrt(F.sum(F.col("value") - F.col("h")).cast("double")).alias("e"), F.max("h").alias("h_core_size"))
    return every.join(core, keys, "left").select(*keys, F.coalesce("e", F.lit(0.0)).alias("e_index"), F.coalesce("h_core_size", F.lit(0)).alias("h_core_size"))


def contemporary_h(papers: DataFrame, keys: list[str], current_year: int, decay: float = 0.5, tie: tuple = ()) -> DataFrame:
    v = F.coalesce(F.col("citations"), F.lit(0)) / F.pow(age(F.col("year"), current_year), F.lit(decay))
    return ranked(papers, keys, v, list(tie)).groupBy(*keys).agg(_h().alias("contemporary_h"))


def age_weighted_rates(papers: DataFrame, keys: list[str], current_year: int) -> DataFrame:
    """Citations per year of age: mean (as many tools report it) and sum (as the literature defines it)."""
    rate = F.when(F.col("year") > 0, F.coalesce(F.col("citations"), F.lit(0)) / age(F.col("year"), current_year))
    return papers.groupBy(*keys).agg(F.coalesce(F.avg(rate), F.lit(0.0)).alias("awcr_mean"), F.coalesce(F.sum(rate), F.lit(0.0)).alias("awcr_sum"))


def multi_authored_h(papers: DataFrame, keys: list[str], m: float = 1.0, tie: tuple = ()) -> DataFrame:
    v = F.coalesce(F.col("citations"), F.lit(0)) / F.pow(F.greatest(F.coalesce(F.col("n_authors"), F.lit(1)), F.lit(1)), F.lit(m))
    r = ranked(papers, keys, v, list(tie))
    return r.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("running") >= F.col("rank"), F.col("rank"))), F.lit(0)).alias("multi_authored_h"))


def individual_h(papers: DataFrame, keys: list[str], tie: tuple = ()) -> DataFrame:
    """h squared over the core's number of authors; h itself where no author count is known."""
    core = h_core(papers, keys, tie).groupBy(*keys).agg(F.max("h").alias("h"), F.coalesce(F.sum("n_authors"), F.lit(0)).alias("n"))
    out = papers.select(*keys).distinct().join(core, keys, "left")
    h = F.coalesce(F.col("h"), F.lit(0)).cast("double")
    return out.select(*keys, F.when(F.coalesce(F.col("n"), F.lit(0)) > 0, h * h / F.col("n")).otherwise(h).alias("individual_h"))


def ar_index(papers: DataFrame, keys: list[str], current_year: int, decay: float = 1.0, tie: tuple = ()) -> DataFrame:
    """Root of the core's citations over age to the power ``decay``."""
    core = h_core(papers, keys, tie).groupBy(*keys).agg(F.sqrt(F.sum(F.col("value") / F.pow(age(F.col("year"), current_year), F.lit(decay)))).alias("ar"))
    return papers.select(*keys).distinct().join(core, keys, "left").select(*keys, F.coalesce("ar", F.lit(0.0)).alias("ar_index"))


def compute_all(papers: DataFrame, keys: list[str], current_year: int, tie: tuple = ()) -> DataFrame:
    """All plain indices per key from one ranked frame."""
    c = F.coalesce(F.col("citations"), F.lit(0))
    r = ranked(papers, keys, c, list(tie))
    whole = Window.partitionBy(*keys)
    r = r.withColumn("h", F.max(F.when(F.col("value") >= F.col("rank"), F.col("rank")).otherwise(0)).over(whole))
    core = F.col("rank") <= F.col("h")
    first = F.min(F.when(F.col("year") > 0, F.col("year")))
    span = F.greatest(F.lit(current_year) - first + 1, F.lit(1))
    return r.groupBy(*keys).agg(
        F.max("h").alias("h_index"),
        F.coalesce(F.max(F.when(F.col("running") >= F.col("rank").cast("long") * F.col("rank"), F.col("rank"))), F.lit(0)).alias("g_index"),
        F.count_if(F.col("value") >= 10).alias("i10_index"),
        F.sqrt(F.coalesce(F.sum(F.when(core, F.col("value") - F.col("h"))), F.lit(0)).cast("double")).alias("e_index"),
        F.count_if(F.col("value") >= 2 * F.col("h")).alias("q2_index"),
        F.max("value").alias("w_index"),
        F.sqrt(F.sum("value").cast("double")).alias("h_max_index"),
        (F.max("h") / span).alias("normalized_h"),
        F.sum("value").alias("total_citations"), F.count(F.lit(1)).alias("papers"), first.alias("first_year"), F.max("year").alias("last_year"),
    )
