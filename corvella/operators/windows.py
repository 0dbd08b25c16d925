"""Ranked curves, fits and citation-window journal indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvella.operators.indices import h_index, ranked
from corvella.plans.ordered import running_totals


def cumulative_by(rows: DataFrame, by: str) -> DataFrame:
    """Count and running count by ``by``."""
    upto = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, 0)  # one row per year
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).withColumn("cumulative", F.sum("n").over(upto))


def bradford(rows: DataFrame, source: str) -> DataFrame:
    """Sources by size with cumulative papers and zone (W12): borders at a third and two thirds."""
    n = rows.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    c = running_totals(n, [F.desc("n"), source], {"rank": F.lit(1), "cumulative": F.col("n")}).withColumn("rank", F.col("rank").cast("int"))
    share = F.col("cumulative") / F.col("total")
    zoned = c.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))  # one row
    return zoned.withColumn("zone", F.when(share <= 1 / 3, 1).when(share <= 2 / 3, 2).otherwise(3)).drop("total")


def lotka(authorship: DataFrame, author: str) -> DataFrame:
    """Slope of log10 authors on log10 papers per author."""
    n = authorship.groupBy(author).agg(F.count(F.lit(1)).alias("papers")).groupBy("papers").agg(F.count(F.lit(1)).alias("authors"))
    return n.agg(F.regr_slope(F.log10("authors"), F.log10("papers")).alias("slope"), F.count(F.lit(1)).alias("points"))


def zipf(terms: DataFrame, term: str) -> DataFrame:
    """Slope of log10 frequency on log10 rank."""
    r = running_totals(terms.groupBy(term).agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), term], {"rank": F.lit(1)})
    return r.agg(F.regr_slope(F.log10("n"), F.log10("rank")).alias("slope"), F.count(F.lit(1)).alias("terms"))


def exponential_growth(rows: DataFrame, by: str) -> DataFrame:
    """Fit of ln(cumulative count) on the year (W15): rate, intercept and doubling time."""
    c = cumulative_by(rows, by).filter("cumulative > 0")
    g = c.agg(F.regr_slope(F.ln("cumulative"), F.col(by)).alias("rate"), F.regr_intercept(F.ln("cumulative"), F.col(by)).alias("intercept"))
    return g.withColumn("doubling", F.when(F.col("rate") > 0, F.ln(F.lit(2.0)) / F.col("rate")))


def kaplan_meier(subjects: DataFrame, keys: list[str]) -> DataFrame:
    """Survival, at-risk counts and log-scale 95 % limits per group and event time (W16). Columns: time, event."""
    t = subjects.groupBy(*keys, "time").agg(F.sum("event").alias("d"), F.count(F.lit(1)).alias("n"))
    later = Window.partitionBy(*keys).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("at_risk", F.sum("n").over(later)).filter("d > 0")
    sofar = Window.partitionBy(*keys).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    gone = F.max(F.when(F.col("d") == F.col("at_risk"), 1).otherwise(0)).over(sofar) == 1
    step = F.when(F.col("d") < F.col("at_risk"), F.ln(1 - F.col("d") / F.col("at_risk"))).otherwise(0.0)
    var = F.when(F.col("d") < F.col("at_risk"), F.col("d") / (F.col("at_risk") * (F.col("at_risk") - F.col("d")))).otherwise(0.0)
    s = t.withColumn("log_s", F.sum(step).over(sofar)).withColumn("var", F.sum(var).over(sofar)).withColumn("gone", gone)
    surv = F.when(F.col("gone"), 0.0).otherwise(F.exp("log_s"))
    return s.select(*keys, "time", "at_risk", F.col("d").alias("events"), surv.alias("survival"), (surv * F.exp(-1.96 * F.sqrt("var"))).alias("lower"), F.least(F.lit(1.0), surv * F.exp(1.96 * F.sqrt("var"))).alias("upper"))


def log_rank(subjects: DataFrame, group: str, first) -> DataFrame:
    """Chi-square (one degree of freedom) of two groups."""
    own = F.col(group) == F.lit(first)
    t = subjects.groupBy("time").agg(F.sum("event").alias("d"), F.count(F.lit(1)).alias("n"), F.sum(F.when(own, F.col("event")).otherwise(0)).alias("d1"), F.count_if(own).alias("n1"))
    t = running_totals(t, [F.desc("time")], {"r": F.col("n"), "r1": F.col("n1")}).filter("d > 0")
    e = F.col("d") * F.col("r1") / F.col("r")
    v = F.when(F.col("r") > 1, F.col("d") * F.col("r1") / F.col("r") * (1 - F.col("r1") / F.col("r")) * (F.col("r") - F.col("d")) / (F.col("r") - 1)).otherwise(0.0)
    g = t.agg(F.sum(F.col("d1") - e).alias("oe"), F.sum(v).alias("v"))
    return g.select("oe", "v", F.when(F.col("v") > 0, F.col("oe") ** 2 / F.col("v")).otherwise(0.0).alias("chi2"))


def percentile_of(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Share of values at or below each, times 100."""
    return rows.withColumn("percentile", F.cume_dist().over(Window.partitionBy(*keys).orderBy(value)) * 100)


def quartiles(journals: DataFrame, keys: list[str], metric: str, name: str) -> DataFrame:
    """Quartile by position (W18): the position itself below four journals, else ceil(4 * position / n)."""
    w = Window.partitionBy(*keys)
    pos, n = F.row_number().over(w.orderBy(F.desc(metric), name)), F.count(F.lit(1)).over(w)
    return journals.withColumn("position", pos).withColumn("quartile", F.when(n < 4, F.least(pos, F.lit(4))).otherwise(F.ceil(4 * pos / n)).cast("int"))


def timeline(papers: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Order by year, unknown last, with the previous year."""
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("year"), tie)
    return papers.withColumn("pos", F.row_number().over(w)).withColumn("previous_year", F.lag("year").over(w))


def trending(papers: DataFrame, top_k: int, days: int) -> DataFrame:
    """Papers of the last ``days`` (whole years, at least the latest) by citations per year of age (K4)."""
    top = papers.agg(F.max("year").alias("top"))
    x = papers.join(F.broadcast(top)).filter(F.col("year") >= F.col("top") - days / 365.0)  # one row
    velocity = F.col("citations_count") / F.greatest(F.col("top") - F.col("year") + 1, F.lit(1))
    return x.select("paper_id", "year", velocity.alias("velocity")).orderBy(F.desc("velocity"), "paper_id").limit(top_k)


def top_per_group(rows: DataFrame, group: str, value: str, tie: str, n: int) -> DataFrame:
    """The ``n`` largest of each group (K7)."""
    w = Window.partitionBy(group).orderBy(F.desc(value), tie)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def _dated_citations(cites: DataFrame, papers: DataFrame) -> DataFrame:
    c = papers.select(F.col("paper_id").alias("src"), F.col("year").alias("citing_year"))
    d = papers.select(F.col("paper_id").alias("dst"), "journal", F.col("year").alias("cited_year"))
    return cites.join(c, "src").join(d, "dst")


def impact_factors(cites: DataFrame, papers: DataFrame, back: int = 2, immediate: bool = False) -> DataFrame:
    """Per journal and year: citations of that year to items of the ``back`` years before (M1), or of the year itself (M2).

    All journals and years at once; every row of ``cites`` counts, so repeated references count repeatedly.
    """
    lo, hi = (0, 0) if immediate else (1, back)
    got = _dated_citations(cites, papers).filter((F.col("citing_year") - F.col("cited_year")).between(lo, hi)).groupBy("journal", F.col("citing_year").alias("year")).agg(F.count(F.lit(1)).alias("citations"))
    items = papers.select("journal", F.explode(F.sequence(F.col("year") + lo, F.col("year") + hi)).alias("year")).groupBy("journal", "year").agg(F.count(F.lit(1)).alias("items"))
    x = items.join(got, ["journal", "year"], "left").na.fill(0, ["citations"])
    return x.withColumn("value", F.col("citations") / F.col("items"))


def cite_scores(cites: DataFrame, papers: DataFrame, window: int = 4) -> DataFrame:
    """Citations from and to the window's years over its items (M3)."""
    pairs = _dated_citations(cites, papers)
    last = F.greatest("citing_year", "cited_year")
    first = F.least("citing_year", "cited_year")
    got = pairs.filter(last - first < window).select("journal", F.explode(F.sequence(last, first + window - 1)).alias("year")).groupBy("journal", "year").agg(F.count(F.lit(1)).alias("citations"))
    items = papers.select("journal", F.explode(F.sequence(F.col("year"), F.col("year") + window - 1)).alias("year")).groupBy("journal", "year").agg(F.count(F.lit(1)).alias("items"))
    return items.join(got, ["journal", "year"], "left").na.fill(0, ["citations"]).withColumn("value", F.col("citations") / F.col("items"))


def snip(cites: DataFrame, papers: DataFrame, year: int, window: int = 3) -> DataFrame:
    """Mean citations of a journal's own window items over the median citations of the papers that cite them (M6)."""
    own = papers.filter(F.col("year").between(year - window, year - 1)).select("paper_id", "journal", "citations_count")
    citing = cites.join(own.select(F.col("paper_id").alias("dst"), "journal"), "dst").join(papers.filter(F.col("year").between(year - window, year)).select(F.col("paper_id").alias("src"), F.col("citations_count").alias("c")), "src").select("journal", "src", "c").distinct()
    med = citing.groupBy("journal").agg(F.percentile("c", 0.5).alias("median"))
    return own.groupBy("journal").agg(F.avg("citations_count").alias("mean")).join(med, "journal", "left").withColumn("snip", F.when(F.col("median") > 0, F.col("mean") / F.col("median")).otherwise(0.0))


def journal_h(papers: DataFrame, year: int) -> DataFrame:
    """h and g over all years, h5 and the integer median of its core over the last five (M7)."""
    p = papers.withColumn("citations", F.col("citations_count"))
    whole = h_index(p, ["journal"], tie=("paper_id",)).select("journal", "h_index", "g_index")
    late = ranked(p.filter(F.col("year").between(year - 4, year)), ["journal"], F.col("citations"), ["paper_id"])
    w = Window.partitionBy("journal")
    core = late.withColumn("h5", F.max(F.when(F.col("value") >= F.col("rank"), F.col("rank")).otherwise(0)).over(w))
    five = core.groupBy("journal").agg(F.max("h5").alias("h5_index"), F.floor(F.percentile(F.when(F.col("rank") <= F.col("h5"), F.col("value")), 0.5)).cast("int").alias("h5_median"))
    return whole.join(five, "journal", "left")
