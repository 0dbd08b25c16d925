"""Corpus, journal, author and review aggregates. Inputs are long frames; every operator is one or two shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvella.operators.indices import h_index


def summary_stats(papers: DataFrame) -> DataFrame:
    """One row of corpus figures: counts, years and exact quantiles of citations (A1)."""
    c = F.col("citations_count")
    q = lambda p: F.percentile(c, p)
    return papers.agg(
        F.count(F.lit(1)).alias("papers"), F.min("year").alias("year_min"), F.max("year").alias("year_max"), F.avg(c).alias("mean"), q(0.5).alias("median"), F.stddev_pop(c).alias("std"),
        F.min(c).alias("min"), F.max(c).alias("max"), q(0.25).alias("q1"), q(0.75).alias("q3"), (q(0.75) - q(0.25)).alias("iqr"), F.sum(c).alias("total"),
    )


def per_year(papers: DataFrame) -> DataFrame:
    """Publications and citations by year; unknown years are left out (A2)."""
    return papers.filter(F.col("year").isNotNull()).groupBy("year").agg(F.count(F.lit(1)).alias("publications"), F.sum("citations_count").alias("citations"))


def author_metrics(author_papers: DataFrame) -> DataFrame:
    """author, h, g, i10, totals, rates and years (A3). A name listed twice on a paper counts twice."""
    base = author_papers.groupBy("author").agg(
        F.sum("citations").alias("total_citations"), F.count(F.lit(1)).alias("papers"), F.avg("citations").alias("mean_citations"), F.min("year").alias("first_year"), F.max("year").alias("last_year")
    )
    span = F.greatest(F.col("last_year") - F.col("first_year") + 1, F.lit(1))
    return base.join(h_index(author_papers, ["author"], tie=("paper_id",)), "author").withColumn("h_per_year", F.col("h_index") / span)


def journal_metrics(papers: DataFrame, current_year: int) -> DataFrame:
    """journal, papers, total, mean, h5 (the journal's last five years), half_life: the citation-weighted median age (A4)."""
    j = Window.partitionBy("journal")
    dated = papers.filter(F.col("journal").isNotNull()).withColumn("last", F.max("year").over(j))
    h5 = h_index(dated.filter(F.col("year") > F.col("last") - 5).withColumn("citations", F.col("citations_count")), ["journal"], tie=("paper_id",)).select("journal", F.col("h_index").alias("h5"))
    by_age = dated.filter("year IS NOT NULL").groupBy("journal", (F.lit(current_year) - F.col("year")).alias("age")).agg(F.sum("citations_count").alias("c"))
    upto = Window.partitionBy("journal").orderBy("age").rowsBetween(Window.unboundedPreceding, 0)
    half = by_age.withColumn("run", F.sum("c").over(upto)).withColumn("all", F.sum("c").over(j)).filter("all > 0 AND run >= all / 2").groupBy("journal").agg(F.min("age").alias("half_life"))
    base = dated.groupBy("journal").agg(F.count(F.lit(1)).alias("papers"), F.sum("citations_count").alias("total_citations"), F.avg("citations_count").alias("mean_citations"))
    return base.join(h5, "journal", "left").join(half, "journal", "left")


def collaboration_index(authorship: DataFrame) -> DataFrame:
    """Mean number of authors over papers that have any (A5)."""
    return authorship.groupBy("paper_id").count().agg(F.avg("count").alias("collaboration_index"))


def summary_rollup(papers: DataFrame) -> DataFrame:
    """Papers and citations per journal and year, per journal, and in all (A6); level 0 is a journal's year."""
    g = papers.rollup("journal", "year").agg(F.count(F.lit(1)).alias("papers"), F.sum("citations_count").alias("citations"), F.grouping_id().alias("g"))
    return g.select("journal", "year", "papers", "citations", F.when(F.col("g") == 0, 0).when(F.col("g") == 1, 1).otherwise(2).alias("level"))


def emerging_authors(author_papers: DataFrame, threshold: int) -> DataFrame:
    """Authors whose first year is at least ``threshold``."""
    return author_papers.groupBy("author").agg(F.min("year").alias("first_year"), F.count(F.lit(1)).alias("papers"), F.sum("citations").alias("citations"), F.avg("citations").alias("mean_citations")).filter(F.col("first_year") >= threshold)


def year_field_counts(papers: DataFrame, fields: DataFrame) -> DataFrame:
    """Papers by year and field, with both margins (A8), long form."""
    return papers.select("paper_id", "year").join(fields, "paper_id").cube("year", "field").agg(F.count(F.lit(1)).alias("papers"), F.grouping_id().alias("level"))


def top_keys(rows: DataFrame, key: str, n: int, metric: str) -> DataFrame:
    """The ``n`` keys with most papers or citations; ties by key (A10)."""
    totals = rows.groupBy(key).agg(F.count(F.lit(1)).alias("papers"), F.sum("citations").alias("citations"))
    return totals.orderBy(F.desc(metric), key).limit(n)


def project_metrics(papers: DataFrame, project: str) -> DataFrame:
    """Per project: papers, citations, h, productivity and span."""
    base = papers.groupBy(project).agg(F.count(F.lit(1)).alias("papers"), F.sum("citations_count").alias("citations"), (F.max("year") - F.min("year") + 1).alias("span"))
    h = h_index(papers.withColumn("citations", F.col("citations_count")), [project], tie=("paper_id",)).select(project, "h_index")
    return base.join(h, project).withColumn("productivity", F.round(F.col("papers") / F.greatest(F.col("span"), F.lit(1)), 3))


def side_by_side(metrics: DataFrame, project: str, names: list[str]) -> DataFrame:
    """``metrics`` (one row per project) as one row per metric, a column per project."""
    values = [c for c in metrics.columns if c != project]
    long = metrics.select(project, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(project, values, "metric", "value")
    return long.groupBy("metric").pivot(project, names).agg(F.first("value"))


def stage_progress(records: DataFrame, stages: list[str]) -> DataFrame:
    """Records per stage, stages without any included, and the total."""
    spark = records.sparkSession
    every = spark.createDataFrame([(s,) for s in stages], "stage string")
    counted = every.join(records.groupBy("stage").agg(F.count(F.lit(1)).alias("n")), "stage", "left").select("stage", F.coalesce("n", F.lit(0)).alias("records"))
    return counted.rollup("stage").agg(F.sum("records").alias("records")).select(F.coalesce("stage", F.lit("total")).alias("stage"), "records")


def judgement_shares(judgements: DataFrame) -> DataFrame:
    """Share of each judgement per domain (A14). Input: study_id, domain, judgement."""
    n = judgements.groupBy("domain", "judgement").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("domain")))


SEVERITY = {"low": 0, "some concerns": 1, "moderate": 1, "high": 2, "serious": 2, "very high": 3, "critical": 3}


def _severity(c: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(c) == k, F.lit(v)) for k, v in SEVERITY.items()])


def overall_risk(judgements: DataFrame) -> DataFrame:
    """Per study, the overall risk by the two usual rules.

    ``rob2``: all low is low; none high is some concerns; all high with one very high is very high; else high.
    ``worst``: the most severe judgement.
    """
    s = _severity(F.col("judgement"))
    g = judgements.groupBy("study_id").agg(F.max(s).alias("top"), F.min(s).alias("least"), F.max_by("judgement", s).alias("worst"))
    rule = F.when(F.col("top") == 0, "low").when(F.col("top") < 2, "some concerns").when((F.col("least") >= 2) & (F.col("top") == 3), "very high").otherwise("high")
    return g.select("study_id", rule.alias("rob2"), F.when(F.col("top") == 0, "low").when(F.col("top") == 1, "moderate").when(F.col("top") == 2, "serious").otherwise("critical").alias("worst"))


def star_quality(stars: DataFrame) -> DataFrame:
    """Newcastle-Ottawa style stars (A15): study_id, item, stars; at most 1 per item, 2 for comparability."""
    cap = F.when(F.col("item") == "comparability", 2).otherwise(1)
    g = stars.groupBy("study_id").agg(F.sum(F.least(F.greatest("stars", F.lit(0)), cap)).alias("total"))
    return g.withColumn("overall", F.when(F.col("total") >= 7, "high").when(F.col("total") >= 5, "moderate").otherwise("low"))


def qca_truth_table(cases: DataFrame, outcome: str, conditions: list[str]) -> DataFrame:
    """Crisp-set truth table: configurations, outcome and count."""
    return cases.groupBy(*conditions, outcome).agg(F.count(F.lit(1)).alias("cases"))


def qca_conditions(cases: DataFrame, outcome: str, conditions: list[str]) -> DataFrame:
    """Per condition: necessity = both / outcome, coverage = sufficiency = both / condition."""
    y = F.col(outcome) > 0
    packed = ", ".join(f"'{c}', CAST({c} AS INT)" for c in conditions)
    long = cases.select(y.cast("int").alias("y"), F.expr(f"stack({len(conditions)}, {packed}) AS (condition, x)"))
    g = long.groupBy("condition").agg(F.sum(F.col("x") * F.col("y")).alias("both"), F.sum("y").alias("ny"), F.sum("x").alias("nx"))
    return g.select("condition", F.when(F.col("ny") > 0, F.col("both") / F.col("ny")).otherwise(0.0).alias("necessity"), F.when(F.col("nx") > 0, F.col("both") / F.col("nx")).otherwise(0.0).alias("sufficiency"))


def fsqca(cases: DataFrame, outcome: str, conditions: list[str]) -> DataFrame:
    """Fuzzy-set configurations (cut at 0.5) with row consistency sum(min(x, y)) / sum(x)."""
    x = F.least(*[F.when(F.col(c) > 0.5, F.col(c)).otherwise(1 - F.col(c)) for c in conditions]) if len(conditions) > 1 else F.col(conditions[0])
    config = F.concat_ws("*", *[F.when(F.col(c) > 0.5, c.upper()).otherwise(c) for c in conditions])
    g = cases.select(config.alias("configuration"), x.alias("x"), F.col(outcome).alias("y")).groupBy("configuration")
    return g.agg(F.count(F.lit(1)).alias("cases"), F.sum(F.least("x", "y")).alias("shared"), F.sum("x").alias("weight"), F.sum("y").alias("y")).select(
        "configuration", "cases", F.when(F.col("weight") > 0, F.col("shared") / F.col("weight")).otherwise(0.0).alias("consistency"), F.when(F.col("y") > 0, F.col("shared") / F.col("y")).otherwise(0.0).alias("coverage")
    )


def prisma_flow(records: DataFrame) -> DataFrame:
    """Flow counts and arithmetic warnings from a screening table (A20): source_kind, duplicate, stage, excluded."""
    n = lambda c: F.count_if(c)
    flow = records.agg(
        F.count(F.lit(1)).alias("identified"), n(F.col("duplicate")).alias("duplicates"), n(~F.col("duplicate")).alias("screened"),
        n(~F.col("duplicate") & F.col("excluded")).alias("excluded"), n(~F.col("duplicate") & ~F.col("excluded")).alias("sought"), n(~F.col("duplicate") & ~F.col("excluded") & F.col("included")).alias("included"),
    )
    rules = [(F.col("identified") - F.col("duplicates") != F.col("screened"), "identified less duplicates is not screened"), (F.col("screened") - F.col("excluded") != F.col("sought"), "screened less excluded is not sought")]
    return flow.withColumn("warnings", F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in rules]), lambda x: x.isNotNull()))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its number of rows."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def histogram(values: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """Equal-width histogram with min(50, max(10, sqrt(n))) bins."""
    v = values.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    s = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    s = s.withColumn("bins", F.lit(bins) if bins else F.least(F.lit(50), F.greatest(F.lit(10), F.floor(F.sqrt("n")))).cast("int"))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    both = v.join(F.broadcast(s))  # one row
    b = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / width), F.col("bins") - 1)).cast("int")
    return both.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def fold_parallel_edges(edges: DataFrame, how: str = "sum", fold=None) -> DataFrame:
    """Parallel edges (src, dst, weight) as one each (A23): sum, max, mean, count or a function of the weight column."""
    w = F.col("weight")
    made = fold(w) if fold is not None else {"sum": F.sum, "max": F.max, "mean": F.avg}[how](w) if how != "count" else F.count(F.lit(1))
    return edges.groupBy("src", "dst").agg(made.alias("weight"), F.count(F.lit(1)).alias("parallel"))


def cohen_kappa(pairs: DataFrame) -> DataFrame:
    """po, pe and kappa of (rater_1, rater_2) decisions (A24); pe = 1 gives 1, no data 0."""
    n = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rater_1") == F.col("rater_2")).alias("same"))
    m1 = pairs.groupBy(F.col("rater_1").alias("k")).agg(F.count(F.lit(1)).alias("n1"))
    m2 = pairs.groupBy(F.col("rater_2").alias("k")).agg(F.count(F.lit(1)).alias("n2"))
    chance = m1.join(m2, "k").agg(F.coalesce(F.sum(F.col("n1") * F.col("n2")), F.lit(0)).alias("products"))
    x = n.join(F.broadcast(chance))  # one row each
    po, pe = F.col("same") / F.col("n"), F.col("products") / (F.col("n") * F.col("n"))
    return x.select("n", F.when(F.col("n") > 0, po).otherwise(0.0).alias("po"), F.when(F.col("n") > 0, pe).otherwise(0.0).alias("pe"), F.when(F.col("n") == 0, 0.0).when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def fleiss_kappa(decisions: DataFrame) -> DataFrame:
    """Kappa over (record_id, reviewer, decision), records with at least two decisions."""
    cell = decisions.groupBy("record_id", "decision").agg(F.count(F.lit(1)).alias("k"))
    rec = cell.groupBy("record_id").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("sq")).filter("m > 1")
    p = rec.agg(F.avg((F.col("sq") - F.col("m")) / (F.col("m") * (F.col("m") - 1))).alias("po"), F.count(F.lit(1)).alias("n"))
    share = cell.join(rec.select("record_id"), "record_id", "left_semi").groupBy("decision").agg(F.sum("k").alias("k"))
    pe = share.agg(F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("sq")).select((F.col("sq") / (F.col("all") * F.col("all"))).alias("pe"))
    x = p.join(F.broadcast(pe))  # one row each
    return x.select("n", "po", "pe", F.when(F.col("n") == 0, 0.0).when(F.col("pe") == 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def conflicts(decisions: DataFrame) -> DataFrame:
    """Records on which at least two reviewers differ."""
    g = decisions.groupBy("record_id").agg(F.count_distinct("reviewer").alias("reviewers"), F.count_distinct("decision").alias("decisions"))
    return g.filter("reviewers >= 2 AND decisions >= 2")


def resolved(decisions: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Final decision per record: its latest resolution, else the agreed one, else 'conflict' (A25)."""
    last = resolutions.groupBy("record_id").agg(F.max_by("decision", "ts").alias("final"))
    agreed = decisions.groupBy("record_id").agg(F.when(F.count_distinct("decision") == 1, F.min("decision")).alias("agreed"))
    return agreed.join(last, "record_id", "left").select("record_id", F.coalesce("final", "agreed", F.lit("conflict")).alias("decision"))


def bland_altman(pairs: DataFrame, z: float = 1.96) -> DataFrame:
    """Bias, standard deviation and limits of agreement of columns x and y."""
    d = F.col("x") - F.col("y")
    g = pairs.agg(F.avg(d).alias("bias"), F.stddev_samp(d).alias("sd"), F.count(F.lit(1)).alias("n"))
    return g.select("n", "bias", "sd", (F.col("bias") - z * F.col("sd")).alias("lower"), (F.col("bias") + z * F.col("sd")).alias("upper"))


def volcano_classes(tests: DataFrame, change: float = 1.0, p: float = 0.05) -> DataFrame:
    """up, down or ns by log fold change and p."""
    c = F.when((F.col("p") < p) & (F.col("change") >= change), "up").when((F.col("p") < p) & (F.col("change") <= -change), "down").otherwise("ns")
    return tests.withColumn("class", c)


def qq_points(tests: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted p against its expected quantile (i - 0.5) / n per key."""
    w = Window.partitionBy(*keys)
    return tests.withColumn("i", F.row_number().over(w.orderBy("p", "id"))).withColumn("expected", (F.col("i") - 0.5) / F.count(F.lit(1)).over(w))


def manhattan_offsets(sites: DataFrame) -> DataFrame:
    """Cumulative offset of each chromosome (A26): chromosome, position -> offset."""
    spans = sites.groupBy("chromosome").agg(F.max("position").alias("span"))
    before = Window.orderBy("chromosome").rowsBetween(Window.unboundedPreceding, -1)  # one row per chromosome
    return spans.withColumn("offset", F.coalesce(F.sum("span").over(before), F.lit(0)))


def validate_forms(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Errors per study (A27): values (study_id, field, value) against rules (field, kind, required, options array)."""
    studies = values.select("study_id").distinct()
    due = studies.join(F.broadcast(rules))  # a template of a few dozen fields
    x = due.join(values, ["study_id", "field"], "left")
    v = F.trim(F.col("value"))
    blank = v.isNull() | (v == "")
    bad = F.when(blank & F.col("required"), F.concat("field", F.lit(": required"))).when(blank, None).when((F.col("kind") == "number") & F.expr("try_cast(trim(value) AS DOUBLE)").isNull(), F.concat("field", F.lit(": not a number")))
    bad = bad.when((F.col("kind") == "boolean") & ~F.lower(v).isin("yes", "no", "true", "false", "1", "0"), F.concat("field", F.lit(": not a boolean")))
    bad = bad.when((F.col("kind") == "select") & ~F.array_contains("options", v), F.concat("field", F.lit(": not an option")))
    bad = bad.when((F.col("kind") == "multiselect") & (F.size(F.array_except(F.transform(F.split(v, ","), F.trim), F.col("options"))) > 0), F.concat("field", F.lit(": not an option")))
    return x.groupBy("study_id").agg(F.sort_array(F.collect_list(bad)).alias("errors"))


def narrative_themes(outcomes: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent themes with their mean effect and its sign (A17). Input: theme, effect, one row per study."""
    e = F.avg("effect")
    sign = F.when(e > 0, "positive").when(e < 0, "negative").otherwise("none")
    return outcomes.groupBy("theme").agg(F.count(F.lit(1)).alias("studies"), e.alias("mean_effect"), sign.alias("direction")).orderBy(F.desc("studies"), "theme").limit(n)


def theme_studies(outcomes: DataFrame, n: int) -> DataFrame:
    """(theme, study, effect) of the ``n`` most frequent themes (A17): a row per study, not a list per theme. Input: theme, study, effect."""
    return outcomes.join(F.broadcast(narrative_themes(outcomes, n).select("theme")), "theme").select("theme", "study", "effect")  # n rows


def study_table(studies: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(study, year, outcomes, mean_effect, direction) of every study, with none where it reports nothing (A17). Inputs: study, year; study, effect."""
    g = outcomes.groupBy("study").agg(F.count("effect").alias("outcomes"), F.avg("effect").alias("mean_effect"))
    x = studies.join(g, "study", "left").na.fill(0, ["outcomes"])
    return x.withColumn("direction", F.when(F.col("mean_effect") > 0, "positive").when(F.col("mean_effect") < 0, "negative").otherwise("none")).select("study", "year", "outcomes", "mean_effect", "direction")


def bias_distribution(judgements: DataFrame) -> DataFrame:
    """Number and share of each judgement over all studies and domains."""
    total = judgements.agg(F.count(F.lit(1)).alias("total"))
    n = judgements.groupBy("judgement").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(total)).select("judgement", "n", (F.col("n") / F.col("total")).alias("share"))  # one row
