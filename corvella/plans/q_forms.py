"""Queries A16, S11, S21, U4."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvella.operators import forms
from corvella.plans.q_aggregates import decisions
from corvella.plans.registry import Registry

R = Registry()
QUERIES, ORACLES = R.QUERIES, R.ORACLES
C = F.col


def nested(v):
    c = v.table("customer")
    return c.select(C("c_custkey").alias("study_id"), F.struct(C("c_mktsegment").alias("setting"), F.when(C("c_acctbal") > 0, C("c_acctbal")).alias("n")).alias("population"), F.struct(F.when(C("c_nationkey") % 2 == 0, C("c_name")).otherwise(" ").alias("name")).alias("intervention"))


FORM = """c_custkey AS study_id, c_name AS study_title, array('A', c_mktsegment) AS authors, 2000 + c_nationkey AS year, c_mktsegment AS journal, 'trial' AS study_design, n_name AS country, CASE WHEN c_nationkey % 2 = 0 THEN 'ward' END AS setting,
 named_struct('n_total', 2 * c_nationkey, 'n_intervention', c_nationkey, 'n_control', c_nationkey, 'age_mean', c_acctbal, 'age_sd', 1.5D, 'pct_female', 50.0D) AS population,
 named_struct('name', c_name, 'comparator_name', 'none', 'duration', '4 weeks', 'dose', CASE WHEN c_acctbal > 0 THEN '5 mg' END) AS intervention,
 sequence(1, 1 + c_nationkey) AS primary_outcomes, CASE WHEN c_nationkey > 5 THEN array('s') END AS secondary_outcomes,
 named_struct('effect_sizes', array(1.0D, 2.0D), 'follow_up_period', '1 year', 'dropouts', c_nationkey, 'adverse_events', CASE WHEN c_acctbal > 0 THEN array('a', 'b') END) AS results,
 'f' AS funding, 'c' AS conflicts_of_interest, CAST(NULL AS STRING) AS notes"""


@R.add("a16_extraction_table", "", """SELECT c_custkey AS study_id, c_name AS study_title, 2000 + c_nationkey AS year, c_mktsegment AS journal, 'trial' AS study_design, n_name AS country, CASE WHEN c_nationkey % 2 = 0 THEN 'ward' END AS setting, 'f' AS funding, 'c' AS conflicts_of_interest, NULL::VARCHAR AS notes,
 'A; ' || c_mktsegment AS authors, c_name AS intervention_name, 2 * c_nationkey AS n_total, c_nationkey AS n_intervention, c_nationkey AS n_control, c_acctbal AS age_mean, 1.5::DOUBLE AS age_sd, 50::DOUBLE AS pct_female, 'none' AS comparator_name, '4 weeks' AS duration, CASE WHEN c_acctbal > 0 THEN '5 mg' END AS dose,
 '1 year' AS follow_up_period, c_nationkey AS dropouts, 1 + c_nationkey AS n_primary_outcomes, (c_nationkey > 5)::INT AS n_secondary_outcomes, 2 AS n_effect_sizes, CASE WHEN c_acctbal > 0 THEN 2 ELSE 0 END AS n_adverse_events FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def a16t(v):
    return forms.extraction_table(v.spark.sql(f"SELECT {FORM} FROM {{c}} JOIN {{n}} ON c_nationkey = n_nationkey", c=v.table("customer"), n=v.table("nation")))


@R.add("a16_wide_forms", "", "SELECT c_custkey AS study_id, c_mktsegment AS population_setting, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS population_n, CASE WHEN c_nationkey % 2 = 0 THEN c_name ELSE ' ' END AS intervention_name FROM customer")
def a16(v):
    return forms.wide(nested(v), ["population.setting", "population.n", "intervention.name"])


@R.add("a16_missing_fields", "", "SELECT c_custkey AS study_id, list_filter([CASE WHEN NOT c_acctbal > 0 THEN 'population.n' END, CASE WHEN c_nationkey % 2 <> 0 THEN 'intervention.name' END], lambda x: x IS NOT NULL) AS missing FROM customer")
def a16m(v):
    return forms.missing(nested(v), ["population.n", "intervention.name"])


@R.add("s11_open_access", "papers", "SELECT '10.1/x' || paper_id AS doi, citations_count > 100 AS is_oa, 'u' || paper_id AS url FROM papers")
def s11(v):
    w = F.struct(F.concat(F.lit("10.1/X"), "paper_id").alias("doi"), (C("citations_count") > 100).alias("is_oa"), F.struct(F.concat(F.lit("u"), "paper_id").alias("url")).alias("best_oa_location"))
    return forms.open_access(v.papers.select(F.to_json(w).alias("value"))).select("doi", "is_oa", "url")


@R.add("s11_orcid", "papers", "SELECT '10.1/x' || paper_id AS paper_id, 'T ' || paper_id AS title, year, journal, '10.1/x' || paper_id AS doi, 'https://doi.org/10.1/X' || paper_id AS url FROM papers")
def s11o(v):
    link = F.concat(F.lit("https://doi.org/10.1/X"), "paper_id")
    external = lambda kind, value, url: F.struct(F.lit(kind).alias("external-id-type"), value.alias("external-id-value"), F.struct(url.alias("value")).alias("external-id-url"))
    ids = F.array(external("eid", F.lit("e1"), F.lit(None).cast("string")), external("DOI", F.concat(F.lit("10.1/X"), "paper_id"), link))
    w = F.struct(C("paper_id").alias("put-code"), F.struct(F.struct(F.concat(F.lit("T "), "paper_id").alias("value")).alias("title")).alias("title"), F.struct(F.struct(C("year").cast("string").alias("value")).alias("year")).alias("publication-date"), F.struct(C("journal").alias("value")).alias("journal-title"), F.struct(ids.alias("external-id")).alias("external-ids"))
    return forms.orcid_works(v.papers.select(F.to_json(w).alias("value"))).select("paper_id", "title", "year", "journal", "doi", "url")


@R.add("s11_coci", "cites", "SELECT '10.1/x' || src AS citing, '10.1/x' || dst AS cited, src % 2 = 0 AS author_self, false AS journal_self FROM cites")
def s11c(v):
    end = lambda c: F.concat(F.lit("https://doi.org/10.1/X"), c)
    w = F.struct(end("src").alias("citing"), end("dst").alias("cited"), F.when(C("src") % 2 == 0, "yes").otherwise("no").alias("author_sc"), F.lit("no").alias("journal_sc"))
    return forms.citation_dump(v.cites.select(F.to_json(w).alias("value"))).select("citing", "cited", "author_self", "journal_self")


@R.add("s21_decisions_table", "", "SELECT doc_id AS record_id, '{\"r1\":\"' || CASE WHEN quality = 1 THEN 'include' ELSE 'exclude' END || '\",\"r2\":\"' || CASE WHEN toxic = 0 THEN 'include' ELSE 'exclude' END || '\"}' AS decisions, quality = 1 - toxic AS agreed FROM labels")
def s21(v):
    return forms.decisions_table(decisions(v))


def _lengths():
    return lambda texts: [[len(t), t.count(" ")] for t in texts]


@R.add("u4_embedder", "", "SELECT doc_id, [length(text), length(text) - length(replace(text, ' ', ''))]::FLOAT[] AS embedding FROM documents")
def u4(v):
    return forms.embed(v.table("documents").select("doc_id", "text"), "text", _lengths).select("doc_id", "embedding")
