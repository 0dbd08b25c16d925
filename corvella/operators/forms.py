"""Extraction forms and screening records as wide tables; the pluggable embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from corvella.functions.scalars import doi


# The columns of the table of extraction forms, plain, from a nested part, and as the length of a list.
PLAIN = ["study_id", "study_title", "year", "journal", "study_design", "country", "setting", "funding", "conflicts_of_interest", "notes"]
NESTED = {
    "population": ["n_total", "n_intervention", "n_control", "age_mean", "age_sd", "pct_female"],
    "intervention": ["comparator_name", "duration", "dose"],
    "results": ["follow_up_period", "dropouts"],
}
LENGTHS = {"n_primary_outcomes": "primary_outcomes", "n_secondary_outcomes": "secondary_outcomes", "n_effect_sizes": "results.effect_sizes", "n_adverse_events": "results.adverse_events"}


def extraction_table(forms: DataFrame) -> DataFrame:
    """Whole extraction forms as one wide row per study (A16): 27 columns, authors joined by '; ', missing lists counted as empty."""
    nested = [F.col(f"{part}.{name}").alias(name) for part, names in NESTED.items() for name in names]
    lengths = [F.coalesce(F.array_size(c), F.lit(0)).alias(name) for name, c in LENGTHS.items()]
    return forms.select(*PLAIN, F.concat_ws("; ", "authors").alias("authors"), F.col("intervention.name").alias("intervention_name"), *nested, *lengths)


def wide(forms: DataFrame, paths: list[str]) -> DataFrame:
    """Nested struct fields as flat columns named by their path."""
    return forms.select("study_id", *[F.col(p).alias(p.replace(".", "_")) for p in paths])


def missing(forms: DataFrame, required: list[str]) -> DataFrame:
    """Required paths that are null or blank, per study."""
    gone = lambda p: F.when(F.col(p).isNull() | (F.trim(F.col(p).cast("string")) == ""), F.lit(p))
    return forms.select("study_id", F.filter(F.array(*[gone(p) for p in required]), lambda x: x.isNotNull()).alias("missing"))


def decisions_table(decisions: DataFrame) -> DataFrame:
    """One row per record: all reviewers' decisions as JSON, and whether they agree."""
    m = F.map_from_entries(F.sort_array(F.collect_list(F.struct("reviewer", "decision"))))
    return decisions.groupBy("record_id").agg(F.to_json(m).alias("decisions"), (F.count_distinct("decision") == 1).alias("agreed"))


def embed(texts: DataFrame, column: str, encode: Callable[[], Callable[[list[str]], list]], name: str = "embedding") -> DataFrame:
    """``texts`` with vectors of a user's encoder (U4). ``encode`` loads it once per Python worker task."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encode()
        for p in parts:
            yield pd.Series([list(map(float, v)) for v in model(p.fillna("").tolist())])

    return texts.withColumn(name, run(F.col(column)))


def open_access(rows: DataFrame) -> DataFrame:
    """Unpaywall records as open-access locations."""
    schema = "doi string, is_oa boolean, oa_status string, best_oa_location struct<url:string,url_for_pdf:string,host_type:string,version:string>"
    w = rows.select(F.from_json("value", schema).alias("w")).select("w.*")
    b: Column = F.col("best_oa_location")
    return w.select(F.lower("doi").alias("doi"), "is_oa", F.col("oa_status").alias("status"), b["url"].alias("url"), b["url_for_pdf"].alias("pdf_url"), b["host_type"].alias("host_type"), b["version"].alias("version"))


ORCID = "`put-code` long, title struct<title:struct<value:string>>, `publication-date` struct<year:struct<value:string>>, `journal-title` struct<value:string>, type string, url struct<value:string>, `external-ids` struct<`external-id`:array<struct<`external-id-type`:string,`external-id-value`:string,`external-id-url`:struct<value:string>>>>"


def orcid_works(lines: DataFrame) -> DataFrame:
    """ORCID work summaries as papers without authors (S11): DOI from the external ids, the work's URL or the first id's."""
    w = lines.select(F.from_json("value", ORCID).alias("w")).select("w.*")
    ids = F.col("`external-ids`")["external-id"]
    found = F.get(F.transform(F.filter(ids, lambda x: F.lower(x["external-id-type"]) == "doi"), lambda x: x["external-id-value"]), F.lit(0))
    first_url = F.get(F.filter(F.transform(ids, lambda x: x["external-id-url"]["value"]), lambda u: u.isNotNull()), F.lit(0))
    return w.select(
        F.coalesce(doi(found), F.col("`put-code`").cast("string")).alias("paper_id"), F.col("title.title.value").alias("title"), F.col("`publication-date`.year.value").try_cast("int").alias("year"), F.col("`journal-title`.value").alias("journal"),
        F.col("type").alias("paper_type"), doi(found).alias("doi"), F.coalesce(F.col("url.value"), first_url).alias("url"), F.array().cast("array<string>").alias("authors"), F.lit("orcid").alias("source"),
    )


def citation_dump(lines: DataFrame) -> DataFrame:
    """COCI records as citations (S11). Both ends lose their resolver prefix; ``author_sc`` and ``journal_sc`` mark self-citations."""
    w = lines.select(F.from_json("value", "citing string, cited string, creation string, timespan string, author_sc string, journal_sc string").alias("w")).select("w.*")
    return w.select(doi(F.col("citing")).alias("citing"), doi(F.col("cited")).alias("cited"), "creation", "timespan", (F.lower("author_sc") == "yes").alias("author_self"), (F.lower("journal_sc") == "yes").alias("journal_self"))
