"""Scholarly views of the driver's star schema, as DataFrames and as the SQL that says the same.

One order is a paper, its suppliers are the authors, its parts the references, a part's brand a keyword
and its type a field. Orders that share a part cite the most recent earlier order with that part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Views:
    """Lazy frames over one data folder. Columns are pruned and filters pushed down by Catalyst."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def papers(self) -> DataFrame:
        o = self.table("orders")
        return o.select(
            F.col("o_orderkey").alias("paper_id"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("journal"),
            F.floor(F.col("o_totalprice") / 1000).cast("int").alias("citations_count"), F.col("o_orderstatus").alias("source"),
        )

    @property
    def authorship(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("author")).distinct()

    @property
    def references(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_partkey").alias("ref")).distinct()

    def _by_part(self, column: str, name: str) -> DataFrame:
        p = self.table("part").select("p_partkey", F.col(column).alias(name))
        return self.table("lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("paper_id"), name).distinct()

    @property
    def keywords(self) -> DataFrame:
        return self._by_part("p_brand", "keyword")

    @property
    def fields(self) -> DataFrame:
        return self._by_part("p_type", "field")

    @property
    def cites(self) -> DataFrame:
        o = self.table("orders").select("o_orderkey", "o_orderdate")
        with_date = self.references.join(o, F.col("paper_id") == F.col("o_orderkey"))
        earlier = Window.partitionBy("ref").orderBy("o_orderdate", "paper_id")
        return with_date.select(F.col("paper_id").alias("src"), F.lag("paper_id").over(earlier).alias("dst")).filter("dst IS NOT NULL").distinct()

    @property
    def coauthors(self) -> DataFrame:
        """Author pairs a < b with their number of shared papers."""
        from corvella.operators.networks import pair_counts

        return pair_counts(self.authorship, "paper_id", "author")

    @property
    def paper_year_counts(self) -> DataFrame:
        return self.table("lineitem").groupBy(F.col("l_partkey").alias("entity"), F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("count"))

    @property
    def effects(self) -> DataFrame:
        """2x2 tables by part type (analysis) and brand (study): events are returned lines, arms the line status."""
        p = self.table("part").select("p_partkey", F.col("p_type").alias("meta_id"), F.col("p_brand").alias("study_id"))
        x = self.table("lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
        i, r = F.col("l_linestatus") == "F", F.col("l_returnflag") == "R"
        q = F.col("l_quantity")
        return x.groupBy("meta_id", "study_id").agg(
            F.count_if(i & r).alias("a"), F.count_if(i).alias("n1"), F.count_if(~i & r).alias("c"), F.count_if(~i).alias("n2"),
            F.avg(F.when(i, q)).alias("m1"), F.stddev_samp(F.when(i, q)).alias("sd1"), F.avg(F.when(~i, q)).alias("m2"), F.stddev_samp(F.when(~i, q)).alias("sd2"),
            F.year(F.max("l_shipdate")).alias("year"),
        )


SQL = {
    "papers": "SELECT o_orderkey AS paper_id, year(o_orderdate)::INT AS year, o_orderpriority AS journal, floor(o_totalprice / 1000)::INT AS citations_count, o_orderstatus AS source FROM orders",
    "authorship": "SELECT DISTINCT l_orderkey AS paper_id, l_suppkey AS author FROM lineitem",
    "refs": "SELECT DISTINCT l_orderkey AS paper_id, l_partkey AS ref FROM lineitem",
    "keywords": "SELECT DISTINCT l_orderkey AS paper_id, p_brand AS keyword FROM lineitem JOIN part ON l_partkey = p_partkey",
    "fields": "SELECT DISTINCT l_orderkey AS paper_id, p_type AS field FROM lineitem JOIN part ON l_partkey = p_partkey",
    "cites": "SELECT DISTINCT src, dst FROM (SELECT paper_id AS src, lag(paper_id) OVER (PARTITION BY ref ORDER BY o_orderdate, paper_id) AS dst FROM (SELECT DISTINCT l_orderkey AS paper_id, l_partkey AS ref FROM lineitem) JOIN orders ON paper_id = o_orderkey) WHERE dst IS NOT NULL",
    "coauthors": "SELECT x.author AS a, y.author AS b, count(*) AS weight FROM authorship x JOIN authorship y ON x.paper_id = y.paper_id AND x.author < y.author GROUP BY ALL",
    "paper_year_counts": "SELECT l_partkey AS entity, year(l_shipdate)::INT AS year, count(*) AS count FROM lineitem GROUP BY ALL",
    "effects": "SELECT p_type AS meta_id, p_brand AS study_id, count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'R') AS a, count(*) FILTER (l_linestatus = 'F') AS n1, count(*) FILTER (l_linestatus <> 'F' AND l_returnflag = 'R') AS c, count(*) FILTER (l_linestatus <> 'F') AS n2, avg(l_quantity) FILTER (l_linestatus = 'F') AS m1, stddev_samp(l_quantity) FILTER (l_linestatus = 'F') AS sd1, avg(l_quantity) FILTER (l_linestatus <> 'F') AS m2, stddev_samp(l_quantity) FILTER (l_linestatus <> 'F') AS sd2, year(max(l_shipdate))::INT AS year FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL",
}
NEEDS = {"coauthors": ["authorship"]}


def sql(views: str, body: str) -> str:
    """``body`` behind the named views (blank separated) as common table expressions."""
    names: list[str] = []
    for v in views.split():
        for x in [*NEEDS.get(v, []), v]:
            if x not in names:
                names.append(x)
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"
