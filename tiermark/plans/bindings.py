"""The given tables seen as a bibliographic snapshot: customers are authors, orders their works, suppliers institutions, parts topics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiermark.operators import assign, hindex
from tiermark.sources.files import work_folder
from tiermark.sources.snapshots import country_map

EXCLUDED = ["PROMO", "ECONOMY"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_KEPT: dict[tuple[str, str, str], str] = {}


def _kept(spark: SparkSession, sf_dir: str, kind: str, column: str, make) -> DataFrame:
    """A table written once a session and bucketed by a column: what groups by that has no exchange under it."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _KEPT:
        name = f"{kind}_{uuid.uuid4().hex}"
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        make().repartition(buckets, column).write.bucketBy(buckets, column).option("path", work_folder(spark)).saveAsTable(name)
        _KEPT[key] = name
    return spark.table(_KEPT[key])


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the customer of their order and the year they were shipped, bucketed by customer: works, affiliations and topics
    of authors all come from these, so line items meet orders once."""

    def make() -> DataFrame:
        li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", F.year("l_shipdate").alias("year"))
        return li.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")

    return _kept(spark, sf_dir, "lines", "o_custkey", make)


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """author_id, work_id, citations."""
    return lines(spark, sf_dir).groupBy(F.col("o_custkey").alias("author_id"), F.col("l_orderkey").alias("work_id")).agg(F.floor(F.sum("l_quantity")).cast("bigint").alias("citations"))


def h1_by_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hindex.h_index(papers(spark, sf_dir), ["author_id"], "citations", h_as="h_index", count_as="works_count")


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested author rows: id, h_index, works_count, affiliations, topics."""
    li = lines(spark, sf_dir)
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_acctbal")
    years = li.groupBy("o_custkey", "l_suppkey").agg(F.sort_array(F.collect_set("year")).alias("years")).join(suppliers, "l_suppkey")
    name = F.when(F.col("o_custkey") % 7 == 0, F.lower("s_name")).otherwise(F.col("s_name"))
    kind = F.when(F.col("s_acctbal") >= 0, "education").otherwise("company")
    institution = F.struct(F.col("l_suppkey").alias("id"), name.alias("display_name"), kind.alias("type"))
    affiliations = years.groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(F.struct(institution.alias("institution"), "years")).alias("affiliations"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type")
    counted = li.groupBy("o_custkey", "l_partkey").agg(F.count("*").alias("count")).join(parts, "l_partkey")
    label = lambda c: F.struct(c.alias("id"), c.alias("display_name"))
    domain = F.when(F.col("p_type").isin("SMALL", "MEDIUM", "LARGE"), "size").otherwise("grade")
    topic = F.struct(F.col("l_partkey").cast("string").alias("id"), F.col("p_name").alias("display_name"), "count", label(F.col("p_brand")).alias("subfield"), label(F.col("p_type")).alias("field"), label(domain).alias("domain"))
    topics = counted.groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(topic).alias("topics"))
    people = h1_by_author(spark, sf_dir).withColumnRenamed("author_id", "id")
    return people.join(affiliations, "id").join(topics, "id")


def institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, country_code: the supplier's nation, null for every twentieth."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, sf_dir, "supplier").join(nations, "s_nationkey").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 20 != 0, F.col("n_name")).alias("country_code"))


def flat_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author rows before institutions get their canonical names."""
    return assign.flat_authors(snapshot(spark, sf_dir))


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat author table, bucketed by institution and written once a session: nearly every query begins with it, and what groups
    by institution needs no exchange of it."""
    return _kept(spark, sf_dir, "authors", "institution_id", lambda: assign.build_authors(snapshot(spark, sf_dir)))


def forget() -> None:
    """Let go of the tables that `lines` and `authors` keep."""
    spark = SparkSession.getActiveSession()
    for (application, *_), name in _KEPT.items():
        if spark and spark.sparkContext.applicationId == application:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    _KEPT.clear()


class Index:
    """The index tables, built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf = spark, sf_dir

    @property
    def authors(self) -> DataFrame:
        return authors(self.spark, self.sf)

    @property
    def countries(self) -> DataFrame:
        return country_map(institutions(self.spark, self.sf))

    @property
    def h2(self) -> DataFrame:
        return hindex.h2_by_institution(self.authors)

    @property
    def h2_field(self) -> DataFrame:
        return hindex.h2_by_institution_field(self.authors)

    @property
    def h2_subfield(self) -> DataFrame:
        return hindex.h2_by_institution_subfield(self.authors)

    @property
    def h3(self) -> DataFrame:
        return hindex.h3(self.h2, self.countries)

    @property
    def h3_field(self) -> DataFrame:
        return hindex.h3(self.h2_field, self.countries, ["field"], ["field_name"])

    @property
    def h3_subfield(self) -> DataFrame:
        return hindex.h3(self.h2_subfield, self.countries, ["subfield"], ["subfield_name"])
