"""The star-schema tables seen as persons, events, records and population.

The derived columns stand in for what the schema lacks (birth dates, code lists);
every view keeps all rows of its table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bands import age_band_open, age_years
from ..functions.fixed_values import BAND_LABELS
from ..operators.events import first_event
from ..operators.joins import lookup_join

FIRST_YEAR, LAST_YEAR, PROJECTED_YEAR = 1995, 2000, 2001
FIRST_MONTH, LAST_MONTH, SERIES_FROM = "1995-04-01", "2001-06-01", "1995-07-01"
BREAKS = ("1997-03-01", "1999-05-01")
AFTER, BEFORE = "1995-01-31", "2001-07-01"
INDEX_DATE, STUDY_END = "1998-01-01", "2001-08-01"
MEASURE_BRANDS = {
    "Brand#1": "BMI",
    "Brand#2": "Smoking",
    "Brand#3": "Alcohol",
    "Brand#4": "BP",
    "Brand#5": "Fasting glucose",
    "Brand#6": "HbA1c",
    "Brand#7": "Total cholesterol",
    "Brand#8": "HDL cholesterol",
    "Brand#9": "LDL cholesterol",
    "Brand#10": "Triglycerides",
    "Brand#11": "eGFR",
    "Brand#12": "LFT",
}
MEASURE_EXCLUDED = {"Brand#1": "small"}
AREA_CODES = tuple(f"A{n:02d}" for n in range(20))


# Declared, so that opening a table starts no job to infer its schema.
SCHEMAS = {
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
    "c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
    "p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def persons_without_area(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "c_custkey AS pid",
        "date_add(DATE'1915-01-01', CAST(c_custkey * 7919 % 25000 AS INT)) AS dob",
        "CASE WHEN c_custkey % 41 <> 0 THEN IF(c_custkey % 2 = 0, 'M', 'F') END AS sex",
        "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Other ethnic group' "
        "WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS ethnicity",
        "CASE WHEN c_custkey % 97 <> 0 THEN CAST(c_custkey % 10 + 1 AS INT) END AS imd10",
        "CASE WHEN c_custkey % 97 <> 0 THEN CAST((c_custkey % 10 + 2) DIV 2 AS INT) END AS imd5",
        "CASE WHEN c_custkey % 13 = 0 "
        "THEN date_add(DATE'1996-01-01', CAST(c_custkey * 31 % 2500 AS INT)) END AS dod",
        "IF(c_custkey % 53 = 0, 'W01', 'E01') || lpad(CAST(c_nationkey AS STRING), 2, '0') "
        "|| lpad(CAST(c_custkey % 40 AS STRING), 3, '0') AS lsoa",
        "IF(c_custkey % 7 <> 0, 1, 0) AS in_gp",
        "c_nationkey",
    )


def nations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("area"))


def persons(spark: SparkSession, sf: str) -> DataFrame:
    """Persons with their area."""
    p = persons_without_area(spark, sf)
    return p.join(nations(spark, sf), p.c_nationkey == F.col("n_nationkey")).drop(
        "c_nationkey", "n_nationkey"
    )


def cohort(spark: SparkSession, sf: str) -> DataFrame:
    """The person columns that rates need."""
    return persons(spark, sf).select("pid", "area", "dob", "imd10")


def small_areas(spark: SparkSession, sf: str) -> DataFrame:
    """Small area -> area with repeated rows, as an address file would hold them."""
    return persons(spark, sf).selectExpr("lsoa", "area", "'A' || substring(lsoa, 4, 2) AS area_code")


def events(
    spark: SparkSession, sf: str, after: str | None = None, before: str | None = None
) -> DataFrame:
    """One event per order inside an open date range that reaches the scan."""
    orders = table(spark, sf, "orders")
    if after is not None:
        start = dt.datetime.fromisoformat(after) + dt.timedelta(days=1)
        orders = orders.where(F.col("o_orderdate") >= F.lit(start).cast("timestamp_ntz"))
    if before is not None:
        end = dt.datetime.fromisoformat(before)
        orders = orders.where(F.col("o_orderdate") < F.lit(end).cast("timestamp_ntz"))
    return orders.selectExpr(
        "o_orderkey AS event_id",
        "o_custkey AS pid",
        "CAST(o_orderdate AS DATE) AS event_date",
        "trunc(CAST(o_orderdate AS DATE), 'month') AS event_mo",
        "o_orderpriority AS category",
        "o_orderstatus AS archived_on",
    )


def admissions(
    spark: SparkSession, sf: str, after: str | None = None, before: str | None = None
) -> DataFrame:
    """Events with a joined list of 3-character codes and one 4-character code."""
    return events(spark, sf, after, before).selectExpr(
        "event_id",
        "pid",
        "event_date",
        "concat_ws(',', 'I' || (event_id % 7 + 60), 'I' || (pid % 5 + 20), archived_on) AS code_concat",
        "'I' || (event_id % 7 + 60) || (pid % 10) AS code4",
    )


def records(
    spark: SparkSession, sf: str, codes: DataFrame | None = None, first_of: str | None = None
) -> DataFrame:
    """One dated, coded record per order line, with a value that is missing at times.

    `codes` keeps only the records whose `code` it holds and adds its other
    columns, before the person is looked up: the other lines are not shuffled.
    `first_of` keeps the first line of each order and value of that column, also before
    the lookup: an order with very many lines then brings one row per value.
    """
    lines = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS event_id",
        "l_linenumber AS line",
        "CAST(l_shipdate AS DATE) AS event_date",
        "l_partkey AS code",
        "IF(l_quantity <= 45, l_quantity, NULL) AS value",
    )
    if codes is not None:
        how = "left_semi" if codes.columns == ["code"] else "inner"
        lines = lookup_join(lines, codes, "code", how)
    if first_of is not None:
        lines = first_event(lines, ("event_id", first_of), ("event_date", "line"))
    owner = table(spark, sf, "orders").selectExpr("o_orderkey AS event_id", "o_custkey AS pid")
    return lines.join(owner, "event_id")


def parts_as_codes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS code", "p_brand AS cluster", "p_name AS description"
    )


def drug_categories(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr("p_partkey AS code", "p_type AS category")


def deaths(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as registered deaths: date as text and an underlying cause."""
    return table(spark, sf, "orders").selectExpr(
        "o_custkey AS pid",
        "date_format(o_orderdate, 'yyyyMMdd') AS reg_dod",
        "'Brand#' || (o_orderkey % 25 + 1) || '/' || (o_custkey * 7 % 50 + 1) AS cause",
    )


def cause_codes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "p_type AS code", "p_brand || '/' || p_size AS cause", "p_name AS description"
    )


def adults_by_year(spark: SparkSession, sf: str) -> DataFrame:
    """Every person in each year of the history, with the age at mid-year."""
    return (
        persons(spark, sf)
        .selectExpr("area", "dob", f"explode(sequence({FIRST_YEAR}, {LAST_YEAR})) AS year")
        .withColumn("age", age_years(F.expr("make_date(year, 6, 1)"), F.col("dob")))
        .where("age >= 18")
    )


def population_history(spark: SparkSession, sf: str) -> DataFrame:
    """Population per area, year and band: 100 per adult person plus a floor per band."""
    band = age_band_open(F.col("age"))
    counted = (
        adults_by_year(spark, sf)
        .withColumn("band", band)
        .groupBy("area", "year")
        .agg(*[F.count_if(F.col("band") == b).alias(b) for b in BAND_LABELS])
    )
    cells = ", ".join(
        f"'{b}', CAST(`{b}` * 100 + {50 + 10 * i} AS DOUBLE)" for i, b in enumerate(BAND_LABELS, 1)
    )
    stacked = f"stack({len(BAND_LABELS)}, {cells}) AS (age_gp, population)"
    return counted.selectExpr("area", "year", stacked)


def spells(spark: SparkSession, sf: str) -> DataFrame:
    """A spell of follow-up around each order: they overlap, nest and touch; some have no end, some no day."""
    return table(spark, sf, "orders").selectExpr(
        "o_custkey AS pid",
        "date_sub(CAST(o_orderdate AS DATE), CAST(o_orderkey * 37 % 200 AS INT)) AS start_date",
        "IF(o_orderkey % 50 <> 0, date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey * 53 % 120 - 5 AS INT)), NULL) "
        "AS end_date",
    )


def long_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Events with a code of 3 to 6 characters."""
    return events(spark, sf).selectExpr(
        "event_id",
        "'I' || (event_id % 7 + 60) || substring(CAST(event_id * 7 % 1000 AS STRING), 1, CAST(event_id % 4 AS INT)) "
        "AS code",
    )


def short_codes(spark: SparkSession, sf: str) -> DataFrame:
    """A code list with codes of 3, 4 and 5 characters, some of which begin with others."""
    return table(spark, sf, "part").selectExpr(
        "substring('I' || (p_partkey % 9 + 58) || (p_partkey * 3 % 10) || (p_partkey * 7 % 10), 1, "
        "CAST(3 + p_partkey DIV 9 % 3 AS INT)) AS code",
        "p_brand AS subtype",
    )
