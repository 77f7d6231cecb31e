"""Files written by Spark from the star-schema tables, to be read by the file sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed_values import POPULATION_AGE_BANDS
from ..sources.tables import save_csv, scratch_folder
from . import star

AGE_LABELS = tuple(POPULATION_AGE_BANDS)
#: text in place of a number that is missing
NO_NUMBER = ("!", "NaN", "Infinity", "12d", "-")
REGIONS = tuple(range(5))


def age_label(age: Column) -> Column:
    """Label of a population file: single years to 19, five-year bands, open from 85."""
    low = (F.floor(age / 5) * 5).cast("int")
    return (
        F.when(age < 20, F.concat(F.lit("Age "), F.floor(age).cast("string")))
        .when(age >= 85, "Aged 85+")
        .otherwise(F.concat(F.lit("Aged "), low.cast("string"), F.lit("-"), (low + 4).cast("string")))
    )


def label_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Adults per year, area and age label, times 1000 (so that files hold commas)."""
    return (
        star.adults_by_year(spark, sf)
        .groupBy("year", "area", age_label(F.col("age")).alias("Age"))
        .agg((F.count(F.lit(1)) * 1000).alias("n"))
    )


def area_names(spark: SparkSession, sf: str) -> list[str]:
    """Names of the areas in the order of their keys; there are as many as rows in `nation`."""
    rows = star.table(spark, sf, "nation").select("n_nationkey", "n_name").collect()
    return [r["n_name"] for r in sorted(rows)]


def _text(n: Column, place: int = 0) -> Column:
    return F.coalesce(F.format_number(n, 0), F.lit(NO_NUMBER[place % len(NO_NUMBER)]))


def yearly_files(spark: SparkSession, sf: str) -> list[str]:
    """One file per year: a row per age label and one for all ages, a column per area."""
    counts = label_counts(spark, sf)
    total = counts.groupBy("year", "area").agg(F.sum("n").alias("n"))
    both = counts.unionByName(total.withColumn("Age", F.lit("All ages")))
    areas = area_names(spark, sf)
    wide = both.groupBy("year", "Age").pivot("area", areas).agg(F.sum("n"))
    wide = wide.select("year", "Age", *[_text(F.col(f"`{a}`"), i).alias(a) for i, a in enumerate(areas)])
    path = scratch_folder(spark, "population")
    name = F.format_string("pop_%d.csv", "year")
    wide.withColumn("file", name).drop("year").write.partitionBy("file").option("header", True).csv(path)
    years = range(star.FIRST_YEAR, star.LAST_YEAR + 1)
    return [f"{path}/file=pop_{year}.csv" for year in years]


def block_files(spark: SparkSession, sf: str) -> str:
    """One file per region with a block per year, as an export tool lays it out."""
    nation = star.table(spark, sf, "nation").select(
        F.col("n_name").alias("area"), F.col("n_regionkey").alias("region")
    )
    quoted = [F.concat(F.lit('"'), _text(F.col(f"`{a}`"), i), F.lit('"')) for i, a in enumerate(AGE_LABELS)]
    blank = "," * len(AGE_LABELS)
    names = ",".join(f'"{a}"' for a in AGE_LABELS)
    rows = (
        label_counts(spark, sf)
        .groupBy("year", "area")
        .pivot("Age", list(AGE_LABELS))
        .agg(F.sum("n"))
        .join(nation, "area")
        .select(
            "region",
            "year",
            F.lit(2).alias("part"),
            "area",
            F.concat_ws(",", F.concat(F.lit('"'), F.col("area"), F.lit('"')), *quoted).alias("line"),
        )
    )
    years = rows.select("region", "year").distinct()
    text = F.col("year").cast("string")
    head = years.withColumn(
        "lines",
        F.array(
            F.concat(F.lit('"Date :",'), text, F.lit(blank[1:])),
            F.lit(blank),
            F.lit('"lad","Age"'),
            F.lit('"local authority",' + names),
        ),
    ).select("region", "year", F.posexplode("lines").alias("part", "line"))
    head = head.select("region", "year", (F.col("part") - 10).alias("part"), F.lit("").alias("area"), "line")
    tail = years.where(F.col("year") < star.LAST_YEAR).withColumn(
        "lines", F.array(F.lit(""), F.lit('"Population estimates"'), F.lit('"Source, as given"'))
    ).select("region", "year", F.posexplode("lines").alias("part", "line"))
    tail = tail.select("region", "year", (F.col("part") + 10).alias("part"), F.lit("").alias("area"), "line")
    title = years.groupBy("region").agg(F.lit(0).alias("year")).select(
        "region", "year", F.lit(0).alias("part"), F.lit("").alias("area"), F.lit('"Population"').alias("line")
    )
    path = scratch_folder(spark, "blocks")
    (
        rows.unionByName(head)
        .unionByName(tail)
        .unionByName(title)
        .repartition("region")
        .sortWithinPartitions("region", "year", "part", "area")
        .select("region", "line")
        .write.partitionBy("region")
        .text(path)
    )
    return path


def area_parts(spark: SparkSession, sf: str) -> list[str]:
    """The small-area file in five parts, one per region."""
    nation = star.table(spark, sf, "nation").select(
        F.col("n_name").alias("area"), F.col("n_regionkey").alias("region")
    )
    path = scratch_folder(spark, "areas")
    (
        star.small_areas(spark, sf)
        .join(nation, "area")
        .select("lsoa", "area", "area_code", "region")
        .write.partitionBy("region")
        .option("header", True)
        .csv(path)
    )
    return [f"{path}/region={r}" for r in REGIONS]


def person_csv(spark: SparkSession, sf: str) -> str:
    path = scratch_folder(spark, "persons")
    more = F.when(F.col("pid") % 7 == 0, "\nnext line").otherwise("")
    note = F.concat(F.lit('said "'), "area", F.lit('", twice'), more)
    save_csv(star.persons(spark, sf).select("pid", "area", "sex", "ethnicity", note.alias("note")), path)
    return path


def code_tsv(spark: SparkSession, sf: str) -> str:
    """Codes with a type that ends in a blank."""
    path = scratch_folder(spark, "codes")
    (
        star.drug_categories(spark, sf)
        .select("code", F.concat("category", F.lit(" ")).alias("subtype"))
        .write.option("header", True)
        .option("sep", "\t")
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path


def event_archive(spark: SparkSession, sf: str) -> str:
    """Events stored in one folder per snapshot."""
    path = scratch_folder(spark, "archive")
    star.events(spark, sf).write.partitionBy("archived_on").parquet(path)
    return path


SNAPSHOTS = ("1996-06-30", "1998-06-30", "2000-06-30")


def dated_archive(spark: SparkSession, sf: str) -> str:
    """Events up to three dates, a folder each; later ones lack some events and change others."""
    path = scratch_folder(spark, "dated")
    days = ", ".join(f"'{d}'" for d in SNAPSHOTS)
    (
        star.events(spark, sf)
        .drop("archived_on")
        .selectExpr("*", f"explode(array({days})) AS archived_on")
        .where("event_date <= CAST(archived_on AS DATE)")
        .where(f"NOT (event_id % 19 = 0 AND archived_on = '{SNAPSHOTS[2]}')")
        .withColumn(
            "category", F.expr(f"IF(event_id % 31 = 0 AND archived_on >= '{SNAPSHOTS[2]}', 'changed', category)")
        )
        .write.partitionBy("archived_on")
        .parquet(path)
    )
    return path


def faulty_csv(spark: SparkSession, sf: str) -> str:
    """Persons in five files, of which some lines are blank or do not fit (pid, balance, day, segment)."""
    path = scratch_folder(spark, "faulty")
    line = """CASE WHEN c_custkey % 11 = 0 THEN c_custkey || ',1.5'
        WHEN c_custkey % 13 = 0 THEN c_custkey || ',1.5,1996-01-01,"a, ""b"" c",more'
        WHEN c_custkey % 17 = 0 THEN c_custkey || ',abc,1996-13-01,x'
        WHEN c_custkey % 19 = 0 THEN c_custkey || ',1.5,1996-01-01,"open'
        WHEN c_custkey % 23 = 0 THEN ''
        ELSE c_custkey || ',' || c_custkey % 100 || '.5,' || IF(c_custkey % 29 = 0, '', '1996-01-01')
             || ',"a ""' || c_mktsegment || '"", b"' END"""
    lines = star.table(spark, sf, "customer").selectExpr("c_custkey % 5 AS part", "c_custkey AS place", f"{line} AS line")
    heads = lines.select("part").distinct().selectExpr("part", "CAST(-1 AS BIGINT) AS place", "'pid,balance,day,segment' AS line")
    (
        lines.unionByName(heads)
        .repartition("part")
        .sortWithinPartitions("part", "place")
        .select("part", "line")
        .write.partitionBy("part")
        .text(path)
    )
    return path
