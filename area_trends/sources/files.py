"""CSV and TSV readers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.fixed_values import POPULATION_AGE_BANDS
from ..operators.codelists import literal_map
from ..operators.joins import lookup_join
from .lines import Checked, carried_in, csv_fields, file_lines, number_lines
from .tables import materialise


def read_csv(
    spark: SparkSession, paths: str | Sequence[str], schema: str | None = None, multi_line: bool = False
) -> DataFrame:
    """CSV parts with a header; blank text is '' and not null.

    A quote inside quoted text is written twice. `multi_line` also allows line breaks
    inside quotes; each file is then read by one task, so it suits code lists and exports.
    The header must name the columns of the schema in its order, or Spark raises.
    Without a schema Spark reads the files once more to infer the types.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    if schema is None:
        df = reader.option("inferSchema", True).csv(paths)
    else:
        df = reader.schema(schema).option("enforceSchema", False).csv(paths)
    text = [name for name, kind in df.dtypes if kind == "string"]
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in text})


def read_tsv(
    spark: SparkSession, paths: str | Sequence[str], schema: str, multi_line: bool = True
) -> DataFrame:
    """Tab-separated code lists with a header; blanks around text are removed.

    Quotes and `multi_line` are as in `read_csv`; code lists are small, so it is on.
    """
    reader = spark.read.schema(schema).option("enforceSchema", False).option("header", True)
    df = reader.option("sep", "\t").option("escape", '"').option("multiLine", multi_line).csv(paths)
    return df.withColumns({name: F.trim(name) for name, kind in df.dtypes if kind == "string"})


def year_in_path(path: Column) -> Column:
    """Year of a file or folder named `..._<year>.csv`."""
    return F.try_to_number(F.regexp_extract(path, r"_(\d{4})\.csv(/[^/]*)?$", 1), F.lit("9999")).cast("int")


def number_from_text(text: Column) -> Column:
    """Number of digits, sign, point and exponent, with thousands commas; other text is null."""
    plain = F.trim(F.regexp_replace(text, ",", ""))
    return F.when(plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), plain.try_cast("double"))


def population_long(
    spark: SparkSession,
    paths: Sequence[str],
    age_bands: Mapping[str, str] = POPULATION_AGE_BANDS,
) -> DataFrame:
    """Yearly files (`Age` and a column per area) as rows (year, age_gp, area, population).

    The year is read from the file name and an age label outside `age_bands`
    gives a null band. Files may hold different areas: one scan reads all files, each
    whole, and takes the column names of a file from its own first line.
    """
    files = spark.read.text(list(paths), wholetext=True).select(
        year_in_path(F.col("_metadata.file_path")).alias("year"),
        F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "").alias("lines"),
    )
    lines = files.select(
        "year",
        csv_fields(F.get("lines", F.lit(0))).alias("names"),
        F.explode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line"),
    )
    fields = lines.select("year", "names", csv_fields(F.col("line")).alias("f"))
    age = F.get("f", F.array_position("names", "Age").cast("int") - 1)
    cells = fields.select("year", age.alias("Age"), F.explode(F.arrays_zip("names", "f")).alias("cell"))
    long = cells.where("cell.names != 'Age'").select(
        "year", "Age", F.col("cell.names").alias("area"), F.col("cell.f").alias("text")
    )
    return long.select(
        "year",
        F.make_date("year", F.lit(6), F.lit(1)).alias("mid_year"),
        literal_map(age_bands, F.col("Age")).alias("age_gp"),
        "area",
        number_from_text(F.col("text")).alias("population"),
    )


def population_checked(
    spark: SparkSession,
    paths: Sequence[str],
    age_bands: Mapping[str, str] = POPULATION_AGE_BANDS,
) -> Checked:
    """`population_long` of the lines that are whole, with the others beside them.

    A file's first line names its columns, one of them `Age`; otherwise all its lines are rejected for their
    `header`. Lines are rejected for `missing fields`, `extra fields`, or `no number: <areas>` where a
    cell that is not blank is none. Files are read as splits, and may be of any size.
    """
    lines = materialise(file_lines(spark, list(paths)), "population_lines")
    lines = number_lines(lines).withColumn("f", csv_fields(F.col("line")))
    lines = materialise(lines.drop("start", "at"), "population_fields")
    heads = lines.where("line_no = 1").select("file", F.col("f").alias("names"))
    body = lookup_join(lines, heads, "file")
    cells = F.filter(F.arrays_zip("names", "f"), lambda c: ~c["names"].eqNullSafe(F.lit("Age")))
    wrong = F.filter(cells, lambda c: c["f"].isNotNull() & number_from_text(c["f"]).isNull())
    body = body.withColumn(
        "reason",
        F.when(~F.coalesce(F.array_contains("names", "Age"), F.lit(False)), "header")
        .when(F.col("line_no") == 1, None)
        .when(~F.exists("f", lambda x: x.isNotNull()), None)
        .when(F.size("f") < F.size("names"), "missing fields")
        .when(F.size("f") > F.size("names"), "extra fields")
        .when(F.size(wrong) > 0, F.concat(F.lit("no number: "), F.array_join(F.transform(wrong, lambda c: c["names"]), ", "))),
    )
    fits = F.col("reason").isNull()
    head, blank = F.col("line_no") == 1, ~F.exists("f", lambda x: x.isNotNull())
    rejected = body.where(~fits).select("file", "line_no", "line", "reason")
    totals = body.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(fits & head).alias("header"),
        F.count_if(fits & ~head & blank).alias("blank"),
        F.count_if(fits & ~head & ~blank).alias("good"),
        F.count_if(~fits).alias("rejected"),
    )
    age = F.get("f", F.array_position("names", "Age").cast("int") - 1)
    whole = body.where(fits & ~head & ~blank).select(year_in_path(F.col("file")).alias("year"), age.alias("Age"), F.explode(cells).alias("c"))
    good = whole.select(
        "year",
        F.make_date("year", F.lit(6), F.lit(1)).alias("mid_year"),
        literal_map(age_bands, F.col("Age")).alias("age_gp"),
        F.col("c.names").alias("area"),
        number_from_text(F.col("c.f")).alias("population"),
    )
    return Checked(good, rejected, totals)


def _block_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """file, f (fields), seq (1, 2, ... over a file's lines with text), mark and block.

    The title does not count. Two passes over splits: the first counts the lines and marks of
    each, a prefix scan of these few rows gives what comes before it, and the second numbers
    the lines within their split from there on.
    """
    lines = file_lines(spark, paths).withColumn("f", csv_fields(F.col("line"))).drop("line")
    held = F.exists("f", lambda x: x.isNotNull())
    mark = F.coalesce(F.col("f")[0].contains("Date"), F.lit(False))
    title = F.min_by(F.struct(held.cast("int").alias("lines"), mark.cast("int").alias("marks")), "at")
    first = F.col("start") == 0
    splits = lines.groupBy("file", "start").agg(
        F.sum(held.cast("int")).alias("lines"), F.sum(mark.cast("int")).alias("marks"), title.alias("title")
    )
    for name in ("lines", "marks"):
        splits = splits.withColumn(name, F.col(name) - F.when(first, F.col(f"title.{name}")).otherwise(0))
    scanned = carried_in(splits, "lines", "marks").select("file", "start", "before_lines", "before_marks")

    here = W.partitionBy("file", "start").orderBy("at")
    body = lines.withColumns({"held": held, "mark": mark, "place": F.row_number().over(here)})
    body = body.where(F.col("held") & ~((F.col("start") == 0) & (F.col("place") == 1)))
    body = body.withColumns(
        {"n": F.row_number().over(here), "marks": F.sum(F.col("mark").cast("int")).over(here)}
    )
    # the lines lie by split already
    return body.join(scanned, ["file", "start"]).select(
        "file",
        "f",
        "mark",
        (F.col("n") + F.col("before_lines")).alias("seq"),
        (F.col("marks") + F.col("before_marks")).alias("block"),
    )


def population_blocks(spark: SparkSession, paths: str | Sequence[str], trailing: int = 2) -> DataFrame:
    """Export files with one block per year, as rows (file, year, area, age, population).

    A file starts with a title line. A line whose first field contains `Date`
    opens a block and holds the year in its second field. Blank lines do not
    count; the second line of a block names the columns, the lines after it hold
    one area each, and all blocks but a file's last end in `trailing` other lines.

    Files are read as splits, however large one is. Lines are numbered by a prefix scan over the
    splits; a block's year and column names, one row per block, are then joined to its lines,
    wherever they lie.
    """
    lines = materialise(_block_lines(spark, paths), "block_lines")
    after = F.lead("seq").over(W.partitionBy("file").orderBy("block"))
    marks = lines.where("mark").select("file", "block", "seq", F.get("f", F.lit(1)).alias("year"), after.alias("until"))
    heads = marks.withColumn("seq", F.col("seq") + 2).withColumnRenamed("seq", "named")
    names = lines.where("NOT mark").select("file", "block", F.col("seq").alias("named"), F.col("f").alias("ages"))
    heads = heads.join(names, ["file", "block", "named"])
    body = lines.where("NOT mark").join(heads, ["file", "block"]).where(F.col("seq") > F.col("named"))
    body = body.where(F.coalesce(F.col("until") - F.col("seq") > trailing, F.lit(True)))
    cells = body.select(
        "file",
        F.col("year").try_cast("int").alias("year"),
        F.col("f")[0].alias("area"),
        F.explode(F.slice(F.arrays_zip("ages", "f"), 2, F.greatest(F.size("ages") - 1, F.lit(0)))).alias("c"),
    )
    return cells.where(F.col("c.ages").isNotNull()).select(
        "file", "year", "area", F.col("c.ages").alias("age"),
        number_from_text(F.col("c.f")).alias("population"),
    )


def ages_by_area(long: DataFrame, areas: Sequence[str] | None = None) -> DataFrame:
    """Blocks turned round: one row per year and age, one column per area.

    Areas that are not given are left out; without a list all areas that occur are
    found by one aggregation while the plan is built.
    """
    names = None if areas is None else list(areas)
    wide = long.groupBy("year", "age").pivot("area", names).agg(F.max("population"))
    return wide.withColumnRenamed("age", "Age")
