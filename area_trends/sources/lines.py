"""Lines of text files in the order of the file, read as splits; rows that do not fit a schema."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType, StructType

from ..operators.joins import lookup_join
from .tables import materialise


def file_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """file, start (of the split, in bytes), at (rising within a split) and line.

    A large file is many splits, read by as many tasks; compressed files are one each.
    """
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("line"),
    )


def carried_in(splits: DataFrame, *sums: str) -> DataFrame:
    """Adds `before_<name>` for each of the sums: its total over the file's splits before this one.

    The prefix scan over split summaries, one small row each; rows of the file itself
    are not brought together.
    """
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    return splits.withColumns({f"before_{s}": F.coalesce(F.sum(s).over(before), F.lit(0)) for s in sums})


def split_key() -> Column:
    """One column for a split, to look its carried values up by."""
    return F.struct("file", "start").alias("split")


def number_lines(lines: DataFrame) -> DataFrame:
    """Adds line_no (1, 2, ... per file) to written `file_lines`.

    Lines of a split are numbered by their distance from its first one, splits by the counts of
    those before.
    """
    splits = lines.groupBy("file", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    held = carried_in(splits, "n").select(split_key(), "first", "before_n")
    found = lookup_join(lines.withColumn("split", F.struct("file", "start")), held, "split")
    number = F.col("at") - F.col("first") + 1 + F.col("before_n")
    return found.withColumn("line_no", number).drop("split", "first", "before_n")


def csv_fields(line: Column, sep: str = ",") -> Column:
    """Fields of a line; quoted ones may hold separators and doubled quotes, blanks are null."""
    s = {"\t": r"\t", "|": r"\|"}.get(sep, sep)
    raw = F.regexp_extract_all(line, F.lit(rf'(?:^|{s})(\s*"(?:[^"]|"")*"\s*|[^{s}]*)'), F.lit(1))
    bare = F.transform(raw, lambda x: F.trim(F.regexp_replace(x, r'^\s*"|"\s*$', "")))
    clean = F.transform(bare, lambda x: F.replace(x, F.lit('""'), F.lit('"')))
    return F.transform(clean, lambda x: F.when(x != "", x))


@dataclass
class Checked:
    """What a checked read found.

    good: the rows of the schema. rejected: file, line_no, line and reason of every other line.
    totals: per file its lines, header (0 or 1), blank, good and rejected lines.
    """

    good: DataFrame
    rejected: DataFrame
    totals: DataFrame


def read_checked(
    spark: SparkSession, paths: str | Sequence[str], schema: str | StructType, sep: str = ",", header: bool = True
) -> Checked:
    """Delimited files, with every line that does not fit the schema beside the rows that do.

    Each file's first line is its header, which must hold the names of the schema in its order;
    otherwise it is rejected as `header`. Lines without text are `blank`: counted, and neither
    good nor rejected. Other lines are rejected for `missing fields`, `extra fields`, an
    `open quote`, or `wrong type: <columns>`; a blank field is null and fits every type. Blank text is
    '' in the good rows, as in `read_csv`. Quotes inside quoted text are doubled; a line break ends a row.

    The files are parsed once, as splits, and stored; only a line that does not fit is taken apart
    again for its reason. For each file, good, rejected, blank and header lines add up to its lines.
    """
    if not isinstance(schema, StructType):
        schema = StructType.fromDDL(schema)
    names = schema.fieldNames()
    options = {"sep": sep, "escape": '"', "columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}
    typed = StructType([*schema.fields]).add("_bad", StringType())
    lines = file_lines(spark, paths)
    parsed = lines.withColumn("row", F.from_csv("line", _ddl(typed), options))
    lines = materialise(parsed, "parsed_lines")
    numbered = number_lines(lines)

    fields = csv_fields(F.col("line"), sep)
    blank = F.trim(F.col("line")) == ""
    first = (F.col("line_no") == 1) if header else F.lit(False)
    as_named = F.transform(fields, lambda x: F.lower(x)) == F.array(*[F.lit(n.lower()) for n in names])
    wrong = F.concat_ws(
        ", ",
        *[
            F.when(F.get(fields, F.lit(i)).isNotNull() & F.col(f"row.`{n}`").isNull(), F.lit(n))
            for i, n in enumerate(names)
        ],
    )
    no_quotes = F.replace(F.col("line"), F.lit('"'), F.lit(""))
    open_quote = (F.char_length("line") - F.char_length(no_quotes)) % 2 == 1
    reason = (
        F.when(open_quote, "open quote")
        .when(F.size(fields) < len(names), "missing fields")
        .when(F.size(fields) > len(names), "extra fields")
        .otherwise(F.concat(F.lit("wrong type: "), wrong))
    )
    kind = (
        F.when(first & F.coalesce(as_named, F.lit(False)), "header")
        .when(first, "bad header")
        .when(blank, "blank")
        .when(F.col("row._bad").isNotNull() | open_quote, "rejected")
        .otherwise("good")
    )
    sorted_lines = numbered.withColumn("kind", kind)
    cells = {f.name: F.col(f"row.`{f.name}`") for f in schema.fields}
    for f in schema.fields:
        if f.dataType == StringType():
            cells[f.name] = F.coalesce(cells[f.name], F.lit(""))
    good = sorted_lines.where("kind = 'good'").select(*[c.alias(n) for n, c in cells.items()])
    rejected = sorted_lines.where("kind in ('rejected', 'bad header')").select(
        "file", "line_no", "line", F.when(F.col("kind") == "bad header", "header").otherwise(reason).alias("reason")
    )
    totals = sorted_lines.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("kind") == "header").alias("header"),
        F.count_if(F.col("kind") == "blank").alias("blank"),
        F.count_if(F.col("kind") == "good").alias("good"),
        F.count_if(F.col("kind").isin("rejected", "bad header")).alias("rejected"),
    )
    return Checked(good, rejected, totals)


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
