"""Tolerant CSV input, typed CSV input, CSV and parquet output, previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

CORRUPT = "_corrupt_record"


def read_text_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
                  encoding: str = "UTF-8") -> DataFrame:
    """Every column as text; rows that do not fit the header keep their source line.

    The header is read from one line only. Undecodable bytes become replacement characters.
    Files in which some line holds an odd number of quotes have cells that run over lines; these
    files are read whole by one task each, all others in splits.
    """
    if columns is None:
        columns = spark.read.option("header", True).option("encoding", encoding).csv(path).columns
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in columns],
                           T.StructField(CORRUPT, T.StringType())])
    reader = (lambda lines: spark.read.option("header", True).option("mode", "PERMISSIVE")
              .option("encoding", encoding).option("columnNameOfCorruptRecord", CORRUPT)
              .option("multiLine", lines).schema(schema))
    files, broken = spark.read.text(path).inputFiles(), set(files_with_broken_cells(spark, path))
    if not broken:
        return reader(False).csv(path)
    whole = reader(True).csv(sorted(f for f in files if f in broken))
    rest = sorted(f for f in files if f not in broken)
    return whole.unionByName(reader(False).csv(rest)) if rest else whole


def files_with_broken_cells(spark: SparkSession, path: str) -> list[str]:
    """Files with a line whose quotes do not pair up, escaped ones left out; one name per file."""
    quotes = F.regexp_replace(F.regexp_replace("value", r'\\\\.', ""), '[^"]', "")
    odd = spark.read.text(path).where(F.length(quotes) % 2 == 1)
    return [r["file"] for r in odd.select(F.input_file_name().alias("file")).distinct().collect()]


def stage_text_csv(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """(rows that fitted the header, source lines that did not), parsed once.

    The parsed rows are written to the shared folder, since everything after reads them often
    and Spark cannot tell good from bad lines without parsing the file again.
    """
    rows = written(read_text_csv(spark, path, **options))
    good = rows.where(f"{CORRUPT} IS NULL").drop(CORRUPT)
    return good, rows.where(f"{CORRUPT} IS NOT NULL").select(CORRUPT)


def read_typed_csv(spark: SparkSession, path: str) -> DataFrame:
    """Types inferred from the contents, at the price of one more pass."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    (df.write.mode(mode).option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists",
                  partition_by: Sequence[str] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def preview(df: DataFrame, n: int = 20, order: Sequence[str] = ()) -> DataFrame:
    """First rows; with an order key the same ones every time."""
    return (df.orderBy(*order) if order else df).limit(n)
