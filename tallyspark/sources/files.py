"""File listing and readers for exports that arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.exprs import base_name, not_contains
from tallyspark.schemas import (SKIP_NAME_FRAGMENT_RECURSIVE, SKIP_NAME_FRAGMENTS,
                                SKIP_NAME_FRAGMENTS_EXTRACT)


def list_files(spark: SparkSession, folder: str, recursive: bool = True,
               suffixes=("xlsx",), exclude=SKIP_NAME_FRAGMENTS) -> DataFrame:
    """Files by suffix, excluding name fragments, recursive or flat (A1).

    Only the listing columns are selected, so the file contents are never
    read. Flat mode lists the folder itself through a glob."""
    glob = "*.{" + ",".join(suffixes) + "}" if len(suffixes) > 1 else f"*.{suffixes[0]}"
    r = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    if recursive:
        df = r.option("recursiveFileLookup", "true").load(folder)
    else:
        df = r.load(folder.rstrip("/") + "/" + glob)
    df = df.select("path", "length", "modificationTime").withColumn("name", base_name("path"))
    for frag in exclude:
        df = df.filter(not_contains("name", frag))
    return df


def list_papers(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """The extraction flow's variant: .xlsx/.xls/.xlsm without the merge,
    log and lock-file fragments; recursive mode also skips trial files."""
    ex = list(SKIP_NAME_FRAGMENTS_EXTRACT) + ([SKIP_NAME_FRAGMENT_RECURSIVE] if recursive else [])
    return list_files(spark, folder, recursive, ("xlsx", "xls", "xlsm"), ex)


LEDGER_HEADERS = [("company_code", "公司代码"), ("func_area", "功能范围：文本"),
                  ("gl_text", "总账科目：短文本"), ("amount_text", "凭证货币价值")]


def _ledger_csv(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The CSV lines as text columns by header, ``_bad`` (a line that doesn't fit the
    header) and the file. Quoted fields may hold commas, quotes and line ends."""
    read = spark.read.option("header", "true").option("inferSchema", "false").option("multiLine", "true").option("escape", '"')
    names = read.csv(path).columns
    schema = ", ".join(f"`{c}` string" for c in [*names, "_bad"])
    df = read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)
    return df.select("*", F.col("_metadata.file_path").alias("file_path")), names


def read_ledger_csv(spark: SparkSession, path: str) -> DataFrame:
    """Expense ledger CSV with a header row, every column as text.
    Missing optional columns come back null; amounts stay text for the
    trailing-minus parser. Lines with more or fewer fields than the header are
    left to :func:`ledger_csv_rejects`."""
    df, names = _ledger_csv(spark, path)
    out = [(F.col(f"`{h}`") if h in names else F.lit(None).cast("string")).alias(c) for c, h in LEDGER_HEADERS]
    return df.where("_bad is null").select(*out, "file_path")


def ledger_csv_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, first_field, line) of the lines that don't fit the header."""
    df, names = _ledger_csv(spark, path)
    return df.where("_bad is not null").select("file_path", F.col(f"`{names[0]}`").alias("first_field"), F.col("_bad").alias("line"))


def read_ledger_rows(rows: DataFrame) -> DataFrame:
    """Expense ledger from workbook sheet rows (header in the first row)."""
    hdr = rows.groupBy("file_name").agg(F.min("row_no").alias("_h"), F.min_by("cells", "row_no").alias("_hdr"))
    body = rows.join(hdr, "file_name").filter(F.col("row_no") > F.col("_h"))
    out = []
    for c, h in LEDGER_HEADERS:
        pos = F.array_position("_hdr", F.lit(h))
        out.append(F.when(pos > 0, F.try_element_at("cells", pos.cast("int"))).alias(c))
    return body.select("file_name", "row_no", *out)
