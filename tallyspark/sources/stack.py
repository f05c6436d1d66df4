"""Stacks of files with unlike columns: one table by column name, nulls where a file
lacks a column, and each row's file (A14, B5)."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE_COL = "文件名"


def base_file(column="_metadata.file_path"):
    """The file's name: path without folders and suffix, percent signs decoded."""
    name = F.element_at(F.split(F.url_decode(F.replace(F.col(column), F.lit("+"), F.lit("%2B"))), "/"), -1)
    return F.regexp_replace(name, r"\.[A-Za-z]+$", "")


def stack_parquet(spark: SparkSession, folder: str, file_col: str = FILE_COL) -> DataFrame:
    """All Parquet files below ``folder``; the union of their schemas is read from the
    footers. The file's whole path comes first (as ``file_col``)."""
    df = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(folder)
    return df.select(F.col("_metadata.file_path").alias(file_col), "*")


def csv_headers(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """(path, header) of every CSV file: each task opens its files and reads the first
    record, no more."""
    def run(frames):
        from tallyspark.sources.xlsx import _open
        for pdf in frames:
            heads = []
            for path in pdf["path"]:
                with _open(path) as fh:
                    heads.append(next(csv.reader(io.TextIOWrapper(fh, "utf-8-sig", newline="")), []))
            yield pd.DataFrame({"path": pdf["path"], "header": heads})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.select("path").mapInPandas(run, "path string, header array<string>")


def unique_names(header: list[str]) -> list[str]:
    """Blank names by position, repeats as ``name.1``, ``name.2``."""
    out: list[str] = []
    for i, h in enumerate(header):
        name = h.strip() or f"Unnamed: {i}"
        n, plain = 0, name
        while name in out:
            n += 1
            name = f"{plain}.{n}"
        out.append(name)
    return out


def stack_csv(spark: SparkSession, folder: str, file_col: str = FILE_COL, glob: str = "*.csv") -> DataFrame:
    """All CSV files below ``folder``, every column as text. Files of one header are one
    read; the reads are stacked by name. Columns come in the order of the header that
    most files have, then by first position in the others."""
    kinds = csv_headers(spark, folder, glob).groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    kinds = sorted(kinds.collect(), key=lambda r: (-len(r["paths"]), r["header"]))  # file names, as any listing holds them
    out = None
    for kind in kinds:
        names = unique_names(kind["header"])
        if not names:
            continue  # an empty file
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        read = spark.read.schema(schema).option("header", "true").option("enforceSchema", "true").option("multiLine", "true")
        df = read.option("escape", '"').csv(kind["paths"]).select(F.col("_metadata.file_path").alias(file_col), *[F.col(f"`{n}`") for n in names])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], f"`{file_col}` string")
    return out
