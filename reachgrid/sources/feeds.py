"""Timetable feeds: zip archives of CSV tables, or unpacked CSV files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachgrid.sources.archives import read_feeds

def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(feed, file, row_no, fields) of every zip in ``folder``.

    row_no 0 marks a present file, -1 an unreadable archive. Decode once and :func:`store` the result where many
    tables are needed; for one table :func:`read_table` touches nothing else.
    """
    return read_feeds(spark, folder)


def read_table(spark: SparkSession, folder: str, file: str, columns: Sequence[str]) -> DataFrame:
    """(feed, row_no, columns) of one table straight from the archives: as :func:`feed_table`, the other members stay packed."""
    return read_feeds(spark, folder, file, columns)


def store(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").partitionBy("file").parquet(folder)


def feed_table(rows: DataFrame, file: str, columns: Sequence[str]) -> DataFrame:
    """One table of all feeds as text columns; absent columns are NULL, an absent file is empty."""
    return rows.where((F.col("file") == file) & (F.col("row_no") > 0)).select(
        "feed", "row_no", *[F.trim(F.element_at("fields", F.lit(c))).alias(c) for c in columns])


def feed_files(rows: DataFrame) -> DataFrame:
    """(feed, file) of the files present."""
    return rows.where(F.col("row_no") == 0).select("feed", "file").distinct()


def unreadable(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("row_no") == -1).select("feed")


def read_unpacked(spark: SparkSession, path: str) -> DataFrame:
    """An unpacked CSV table: lower-case trimmed headers, quotes, blank rows dropped."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    named = raw.toDF(*[c.lstrip("﻿").strip().lower() for c in raw.columns])
    filled = F.array(*[F.coalesce(F.trim(F.col(c)), F.lit("")) != "" for c in named.columns])
    return named.where(F.array_contains(filled, True))
