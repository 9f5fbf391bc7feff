"""File sources and sinks: directory scans, transcript files, processed corpora, aligned lines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rhetorica.operators.util import numbered

PROCESSED_SCHEMA = "speaker string, num_word_types bigint, sents array<array<string>>"


def scan(spark: SparkSession, root: str, ext: str = ".txt") -> DataFrame:
    """(path) of all files under ``root`` with the extension; a missing dot is put before it."""
    ext = ext if ext.startswith(".") else f".{ext}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path").where(F.col("path").endswith(ext))


def transcripts(spark: SparkSession, root: str, pattern: str = r".*\.txt", encoding: str = "utf-8") -> DataFrame:
    """(file_id, raw), one row per file whose path below ``root`` matches the pattern as a whole."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = "^(?:file:)?/*" + re.escape(re.sub(r"^(?:file:)?/*", "", root.rstrip("/"))) + "/"
    rows = files.select(F.regexp_replace("path", base, "").alias("file_id"), "content")
    return rows.where(F.col("file_id").rlike(f"^(?:{pattern})$")).select("file_id", F.decode("content", encoding).alias("raw"))


def write_processed(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(speaker, num_word_types, sents) as JSON lines."""
    df.select("speaker", "num_word_types", "sents").write.mode(mode).json(path)


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROCESSED_SCHEMA).json(path)


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(row_id, text, label) as one table of JSON lines: rows stay together, nothing relies on line numbers."""
    df.select("row_id", "text", "label").write.mode(mode).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("row_id bigint, text string, label string").json(path)


def numbered_lines(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(row_id, column) of a text file's lines, numbered from 0 in file order; the file is split over tasks."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    # within a block of a file ids grow in the order of its lines
    return numbered(rows, [], ["_file", "_block", "_id"], "lines").select((F.col("_n") - 1).alias("row_id"), F.col("value").alias(column))


def read_aligned(spark: SparkSession, texts: str, labels: str) -> DataFrame:
    """(row_id, text, label) from two single files that are aligned by line; files of different
    length raise an error when rows are read."""
    both = numbered_lines(spark, texts, "text").join(numbered_lines(spark, labels, "label"), "row_id", "full")
    broken = F.col("text").isNull() | F.col("label").isNull()
    return both.select("row_id", F.when(broken, F.raise_error(F.lit("the files have different numbers of lines"))).otherwise(F.col("text")).alias("text"), "label")
