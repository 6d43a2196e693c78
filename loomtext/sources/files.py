"""Text sources: directory trees, news and book files, line searches, surveys. All through Spark's readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.scalars import absolute_path, file_suffix, strip_html


def text_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, text): whole files of a tree whose names fit the pattern."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def encoded_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, text): decoded by the suffix of the file name: -8 Latin-1, -0 UTF-8, others ASCII."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    suffix = file_suffix(F.col("path"))
    text = F.when(suffix == "8", F.decode("content", "ISO-8859-1")).when(suffix == "0", F.decode("content", "UTF-8")).otherwise(F.decode("content", "US-ASCII"))
    return raw.select("path", text.alias("text"), F.col("length").alias("size"))


def news(files: DataFrame) -> DataFrame:
    """(path, title, body): the first line is the title."""
    parts = F.split("text", "\n", 2)
    return files.select("path", F.element_at(parts, 1).alias("title"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("body"))


def label(text: Column, name: str) -> Column:
    """What follows 'Name: ' on its line, or an empty string."""
    return F.trim(F.regexp_extract(text, rf"(?m)^{name}:[ \t]*([^\r\n]*)", 1))


def books(files: DataFrame) -> DataFrame:
    """(path, title, author, language, header, body, footer): of files with *** START and *** END lines; without them all is body."""
    begin, finish = r"(?m)^\*\*\* ?START[^\n]*\n", r"(?m)^\*\*\* ?END[^\n]*$"
    parts = F.split("text", begin, 2)
    header = F.when(F.size(parts) > 1, F.element_at(parts, 1)).otherwise(F.lit(""))
    rest = F.split(F.element_at(parts, -1), finish, 2)
    return files.select(
        "path", label(header, "Title").alias("title"), label(header, "Author").alias("author"), label(header, "Language").alias("language"), header.alias("header"),
        F.element_at(rest, 1).alias("body"), F.when(F.size(rest) > 1, F.element_at(rest, 2)).otherwise(F.lit("")).alias("footer"),
    )


def posts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Each key once (the first text in order), tags stripped."""
    first = df.groupBy(key).agg(F.min(text).alias(text))
    return first.withColumn(text, strip_html(F.col(text)))


def not_loaded(new: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """The new rows whose key isn't loaded yet."""
    return new.join(loaded.select(key), key, "left_anti")


def external_field(df: DataFrame, files: DataFrame, field: str, path_column: str, root: str) -> DataFrame:
    """df with the field filled from files named by a column, where it is missing."""
    at = absolute_path(F.col(path_column), F.lit(root))
    tail = files.select(F.regexp_replace("path", r"^[a-z]+:/+", "/").alias("_p"), F.col("text").alias("_t"))
    joined = df.withColumn("_at", at).join(tail, F.col("_at") == F.col("_p"), "left")
    kept = F.coalesce(F.col(field), F.col("_t")) if field in df.columns else F.col("_t")
    return joined.withColumn(field, kept).drop("_at", "_p", "_t")


def grep(spark: SparkSession, root: str, needle: str, pattern: str = "*") -> DataFrame:
    """(path, line): lines that contain a string."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    return lines.filter(F.col("value").contains(needle)).select(F.input_file_name().alias("path"), F.col("value").alias("line"))


def survey(files: DataFrame) -> DataFrame:
    """One row: files, their size together and on average (rounded down), and how many are empty; from a `size` column."""
    size = F.col("size")
    return files.agg(F.count("*").alias("files"), F.sum(size).alias("total"), F.floor(F.avg(size)).cast("long").alias("average"), F.count_if(size == 0).alias("empty"))


def by_suffix(files: DataFrame) -> DataFrame:
    return files.groupBy(file_suffix(F.col("path")).alias("suffix")).agg(F.count("*").alias("n"))


def line_count(text: Column) -> Column:
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, "\n", -1)) - F.when(text.endswith("\n"), 1).otherwise(0))


def empty_titles(books: DataFrame, column: str = "title") -> DataFrame:
    """(documents, empty): how many have no title."""
    return books.agg(F.count("*").alias("documents"), F.count_if(F.coalesce(F.trim(F.col(column)), F.lit("")) == "").alias("empty"))
