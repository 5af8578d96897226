"""Scans and sinks for CSV, JSON lines and folders of files."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column a string, missing cells empty; quoted newlines and doubled quotes are understood, blank lines dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return df.na.drop("all").na.fill("")


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The given columns in order, each file with a byte order mark, a header and CRLF line ends; nulls are empty cells, spaces stay.

    Cells are quoted only where they hold a quote, a comma or a line end, so
    the lines are made here and written as text (files end in .txt). An empty table gives one file
    with the header.
    """
    cell = lambda c: F.when(c.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    names = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in '",\r\n') else c for c in columns)
    lines = df.select(F.concat_ws(",", *[F.coalesce(cell(df[c].cast("string")), F.lit("")) for c in columns]).alias("value"))

    def headed(batches):
        yield pa.record_batch({"value": [f"\ufeff{names}"]})
        for b in batches:
            yield pa.record_batch({"value": b.column(0)})

    # One partition makes one file.
    lines.mapInArrow(headed, "value string").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def read_optional_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A JSON document of several lines, or None if there is no such file."""
    if not _exists(spark, path):
        return None
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("multiLine", True).json(path)


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """One small report, indented by two, with its keys in the order given. Rows of a table go through ``write_jsonl``."""
    text = json.dumps(report, ensure_ascii=False, indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Constant rows kept as a CSV file, in the types of ``schema``; empty cells are null, and a cell of another type is an error."""
    columns = spark.createDataFrame([], schema).schema
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*[F.col(c.name).cast(c.dataType).alias(c.name) for c in columns])


def count_rows(spark: SparkSession, path: str) -> int:
    """Rows of a CSV ledger, 0 if there is none."""
    return read_csv(spark, path).count() if _exists(spark, path) else 0


def read_json_arrays(spark: SparkSession, path: str) -> DataFrame:
    """All rows of JSON array files, with the file's name as precedence."""
    return spark.read.option("multiLine", True).json(path).withColumn("file_name", F.col("_metadata.file_name"))


def list_files(spark: SparkSession, root: str, suffix: str = ".pdf") -> DataFrame:
    """(path, issuer, size, sha256) of files below a folder, by suffix in any case; the issuer is the folder that a file lies in."""
    glob = "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)
    issuer = F.regexp_extract("path", "([^/]+)/[^/]+$", 1)
    return files.select("path", issuer.alias("issuer"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
