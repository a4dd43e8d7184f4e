"""Sources and sinks: registries, inboxes, delimited files, snapshots with manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.docs import media_type
from ..operators.hashing import insert_ignore


def registry(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """JSON documents of one or many lines each; unreadable ones come out as nulls rather than failing."""
    reader = spark.read.option("multiLine", "true").option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path).withColumn("source_file", F.col("_metadata.file_name"))


def inbox(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder with size, hash and media type; contents are not kept."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", F.sha2("content", 256).alias("sha256"), media_type(F.col("path")).alias("media_type"))


def delimited(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """CSV or TSV with a header line, byte order mark and quoted line breaks allowed, all columns text."""
    got = spark.read.option("header", "true").option("multiLine", "true").option("sep", delimiter).option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").csv(path)
    return got.toDF(*[c.lstrip("﻿") for c in got.columns])


def export_snapshot(df: DataFrame, path: str, order: list[str]) -> DataFrame:
    """Writes rows as JSON lines in a total order, fields sorted by name, and returns (n, sha256) of all lines."""
    fields = sorted(df.columns)
    lines = df.select(*order, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("line"))
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)
    return manifest(df, order)


def manifest(df: DataFrame, order: list[str]) -> DataFrame:
    """(n, digest): number and digest of the rows, whatever their order.

    Each row's hash is cut into eight numbers that are summed, so partial sums meet and no
    task ever holds more than one row; the digest hashes the sums. Repeated rows count.
    """
    fields = sorted(df.columns)
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]), 256)
    words = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)") for i in range(8)]
    got = df.select(row.alias("h")).agg(F.count("*").alias("n"), *[w.alias(f"s{i}") for i, w in enumerate(words)])
    return got.select("n", F.sha2(F.concat_ws(",", "n", *[F.coalesce(F.col(f"s{i}").cast("string"), F.lit("0")) for i in range(8)]), 256).alias("digest"))


def import_snapshot(spark: SparkSession, path: str, store: DataFrame, schema, keys: list[str], order: list[str], digest: str, known: str | None) -> DataFrame:
    """Rows of a snapshot that the store lacks; nothing if its digest is already known, an error if it doesn't match."""
    rows = spark.read.schema(schema).json(path)
    if digest == known:
        return rows.limit(0)
    if manifest(rows, order).first()["digest"] != digest:
        raise ValueError("snapshot doesn't match its digest")
    return insert_ignore(store, rows, keys, order)
