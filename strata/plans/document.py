"""Documents to governed artifacts as one chain of transforms: ingest, recover, structure, govern, validate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import parsing
from ..operators.docs import governance, media_type


def ingest(df: DataFrame, name: str, data: str) -> DataFrame:
    """Adds hash, length and media type to file bytes."""
    return df.withColumn("sha256", F.sha2(F.col(data), 256)).withColumn("byte_length", F.length(data)).withColumn("media_type", media_type(F.col(name)))


def recover(files: DataFrame, key: str, data: str) -> DataFrame:
    """Blocks of every file with provenance: parser and file hash."""
    blocks = parsing.parsed(files, key, data, "media_type")
    return blocks.join(files.select(key, "sha256"), key).withColumn("source", F.concat_ws(":", "parser", "sha256"))


def artifacts(df: DataFrame, key: str, name: str, data: str) -> DataFrame:
    """One row for each file: identity, coverage, counts, squeezed text and a status."""
    files = ingest(df, name, data)
    blocks = recover(files, key, data)
    counts = blocks.groupBy(key).agg(
        F.count(F.when(F.col("kind") == "heading", 1)).alias("n_headings"),
        F.count(F.when(F.col("kind") == "row", 1)).alias("n_rows"),
        F.max((F.col("kind") == "error").cast("int")).alias("failed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"),
    )
    both = files.select(key, "sha256", "byte_length", "media_type").join(counts, key, "left").join(governance(blocks, key), key, "left")
    status = F.when(F.col("failed") == 1, "failed").when(F.col("n_blocks").isNull(), "capability_gap").when(F.col("retrieval_state") == "content_ingested", "ok").otherwise("partial")
    return both.withColumn("status", status).drop("failed")
