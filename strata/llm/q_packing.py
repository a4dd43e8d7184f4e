"""Problem 7: documents in containers of fixed capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table, written
from . import packing


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container number of each document, or piece of one that alone exceeds the capacity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, "doc_id", "text", table(spark, sf_dir, "pack_sizes"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each capacity's containers are filled."""
    sizes = table(spark, sf_dir, "pack_sizes").select("pack_name", "capacity_tokens").distinct()
    bins = p7_containers(spark, sf_dir).groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("pieces"))
    got = bins.groupBy("pack_name").agg(F.count("*").alias("n_containers"), F.sum("pieces").alias("n_pieces"), F.sum("used").alias("used"), F.max("used").alias("most_used"))
    return got.join(sizes, "pack_name").select("pack_name", "n_containers", "n_pieces", "most_used", F.round(F.col("used") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("filled"))


def p7_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of each pack: all documents are in it, no container is over its capacity, only documents over it are split."""
    sizes = table(spark, sf_dir, "pack_sizes").select("pack_name", "capacity_tokens").distinct()
    got = written(p7_containers(spark, sf_dir).join(sizes, "pack_name"), "p7-whole")
    docs = got.groupBy("pack_name", "doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("pieces"), F.first("capacity_tokens").alias("most"))
    docs = docs.groupBy("pack_name").agg(F.count("*").alias("n_docs"), F.count(F.when((F.col("pieces") > 1) & (F.col("tokens") <= F.col("most")), 1)).alias("n_split_in_vain"))
    full = got.groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("used"), F.first("capacity_tokens").alias("most"))
    return docs.join(full.groupBy("pack_name").agg(F.count(F.when(F.col("used") > F.col("most"), 1)).alias("n_over")), "pack_name")


ORACLE = {"p7_whole": "SELECT DISTINCT pack_name, (SELECT count(*) FROM documents) AS n_docs, 0 AS n_split_in_vain, 0 AS n_over FROM pack_sizes"}
QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill, "p7_whole": p7_whole}
