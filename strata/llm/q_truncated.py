"""Problem 5: summaries cut off by field limits or in transfer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import truncated


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated.find_truncated(table(spark, sf_dir, "feed_items").select("item_no", "feed_id", "summary"), "item_no", "summary", "feed_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose summary lost its end."""
    return _found(spark, sf_dir).select("item_no")


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut items for each feed."""
    cut = _found(spark, sf_dir).groupBy(F.col("source").alias("feed_id")).agg(F.count("*").alias("n_cut"))
    items = table(spark, sf_dir, "feed_items").groupBy(F.coalesce("feed_id", F.lit("")).alias("feed_id")).agg(F.count("*").alias("n_items"), F.count(F.when(F.trim("summary") != "", 1)).alias("n_texts"))
    got = items.join(cut, "feed_id", "left").withColumn("n_cut", F.coalesce("n_cut", F.lit(0)))
    return got.withColumn("cut_share", F.round(F.col("n_cut") / F.greatest("n_items", F.lit(1)), 6))


def p5_ellipsis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries that end in an ellipsis, as far as they are found to be cut."""
    ends = table(spark, sf_dir, "feed_items").where(r"summary rlike '(?:\\.\\.\\.|…)\\s*$'").select("item_no")
    return ends.join(p5_found(spark, sf_dir), "item_no", "left_semi")


ORACLE = {"p5_ellipsis": "SELECT item_no FROM feed_items WHERE regexp_matches(summary, '(?:\\.\\.\\.|…)\\s*$')"}
QUERIES = {"p5_found": p5_found, "p5_rates": p5_rates, "p5_ellipsis": p5_ellipsis}
