"""Problem 6: template residue and error-page text in feed items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import residue

FIELDS = ("title", "summary")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "feed_items").select("item_no", *FIELDS)
    return residue.find_residue(items, "item_no", FIELDS)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose title or summary is or contains residue; a row's fields are judged together, so no shuffle is needed."""
    return _found(spark, sf_dir).where("first_of_row").select("item_no")


def p6_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each exemplar was met in each field."""
    return _found(spark, sf_dir).groupBy("field", "exemplar").agg(F.count("*").alias("n"), F.min("coverage").alias("least_coverage"))


QUERIES = {"p6_found": p6_found, "p6_exemplars": p6_exemplars}
