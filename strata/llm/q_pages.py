"""Problem 1: noise in the text of scanned pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import pages


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame lines, broken words and misread lines of every page."""
    return pages.find_noise(table(spark, sf_dir, "scan_pages"), "page_id", "scan_id", "page", "text")


def p1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired paragraphs of every scan."""
    return pages.repair(table(spark, sf_dir, "scan_pages"), "page_id", "scan_id", "page", "text")


def p1_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each kind for each source."""
    found = p1_found(spark, sf_dir).join(table(spark, sf_dir, "scan_pages").select("page_id", "source"), "page_id")
    return found.groupBy("source", "kind").agg(F.count("*").alias("n_lines"), F.countDistinct("page_id").alias("n_pages"))


QUERIES = {"p1_found": p1_found, "p1_paragraphs": p1_paragraphs, "p1_noise": p1_noise}
