"""Problem 9: abusive, hateful or sexual content in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table, written
from . import abuse


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    return abuse.score(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id", "text", ("source",))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least one passage over the threshold."""
    return p9_scores(spark, sf_dir).where("n_windows > 0").select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of flagged documents for each source, by kind."""
    got = p9_scores(spark, sf_dir)
    flagged = F.col("n_windows") > 0
    return got.groupBy("source").agg(
        F.count("*").alias("n_docs"),
        F.count(F.when(flagged, 1)).alias("n_flagged"),
        *[F.count(F.when(flagged & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in ("insult", "threat", "hate", "sexual")],
        F.round(F.avg(flagged.cast("int")), 6).alias("rate"),
    )


def p9_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement with the reviewed sample: documents by majority label and finding."""
    got = written(p9_scores(spark, sf_dir), "p9-scores")
    votes = table(spark, sf_dir, "doc_labels").groupBy("doc_id").agg(F.sum(F.when(F.col("label") == "flag", 1).otherwise(-1)).alias("v"))
    return got.join(votes, "doc_id").groupBy((F.col("v") > 0).alias("labelled"), (F.col("n_windows") > 0).alias("found")).agg(F.count("*").alias("n"))


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates, "p9_labels": p9_labels}
