"""Problem 8: evaluation items in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table, written
from . import leaks


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items").select("item_id", "text")
    return leaks.find_leaks(docs, "doc_id", "text", items, "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and the documents that contain at least half of their passage."""
    return _found(spark, sf_dir).select("item_id", "doc_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each leaked item: documents that contain it and the largest share found."""
    return _found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("share").alias("most"))


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaking documents with the leaked spans removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return leaks.without_leaks(docs, "doc_id", "text", written(_found(spark, sf_dir), "p8-spans"))


def p8_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose whole passage a document has word for word: found by the automaton, then checked to the letter."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items").select("item_id", F.col("text").alias("item"))
    lines = F.filter(F.split("item", "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s*\(?[A-Ea-e][.):]\s"))
    first = items.select(F.trim(F.element_at(F.split("item", "\n"), 1)).alias("line")).groupBy("line").agg(F.count("*").alias("n")).where("n >= 3")
    items = items.select("item_id", lines.alias("l"), F.trim(F.element_at(F.split("item", "\n"), 1)).alias("line")).join(first, "line", "left")
    flat = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    items = items.select("item_id", flat(F.array_join(F.when(F.col("n").isNotNull(), F.slice("l", 2, 1000)).otherwise(F.col("l")), " ")).alias("passage"))
    found = _found(spark, sf_dir).select("item_id", "doc_id").join(items, "item_id").join(docs, "doc_id")
    return found.where(F.contains(flat(F.col("text")), F.col("passage"))).select("item_id", "doc_id")


_FLAT = "concat(' ', trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
ORACLE = {
    "p8_verbatim": f"""WITH d AS (SELECT trim(string_split(text, chr(10))[1]) AS line FROM eval_items GROUP BY 1 HAVING count(*) >= 3),
    l AS (SELECT item_id, trim(string_split(text, chr(10))[1]) AS line, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(x, '^\\s*\\(?[A-Ea-e][.):]\\s')) AS l FROM eval_items),
    p AS (SELECT item_id, {_FLAT.format("array_to_string(CASE WHEN line IN (SELECT line FROM d) THEN l[2:] ELSE l END, ' ')")} AS passage FROM l), t AS (SELECT doc_id, {_FLAT.format('text')} AS text FROM documents WHERE text IS NOT NULL)
    SELECT item_id, doc_id FROM p JOIN t ON contains(t.text, p.passage)"""
}
QUERIES = {"p8_found": p8_found, "p8_items": p8_items, "p8_clean": p8_clean, "p8_verbatim": p8_verbatim}
