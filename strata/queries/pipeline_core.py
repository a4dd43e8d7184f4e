"""Queries of the general problems: nested records (3) and timestamps (4)."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import shred, timestamps
from ..session import table, written

STUDENT = (
    shred.Entity("enrollment", ("enrollments",), ("enrollment_id", "enrollment_date", "status", "course.course_id", "section.section_id"), True,
                 frozenset({"enrollment_id", "section", "course", "course_level", "enrollment_date", "status"})),
    shred.Entity("status", ("lifecycle",), ("status", "created_date", "last_modified_date")),
    shred.Entity("mastery", ("standards_mastery",), ("standard.standard_code", "mastery_level", "evidence_count", "last_assessed_date"), False,
                 frozenset({"standard", "mastery_level", "evidence_count", "last_assessed_date"})),
    shred.Entity("assignment", ("modules", "gradebook", "assignment_statuses"), ("assignment_id", "assignment_name", "category", "status"), True,
                 frozenset({"assignment_id", "assignment_name", "category", "status", "points_earned", "points_possible"}), "module_id"),
)
SCHOOL = (shred.Entity("program", ("programs",), ("program_name", "program_id", "program_type", "status")),)


MODULES = (shred.Entity("assignment", STUDENT[3].path[1:], STUDENT[3].fields, True, STUDENT[3].own, "module_id"),)


def _keyed(specs: tuple[shred.Entity, ...]) -> tuple[shred.Entity, ...]:
    """The entities with their own key only."""
    return tuple(dataclasses.replace(e, fields=e.fields[:1]) for e in specs)


def _student_nodes(spark: SparkSession, sf_dir: str, narrow=lambda specs: specs) -> DataFrame:
    """Columns with a schema are shredded by built-in functions; only JSON text goes to Python."""
    keys, specs = ("origin", "row_no"), narrow(STUDENT)
    records = table(spark, sf_dir, "records").select(F.lit("records").alias("origin"), F.col("record_no").alias("row_no"), "student_id", "enrollments", "lifecycle", "standards_mastery", "modules")
    typed = shred.typed_nodes(records, keys, ("student_id",), ((specs[0], "enrollments"), (specs[1], "lifecycle"), (specs[2], "standards_mastery")))
    modules = shred.shred(records.select(*keys, "modules"), keys, "modules", narrow(MODULES), (), below=4 * shred.STRIDE)
    raw = table(spark, sf_dir, "raw_records").select(F.lit("raw_records").alias("origin"), F.col("raw_no").alias("row_no"), "body")
    return typed.unionByName(modules).unionByName(shred.shred(raw, keys, "body", specs, ("student_id",)))


def _school_nodes(spark: SparkSession, sf_dir: str, narrow=lambda specs: specs) -> DataFrame:
    schools = table(spark, sf_dir, "schools").select(F.lit("schools").alias("origin"), "row_no", "msid", "programs")
    return shred.typed_nodes(schools, ("origin", "row_no"), ("msid",), ((narrow(SCHOOL)[0], "programs"),))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every child of every record with its parent's key, once each."""
    keys = ("origin", "row_no")
    students = shred.entity_keys(written(_student_nodes(spark, sf_dir, _keyed), "p3-nodes"), keys, "student_id", _keyed(STUDENT))
    schools = shred.entity_keys(_school_nodes(spark, sf_dir, _keyed), keys, "msid", _keyed(SCHOOL))
    schools = schools.withColumn("child_key", F.expr(r"regexp_replace(child_key, '(?U)^\\s+|\\s+$', '')"))
    both = students.unionByName(schools)
    blank = F.expr(r"child_key rlike '(?U)^\\s*$' or parent_key rlike '(?U)^\\s*$'")
    return both.where(F.col("parent_key").isNotNull() & F.col("child_key").isNotNull() & ~blank).distinct()


def p3_entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The related tables: rows and distinct parents of each entity table."""
    keys = ("origin", "row_no")
    out = None
    for nodes, parent, specs in ((_student_nodes(spark, sf_dir), "student_id", STUDENT), (_school_nodes(spark, sf_dir), "msid", SCHOOL)):
        for name, flat in shred.entities(written(nodes, "p3-nodes"), keys, parent, specs).items():
            one = flat.agg(F.count("*").alias("n_rows"), F.countDistinct(parent).alias("n_parents")).select(F.lit(name).alias("entity"), "n_rows", "n_parents")
            out = one if out is None else out.unionByName(one)
    return out


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One UTC instant for every value that names a moment."""
    feeds = table(spark, sf_dir, "feeds").select(F.col("id").alias("feed_id"), F.col("tz"), F.col("state.last_modified").alias("last_modified"))
    items = table(spark, sf_dir, "feed_items").select("item_no", "feed_id", "published").join(feeds.select("feed_id", "tz"), "feed_id", "left")
    items = items.withColumn("row_key", F.col("item_no").cast("string"))
    a = timestamps.normalise(items, "published", "feed_id", "item_no", "tz", ("row_key",))
    b = timestamps.normalise(feeds.withColumn("row_key", F.col("feed_id")).withColumn("n", F.lit(0).cast("bigint")), "last_modified", "feed_id", "n", None, ("row_key",), "UTC")
    found = a.select(F.lit("feed_items").alias("origin"), "row_key", "utc_us")
    return found.unionByName(b.select(F.lit("feeds").alias("origin"), "row_key", "utc_us"))


def p4_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each feed's items use each form, with date orders, folds and abbreviations left to the source's own records."""
    feeds = table(spark, sf_dir, "feeds").select(F.col("id").alias("feed_id"), "tz")
    items = table(spark, sf_dir, "feed_items").select("item_no", "feed_id", "published").join(feeds, "feed_id", "left")
    got = timestamps.normalise(items, "published", "feed_id", "item_no", "tz", ("feed_id",), "UTC", slash="auto", dot="auto", fold="auto", mark="auto")
    return got.groupBy("feed_id", "reading").agg(F.count("*").alias("n"), F.min("utc_us").alias("first_us"), F.max("utc_us").alias("last_us"))


def p3_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The children of the columns that have a schema, as p3_found has them."""
    return p3_found(spark, sf_dir).where("origin = 'schools' or (origin = 'records' and child <> 'assignment')")


_BLANK = "nullif(regexp_replace({}, '^\\s+|\\s+$', '', 'g'), '')"
_STUDENT = f"SELECT 'records' AS origin, record_no AS row_no, student_id AS parent_key, {{}} AS child, {{}} AS child_key FROM (SELECT record_no, student_id, {{}} AS x FROM records WHERE {_BLANK.format('student_id')} IS NOT NULL) WHERE {{}} IS NOT NULL"
ORACLE = {
    "p3_typed": " UNION ".join(
        [
            _STUDENT.format("'enrollment'", "x.enrollment_id", "unnest(enrollments)", _BLANK.format("x.enrollment_id")),
            _STUDENT.format("'mastery'", "x.standard.standard_code", "unnest(standards_mastery)", _BLANK.format("x.standard.standard_code")),
            _STUDENT.format("'status'", "x.status", "lifecycle", _BLANK.format("x.status")),
            f"SELECT 'schools', row_no, msid, 'program', {_BLANK.format('x.program_name')} FROM (SELECT row_no, msid, unnest(programs) AS x FROM schools WHERE {_BLANK.format('msid')} IS NOT NULL) WHERE {_BLANK.format('x.program_name')} IS NOT NULL",
        ]
    )
}


def queries() -> dict:
    return {"p3_found": p3_found, "p3_typed": p3_typed, "p3_entity_counts": p3_entity_counts, "p4_found": p4_found, "p4_formats": p4_formats}
