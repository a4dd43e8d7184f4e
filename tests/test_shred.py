import json

from strata.operators.shred import Entity, entities, entity_keys, shred, typed_nodes
from strata.queries.pipeline_core import STUDENT

KEYS = ("origin", "row_no")


def found(spark, bodies):
    df = spark.createDataFrame([("raw", i, b, "clash") for i, b in enumerate(bodies)], "origin string, row_no bigint, body string, node string")
    nodes = shred(df, KEYS, "body", STUDENT, ("student_id",))
    return sorted(((r.row_no, r.parent_key, r.child, r.child_key) for r in entity_keys(nodes, KEYS, "student_id", STUDENT).distinct().collect()), key=repr)


def test_shapes(spark):
    rec = {"student_id": "S1", "enrollments": [{"enrollment_id": "E1", "status": "a"}, None, {"enrollment_id": ""}]}
    bodies = [
        json.dumps(rec),
        json.dumps({"records": [rec, {"student_id": None, "enrollments": [{"enrollment_id": "E9"}]}]}),
        json.dumps([{**rec, "enrollments": {"E5": {"status": "x"}, "E6": {"enrollment_id": "E7"}}}]),
        json.dumps({**rec, "enrollments": {"enrollment_id": "E2"}}),
        json.dumps({**rec, "enrollments": json.dumps([{"enrollment_id": "E3"}])}),
        json.dumps(json.dumps(rec)),
        "﻿" + json.dumps({"student_id": "S2", "lifecycle": [{"status": "active"}], "standards_mastery": [{"standard": {"standard_code": "A.1"}}, {"standard": None}]}),
        json.dumps({"student_id": "S3", "modules": {"gradebook": {"assignment_statuses": {"A1": {"status": "late"}}}}}),
        json.dumps({"student_id": "S4", "modules": [{"module_id": "gradebook", "assignment_statuses": {"assignment_id": "A2"}}]}),
        json.dumps({"student_id": "S5", "modules": json.dumps({"gradebook": {"assignment_statuses": [{"assignment_id": "A3"}]}})}),
        json.dumps({"student_id": "S6", "lifecycle.status": "active", "standards_mastery": [{"standard.standard_code": "A.2"}]}),
        json.dumps(json.dumps(json.dumps(json.dumps(json.dumps(json.dumps({"records": {"records": [[[[[[[[rec]]]]]]]]}})))))),
        json.dumps(rec)[:-5], "", "   ", None, "not json", "[]", "{}", "null", '"' * 3, "[" * 100_000,
    ]
    got = found(spark, bodies)
    want = [(0, "S1", "enrollment", "E1"), (1, "S1", "enrollment", "E1"), (1, None, "enrollment", "E9"), (2, "S1", "enrollment", "E5"), (2, "S1", "enrollment", "E7"), (3, "S1", "enrollment", "E2"), (4, "S1", "enrollment", "E3"), (5, "S1", "enrollment", "E1")]
    want += [(6, "S2", "status", "active"), (6, "S2", "mastery", "A.1"), (7, "S3", "assignment", "A1"), (8, "S4", "assignment", "A2"), (9, "S5", "assignment", "A3")]
    want += [(10, "S6", "status", "active"), (10, "S6", "mastery", "A.2"), (11, "S1", "enrollment", "E1")]
    blank = [g for g in got if g[3] == ""]
    assert {g for g in got if g[3] != "" and g[1]} == {w for w in want if w[1]}
    assert all(g[2] == "enrollment" for g in blank)
    assert found(spark, []) == []


def test_entity_tables_keep_the_parent(spark):
    body = json.dumps({"student_id": "S1", "enrollments": [{"enrollment_id": "E1", "course": {"course_id": "C"}}, {"enrollment_id": "E2"}]})
    df = spark.createDataFrame([("raw", 1, body)], "origin string, row_no bigint, body string")
    flat = entities(shred(df, KEYS, "body", STUDENT, ("student_id",)), KEYS, "student_id", STUDENT)
    rows = sorted((r.student_id, r.ordinal, r.enrollment_id, r.course_course_id) for r in flat["enrollment"].collect())
    assert rows == [("S1", 0, "E1", "C"), ("S1", 1, "E2", None)]
    assert flat["mastery"].count() == 0


def test_typed_columns_give_the_same_tables(spark):
    """Built-in shredding of columns with a schema equals shredding the same rows as JSON text."""
    schema = "origin string, row_no bigint, student_id string, enrollments array<struct<enrollment_id:string,course:struct<course_id:string>>>, lifecycle struct<status:string>"
    rows = [("r", 1, "S1", [("E1", ("C1",)), None, ("E2", None), (None, ("C3",))], ("active",)), ("r", 2, None, [("E3", None)], None), ("r", 3, "S3", None, (None,)), ("r", 4, "S4", [], ("",))]
    df = spark.createDataFrame(rows, schema)
    specs = (Entity("enrollment", ("enrollments",), ("enrollment_id", "course.course_id"), True, frozenset({"enrollment_id", "course"})), Entity("status", ("lifecycle",), ("status",)))
    typed = typed_nodes(df, KEYS, ("student_id",), ((specs[0], "enrollments"), (specs[1], "lifecycle")))
    text = shred(df.selectExpr("origin", "row_no", "to_json(struct(student_id, enrollments, lifecycle)) AS body"), KEYS, "body", specs, ("student_id",))
    for name in ("enrollment", "status"):
        a, b = (entities(n, KEYS, "student_id", specs)[name].drop("ordinal").collect() for n in (typed, text))
        assert sorted(map(tuple, a), key=repr) == sorted(map(tuple, b), key=repr)
    assert typed_nodes(df.limit(0), KEYS, ("student_id",), ((specs[0], "enrollments"),)).count() == 0
