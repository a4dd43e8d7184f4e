"""Look-ups: crosswalks, ladders, defaults, conditions, folded evidence, violations, watched pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crosswalk_map(df: DataFrame, needle: str, source: str, target: str, frame: str = "frame", code: str = "code", subject: str = "subject", codes: str = "codes") -> DataFrame:
    """(code, mapped) of a crosswalk's rows between two frames whose code or subject holds the text, case aside; one row for each code mapped to."""
    hit = F.lower(F.concat_ws("\x1f", code, subject)).contains(needle.lower())
    return df.where((F.col(frame) == source) & (F.col("to") == target) & hit).select(F.col(code), F.explode(codes).alias("mapped"))


def ladder(df: DataFrame, steps: list[tuple[DataFrame, list[str], str]], default) -> DataFrame:
    """``rank`` by the first step that knows the row: each step is (table, key columns, value column); keys are unique in a step."""
    found = []
    for i, (step, keys, value) in enumerate(steps):
        df = df.join(step.select(*keys, F.col(value).alias(f"__v{i}")), keys, "left")
        found.append(F.col(f"__v{i}"))
    return df.withColumn("rank", F.coalesce(*found, F.lit(default))).drop(*[f"__v{i}" for i in range(len(steps))])


def with_default(left: DataFrame, right: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Left join by key; rows without partner get the default record. The right side's keys are unique."""
    got = left.join(right.withColumn("__hit", F.lit(True)), key, "left")
    return got.select(*left.columns, *[F.when(F.col("__hit"), F.col(c)).otherwise(F.lit(defaults.get(c))).alias(c) for c in right.columns if c != key])


def meets(conditions: list[tuple[str, str, object]]) -> Column:
    """All of (column, operator, value): 'in' (array column or scalar among values), 'is' (boolean), 'eq' (text, case aside); a null meets none."""
    parts = []
    for column, how, value in conditions:
        c = F.col(column)
        if how == "in":
            parts.append(c.isin(list(value)))
        elif how == "has":
            parts.append(F.array_contains(c, value))
        elif how == "is":
            parts.append(c == F.lit(bool(value)))
        elif how == "eq":
            parts.append(F.lower(c) == str(value).lower())
        else:
            raise ValueError(f"no such condition: {how}")
    return reduce(lambda a, b: a & b, [F.coalesce(p, F.lit(False)) for p in parts], F.lit(True))


def fold_in(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Fills a stated value's blanks with evidence and says where each came from; a stated value is never overwritten."""
    for stated, evidence in pairs:
        own = F.nullif(F.trim(F.col(stated)), F.lit(""))
        df = df.withColumn(f"{stated}_from", F.when(own.isNotNull(), "stated").when(F.col(evidence).isNotNull(), "evidence").otherwise("none")).withColumn(stated, F.coalesce(own, evidence))
    return df


def violations(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules that a row breaks, in order; a rule that can't be judged is broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]))


def watch(before: DataFrame, now: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state) of watched pages: skipped without key, error without digest, baseline_recorded, unchanged or changed. Keys of ``before`` are unique."""
    got = now.select(key, F.col(digest).alias("now")).join(before.select(key, F.col(digest).alias("was")), key, "left")
    state = F.when(F.col(key).isNull(), "skipped").when(F.col("now").isNull(), "error").when(F.col("was").isNull(), "baseline_recorded").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    return got.select(key, state.alias("state"))


def ranked(value: Column, order: list[str], default: int) -> Column:
    """Place of a value in a stated order, from 0; others get the default."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), value)
    return F.when(at > 0, at - 1).otherwise(F.lit(default)).cast("int")
