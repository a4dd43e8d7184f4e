"""Snapshot comparison: what changed between a baseline and the current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(base: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    """``key`` and state (added, removed, changed, current) by a full outer join on unique keys."""
    b = base.select(F.col(key), F.col(value).alias("old"), F.lit(True).alias("in_old"))
    n = now.select(F.col(key), F.col(value).alias("new"), F.lit(True).alias("in_new"))
    state = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed").otherwise("current")
    return b.join(n, key, "full_outer").select(key, state.alias("state"))


def registry_diff(registry: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """State of each registered entry: missing (not found), new (no recorded value), changed or unchanged."""
    f = found.select(key, F.col(value).alias("found"), F.lit(True).alias("seen"))
    state = (
        F.when(F.col("seen").isNull(), "missing").when(F.col(value).isNull(), "new").when(~F.col(value).eqNullSafe(F.col("found")), "changed").otherwise("unchanged")
    )
    return registry.join(f, key, "left").select(key, state.alias("state"))


def reconcile(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Field by field: (key, field, left, right) where both sides have a value and the values differ; rows of the
    left that the right lacks come out with field '(missing)'."""
    r = right.select(key, *[F.col(f).cast("string").alias(f"r_{f}") for f in fields], F.lit(True).alias("there"))
    both = left.select(key, *[F.col(f).cast("string").alias(f"l_{f}") for f in fields]).join(r, key, "left")
    items = [F.struct(F.lit(f).alias("field"), F.col(f"l_{f}").alias("left"), F.col(f"r_{f}").alias("right")) for f in fields]
    gone = F.struct(F.lit("(missing)").alias("field"), F.lit(None).cast("string").alias("left"), F.lit(None).cast("string").alias("right"))
    listed = F.when(F.col("there").isNull(), F.array(gone)).otherwise(
        F.filter(F.array(*items), lambda x: x["left"].isNotNull() & x["right"].isNotNull() & (x["left"] != x["right"]))
    )
    return both.select(key, F.explode(listed).alias("x")).select(key, "x.field", "x.left", "x.right")


def upsert(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Merge by key: fields that the new row fills replace the old; ``changed`` tells whether any did."""
    n = new.select(key, *[F.col(f).alias(f"n_{f}") for f in fields], F.lit(True).alias("is_new"))
    both = old.select(key, *fields, F.lit(True).alias("is_old")).join(n, key, "full_outer")

    def pick(f: str) -> Column:
        fresh = F.when(F.col(f"n_{f}").cast("string") != "", F.col(f"n_{f}"))
        return F.coalesce(fresh, F.col(f))

    differs = [F.col(f"n_{f}").isNotNull() & (F.col(f"n_{f}").cast("string") != "") & ~F.col(f).eqNullSafe(F.col(f"n_{f}")) for f in fields]
    changed = F.col("is_old").isNull()
    for d in differs:
        changed = changed | d
    return both.select(key, *[pick(f).alias(f) for f in fields], F.coalesce(changed & F.col("is_new").isNotNull(), F.lit(False)).alias("changed"))


def freshness(status: Column, superseded: Column, last_checked_days: Column, known_hash: Column, new_hash: Column, stale_days: int) -> Column:
    """First rule that holds, in this order: recorded successor, gone, not modified, unreachable (stale when long unverified), no baseline, hash."""
    stale = last_checked_days > stale_days
    return (
        F.when(superseded.isNotNull(), "superseded")
        .when(status.isin(404, 410), "removed_404")
        .when(status == 304, "current")
        .when(status.isNull() & stale, "stale_age")
        .when(status.isNull(), "uncertain")
        .when(((status == 0) | (status >= 400)) & stale, "stale_age")
        .when((status == 0) | (status >= 400), "unreachable")
        .when(known_hash.isNull(), "uncertain")
        .when(known_hash != new_hash, "changed")
        .otherwise("current")
    )


def due(last_checked: Column, cadence_days: Column, now: str) -> Column:
    """Never checked, or longer ago than the cadence; exactly the cadence isn't due yet."""
    return last_checked.isNull() | (F.timestamp_seconds(F.unix_timestamp(last_checked) + cadence_days.cast("bigint") * 86400) < F.lit(now).cast("timestamp"))


def streak_islands(df: DataFrame, by: str, order: str, bad: Column, least: int) -> DataFrame:
    """Runs of at least ``least`` consecutive bad rows: (by, first, last, n), by gaps and islands."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(order)
    marked = df.select(F.col(by), F.col(order), bad.alias("bad")).withColumn("island", F.sum((~F.col("bad")).cast("int")).over(w))
    return marked.where("bad").groupBy(by, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).select(by, "first", "last", "n")
