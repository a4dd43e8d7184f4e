"""Content hashes, first-wins deduplication and duplicate edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def squeezed(text: Column) -> Column:
    """White space runs as one blank, outer blanks gone."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def text_hash(text: Column) -> Column:
    return F.sha2(squeezed(text), 256)


def key_hash(*parts: Column, missing: str = "None") -> Column:
    """Hash of the parts joined with '|'; a missing part is written out, so it isn't an empty one."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit(missing)) for p in parts]), 256)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``: an aggregate with partial sums rather than a window, so a hot key is no one task's."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min(F.struct(*[F.col(c) for c in order], *[F.col(c).alias(f"r_{i}") for i, c in enumerate(rest)])).alias("m"))
    return first.select(*keys, *[F.col(f"m.r_{i}").alias(c) for i, c in enumerate(rest)]).select(*df.columns)


def insert_ignore(store: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of a batch that the store doesn't have, first write wins within the batch."""
    return keep_first(batch, keys, order).join(store.select(*keys), keys, "left_anti")


def duplicate_edges(df: DataFrame, key: str, same: Column) -> DataFrame:
    """(duplicate, first, n): every row whose value was met before, with the first of its group; copies aren't paired with each other."""
    groups = df.where(same.isNotNull()).groupBy(same.alias("__h")).agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")
    return df.where(same.isNotNull()).select(F.col(key).alias("duplicate"), same.alias("__h")).join(groups, "__h").where("duplicate <> first").select("duplicate", "first", "n")


def ranked(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in a total order, with their rank."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
