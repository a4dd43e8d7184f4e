"""Record packages: projections by type, masking, translation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def masked(key: Column, name: Column, by_id: bool) -> Column:
    """A person's reference: only the id in id mode, else name with id."""
    return key if by_id else F.concat_ws(" ", name, F.concat(F.lit("("), key, F.lit(")")))


def package(df: DataFrame, key: str, sections: dict[str, Column], wanted: list[str]) -> DataFrame:
    """One JSON object for each row with the wanted sections in order; unknown sections are an error."""
    unknown = set(wanted) - set(sections)
    if unknown:
        raise ValueError(f"no such section: {sorted(unknown)}")
    return df.select(key, F.to_json(F.struct(*[sections[w].alias(w) for w in wanted])).alias("package"))


def translate(df: DataFrame, value: Column, scale: DataFrame, from_col: str, to_col: str) -> DataFrame:
    """Adds ``translated``: every target of the value, case and outer blanks aside; no target gives null."""
    s = scale.select(F.lower(F.trim(F.col(from_col))).alias("__from"), F.col(to_col).alias("translated")).where(F.col("translated").isNotNull() & (F.col("translated") != ""))
    return df.withColumn("__v", F.lower(F.trim(value))).join(s, F.col("__v") == F.col("__from"), "left").drop("__v", "__from")


def rule_failures(text: Column) -> Column:
    """Names of the rules that a text breaks: identity-number-like values block, phone numbers that are no placeholders warn."""
    ssn = F.when(text.rlike(r"\b\d{3}-\d{2}-\d{4}\b"), F.lit("no_real_pii"))
    phones = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\b\d{3}[-.]\d{3}[-.]\d{4}\b)"), F.lit(1))
    phone = F.when(F.exists(phones, lambda p: ~p.startswith("555")), F.lit("placeholder_pii"))
    return F.array_compact(F.array(ssn, phone))
