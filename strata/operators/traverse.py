"""Layered traversal with a fetcher for each kind of seed, gaps for what couldn't be fetched, and an envelope."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

Fetcher = Callable[[DataFrame], DataFrame]
SEED = "kind string, ref string"


def run(seeds: DataFrame, fetchers: dict[str, Fetcher], max_layers: int = 4, max_findings: int | None = None) -> tuple[DataFrame, DataFrame, str]:
    """(findings, gaps, why it stopped) of a walk from ``seeds`` (kind, ref).

    A fetcher takes the layer's seeds of its kind and returns (ref, next_kind, next_ref,
    error): a row without next and without error is a finding that leads nowhere. Findings
    are (layer, kind, ref, n_next), each seed once, at its first layer; gaps are (layer,
    kind, ref, reason): no_fetcher or fetch_error. The walk ends when a layer is empty
    ('exhausted'), finds nothing new ('saturated'), at ``max_layers`` ('max_layers') or once
    ``max_findings`` are there ('max_findings'); a layer that was begun is kept whole.
    """
    spark = seeds.sparkSession
    layer = written(seeds.select("kind", "ref").where("kind is not null and ref is not null").distinct(), "walk-seeds")
    known = layer
    findings, gaps, n, why = [], [], 0, "max_layers"
    for depth in range(max_layers):
        if layer.isEmpty():
            why = "exhausted" if depth == 0 else "saturated"
            break
        told = None
        for kind, fetch in fetchers.items():
            got = fetch(layer.where(F.col("kind") == kind)).select(F.lit(kind).alias("kind"), "ref", "next_kind", "next_ref", "error")
            told = got if told is None else told.unionByName(got)
        told = written(told, "walk-layer") if told is not None else spark.createDataFrame([], "kind string, ref string, next_kind string, next_ref string, error string")
        answered = told.groupBy("kind", "ref").agg(F.count("next_ref").alias("n_next"), F.max("error").alias("error"))
        findings.append(answered.where("error is null").select(F.lit(depth).alias("layer"), "kind", "ref", "n_next"))
        failed = answered.where("error is not null").select(F.lit(depth).alias("layer"), "kind", "ref", F.lit("fetch_error").alias("reason"))
        lacking = layer.where(~F.col("kind").isin(list(fetchers))).select(F.lit(depth).alias("layer"), "kind", "ref", F.lit("no_fetcher").alias("reason"))
        gaps += [failed, lacking]
        fresh = told.where("next_ref is not null and error is null").select(F.col("next_kind").alias("kind"), F.col("next_ref").alias("ref")).distinct()
        layer = written(fresh.join(known, ["kind", "ref"], "left_anti"), "walk-layer")
        known = written(known.unionByName(layer), "walk-known")
        n += findings[-1].count() if max_findings is not None else 0
        if max_findings is not None and n >= max_findings:
            why = "max_findings"
            break
    none = spark.createDataFrame([], "layer int, kind string, ref string, n_next bigint"), spark.createDataFrame([], "layer int, kind string, ref string, reason string")
    for f in findings:
        none = (none[0].unionByName(f), none[1])
    for g in gaps:
        none = (none[0], none[1].unionByName(g))
    return none[0], none[1], why


def envelope(findings: DataFrame, gaps: DataFrame, why: str) -> DataFrame:
    """One row that sums a walk up: (findings, layers, gaps, no_fetcher, fetch_error, stopped)."""
    all_rows = findings.select("layer", F.lit(None).cast("string").alias("reason")).unionByName(gaps.select("layer", "reason"))
    found = F.col("reason").isNull()
    return all_rows.agg(
        F.count(F.when(found, 1)).alias("findings"),
        F.coalesce(F.max(F.when(found, F.col("layer") + 1)), F.lit(0)).alias("layers"),
        F.count("reason").alias("gaps"),
        *[F.count(F.when(F.col("reason") == r, 1)).alias(r) for r in ("no_fetcher", "fetch_error")],
    ).withColumn("stopped", F.lit(why))
