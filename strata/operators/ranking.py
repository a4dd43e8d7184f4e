"""Cue scoring, top-two decisions, ranked winners with minority report, ordered overlays, provider chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cue_scores(texts: DataFrame, key: str, text: Column, cues: list[tuple[str, str, int]]) -> DataFrame:
    """(key, label, score): weights of the cues that occur in the lowered text, each counted once.

    ``cues`` is (label, cue, weight): a short list, so it becomes one expression for each
    label and no join. Cues are met inside words too. Labels without hit score 0.
    """
    return texts.select(key, F.explode(_scored(text, cues)).alias("x")).select(key, "x.label", "x.pos", "x.score")


def _scored(text: Column, cues: list[tuple[str, str, int]]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    labels = list(dict.fromkeys(c[0] for c in cues))
    parts = []
    for i, label in enumerate(labels):
        total: Column = F.lit(0)
        for _, cue, weight in [c for c in cues if c[0] == label]:
            total = total + F.when(low.contains(cue.lower()), weight).otherwise(0)
        parts.append(F.struct(F.lit(label).alias("label"), F.lit(i).alias("pos"), total.alias("score")))
    return F.array(*parts)


def routed(texts: DataFrame, key: str, text: Column, cues: list[tuple[str, str, int]]) -> DataFrame:
    """``top_two`` of ``cue_scores`` within each row: nothing is shuffled."""
    best = F.array_sort(F.transform(_scored(text, cues), lambda x: F.struct((-x["score"]).alias("s"), x["pos"].alias("pos"), x["label"].alias("label"))))
    return _decided(texts.select(key, F.slice(best, 1, 2).alias("b")), key)


def top_two(scores: DataFrame, key: str) -> DataFrame:
    """(key, first, first_score, second, second_score, margin, confidence): ties go to the earlier label."""
    best = scores.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "pos", "label"))), 1, 2).alias("b"))
    return _decided(best, key)


def _decided(best: DataFrame, key: str) -> DataFrame:
    a, b = F.element_at("b", 1), F.try_element_at(F.col("b"), F.lit(2))
    got = best.select(key, a["label"].alias("first"), (-a["s"]).alias("first_score"), b["label"].alias("second"), F.coalesce(-b["s"], F.lit(0)).alias("second_score"))
    margin = F.col("first_score") - F.col("second_score")
    confidence = F.when(F.col("first_score") == 0, "low").when(margin >= 2, "high").when(margin == 1, "medium").otherwise("low")
    return got.select("*", margin.alias("margin"), confidence.alias("confidence"))


def winners(candidates: DataFrame, claim: str, rank: str, order: str, reading: str) -> DataFrame:
    """(claim, winner, reading, rank, n_candidates, n_conflicts, n_close): the strongest candidate of each claim,
    ties by order, and how many others read otherwise, close ones within 15 of its rank."""
    best = candidates.groupBy(claim).agg(F.min(F.struct((-F.col(rank)).alias("r"), F.col(order).alias("o"), F.col(reading).alias("v"))).alias("m"), F.count("*").alias("n_candidates"))
    top = best.select(claim, F.col("m.o").alias("winner"), F.col("m.v").alias("winning_reading"), (-F.col("m.r")).alias("winning_rank"), "n_candidates")
    other = F.lower(F.trim(F.coalesce(F.col(reading), F.lit("")))) != F.lower(F.trim(F.coalesce(F.col("winning_reading"), F.lit(""))))
    votes = candidates.join(top, claim).where(other).groupBy(claim).agg(F.count("*").alias("n_conflicts"), F.sum((F.col("winning_rank") - F.col(rank) <= 15).cast("bigint")).alias("n_close"))
    return top.join(votes, claim, "left").select(claim, "winner", "winning_reading", "winning_rank", "n_candidates", F.coalesce("n_conflicts", F.lit(0)).alias("n_conflicts"), F.coalesce("n_close", F.lit(0)).alias("n_close"))


def overlay(base: DataFrame, layers: DataFrame, key: str) -> DataFrame:
    """Ordered merge of (key, field, mode, value, rank) onto (key, field, value).

    ``sets`` fills what is empty, lowest rank first; ``overrides`` of the highest rank
    wins; ``adds`` of all ranks are appended to what is there, joined with ';'.
    """
    by = layers.groupBy(key, "field").agg(
        F.min(F.when((F.col("mode") == "sets") & F.col("value").isNotNull(), F.struct("rank", "value"))).alias("s"),
        F.max(F.when(F.col("mode") == "overrides", F.struct("rank", "value"))).alias("o"),
        F.array_sort(F.collect_list(F.when(F.col("mode") == "adds", F.struct("rank", "value")))).alias("a"),
    )
    both = base.select(key, "field", F.col("value").alias("base")).join(by, [key, "field"], "full_outer")
    value = F.coalesce(F.col("o.value"), F.when(F.coalesce("base", F.lit("")) != "", F.col("base")), F.col("s.value"))
    added = F.array_join(F.transform(F.coalesce("a", F.array().cast("array<struct<rank:int,value:string>>")), lambda x: x["value"]), ";")
    return both.select(key, "field", F.when(added == "", value).otherwise(F.concat_ws(";", value, F.when(added != "", added))).alias("value"))


def provider_chains(offers: DataFrame, blocked: DataFrame) -> DataFrame:
    """Providers of each evidence type in order: (evidence, chain) from (provider, pos, evidence, authoritative, active) minus
    (provider, evidence) that are held back; evidence that nobody provides has an empty chain."""
    live = offers.where("active").join(blocked, ["provider", "evidence"], "left_anti")
    chains = live.groupBy("evidence").agg(F.array_sort(F.collect_list(F.struct((~F.col("authoritative")).alias("later"), "pos", "provider"))).alias("c"))
    got = offers.select("evidence").distinct().join(chains, "evidence", "left")
    return got.select("evidence", F.coalesce(F.array_join(F.transform("c", lambda x: x["provider"]), ">"), F.lit("")).alias("chain"))


def composite(weights: dict[str, float]) -> Column:
    """Weighted sum of score columns, three digits."""
    total: Column = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.col(c).cast("double") * F.lit(w)
    return F.round(total, 3)


def banded(value: Column, bands: list[tuple[float, str]], otherwise: str) -> Column:
    """Name of the first band whose floor the value reaches."""
    out = None
    for floor, name in bands:
        out = F.when(value >= floor, name) if out is None else out.when(value >= floor, name)
    return out.otherwise(otherwise)
