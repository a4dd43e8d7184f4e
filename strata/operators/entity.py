"""Entity resolution: normalised names, exact-then-Jaccard matching, merging by several keys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, written


def normalised(name: Column, drop: list[str]) -> Column:
    """Lowered name without apostrophes, punctuation and the given generic words."""
    text = F.regexp_replace(F.lower(name), r"['’‘]", "")
    text = F.regexp_replace(text, r"[\".,/()&-]", " ")
    if drop:
        text = F.regexp_replace(text, r"\b(" + "|".join(drop) + r")\b", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def words(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(name, " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def best_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str, name: str, threshold: float = 0.65) -> DataFrame:
    """(left_key, right_key, score): exact equality first, else the best Jaccard of at least ``threshold``, ties by right key.

    Names are compared once each, however many rows carry them. Candidates share a word:
    of the sorted words by rarity only the first few need be looked up, since two sets as
    alike as the threshold share one of their first |s| - ceil(t|s|) + 1 rarest words.
    """
    lw = left.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("__n")).select(F.col(name).alias("ln"), words(F.col(name)).alias("lw"))
    rw = right.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("rn")).agg(F.min(right_key).alias("rk")).withColumn("rw", words(F.col("rn")))
    exact = lw.join(rw, lw.ln == rw.rn).select("ln", "rk", F.lit(1.0).alias("score"), F.lit(1).alias("is_exact"))
    rest = lw.join(rw.select("rn"), lw.ln == F.col("rn"), "left_anti")
    counts = rw.select(F.explode("rw").alias("w")).groupBy("w").agg(F.count("*").alias("c"))

    def prefix(df: DataFrame, key: str, array: str) -> DataFrame:
        listed = df.select(key, array, F.explode(array).alias("w")).join(counts, "w", "left").groupBy(key, array).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "w"))).alias("by_rarity"))
        keep = F.size(array) - F.ceil(F.lit(threshold) * F.size(array) - 1e-9) + 1
        return listed.select(key, array, F.explode(F.slice("by_rarity", F.lit(1), F.greatest(keep, F.lit(1)).cast("int"))).alias("x")).select(key, array, F.col("x.w").alias("w"))

    pairs = prefix(rest, "ln", "lw").join(prefix(rw.select("rk", "rw"), "rk", "rw"), "w").select("ln", "lw", "rk", "rw").distinct()
    fuzzy = pairs.select("ln", "rk", jaccard(F.col("lw"), F.col("rw")).alias("score"), F.lit(0).alias("is_exact")).where(F.col("score") >= threshold)
    best = exact.unionByName(fuzzy).groupBy("ln").agg(F.min(F.struct(-F.col("is_exact"), -F.col("score"), F.col("rk"))).alias("m"))
    best = best.select("ln", F.col("m.rk").alias(right_key), F.round(-F.col("m.col2"), 6).alias("score"))
    return left.select(left_key, F.col(name).alias("ln")).join(best, "ln").select(left_key, right_key, "score")


def merge(df: DataFrame, block: str, order: str, key_id: str, key_name: str, fields: list[str], source: str) -> DataFrame:
    """Folds rows of one entity in ``order``: by id, else by name; blanks are filled, sources united, an id is gained on the way.

    Sequential by nature, so it runs for each ``block``: a key that no entity crosses. A
    block of many rows is read batch by batch, only its entities are held.
    """
    types = dict(df.dtypes)
    schema = f"{block} {types[block]}, entity int, {key_id} string, {key_name} string, " + ", ".join(f"{f} string" for f in fields) + ", sources array<string>, n_rows bigint"
    cols = [block, order, key_id, key_name, *fields, source]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, made, by_id, by_name = None, [], {}, {}

        def out() -> pd.DataFrame:
            rows = [[now, i, e[key_id], e[key_name], *[e[f] for f in fields], sorted(e["sources"]), e["n"]] for i, e in enumerate(made)]
            return pd.DataFrame(rows, columns=[block, "entity", key_id, key_name, *fields, "sources", "n_rows"])

        for pdf in batches:
            for row in pdf[cols].itertuples(index=False, name=None):
                b, _, rid, name, *rest = row
                *values, src = rest
                if b != now:
                    if made:
                        yield out()
                    now, made, by_id, by_name = b, [], {}, {}
                rid, name = rid or None, name or None
                at = by_id.get(rid) if rid is not None else None
                if at is None and name is not None:
                    at = by_name.get(name)
                if at is None:
                    at = len(made)
                    made.append({key_id: None, key_name: name, **{f: None for f in fields}, "sources": set(), "n": 0})
                    if name is not None:
                        by_name.setdefault(name, at)
                e = made[at]
                if rid is not None and e[key_id] is None:
                    e[key_id] = rid
                    by_id[rid] = at
                for f, v in zip(fields, values):
                    if v not in (None, "") and e[f] in (None, ""):
                        e[f] = v
                if src:
                    e["sources"].add(src)
                e["n"] += 1
        if made:
            yield out()

    work = df.select(F.col(block), F.col(order), *[F.col(c).cast("string").alias(c) for c in (key_id, key_name, *fields, source)])
    return work.repartition(block).sortWithinPartitions(block, order).mapInPandas(fold, schema)


def components(df: DataFrame, row: str, keys: list[str]) -> DataFrame:
    """(row, entity): rows that share any key value are one entity, named by its smallest row, over any number of steps.

    Each round takes the smallest label of every key value and of every row's key values
    (two aggregations, which combine before the shuffle, and no pairs); labels are cut with
    a written table and rounds go on until nothing changes. Null and blank keys link nothing.
    """
    told = F.explode(F.array_compact(F.array(*[F.when(F.trim(F.col(k).cast("string")) != "", F.concat(F.lit(f"{i}|"), F.lower(F.trim(F.col(k).cast("string"))))) for i, k in enumerate(keys)])))
    links = written(df.select(F.col(row).alias("r"), told.alias("key")).distinct(), "entity-keys")
    labels = written(df.select(F.col(row).alias("r"), F.col(row).alias("label")).distinct(), "entity-labels")
    while True:
        low = links.join(labels, "r").groupBy("key").agg(F.min("label").alias("low"))
        near = links.join(low, "key").groupBy("r").agg(F.min("low").alias("near"))
        step = labels.join(near, "r", "left").select("r", "label", F.least("label", "near").alias("new"))
        # a label is followed to its own label, so chains halve
        jump = labels.select(F.col("r").alias("new"), F.col("label").alias("further"))
        step = written(step.join(jump, "new", "left").select("r", F.least("new", "further").alias("label"), (F.least("new", "further") < F.col("label")).alias("moved")), "entity-labels")
        settled = step.where("moved").isEmpty()
        discard(labels)
        if settled:
            return step.select(F.col("r").alias(row), F.col("label").alias("entity"))
        labels = written(step.select("r", "label"), "entity-labels")
        discard(step)


def merged(df: DataFrame, row: str, keys: list[str], fields: list[str], source: str) -> DataFrame:
    """One row for each entity of ``components``: the first filled value of each key and field by row, sources united, rows counted."""
    filled = lambda c: F.trim(F.col(c).cast("string")) != ""
    first = [F.min_by(F.when(filled(c), F.col(c)), F.when(filled(c), F.col(row))).alias(c) for c in (*keys, *fields)]
    got = df.join(components(df, row, keys), row).groupBy("entity")
    return got.agg(*first, F.array_sort(F.collect_set(source)).alias("sources"), F.count("*").alias("n_rows"))
