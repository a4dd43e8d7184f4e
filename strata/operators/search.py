"""Ranked full-text lookup and vector search.

Text is tokenised by built-in functions; a query's term frequencies are computed in the
scan itself, so a lookup costs one scan of the texts and no shuffle but the top-k. ``postings`` builds
the inverted table for corpora that are searched often; ``search_postings`` ranks from it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
WORD = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lowered words of a text; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def query_terms(query: str) -> list[list[str]]:
    """Blank-separated query tokens, each the phrase of its words; a query without words is empty."""
    import re

    raw = re.findall(r"[A-Za-zÀ-ÿ0-9.]+", query or "")
    got = [re.findall(r"[^\W_]+", t.lower()) for t in raw]
    return [g for g in got if g]


def _frequency(toks: Column, phrase: list[str], prefix: bool) -> Column:
    """Occurrences of a phrase in the tokens; with ``prefix`` its last word may go on."""
    if len(phrase) == 1 and not prefix:
        return F.size(F.filter(toks, lambda t: t == phrase[0]))
    if len(phrase) == 1:
        return F.size(F.filter(toks, lambda t: t.startswith(phrase[0])))
    # counted in the joined tokens: a look-ahead leaves overlapping occurrences countable, and the
    # tokens are made once a row rather than once a position
    rest = " ".join(phrase[1:]) + (r"[^ ]*" if prefix else "")
    return F.regexp_count(F.array_join(toks, " "), F.lit(rf"(?<![^ ]){phrase[0]}(?= {rest}(?![^ ]))"))


def bm25(df: DataFrame, key: str, text: Column, query: str, k: int = 10, prefix: bool = False, where: Column | None = None) -> DataFrame:
    """``key`` and score of the ``k`` best rows that hold every query token; lower is better, ties by key.

    Document frequencies and lengths are those of the whole table, ``where`` filters what
    may come out. An empty query, an empty table and null texts give no row.
    """
    phrases = query_terms(query)
    if not phrases:
        return df.select(key).limit(0).withColumn("score", F.lit(None).cast("double"))
    work = df.withColumn("__t", tokens(text)).select(
        key, F.size("__t").alias("__n"), (F.lit(True) if where is None else F.coalesce(where, F.lit(False))).alias("__ok"), *[_frequency(F.col("__t"), p, prefix).alias(f"__f{i}") for i, p in enumerate(phrases)]
    )
    # texts are read and cut once; what both passes need of a row is a few numbers
    work = written(work, "bm25")
    stats = work.agg(F.count("*").alias("n"), F.avg("__n").alias("len"), *[F.sum((F.col(f"__f{i}") > 0).cast("bigint")).alias(f"d{i}") for i in range(len(phrases))]).first()
    n, mean = stats["n"], stats["len"] or 1.0
    score: Column = F.lit(0.0)
    for i in range(len(phrases)):
        d = stats[f"d{i}"] or 0
        idf = F.log(F.lit((n - d + 0.5) / (d + 0.5)))
        idf = F.when(idf <= 0, F.lit(IDF_FLOOR)).otherwise(idf)
        tf = F.col(f"__f{i}").cast("double")
        score = score - idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__n") / F.lit(float(mean))))
    hit = reduce(lambda a, b: a & b, [F.col(f"__f{i}") > 0 for i in range(len(phrases))])
    got = work.where(hit & F.col("__ok")).select(key, F.round(score, 6).alias("score"))
    return got.orderBy("score", key).limit(k)


def postings(df: DataFrame, key: str, text: Column) -> DataFrame:
    """Inverted table: term, ``key``, term frequency and the row's length; partial counts are made before the shuffle."""
    work = df.select(key, tokens(text).alias("t"))
    return work.select(key, F.size("t").alias("length"), F.explode("t").alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def search_postings(table: DataFrame, key: str, terms: list[str], n_docs: int, mean_length: float, k: int = 10) -> DataFrame:
    """Ranks from the inverted table: only the query terms' postings are read."""
    terms = list(dict.fromkeys(terms))
    mine = table.where(F.col("term").isin(terms))
    df_of = {r["term"]: r["d"] for r in mine.groupBy("term").agg(F.count("*").alias("d")).collect()}
    if len(df_of) < len(terms):
        return mine.select(key).limit(0).withColumn("score", F.lit(None).cast("double"))
    idf = F.element_at(F.create_map(*[x for t in terms for x in (F.lit(t), F.greatest(F.log(F.lit((n_docs - df_of[t] + 0.5) / (df_of[t] + 0.5))), F.lit(IDF_FLOOR)))]), F.col("term"))
    part = -idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean_length)))
    got = mine.groupBy(key).agg(F.count("*").alias("hits"), F.sum(part).alias("s")).where(F.col("hits") == len(terms))
    return got.select(key, F.round("s", 6).alias("score")).orderBy("score", key).limit(k)


def like(df: DataFrame, columns: list[str], text: str, k: int | None = None, key: str | None = None) -> DataFrame:
    """Rows of which any column holds the text, case aside; wildcards in the text are plain characters."""
    unknown = set(columns) - set(df.columns)
    if unknown:
        raise ValueError(f"no such column: {sorted(unknown)}")
    got = df.where(reduce(lambda a, b: a | b, [F.lower(F.col(c).cast("string")).contains(text.lower()) for c in columns]))
    if key:
        got = got.orderBy(key)
    return got.limit(k) if k else got


def distance(a: Column, b: list[float]) -> Column:
    other = F.array(*[F.lit(float(x)) for x in b])
    return F.sqrt(F.aggregate(F.zip_with(a, other, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v))


def knn(df: DataFrame, key: str, vector: str, query: list[float], k: int = 10, after: Column | None = None) -> DataFrame:
    """The ``k`` nearest rows by L2 distance, ties by key. ``after`` filters the k found, as a filter on a vector
    index does, so fewer may be left. Vectors that are null or of another length take no part."""
    fit = df.where(F.size(vector) == len(query))
    near = fit.withColumn("distance", F.round(distance(F.col(vector), query), 6)).orderBy("distance", key).limit(k)
    return near if after is None else near.where(after)


def vector_of(df: DataFrame, key: str, value, vector: str) -> list[float]:
    """One row's vector, for a query by example."""
    row = df.where(F.col(key) == value).select(vector).first()
    return [] if row is None else list(row[0])


# Accented letters and the plain ones they fold to.
_ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"


def folded(text: Column) -> Column:
    """Lowered text with accents folded away."""
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


def _head(term: Column) -> Column:
    first = F.substring(term, 1, 1)
    return F.when(first.rlike("[a-z0-9]"), first).otherwise("_")


def build_index(sources: list[tuple[str, DataFrame, str, Column]], path: str) -> str:
    """Writes one index over several tables, each (name, table, key, text): postings with places, and lengths.

    Postings lie in partitions by the term's first character, sorted by term within, so a
    word, a prefix or a phrase reads a few row groups. Accents are folded. Null texts have
    no term; keys are kept as text beside their table's name.
    """
    rows = None
    for name, df, key, text in sources:
        one = df.select(F.lit(name).alias("source"), F.col(key).cast("string").alias("key"), tokens(folded(text)).alias("t"))
        rows = one if rows is None else rows.unionByName(one)
    rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.size("t")).alias("words")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    places = rows.select("source", "key", F.size("t").alias("length"), F.posexplode("t").alias("at", "term"))
    made = places.groupBy("source", "key", "term").agg(F.first("length").alias("length"), F.sort_array(F.collect_list("at")).alias("places"))
    made = made.withColumn("head", _head(F.col("term")))
    made.repartition("head", F.pmod(F.hash("term"), F.lit(8))).sortWithinPartitions("head", "term").write.mode("overwrite").partitionBy("head").option("compression", "zstd").parquet(f"{path}/postings")
    return path


def _shifted(places: str, by: int) -> Column:
    return F.transform(places, lambda p: p - F.lit(by))


def _matching(spark, path: str, phrase: list[str], prefix: bool) -> DataFrame:
    """(source, key, length, f) of the rows that hold a phrase, from the postings of its words alone."""
    post = spark.read.schema("source string, key string, term string, length int, places array<int>, head string").parquet(f"{path}/postings")
    found = None
    for i, word in enumerate(phrase):
        goes_on = prefix and i == len(phrase) - 1
        mine = post.where((F.col("head") == F.lit(word[0] if word[0].isascii() and word[0].isalnum() else "_")) & (F.col("term").startswith(word) if goes_on else F.col("term") == word))
        mine = mine.select("source", "key", "length", _shifted("places", i).alias("starts"))
        if goes_on:
            mine = mine.groupBy("source", "key").agg(F.first("length").alias("length"), F.flatten(F.collect_list("starts")).alias("starts"))
        if found is None:
            found = mine
        else:
            found = found.join(mine.select("source", "key", F.col("starts").alias("more")), ["source", "key"]).select("source", "key", "length", F.array_intersect("starts", "more").alias("starts"))
    return found.select("source", "key", "length", F.size("starts").alias("f")).where("f > 0")


def search_index(spark, path: str, query: str, k: int = 10, prefix: bool = False, source: str | None = None) -> DataFrame:
    """(source, key, score) of the ``k`` best rows that hold every query token; as ``bm25``, but from an index that ``build_index`` wrote."""
    stats = spark.read.parquet(f"{path}/stats").agg(F.sum("n").alias("n"), F.sum("words").alias("w")).first()
    n, mean = stats["n"] or 0, (stats["w"] or 0) / max(stats["n"] or 0, 1) or 1.0
    phrases = [[w.translate(str.maketrans(_ACCENTED, _PLAIN)) for w in p] for p in query_terms(query)]
    if not phrases:
        return spark.createDataFrame([], "source string, key string, score double")
    got = None
    for i, p in enumerate(phrases):
        one = written(_matching(spark, path, p, prefix), "index-hits")
        d = one.count()
        idf = max(math.log((n - d + 0.5) / (d + 0.5)), IDF_FLOOR) if d else IDF_FLOOR
        tf = F.col("f").cast("double")
        one = one.select("source", "key", (-F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(float(mean))))).alias(f"s{i}"))
        got = one if got is None else got.join(one, ["source", "key"])
    if source is not None:
        got = got.where(F.col("source") == source)
    total = reduce(lambda a, b: a + b, [F.col(f"s{i}") for i in range(len(phrases))])
    return got.select("source", "key", F.round(total, 6).alias("score")).orderBy("score", "source", "key").limit(k)
