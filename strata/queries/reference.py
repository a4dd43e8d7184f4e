"""Queries over the test tables for every operator family, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import docs, drift, entity, graphs, hashing, ranking, records, search, web
from ..session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"


def _bm25_sql(conditions: list[str], where: str = "true", k: int = 10, text: str = "text", src: str = "documents", key: str = "doc_id") -> str:
    """SQL of the rank, with one count expression over the token list ``t`` for each query token."""
    f = ", ".join(f"{c} AS f{i}" for i, c in enumerate(conditions))
    d = ", ".join(f"sum(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END) AS d{i}" for i in range(len(conditions)))
    score = " + ".join(
        f"(CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d{i} + 0.5) / (d{i} + 0.5)) END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(conditions))
    )
    hit = " AND ".join(f"f{i} > 0" for i in range(len(conditions)))
    return f"""WITH a AS (SELECT *, regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}]+') AS t FROM {src}),
        b AS (SELECT *, len(t) AS len, {f} FROM a), s AS (SELECT count(*) AS n, avg(len) AS mean, {d} FROM b)
        SELECT {key}, round(-({score}), 6) AS score FROM b, s WHERE {hit} AND {where} ORDER BY score, {key} LIMIT {k}"""


def _count(word: str) -> str:
    return f"len(list_filter(t, lambda x: x = '{word}'))"


@query(_bm25_sql([_count("fractions"), _count("students")]))
def bm25_topk(spark, d):
    """Documents that hold all words, best first."""
    return search.bm25(table(spark, d, "documents"), "doc_id", F.col("text"), "fractions students")


@query(_bm25_sql([_count("erosion")], "lang = 'en' AND doc_type = 'memo'"))
def bm25_filtered(spark, d):
    return search.bm25(table(spark, d, "documents"), "doc_id", F.col("text"), "erosion", where=(F.col("lang") == "en") & (F.col("doc_type") == "memo"))


@query(_bm25_sql(["len(list_filter(t, lambda x: starts_with(x, 'photo')))", "len(list_filter(t, lambda x: starts_with(x, 'rubri')))"]))
def prefix_search(spark, d):
    """Every query token may go on: 'photo' meets photography and photosynthesis."""
    return search.bm25(table(spark, d, "documents"), "doc_id", F.col("text"), "photo rubri", prefix=True)


@query(_bm25_sql(["len(list_filter(range(len(t)), lambda i: t[i + 1] = 'primary' AND t[i + 2] = 'sources'))"]))
def phrase_search(spark, d):
    """A dotted token is the phrase of its parts."""
    return search.bm25(table(spark, d, "documents"), "doc_id", F.col("text"), "primary.sources")


@query("SELECT doc_id, title FROM documents WHERE contains(lower(text), 'water cycle') ORDER BY doc_id LIMIT 50")
def like_search(spark, d):
    return search.like(table(spark, d, "documents"), ["text"], "WATER cycle", 50, "doc_id").select("doc_id", "title")


@query("SELECT item_no FROM feed_items WHERE contains(lower(title), 'spelling') OR contains(lower(summary), 'spelling') OR contains(lower(category), 'spelling')")
def like_any_column(spark, d):
    return search.like(table(spark, d, "feed_items"), ["title", "summary", "category"], "Spelling").select("item_no")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def group_count_subject(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))


@query(
    f"""WITH p AS (SELECT doc_id, unnest({TOK}) AS term FROM documents), q AS (SELECT term, doc_id, count(*) AS tf FROM p GROUP BY ALL)
        SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM q GROUP BY term"""
)
def vocabulary(spark, d):
    """Document and collection frequency of every word, from the inverted table."""
    p = search.postings(table(spark, d, "documents"), "doc_id", F.col("text"))
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(_bm25_sql([_count("library"), _count("grade")], k=20))
def postings_search(spark, d):
    """The same rank from the inverted table instead of the texts."""
    df = table(spark, d, "documents")
    n, mean = df.agg(F.count("*"), F.avg(F.size(search.tokens(F.col("text"))))).first()
    return search.search_postings(search.postings(df, "doc_id", F.col("text")), "doc_id", ["library", "grade"], n, mean or 1.0, 20)


_KNN = """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7),
    r AS (SELECT vec_id, label, round(list_distance(v.embedding::DOUBLE[], q.e::DOUBLE[]), 6) AS distance FROM embeddings v, q ORDER BY distance, vec_id LIMIT 10)"""


@query(_KNN + " SELECT vec_id, label, distance FROM r")
def knn_topk(spark, d):
    e = table(spark, d, "embeddings")
    return search.knn(e, "vec_id", "embedding", search.vector_of(e, "vec_id", 7, "embedding")).select("vec_id", "label", "distance")


@query(_KNN + " SELECT vec_id, label, distance FROM r WHERE label % 2 = 0")
def knn_postfilter(spark, d):
    """The filter comes after the k nearest, so fewer may be left."""
    e = table(spark, d, "embeddings")
    return search.knn(e, "vec_id", "embedding", search.vector_of(e, "vec_id", 7, "embedding"), after=F.col("label") % 2 == 0).select("vec_id", "label", "distance")


@query(f"SELECT 'keyword' AS engine, 'no_vectors' AS gap, doc_id, score FROM ({_bm25_sql([_count('magnetism')], k=5)})")
def search_fallback(spark, d):
    """Unified search without vectors for the corpus: keyword results and the reason."""
    got = search.bm25(table(spark, d, "documents"), "doc_id", F.col("text"), "magnetism", 5)
    return got.select(F.lit("keyword").alias("engine"), F.lit("no_vectors").alias("gap"), "doc_id", "score")


@query("SELECT source, count(*) AS n_docs, CAST(round_even(sum(length(text)) / 4.0, 0) AS BIGINT) AS tokens, round(100.0 - 100.0 * 250 / greatest(round_even(sum(length(text)) / 4.0, 0), 1), 4) AS saved FROM documents WHERE text IS NOT NULL GROUP BY source")
def token_savings(spark, d):
    """Tokens of a corpus at four characters each and what a lookup of 250 tokens saves."""
    tokens = F.bround(F.sum(F.length("text")) / 4.0)
    got = table(spark, d, "documents").where("text is not null").groupBy("source").agg(F.count("*").alias("n_docs"), tokens.cast("bigint").alias("tokens"))
    return got.withColumn("saved", F.round(100.0 - 100.0 * 250 / F.greatest(F.col("tokens").cast("double"), F.lit(1.0)), 4))


# ---- hashes, duplicates, snapshots


@query(
    """WITH h AS (SELECT item_no, sha256(concat_ws('|', coalesce(feed_id, 'None'), coalesce(guid, link, 'None'), coalesce(title, 'None'))) AS h, content_sha256 AS c FROM feed_items)
    SELECT item_no, CASE WHEN c IS NULL THEN 'missing' WHEN lower(trim(c)) = h THEN 'same' ELSE 'other' END AS state FROM h"""
)
def content_hash(spark, d):
    h = hashing.key_hash(F.col("feed_id"), F.coalesce("guid", "link"), F.col("title"))
    c = F.col("content_sha256")
    return table(spark, d, "feed_items").select("item_no", F.when(c.isNull(), "missing").when(F.lower(F.trim(c)) == h, "same").otherwise("other").alias("state"))


@query("SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) AS h FROM documents")
def text_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", hashing.text_hash(F.col("text")).alias("h"))


@query("SELECT feed_id, guid, item_no, title FROM (SELECT *, row_number() OVER (PARTITION BY feed_id, guid ORDER BY item_no) AS rn FROM feed_items) WHERE rn = 1")
def dedup_keep_first(spark, d):
    return hashing.keep_first(table(spark, d, "feed_items").select("feed_id", "guid", "item_no", "title"), ["feed_id", "guid"], ["item_no"])


@query(
    """WITH h AS (SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) AS h FROM documents WHERE text IS NOT NULL), g AS (SELECT h, min(doc_id) AS f, count(*) AS n FROM h GROUP BY h HAVING count(*) > 1)
    SELECT doc_id AS duplicate, f AS first, n FROM h JOIN g USING (h) WHERE doc_id <> f"""
)
def dup_edges(spark, d):
    return hashing.duplicate_edges(table(spark, d, "documents"), "doc_id", hashing.text_hash(F.col("text")))


@query(
    """WITH m AS (SELECT max(first_seen) AS last FROM feed_items), b AS (SELECT i.*, row_number() OVER (PARTITION BY feed_id, guid ORDER BY item_no) AS rn FROM feed_items i, m WHERE first_seen = last)
    SELECT feed_id, guid, item_no FROM b WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM feed_items s, m WHERE s.first_seen < last AND s.feed_id = b.feed_id AND s.guid = b.guid)"""
)
def insert_ignore(spark, d):
    """What the newest delivery adds to the store, by feed and guid."""
    items = table(spark, d, "feed_items").select("feed_id", "guid", "item_no", "first_seen")
    last = items.agg(F.max("first_seen")).first()[0]
    return hashing.insert_ignore(items.where(F.col("first_seen") < last), items.where(F.col("first_seen") == last), ["feed_id", "guid"], ["item_no"]).select("feed_id", "guid", "item_no")


@query("SELECT first_seen, feed_id, item_no, title FROM feed_items ORDER BY first_seen DESC, feed_id, item_no LIMIT 40")
def feed_digest(spark, d):
    return table(spark, d, "feed_items").select("first_seen", "feed_id", "item_no", "title").orderBy(F.desc("first_seen"), "feed_id", "item_no").limit(40)



# ---- drift and freshness


@query(
    """WITH b AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 10 <> 0), n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN concat(coalesce(text, ''), '!') ELSE coalesce(text, '') END) AS h FROM documents WHERE doc_id % 10 <> 1)
    SELECT doc_id, CASE WHEN b.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN b.h <> n.h THEN 'changed' ELSE 'current' END AS state FROM b FULL JOIN n USING (doc_id)"""
)
def drift_3state(spark, d):
    """A baseline against a later state of the same corpus: both are whole tables but for the rows that came or went."""
    docs_ = table(spark, d, "documents")
    text = F.coalesce("text", F.lit(""))
    base = docs_.where("doc_id % 10 <> 0").select("doc_id", F.sha2(text, 256).alias("h"))
    now = docs_.where("doc_id % 10 <> 1").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat(text, F.lit("!"))).otherwise(text), 256).alias("h"))
    return drift.diff(base, now, "doc_id", "h")


@query(
    """WITH l AS (SELECT feed_id AS id, max(content_sha256) AS h FROM feed_items GROUP BY feed_id)
    SELECT f.id, CASE WHEN l.id IS NULL THEN 'missing' WHEN f.state.content_sha256 IS NULL THEN 'new' WHEN l.h IS NULL OR f.state.content_sha256 <> l.h THEN 'changed' ELSE 'unchanged' END AS state FROM feeds f LEFT JOIN l ON f.id = l.id"""
)
def registry_diff(spark, d):
    found = table(spark, d, "feed_items").groupBy(F.col("feed_id").alias("id")).agg(F.max("content_sha256").alias("h"))
    return drift.registry_diff(table(spark, d, "feeds").select("id", F.col("state.content_sha256").alias("h")), found, "id", "h")


@query(
    """WITH n AS (SELECT msid, school_name, type, grades, status, row_number() OVER (PARTITION BY msid ORDER BY row_no) AS a, row_number() OVER (PARTITION BY msid ORDER BY row_no DESC) AS z FROM schools WHERE msid IS NOT NULL),
    l AS (SELECT * FROM n WHERE a = 1), r AS (SELECT * FROM n WHERE z = 1),
    u AS (SELECT l.msid, unnest([{'field': 'school_name', 'left': l.school_name, 'right': r.school_name}, {'field': 'type', 'left': l.type, 'right': r.type}, {'field': 'grades', 'left': l.grades, 'right': r.grades}, {'field': 'status', 'left': l.status, 'right': r.status}]) AS x FROM l JOIN r USING (msid))
    SELECT msid, x.field AS field, x."left" AS "left", x."right" AS "right" FROM u WHERE x."left" IS NOT NULL AND x."right" IS NOT NULL AND x."left" <> x."right\""""
)
def reconcile_fields(spark, d):
    """First against latest row of each school, field by field."""
    s = table(spark, d, "schools").where("msid is not null").select("msid", "row_no", "school_name", "type", "grades", "status")
    latest = s.withColumn("row_no", -F.col("row_no"))
    return drift.reconcile(hashing.keep_first(s, ["msid"], ["row_no"]), hashing.keep_first(latest, ["msid"], ["row_no"]), "msid", ["school_name", "type", "grades", "status"])


_NOW = "2026-07-01 00:00:00"
_AGE = f"date_diff('second', try_cast(replace(replace(state.last_checked, 'T', ' '), 'Z', '') AS TIMESTAMP), TIMESTAMP '{_NOW}') // 86400"


def _checked() -> F.Column:
    return F.try_to_timestamp(F.col("state.last_checked"), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))


def _fresh(spark, d):
    age = F.floor((F.unix_timestamp(F.lit(_NOW).cast("timestamp")) - F.unix_timestamp(_checked())) / 86400)
    feeds = table(spark, d, "feeds")
    found = table(spark, d, "feed_items").groupBy(F.col("feed_id").alias("fid")).agg(F.max("content_sha256").alias("h"))
    both = feeds.join(found, feeds.id == found.fid, "left")
    st = drift.freshness(F.col("state.last_status"), F.lit(None).cast("string"), age, F.col("state.content_sha256"), F.coalesce("h", F.lit("")), 365)
    return both.select("id", st.alias("freshness"))


_FRESH = f"""SELECT f.id, CASE WHEN state.last_status IN (404, 410) THEN 'removed_404' WHEN state.last_status = 304 THEN 'current' WHEN state.last_status IS NULL AND {_AGE} > 365 THEN 'stale_age' WHEN state.last_status IS NULL THEN 'uncertain'
    WHEN (state.last_status = 0 OR state.last_status >= 400) AND {_AGE} > 365 THEN 'stale_age' WHEN state.last_status = 0 OR state.last_status >= 400 THEN 'unreachable' WHEN state.content_sha256 IS NULL THEN 'uncertain'
    WHEN state.content_sha256 <> coalesce(h, '') THEN 'changed' ELSE 'current' END AS freshness FROM feeds f LEFT JOIN (SELECT feed_id, max(content_sha256) AS h FROM feed_items GROUP BY feed_id) l ON f.id = l.feed_id"""


@query(_FRESH)
def freshness_state(spark, d):
    return _fresh(spark, d)


@query(f"SELECT freshness, count(*) AS n FROM ({_FRESH}) GROUP BY freshness")
def state_counts(spark, d):
    return _fresh(spark, d).groupBy("freshness").agg(F.count("*").alias("n"))


@query(f"SELECT id, freshness FROM ({_FRESH}) WHERE freshness IN ('stale_age', 'removed_404', 'superseded', 'changed')")
def stale_list(spark, d):
    return _fresh(spark, d).where(F.col("freshness").isin("stale_age", "removed_404", "superseded", "changed"))


@query(f"SELECT id, cadence_days FROM feeds WHERE (state.last_checked IS NULL OR try_cast(replace(replace(state.last_checked, 'T', ' '), 'Z', '') AS TIMESTAMP) + cadence_days * INTERVAL 1 DAY < TIMESTAMP '2026-04-01 00:00:00') AND tier <> 'product_updates'")
def due_feeds(spark, d):
    """Feeds whose cadence has passed, without the tier that is off by default."""
    return table(spark, d, "feeds").where(drift.due(_checked(), F.col("cadence_days"), "2026-04-01 00:00:00") & (F.col("tier") != "product_updates")).select("id", "cadence_days")


@query(
    """WITH o AS (SELECT id, state.etag AS etag, state.last_modified AS last_modified FROM feeds WHERE state IS NOT NULL), n AS (SELECT feed_id AS id, CAST(NULL AS VARCHAR) AS etag, max(published) AS last_modified FROM feed_items GROUP BY feed_id)
    SELECT coalesce(o.id, n.id) AS id, coalesce(nullif(n.etag, ''), o.etag) AS etag, coalesce(nullif(n.last_modified, ''), o.last_modified) AS last_modified,
    n.id IS NOT NULL AND (o.id IS NULL OR (n.last_modified <> '' AND (o.last_modified IS NULL OR n.last_modified <> o.last_modified))) AS changed FROM o FULL JOIN n ON o.id = n.id"""
)
def fetch_state_upsert(spark, d):
    old = table(spark, d, "feeds").where("state is not null").select("id", "state.etag", "state.last_modified")
    new = table(spark, d, "feed_items").groupBy(F.col("feed_id").alias("id")).agg(F.max("published").alias("last_modified")).withColumn("etag", F.lit(None).cast("string"))
    return drift.upsert(old, new, "id", ["etag", "last_modified"])


@query(
    """WITH m AS (SELECT user_id, ts, event_id, event_type IN ('error', 'view') AS bad, sum(CASE WHEN event_type IN ('error', 'view') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events)
    SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM m WHERE bad GROUP BY user_id, island HAVING count(*) >= 4"""
)
def breaker_islands(spark, d):
    """Where a breaker of four bad events in a row would trip, by user."""
    return drift.streak_islands(table(spark, d, "events"), "user_id", "event_id", F.col("event_type").isin("error", "view"), 4)


# ---- schools


@query("""SELECT msid, row_no, coalesce(array_to_string(list_filter(list_transform(programs, lambda p: p.program_name), lambda x: x IS NOT NULL), ', '), '') AS programs FROM schools""")
def flatten_programs(spark, d):
    names = F.filter(F.transform("programs", lambda p: p["program_name"]), lambda x: x.isNotNull())
    return table(spark, d, "schools").select("msid", "row_no", F.coalesce(F.array_join(names, ", "), F.lit("")).alias("programs"))


@query("SELECT row_no FROM schools WHERE list_contains(levels, 'Elementary') AND coalesce(len(list_filter(programs, lambda p: p.program_type = 'magnet')), 0) > 0 OR contains(lower(school_name), 'charter')")
def school_query(spark, d):
    magnet = F.exists("programs", lambda p: p["program_type"] == "magnet")
    s = table(spark, d, "schools")
    return s.where((F.array_contains("levels", "Elementary") & F.coalesce(magnet, F.lit(False))) | F.lower("school_name").contains("charter")).select("row_no")


@query(
    """WITH l AS (SELECT district_number, unnest(CASE WHEN levels IS NULL OR len(levels) = 0 THEN ['?'] ELSE levels END) AS level FROM schools)
    SELECT district_number, coalesce(level, '?') AS level, count(*) AS n FROM l GROUP BY ALL"""
)
def school_level_profile(spark, d):
    s = table(spark, d, "schools").select("district_number", F.explode_outer("levels").alias("level"))
    return s.groupBy("district_number", F.coalesce("level", F.lit("?")).alias("level")).agg(F.count("*").alias("n"))


@query(
    """SELECT district_number, count(*) AS n_schools, count(CASE WHEN lower(status) = 'active' THEN 1 END) AS n_active, CAST(sum(coalesce(len(programs), 0)) AS BIGINT) AS n_programs,
    round(sum(CASE WHEN charter THEN 1 ELSE 0 END) / greatest(count(*), 1), 6) AS charter_share FROM schools GROUP BY district_number"""
)
def school_stats(spark, d):
    n_programs = F.greatest(F.coalesce(F.size("programs"), F.lit(0)), F.lit(0))
    return table(spark, d, "schools").groupBy("district_number").agg(
        F.count("*").alias("n_schools"),
        F.count(F.when(F.lower("status") == "active", 1)).alias("n_active"),
        F.sum(n_programs).alias("n_programs"),
        F.round(F.sum(F.when(F.col("charter"), 1).otherwise(0)) / F.greatest(F.count("*"), F.lit(1)), 6).alias("charter_share"),
    )


# ---- entity resolution

_DROP = ["school", "elementary", "middle", "high", "primary", "center", "academy", "charter", "learning", "career"]
_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(school_name), '[''’‘]', '', 'g'), '[\".,/()&-]', ' ', 'g'), '\\b(" + "|".join(_DROP) + ")\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT row_no, {_NORM} AS name FROM schools")
def name_normalize(spark, d):
    return table(spark, d, "schools").select("row_no", entity.normalised(F.col("school_name"), _DROP).alias("name"))


_MATCH = """WITH l AS (SELECT record_no, lower(trim(current_school.school_name)) AS name FROM records WHERE current_school.school_name IS NOT NULL), n AS (SELECT DISTINCT name, list_distinct(list_filter(string_split(name, ' '), lambda x: x <> '')) AS w FROM l),
    s AS (SELECT lower(trim(school_name)) AS name, min(row_no) AS row_no FROM schools WHERE school_name IS NOT NULL GROUP BY 1), r AS (SELECT *, list_distinct(list_filter(string_split(name, ' '), lambda x: x <> '')) AS w FROM s),
    p AS (SELECT n.name, r.row_no, CASE WHEN n.name = r.name THEN 1 ELSE 0 END AS e, CASE WHEN n.name = r.name THEN 1.0 ELSE len(list_intersect(n.w, r.w)) / (len(n.w) + len(r.w) - len(list_intersect(n.w, r.w))) END AS score FROM n JOIN r ON list_has_any(n.w, r.w)),
    b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY e DESC, score DESC, row_no) AS rn FROM p WHERE score >= 0.65)"""


def _matched(spark, d):
    left = table(spark, d, "records").select("record_no", F.lower(F.trim("current_school.school_name")).alias("name"))
    right = table(spark, d, "schools").select("row_no", F.lower(F.trim("school_name")).alias("name"))
    return entity.best_match(left, right, "record_no", "row_no", "name", 0.65)


@query(_MATCH + " SELECT record_no, row_no, round(score, 6) AS score FROM l JOIN b USING (name) WHERE rn = 1")
def jaccard_match(spark, d):
    """Each record's school by name: exact first, else the most alike."""
    return _matched(spark, d)


@query(_MATCH + " SELECT (SELECT count(*) FROM l JOIN b USING (name) WHERE rn = 1) AS matched, (SELECT count(*) FROM l) AS total, round((SELECT count(*) FROM l JOIN b USING (name) WHERE rn = 1) / greatest((SELECT count(*) FROM l), 1), 6) AS rate")
def match_rate(spark, d):
    total = table(spark, d, "records").agg(F.count("current_school.school_name").alias("total"))
    got = _matched(spark, d).agg(F.count("*").alias("matched"))
    both = got.withColumn("k", F.lit(1)).join(total.withColumn("k", F.lit(1)), "k").drop("k")
    return both.select("matched", "total", F.round(F.col("matched") / F.greatest("total", F.lit(1)), 6).alias("rate"))


_ENTITIES = """WITH RECURSIVE k AS (SELECT row_no, '0|' || lower(trim(msid)) AS key FROM schools WHERE trim(msid) <> '' UNION SELECT row_no, '1|' || lower(trim(school_name)) FROM schools WHERE trim(school_name) <> ''),
    e AS (SELECT DISTINCT a.row_no AS a, b.row_no AS b FROM k a JOIN k b USING (key)), r AS (SELECT row_no AS a, row_no AS b FROM schools UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a AS row_no, min(b) AS entity FROM r GROUP BY a)"""


@query(
    _ENTITIES
    + """ SELECT entity, arg_min(msid, row_no) FILTER (WHERE trim(msid) <> '') AS msid, arg_min(school_name, row_no) FILTER (WHERE trim(school_name) <> '') AS school_name, arg_min(type, row_no) FILTER (WHERE trim(type) <> '') AS type, arg_min(grades, row_no) FILTER (WHERE trim(grades) <> '') AS grades,
    string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS n_rows FROM schools JOIN c USING (row_no) GROUP BY entity"""
)
def entity_merge(spark, d):
    """School rows folded into schools over number and name, across districts and any number of steps."""
    got = entity.merged(table(spark, d, "schools"), "row_no", ["msid", "school_name"], ["type", "grades"], "source")
    return got.withColumn("sources", F.when(F.size("sources") > 0, F.array_join("sources", ",")))


# ---- cues, winners, overlays, chains

CUES = [
    ("science", "erosion", 2), ("science", "magnetism", 2), ("science", "photosynthesis", 2), ("science", "water cycle", 2), ("science", "lab", 1),
    ("mathematics", "fraction", 2), ("mathematics", "probability", 2), ("mathematics", "linear functions", 2), ("mathematics", "place value", 2), ("mathematics", "unit rates", 2),
    ("writing", "paragraph", 2), ("writing", "persuasive", 2), ("writing", "argument", 2), ("writing", "figurative", 2), ("writing", "main idea", 1),
    ("operations", "bus", 1), ("operations", "board", 1), ("operations", "portal", 2), ("operations", "vote", 1),
]


def _cue_sql() -> str:
    labels = list(dict.fromkeys(c[0] for c in CUES))
    parts = []
    for i, label in enumerate(labels):
        total = " + ".join(f"CASE WHEN contains(lower(coalesce(text, '')), '{c}') THEN {w} ELSE 0 END" for lab, c, w in CUES if lab == label)
        parts.append(f"SELECT doc_id, '{label}' AS label, {i} AS pos, CAST({total} AS INTEGER) AS score FROM documents")
    return " UNION ALL ".join(parts)


@query(_cue_sql())
def cue_scores(spark, d):
    return ranking.cue_scores(table(spark, d, "documents"), "doc_id", F.col("text"), CUES)


@query(
    f"""WITH s AS ({_cue_sql()}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rn FROM s),
    t AS (SELECT a.doc_id, a.label AS first, a.score AS first_score, b.label AS second, b.score AS second_score, a.score - b.score AS margin FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.rn = 1 AND b.rn = 2)
    SELECT *, CASE WHEN first_score = 0 THEN 'low' WHEN margin >= 2 THEN 'high' WHEN margin = 1 THEN 'medium' ELSE 'low' END AS confidence FROM t"""
)
def route_top2(spark, d):
    """Best and second label of every document with margin and confidence."""
    return ranking.routed(table(spark, d, "documents"), "doc_id", F.col("text"), CUES)


@query(
    f"""WITH s AS ({_cue_sql()}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rn FROM s),
    t AS (SELECT a.doc_id, a.label AS chosen, b.label AS alternate, a.score AS top, b.score AS next FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.rn = 1 AND b.rn = 2)
    SELECT doc_id, chosen, alternate, top FROM t WHERE top > 0 AND (top = next OR (top - next <= 1 AND next >= 2))"""
)
def minority_report(spark, d):
    """Documents whose choice is nearly a tie, with the alternative kept."""
    got = route_top2(spark, d).where("first_score > 0 and (margin = 0 or (margin <= 1 and second_score >= 2))")
    return got.select("doc_id", F.col("first").alias("chosen"), F.col("second").alias("alternate"), F.col("first_score").alias("top"))


_CLAIMS = """SELECT concat(category, '/', coalesce(grade_band, '-')) AS claim, id, authority AS reading,
    CASE WHEN authority = 'primary' THEN 40 ELSE 20 END + CASE tier WHEN 'canonical' THEN 30 WHEN 'district' THEN 20 ELSE 10 END + CASE scope WHEN 'state' THEN 9 WHEN 'district' THEN 6 ELSE 3 END AS rank, verified FROM feeds"""


def _claims(spark, d):
    rank = (
        F.when(F.col("authority") == "primary", 40).otherwise(20)
        + F.when(F.col("tier") == "canonical", 30).when(F.col("tier") == "district", 20).otherwise(10)
        + F.when(F.col("scope") == "state", 9).when(F.col("scope") == "district", 6).otherwise(3)
    )
    return table(spark, d, "feeds").select(F.concat("category", F.lit("/"), F.coalesce("grade_band", F.lit("-"))).alias("claim"), "id", F.col("authority").alias("reading"), rank.alias("rank"), "verified")


@query(
    f"""WITH c AS ({_CLAIMS}), w AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY rank DESC, id) AS rn FROM c), t AS (SELECT * FROM w WHERE rn = 1)
    SELECT t.claim, t.id AS winner, t.reading AS winning_reading, t.rank AS winning_rank, count(*) AS n_candidates,
    count(CASE WHEN lower(trim(c.reading)) <> lower(trim(t.reading)) THEN 1 END) AS n_conflicts,
    count(CASE WHEN lower(trim(c.reading)) <> lower(trim(t.reading)) AND t.rank - c.rank <= 15 THEN 1 END) AS n_close FROM c JOIN t USING (claim) GROUP BY ALL"""
)
def source_winner(spark, d):
    """The strongest source of each claim and how far the others disagree."""
    return ranking.winners(_claims(spark, d), "claim", "rank", "id", "reading")


@query(
    f"""WITH c AS ({_CLAIMS}), w AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY rank DESC, id) AS rn FROM c), t AS (SELECT * FROM w WHERE rn = 1)
    SELECT t.claim, t.id AS source_a, c.id AS source_b, CASE WHEN t.rank - c.rank <= 15 THEN 'high' ELSE 'medium' END AS materiality FROM c JOIN t USING (claim) WHERE c.verified AND c.id <> t.id AND c.reading <> t.reading"""
)
def conflict_report(spark, d):
    """Verified sources that read otherwise than the winner; each is paired with the winner only."""
    c = _claims(spark, d)
    top = ranking.winners(c, "claim", "rank", "id", "reading")
    both = c.where("verified").join(top, "claim").where((F.col("id") != F.col("winner")) & (F.col("reading") != F.col("winning_reading")))
    return both.select("claim", F.col("winner").alias("source_a"), F.col("id").alias("source_b"), F.when(F.col("winning_rank") - F.col("rank") <= 15, "high").otherwise("medium").alias("materiality"))


@query(
    """WITH base AS (SELECT id AS k, 'tz' AS field, tz AS value FROM feeds), layers AS (SELECT id AS k, 'tz' AS field, 'sets' AS mode, 'UTC' AS value, 1 AS rank FROM feeds UNION ALL SELECT id, 'tz', 'overrides', 'America/New_York', 5 FROM feeds WHERE category = 'standards'
    UNION ALL SELECT id, 'tz', 'overrides', 'America/Chicago', 9 FROM feeds WHERE scope = 'state' UNION ALL SELECT id, 'tags', 'adds', category, 2 FROM feeds UNION ALL SELECT id, 'tags', 'adds', tier, 3 FROM feeds),
    k AS (SELECT k, field FROM base UNION SELECT k, field FROM layers)
    SELECT k.k AS id, k.field, nullif(concat_ws(';', coalesce((SELECT value FROM layers l WHERE l.k = k.k AND l.field = k.field AND mode = 'overrides' ORDER BY rank DESC LIMIT 1), nullif((SELECT value FROM base b WHERE b.k = k.k AND b.field = k.field), ''),
    (SELECT value FROM layers l WHERE l.k = k.k AND l.field = k.field AND mode = 'sets' ORDER BY rank LIMIT 1)), (SELECT string_agg(value, ';' ORDER BY rank) FROM layers l WHERE l.k = k.k AND l.field = k.field AND mode = 'adds')), '') AS value FROM k"""
)
def overlay_merge(spark, d):
    f = table(spark, d, "feeds")
    layer = lambda df, field, mode, value, rank: df.select("id", F.lit(field).alias("field"), F.lit(mode).alias("mode"), value.cast("string").alias("value"), F.lit(rank).alias("rank"))
    layers = (
        layer(f, "tz", "sets", F.lit("UTC"), 1)
        .unionByName(layer(f.where("category = 'standards'"), "tz", "overrides", F.lit("America/New_York"), 5))
        .unionByName(layer(f.where("scope = 'state'"), "tz", "overrides", F.lit("America/Chicago"), 9))
        .unionByName(layer(f, "tags", "adds", F.col("category"), 2))
        .unionByName(layer(f, "tags", "adds", F.col("tier"), 3))
    )
    return ranking.overlay(f.select("id", F.lit("tz").alias("field"), F.col("tz").alias("value")), layers, "id")


@query(
    """WITH o AS (SELECT s.s_name AS provider, s.s_suppkey AS pos, p.p_brand AS evidence, bool_or(p.p_size > 40) AS authoritative FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey WHERE s.s_acctbal > 0 GROUP BY ALL),
    a AS (SELECT DISTINCT p_brand AS evidence FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey), c AS (SELECT evidence, string_agg(provider, '>' ORDER BY NOT authoritative, pos) AS chain FROM o WHERE NOT (pos % 5 = 0 AND evidence LIKE '%1') GROUP BY evidence)
    SELECT a.evidence, coalesce(chain, '') AS chain FROM a LEFT JOIN c USING (evidence)"""
)
def provider_chain(spark, d):
    """Suppliers of each brand in order: authoritative ones first; suppliers in debt are off, some are held back from some brands."""
    line, sup, part = (table(spark, d, n) for n in ("lineitem", "supplier", "part"))
    offers = (
        line.select("l_suppkey", "l_partkey")
        .join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("s_name").alias("provider"), F.col("s_suppkey").alias("pos"), F.col("p_brand").alias("evidence"))
        .agg(F.bool_or(F.col("p_size") > 40).alias("authoritative"), F.bool_or(F.col("s_acctbal") > 0).alias("active"))
    )
    blocked = offers.where((F.col("pos") % 5 == 0) & F.col("evidence").endswith("1")).select("provider", "evidence")
    return ranking.provider_chains(offers, blocked)


_WEIGHTS = {"integrity": 0.25, "accuracy": 0.2, "alignment": 0.2, "governance": 0.2, "access": 0.15}
_SCORES = "SELECT o_orderkey, o_orderkey % 6 AS integrity, (o_orderkey // 2) % 6 AS accuracy, CAST(floor(o_totalprice) AS BIGINT) % 6 AS alignment, o_custkey % 6 AS governance, 3 + o_custkey % 3 AS access FROM orders"


@query(
    f"""WITH s AS ({_SCORES}), c AS (SELECT *, round(0.0 + integrity * 0.25::DOUBLE + accuracy * 0.2::DOUBLE + alignment * 0.2::DOUBLE + governance * 0.2::DOUBLE + access * 0.15::DOUBLE, 3) AS composite FROM s)
    SELECT o_orderkey, composite, CASE WHEN least(integrity, accuracy, alignment, governance, access) = 0 THEN 'Rejected' WHEN composite >= 4 THEN 'Approved' WHEN composite >= 3 THEN 'Conditionally Approved' WHEN composite >= 2 THEN 'Remediation Required' ELSE 'Rejected' END AS decision FROM c"""
)
def quality_composite(spark, d):
    """Weighted score and decision; any dimension at zero rejects."""
    o = table(spark, d, "orders")
    s = o.select(
        "o_orderkey", (F.col("o_orderkey") % 6).alias("integrity"), (F.expr("o_orderkey div 2") % 6).alias("accuracy"), (F.floor("o_totalprice") % 6).alias("alignment"), (F.col("o_custkey") % 6).alias("governance"), (3 + F.col("o_custkey") % 3).alias("access")
    ).withColumn("composite", ranking.composite(_WEIGHTS))
    band = ranking.banded(F.col("composite"), [(4.0, "Approved"), (3.0, "Conditionally Approved"), (2.0, "Remediation Required")], "Rejected")
    return s.select("o_orderkey", "composite", F.when(F.least(*_WEIGHTS) == 0, "Rejected").otherwise(band).alias("decision"))


@query(
    """WITH i AS (SELECT id, CAST(verified IS NOT TRUE AS INTEGER) * 10 + CAST(tz IS NULL AS INTEGER) * 4 + CAST(state IS NULL AS INTEGER) * 20 + CAST(coalesce(state.last_status, 200) >= 400 AS INTEGER) * 15 AS penalty FROM feeds)
    SELECT id, greatest(0, 100 - penalty) AS score, CASE WHEN 100 - penalty >= 90 THEN 'strong' WHEN 100 - penalty >= 70 THEN 'usable_with_warnings' WHEN 100 - penalty >= 40 THEN 'partial' ELSE 'not_ready' END AS band FROM i"""
)
def readiness_score(spark, d):
    i = lambda c: F.when(c, 1).otherwise(0)
    penalty = i(~F.coalesce("verified", F.lit(False))) * 10 + i(F.col("tz").isNull()) * 4 + i(F.col("state").isNull()) * 20 + i(F.coalesce("state.last_status", F.lit(200)) >= 400) * 15
    got = table(spark, d, "feeds").select("id", F.greatest(F.lit(0), 100 - penalty).alias("score"))
    return got.withColumn("band", ranking.banded(F.col("score"), [(90, "strong"), (70, "usable_with_warnings"), (40, "partial")], "not_ready"))


@query("SELECT rater, count(*) AS n, count(CASE WHEN label = 'ok' THEN 1 END) AS approved, round(count(CASE WHEN label = 'ok' THEN 1 END) / greatest(count(*), 1), 6) AS rate FROM doc_labels GROUP BY rater")
def ledger_rates(spark, d):
    ok = F.count(F.when(F.col("label") == "ok", 1))
    return table(spark, d, "doc_labels").groupBy("rater").agg(F.count("*").alias("n"), ok.alias("approved"), F.round(ok / F.greatest(F.count("*"), F.lit(1)), 6).alias("rate"))


_PII = "(SELECT item_no, regexp_replace(concat_ws(' ', title, summary), '\\b(\\d{3}-\\d{4})\\b', '407-\\1', 'g') AS x FROM feed_items)"


_PHONES = "list_filter(regexp_extract_all(x, '\\b\\d{3}[-.]\\d{3}[-.]\\d{4}\\b'), lambda p: NOT starts_with(p, '555'))"


@query(
    f"""SELECT item_no, 'no_real_pii' AS rule FROM {_PII} WHERE regexp_matches(x, '\\b\\d{{3}}-\\d{{2}}-\\d{{4}}\\b') UNION ALL SELECT item_no, 'placeholder_pii' FROM {_PII} WHERE len({_PHONES}) > 0"""
)
def pii_rules(spark, d):
    """Items that break a rule on personal data: identity numbers block, phone numbers that are no placeholders warn.

    The texts write local numbers, which get an area code here.
    """
    x = F.regexp_replace(F.concat_ws(" ", "title", "summary"), r"\b(\d{3}-\d{4})\b", "407-$1")
    return table(spark, d, "feed_items").select("item_no", F.explode(records.rule_failures(x)).alias("rule"))


# ---- web

_HTML = """concat('<html><head><link rel="alternate" type="application/rss+xml" href="/', feed_id, '/feed.xml"><script type="application/ld+json">{}</script></head><body><h1>', coalesce(title, ''), '</h1><p>', coalesce(summary, ''),
    '</p><a href="', coalesce(link, '#top'), '#part">more</a> <a href="mailto:x@example.com">mail</a> <a href="', coalesce(link, '#'), '">again</a> <a href="/api/items/', item_no, '.json?x=1">data</a></body></html>')"""


def _pages(spark, d):
    """Pages built from the items, for there is no page table."""
    return table(spark, d, "feed_items").select("item_no", "link", F.expr(_HTML.replace("{}", "{}")).alias("html"))


_LINKS = f"""WITH h AS (SELECT item_no, {_HTML} AS html FROM feed_items), u AS (SELECT item_no, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"''<>]+)["'']', 1)) AS u FROM h),
    k AS (SELECT DISTINCT item_no, string_split(trim(u), '#')[1] AS url FROM u WHERE NOT regexp_matches(trim(u), '(?i)^(javascript|mailto|tel):|^#|^\\s*$'))"""


@query(_LINKS + " SELECT item_no, url FROM k WHERE url <> ''")
def links_extract(spark, d):
    return _pages(spark, d).select("item_no", F.explode(web.links(F.col("html"))).alias("url"))


@query("""SELECT regexp_replace(lower(regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') AS host, count(*) AS n FROM feed_items WHERE link LIKE '%://%' GROUP BY 1""")
def host_counts(spark, d):
    return table(spark, d, "feed_items").select(web.host(F.col("link")).alias("host")).where("host is not null").groupBy("host").agg(F.count("*").alias("n"))


@query("""SELECT regexp_extract(regexp_extract(url, '://([^/?#]*)', 1), '([^.]+\\.[^.]+)$', 1) AS domain, count(*) AS n FROM feeds GROUP BY 1""")
def link_domains(spark, d):
    return table(spark, d, "feeds").groupBy(web.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


@query("SELECT item_no, concat('/', feed_id, '/feed.xml') AS feed FROM feed_items")
def feed_autodiscover(spark, d):
    return _pages(spark, d).select("item_no", F.explode(web.feed_links(F.col("html"))).alias("feed"))


@query("SELECT item_no, 1 AS json_ld, concat('/api/items/', item_no, '.json?x=1') AS endpoints, concat('/', feed_id, '/feed.xml') AS feeds FROM feed_items")
def data_sources_detect(spark, d):
    got = _pages(spark, d).select("item_no", web.structured_data(F.col("html")).alias("s"))
    return got.select("item_no", F.col("s.json_ld").alias("json_ld"), F.array_join("s.endpoints", ";").alias("endpoints"), F.array_join("s.feeds", ";").alias("feeds"))


SIGNATURES = [("edge-guard", "header", "x-edge-guard"), ("edge-guard", "cookie", "__eg_"), ("edge-guard", "body", "checking your browser"), ("gate", "header", "x-gate"), ("gate", "body", "request unsuccessful")]
CAPTCHAS = [("picture", "verify you are human"), ("puzzle", "complete the captcha")]
_STATUS = "CASE item_no % 6 WHEN 0 THEN 403 WHEN 1 THEN 429 WHEN 2 THEN 503 ELSE 200 END"
_HEAD = "CASE item_no % 5 WHEN 0 THEN 'X-Edge-Guard: 1' WHEN 1 THEN 'Server: x' || chr(10) || 'Set-Cookie: __eg_id=1' ELSE 'Server: x' END"


@query(
    f"""WITH r AS (SELECT item_no, {_STATUS} AS st, lower({_HEAD}) AS h, lower(coalesce(summary, '')) AS b FROM feed_items),
    v AS (SELECT *, CASE WHEN contains(concat(chr(10), h), concat(chr(10), 'x-edge-guard')) OR contains(h, '__eg_') OR contains(b, 'checking your browser') THEN 'edge-guard' WHEN contains(concat(chr(10), h), concat(chr(10), 'x-gate')) OR contains(b, 'request unsuccessful') THEN 'gate' END AS v,
    CASE WHEN contains(b, 'verify you are human') THEN 'picture' WHEN contains(b, 'complete the captcha') THEN 'puzzle' END AS c FROM r),
    x AS (SELECT *, (v = 'edge-guard' AND contains(b, 'checking your browser')) OR (v = 'gate' AND contains(b, 'request unsuccessful')) AS m FROM v)
    SELECT item_no, coalesce(v, c) AS vendor, CASE WHEN c IS NOT NULL THEN 'captcha' WHEN st IN (429, 503) THEN 'rate_limit' WHEN v IS NOT NULL AND m THEN 'challenge' WHEN v IS NOT NULL OR st IN (401, 403, 406, 451) THEN 'ip_block' ELSE 'none' END AS kind,
    CASE WHEN (v IS NOT NULL AND m) OR c IS NOT NULL THEN 'high' WHEN v IS NOT NULL OR st IN (401, 403, 406, 451, 429, 503) THEN 'medium' ELSE 'low' END AS confidence FROM x"""
)
def block_classify(spark, d):
    """Responses classified by signature; status and headers are made up from the item number."""
    got = table(spark, d, "feed_items").select("item_no", web.refusal(F.expr(_STATUS), F.expr(_HEAD.replace("chr(10)", "'\\n'")), F.col("summary"), SIGNATURES, CAPTCHAS).alias("r"))
    return got.select("item_no", "r.vendor", "r.kind", "r.confidence")


@query(
    """WITH b AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS b FROM documents), s AS (SELECT doc_id, length(b) AS n, lower(b) AS l, length(trim(regexp_replace(b, '<[^>]+>', ' ', 'g'))) / greatest(length(b), 1) AS share FROM b)
    SELECT doc_id, CASE WHEN n < 200 THEN 0.0 ELSE greatest(0.0, least(1.0, round((0.5 + CASE WHEN n < 1000 THEN -0.3 WHEN n < 5000 THEN -0.1 WHEN n > 20000 THEN 0.1 ELSE 0.0 END + CASE WHEN contains(l, 'enable javascript') THEN -0.3 ELSE 0.0 END + CASE WHEN contains(l, 'access denied') THEN -0.3 ELSE 0.0 END
    + CASE WHEN share < 0.10 THEN -0.2 WHEN share > 0.40 THEN 0.1 ELSE 0.0 END)::DOUBLE, 3))) END AS score FROM s"""
)
def content_confidence(spark, d):
    return table(spark, d, "documents").select("doc_id", web.content_score(F.col("text"), F.lit(200), ["enable javascript"], ["access denied"]).alias("score"))


@query(
    """SELECT id, CASE WHEN st IN (401, 403) THEN 'BLOCKED' WHEN st IN (404, 410) THEN 'DEAD' WHEN st >= 400 THEN 'ERROR' WHEN cadence_days = 30 THEN 'REDIRECT' WHEN type = 'feed' THEN 'LIVE_FEED' WHEN st = 200 THEN 'LIVE_PAGE' ELSE 'UNKNOWN' END AS class FROM (SELECT *, state.last_status AS st FROM feeds)"""
)
def seed_classify(spark, d):
    f = table(spark, d, "feeds")
    moved = F.when(F.col("cadence_days") == 30, F.concat("url", F.lit("/moved"))).otherwise(F.concat("url", F.lit("/")))
    st = F.col("state.last_status")
    return f.select("id", web.probe_class(st, F.lit(None).cast("string"), F.col("url"), moved, F.col("type") == "feed", F.lit(0), st == 200).alias("class"))



# ---- documents


@query(
    """WITH p AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\n\\s*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')) AS raw FROM documents)
    SELECT doc_id, count(*) AS n, count(CASE WHEN regexp_matches(raw, '^#{1,6}\\s') THEN 1 END) AS n_headings, CAST(sum(length(trim(regexp_replace(regexp_replace(raw, '^#{1,6}\\s+', ''), '\\s+', ' ', 'g')))) AS BIGINT) AS n_chars FROM p GROUP BY doc_id"""
)
def paragraph_split(spark, d):
    p = docs.paragraphs(table(spark, d, "documents"), "doc_id", "text")
    return p.groupBy("doc_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("kind") == "heading", 1)).alias("n_headings"), F.sum(F.length("text")).alias("n_chars"))


@query(
    """SELECT scan_id, count(*) AS n_blocks, round(avg(CASE WHEN source IS NULL THEN 0.0 ELSE 1.0 END), 6) AS provenance_coverage, round(avg(CASE WHEN confidence IS NULL THEN 0.0 ELSE 1.0 END), 6) AS confidence_coverage, round(coalesce(avg(confidence), 0.0), 6) AS mean_confidence,
    CASE WHEN max(CASE WHEN length(trim(coalesce(text, ''))) > 0 THEN 1 ELSE 0 END) = 1 THEN 'content_ingested' ELSE 'metadata_only' END AS retrieval_state, count(DISTINCT page) = count(*) AS order_ok FROM scan_pages GROUP BY scan_id"""
)
def governance_coverage(spark, d):
    """Coverage of each scan, its pages as blocks."""
    return docs.governance(table(spark, d, "scan_pages").withColumn("pos", F.col("page")), "scan_id")


@query("""SELECT id, concat(id, CASE type WHEN 'feed' THEN '.xml' ELSE '.HTML' END) AS name, CASE type WHEN 'feed' THEN 'application/xml' ELSE 'text/html' END AS media_type FROM feeds""")
def media_types(spark, d):
    name = F.concat("id", F.when(F.col("type") == "feed", ".xml").otherwise(".HTML"))
    return table(spark, d, "feeds").select("id", name.alias("name"), docs.media_type(name).alias("media_type"))




# ---- records, graphs, traversal, translation


@query("SELECT record_no, student_id AS reference, coalesce(len(enrollments), 0) AS n_enrollments, coalesce(len(list_filter(enrollments, lambda e: e.status = 'active')), 0) AS n_active FROM records")
def id_masking(spark, d):
    n = lambda c: F.coalesce(F.when(F.size(c) >= 0, F.size(c)), F.lit(0)).cast("bigint")
    ref = records.masked(F.col("student_id"), F.lit("name"), True)
    return table(spark, d, "records").select("record_no", ref.alias("reference"), n(F.col("enrollments")).alias("n_enrollments"), n(F.filter("enrollments", lambda e: e["status"] == "active")).alias("n_active"))



_EDGES = """SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, 'offers' AS relation FROM lineitem UNION SELECT 'n' || s_nationkey, 's' || s_suppkey, 'has' FROM supplier UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'has' FROM nation"""


def _graph(spark, d):
    line = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"))
    sup = table(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("a"), F.concat(F.lit("s"), "s_suppkey").alias("b"))
    nat = table(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("a"), F.concat(F.lit("n"), "n_nationkey").alias("b"))
    return graphs.node_edge([(line, "a", "supplier", "b", "part", "offers"), (sup, "a", "nation", "b", "supplier", "has"), (nat, "a", "region", "b", "nation", "has")])


@query(_EDGES)
def graph_edges(spark, d):
    return _graph(spark, d)[1]


@query(f"WITH e AS ({_EDGES}), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e) SELECT id, CASE left(id, 1) WHEN 's' THEN 'supplier' WHEN 'p' THEN 'part' WHEN 'n' THEN 'nation' ELSE 'region' END AS kind FROM n")
def graph_nodes(spark, d):
    return _graph(spark, d)[0]


@query(
    f"""WITH RECURSIVE e AS ({_EDGES}), w AS (SELECT 'r1' AS node, 0 AS layer UNION SELECT e.dst, w.layer + 1 FROM w JOIN e ON e.src = w.node WHERE w.layer < 2)
    SELECT node, min(layer) AS layer FROM w GROUP BY node"""
)
def traversal_layers(spark, d):
    """Everything within two steps of one region."""
    edges = _graph(spark, d)[1].select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return graphs.layers(edges, spark.createDataFrame([("r1",)], "a string"), 2, 1_000_000).reached


_SCALE = [("K", "Kindergarten"), ("1", "First"), ("2", "Second"), ("3", "Third"), ("10", "Sophomore"), ("12", "Senior"), ("4", "")]


@query("WITH s AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _SCALE) + ") v(f, t)) SELECT record_no, current_grade_level, t AS translated FROM records LEFT JOIN s ON lower(trim(current_grade_level)) = lower(trim(f)) AND t <> ''")
def grade_translate(spark, d):
    scale = spark.createDataFrame(_SCALE, "f string, t string")
    return records.translate(table(spark, d, "records").select("record_no", "current_grade_level"), F.col("current_grade_level"), scale, "f", "t")


@query(
    """SELECT record_no, s.standard.standard_code AS code, split_part(s.standard.standard_code, '.', 2) AS grade, split_part(s.standard.standard_code, '.', 3) AS strand FROM (SELECT record_no, unnest(standards_mastery) AS s FROM records) WHERE s.standard.standard_code IS NOT NULL"""
)
def crosswalk_explode(spark, d):
    s = table(spark, d, "records").select("record_no", F.explode("standards_mastery").alias("s")).select("record_no", F.col("s.standard.standard_code").alias("code")).where("code is not null")
    return s.select("record_no", "code", F.split_part("code", F.lit("."), F.lit(2)).alias("grade"), F.split_part("code", F.lit("."), F.lit(3)).alias("strand"))


@query(
    """WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS w, source FROM documents), o AS (SELECT a.doc_id, len(list_intersect(a.w, b.w)) / greatest(greatest(len(a.w), len(b.w)), 1) AS overlap FROM w a JOIN w b ON b.doc_id = a.doc_id + 1)
    SELECT doc_id, round(overlap, 6) AS overlap, CASE WHEN overlap >= 0.85 THEN 'stable' WHEN overlap < 0.70 THEN 'changed' ELSE 'similar' END AS verdict FROM o"""
)
def archive_overlap(spark, d):
    """Each text against the one archived after it, by shared words."""
    w = table(spark, d, "documents").select("doc_id", F.array_distinct(search.tokens(F.col("text"))).alias("w"))
    n = w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("w2"))
    overlap = F.size(F.array_intersect("w", "w2")) / F.greatest(F.greatest(F.size("w"), F.size("w2")), F.lit(1))
    got = w.join(n, "doc_id").select("doc_id", overlap.alias("o"))
    return got.select("doc_id", F.round("o", 6).alias("overlap"), F.when(F.col("o") >= 0.85, "stable").when(F.col("o") < 0.70, "changed").otherwise("similar").alias("verdict"))
