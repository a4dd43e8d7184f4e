"""More queries: scans, predicates, look-ups, ordered scans, rates."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import table
from .reference import query


@query(
    """SELECT 'feed' AS kind, id, url FROM feeds WHERE url IS NOT NULL UNION ALL SELECT 'item', CAST(item_no AS VARCHAR), link FROM feed_items WHERE link IS NOT NULL"""
)
def seed_union(spark, d):
    """Addresses of all registries, tagged with their kind; entries without address drop out."""
    a = table(spark, d, "feeds").select(F.lit("feed").alias("kind"), "id", "url")
    b = table(spark, d, "feed_items").select(F.lit("item").alias("kind"), F.col("item_no").cast("string").alias("id"), F.col("link").alias("url"))
    return a.unionByName(b).where("url is not null")


@query("""SELECT raw_no, CASE WHEN body IS NULL OR trim(body) = '' THEN 'empty' WHEN starts_with(ltrim(body), '{') THEN 'object' WHEN starts_with(ltrim(body), '[') THEN 'list' WHEN starts_with(ltrim(body), '"') THEN 'encoded' ELSE 'other' END AS kind FROM raw_records""")
def body_detect(spark, d):
    """What kind of body a delivery is, by its first characters."""
    head = F.ltrim(F.coalesce("body", F.lit("")))
    kind = F.when(head == "", "empty").when(head.startswith("{"), "object").when(head.startswith("["), "list").when(head.startswith('"'), "encoded").otherwise("other")
    return table(spark, d, "raw_records").select("raw_no", kind.alias("kind"))


@query("""SELECT row_no, msid IS NULL OR trim(msid) = '' OR contains(upper(msid), 'X') OR length(trim(msid)) <> 6 AS placeholder FROM schools""")
def placeholder_ids(spark, d):
    m = F.col("msid")
    return table(spark, d, "schools").select("row_no", (m.isNull() | (F.trim(m) == "") | F.upper(m).contains("X") | (F.length(F.trim(m)) != 6)).alias("placeholder"))


@query("""SELECT id FROM feeds WHERE lower(scope) = 'district' AND lower(grade_band) = 'k-12' AND cadence_days = 7""")
def map_subset(spark, d):
    """Rows that match every selector given as a map, strings without case."""
    wanted = F.create_map(F.lit("scope"), F.lit("District"), F.lit("grade_band"), F.lit("k-12"), F.lit("cadence_days"), F.lit("7"))
    have = F.create_map(*[x for c in ("scope", "grade_band", "cadence_days", "tier") for x in (F.lit(c), F.col(c).cast("string"))])
    f = table(spark, d, "feeds")
    hit = F.forall(F.map_entries(wanted), lambda e: F.coalesce(F.lower(e["value"]) == F.lower(F.try_element_at(have, e["key"])), F.lit(False)))
    return f.where(hit).select("id")


@query(
    """WITH k AS (SELECT record_no, current_school.school_id AS sid, lower(trim(current_school.school_name)) AS nm FROM records), i AS (SELECT msid, min(row_no) AS row_no FROM schools WHERE msid IS NOT NULL GROUP BY msid), n AS (SELECT lower(trim(school_name)) AS nm, min(row_no) AS row_no FROM schools WHERE school_name IS NOT NULL GROUP BY 1)
    SELECT record_no, coalesce(i.row_no, n.row_no) AS row_no, CASE WHEN i.row_no IS NOT NULL THEN 'id' WHEN n.row_no IS NOT NULL THEN 'name' ELSE 'none' END AS how FROM k LEFT JOIN i ON k.sid = i.msid LEFT JOIN n ON k.nm = n.nm"""
)
def key_or_name_lookup(spark, d):
    """A record's school by id first, else by name."""
    k = table(spark, d, "records").select("record_no", F.col("current_school.school_id").alias("sid"), F.lower(F.trim("current_school.school_name")).alias("nm"))
    s = table(spark, d, "schools")
    i = s.where("msid is not null").groupBy(F.col("msid").alias("sid")).agg(F.min("row_no").alias("by_id"))
    n = s.where("school_name is not null").groupBy(F.lower(F.trim("school_name")).alias("nm")).agg(F.min("row_no").alias("by_name"))
    how = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_name").isNotNull(), "name").otherwise("none")
    return k.join(i, "sid", "left").join(n, "nm", "left").select("record_no", F.coalesce("by_id", "by_name").alias("row_no"), how.alias("how"))


@query(
    """WITH c AS (SELECT DISTINCT s.standard.standard_code AS code, 'records' AS o FROM (SELECT unnest(standards_mastery) AS s FROM records) WHERE s.standard.standard_code IS NOT NULL), w AS (SELECT code, substr(code, 1, 2) AS book FROM c),
    h AS (SELECT DISTINCT unnest(regexp_extract_all(body, '[A-Z]{2}\\.\\d+\\.[A-Z]{2}\\.\\d+\\.\\d+')) AS code FROM raw_records)
    SELECT book, count(*) AS listed, count(h.code) AS found, CAST(100 * count(h.code) // greatest(count(*), 1) AS BIGINT) AS percent FROM w LEFT JOIN h USING (code) GROUP BY book"""
)
def code_harvest(spark, d):
    """Codes that the records list against those met anywhere in the raw bodies, whole percent by book."""
    s = table(spark, d, "records").select(F.explode("standards_mastery").alias("s")).select(F.col("s.standard.standard_code").alias("code")).where("code is not null").distinct()
    h = table(spark, d, "raw_records").select(F.explode(F.regexp_extract_all("body", F.lit(r"([A-Z]{2}\.\d+\.[A-Z]{2}\.\d+\.\d+)"), F.lit(1))).alias("code")).distinct().withColumn("seen", F.lit(1))
    got = s.join(h, "code", "left").groupBy(F.substring("code", 1, 2).alias("book")).agg(F.count("*").alias("listed"), F.count("seen").alias("found"))
    return got.withColumn("percent", F.expr("100 * found div greatest(listed, 1)"))


@query(
    """WITH g AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events)
    SELECT user_id, CAST(run AS BIGINT) AS run, min(event_id) AS first_event, count(*) AS n FROM g WHERE run > 0 GROUP BY user_id, run"""
)
def run_grouping(spark, d):
    """A record starts where its head is met and goes on to the next head."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").select("user_id", "event_id", F.sum((F.col("event_type") == "signup").cast("bigint")).over(w).alias("run"))
    return e.where("run > 0").groupBy("user_id", "run").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n"))


@query(
    "SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS next_event FROM events"
)
def next_segment(spark, d):
    """Each mark with the one that ends its segment."""
    return table(spark, d, "events").select("event_id", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).alias("next_event"))


@query(
    """WITH w AS (SELECT event_id, event_type, list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS nxt FROM events)
    SELECT event_id, list_filter(nxt, lambda x: x <> 'view')[1] AS followed_by FROM w WHERE event_type = 'signup'"""
)
def lookahead(spark, d):
    """The first of the next five entries that isn't blank, so to say."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(1, 5)
    e = table(spark, d, "events").select("event_id", "event_type", F.collect_list("event_type").over(w).alias("nxt")).where("event_type = 'signup'")
    return e.select("event_id", F.try_element_at(F.filter("nxt", lambda x: x != "view"), F.lit(1)).alias("followed_by"))


@query(
    """WITH c AS (SELECT feed_id, category, count(*) AS n, max(CASE tier WHEN 'canonical' THEN 3 WHEN 'district' THEN 2 ELSE 1 END) AS best FROM feed_items WHERE category IS NOT NULL GROUP BY feed_id, category)
    SELECT feed_id, category, CASE least(3, best + CASE WHEN n >= 2 AND best >= 2 THEN 1 ELSE 0 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence FROM c"""
)
def confidence_rollup(spark, d):
    """Best confidence of corroborating findings, one step higher where at least two agree on a fair one."""
    rank = F.when(F.col("tier") == "canonical", 3).when(F.col("tier") == "district", 2).otherwise(1)
    c = table(spark, d, "feed_items").where("category is not null").groupBy("feed_id", "category").agg(F.count("*").alias("n"), F.max(rank).alias("best"))
    level = F.least(F.lit(3), F.col("best") + F.when((F.col("n") >= 2) & (F.col("best") >= 2), 1).otherwise(0))
    return c.select("feed_id", "category", F.when(level == 3, "high").when(level == 2, "medium").otherwise("low").alias("confidence"))


@query(
    """SELECT record_no, round((CASE WHEN student_id IS NULL THEN 0 ELSE 1 END + CASE WHEN lifecycle IS NULL THEN 0 ELSE 1 END + CASE WHEN current_school IS NULL THEN 0 ELSE 1 END + CASE WHEN academic_year IS NULL THEN 0 ELSE 1 END + CASE WHEN enrollments IS NULL THEN 0 ELSE 1 END + CASE WHEN modules IS NULL THEN 0 ELSE 1 END) / 6.0, 6) AS completeness FROM records"""
)
def completeness(spark, d):
    cols = ["student_id", "lifecycle", "current_school", "academic_year", "enrollments", "modules"]
    return table(spark, d, "records").select("record_no", F.round(sum(F.col(c).isNotNull().cast("int") for c in cols) / 6.0, 6).alias("completeness"))


@query("""SELECT record_no, CASE WHEN g IN ('K', '1', '2') THEN 'K-2' WHEN g IN ('3', '4', '5') THEN '3-5' WHEN g IN ('6', '7', '8') THEN '6-8' WHEN g IN ('9', '10', '11', '12') THEN '9-12' END AS band FROM (SELECT record_no, upper(trim(current_grade_level)) AS g FROM records)""")
def grade_band(spark, d):
    g = F.upper(F.trim("current_grade_level"))
    band = F.when(g.isin("K", "1", "2"), "K-2").when(g.isin("3", "4", "5"), "3-5").when(g.isin("6", "7", "8"), "6-8").when(g.isin("9", "10", "11", "12"), "9-12")
    return table(spark, d, "records").select("record_no", band.alias("band"))


@query("""SELECT event_id, CAST(least(coalesce(CAST(CASE WHEN event_id % 3 = 0 THEN value END AS DOUBLE), 2.0 * pow(2, event_id % 8)), 120.0) AS DOUBLE) AS wait FROM events WHERE event_type = 'error'""")
def backoff(spark, d):
    """What the server says, else twice as long each time, two minutes at most."""
    said = F.when(F.col("event_id") % 3 == 0, F.col("value").cast("double"))
    wait = F.least(F.coalesce(said, F.lit(2.0) * F.pow(F.lit(2.0), F.col("event_id") % 8)), F.lit(120.0))
    return table(spark, d, "events").where("event_type = 'error'").select("event_id", wait.alias("wait"))


@query("""SELECT content_sha256, min(item_no) AS first_item, count(*) AS n, 'pending' AS status FROM feed_items WHERE content_sha256 IS NOT NULL GROUP BY content_sha256""")
def deferred_queue(spark, d):
    """One pending entry for each content hash, however often it was offered."""
    q = table(spark, d, "feed_items").where("content_sha256 is not null").groupBy("content_sha256").agg(F.min("item_no").alias("first_item"), F.count("*").alias("n"))
    return q.withColumn("status", F.lit("pending"))


@query(
    """WITH r AS (SELECT s.row_no AS school, t.feed_id FROM schools s LEFT JOIN (SELECT DISTINCT feed_id, split_part(feed_id, '-', 1) AS town FROM feed_items) t ON lower(split_part(s.school_name, ' ', 1)) = t.town)
    SELECT school, CASE WHEN count(feed_id) = 0 THEN 'gap' ELSE string_agg(feed_id, ',' ORDER BY feed_id) END AS feeds FROM r GROUP BY school"""
)
def role_join(spark, d):
    """One to many by role: a school's feeds in order, or a named gap."""
    t = table(spark, d, "feed_items").select("feed_id").distinct().withColumn("town", F.split_part("feed_id", F.lit("-"), F.lit(1)))
    s = table(spark, d, "schools").select(F.col("row_no").alias("school"), F.lower(F.split_part("school_name", F.lit(" "), F.lit(1))).alias("town"))
    got = s.join(t, "town", "left").groupBy("school").agg(F.array_sort(F.collect_list("feed_id")).alias("f"))
    return got.select("school", F.when(F.size("f") == 0, "gap").otherwise(F.array_join("f", ",")).alias("feeds"))
