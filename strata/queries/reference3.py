"""Queries for extraction, look-ups, tables, traversal and measures of text, each with its SQL."""

from pyspark.sql import functions as F

from ..functions import text as texts
from ..operators import extract, lookup, search, tabular, traverse
from ..plans import engines
from ..session import table
from .reference import query

MASTERY = "SELECT record_no, s.standard.standard_code AS code, s.standard.standard_name AS name FROM (SELECT record_no, unnest(standards_mastery) AS s FROM records) WHERE s.standard.standard_code IS NOT NULL"


def _mastery(spark, d):
    return table(spark, d, "records").select("record_no", F.explode("standards_mastery").alias("s")).select("record_no", F.col("s.standard.standard_code").alias("code"), F.col("s.standard.standard_name").alias("name")).where("code is not null")


# ---- measures of text

@query("""WITH s AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 200 THEN concat(substr(t, 1, 197), '...') ELSE t END AS snippet FROM s""")
def snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", texts.snippet(F.col("text")).alias("snippet"))


@query(
    """WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z]+') AS w, greatest(len(regexp_extract_all(text, '[.!?]+')), 1) AS s FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, len(w) AS n, s, list_sum(list_transform(w, lambda x: greatest(len(regexp_extract_all(regexp_replace(x, 'e$', ''), '[aeiouy]+')), 1))) AS y FROM w)
    SELECT doc_id, n AS words, s AS sentences, CAST(y AS BIGINT) AS syllables FROM c WHERE n > 0"""
)
def reading_grade(spark, d):
    """What the Flesch-Kincaid grade of every document is made of."""
    return table(spark, d, "documents").select("doc_id", texts.readability(F.col("text")).alias("r")).where("r.words > 0").select("doc_id", "r.words", "r.sentences", "r.syllables")


_BLOCK = "</?(?:p|div|li|tr|h[1-6]|br|section|article|table|ul|ol|blockquote)\\b[^>]*>"


@query(
    f"""WITH a AS (SELECT item_no, string_split(regexp_replace(regexp_replace(concat('<div><h2>', coalesce(title, ''), '</h2>', coalesce(summary, ''), '</div>'), '{_BLOCK}', chr(10), 'gi'), '<[^>]*>', '', 'g'), chr(10)) AS l FROM feed_items)
    SELECT item_no, unnest(list_filter(list_transform(l, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')) AS line FROM a"""
)
def html_lines(spark, d):
    page = F.concat(F.lit("<div><h2>"), F.coalesce("title", F.lit("")), F.lit("</h2>"), F.coalesce("summary", F.lit("")), F.lit("</div>"))
    return table(spark, d, "feed_items").select("item_no", F.explode(texts.html_lines(page)).alias("line"))


_DOMAIN = "regexp_extract(regexp_replace(lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', ''), '([^.]+\\.[^.]+)$', 1)"


@query(f"""SELECT item_no, coalesce({_DOMAIN.format('f.url')} = {_DOMAIN.format('i.link')}, false) AS same FROM feed_items i JOIN feeds f ON i.feed_id = f.id""")
def same_site(spark, d):
    f = table(spark, d, "feeds").select(F.col("id").alias("feed_id"), "url")
    return table(spark, d, "feed_items").join(f, "feed_id").select("item_no", texts.same_site(F.col("url"), F.col("link")).alias("same"))


@query("""WITH u AS (SELECT DISTINCT item_no, regexp_replace(unnest(regexp_extract_all(coalesce(summary, ''), 'https?://[^\\s<>"'')\\]]+')), '[.,;:!?]+$', '') AS url FROM feed_items) SELECT item_no, url FROM u WHERE url NOT IN (SELECT url FROM feeds WHERE url IS NOT NULL)""")
def url_provenance(spark, d):
    """Addresses named in texts that no registry declares."""
    u = table(spark, d, "feed_items").select("item_no", F.explode(extract.urls(F.col("summary"))).alias("url"))
    return u.join(table(spark, d, "feeds").select("url").where("url is not null").distinct(), "url", "left_anti").select("item_no", "url")


# ---- saved pages

_SAVED = "concat('<!-- saved from url=(', length(link), ')', link, ' --><html><head><title>', chr(10), title, '</title></head><body><p><a class=\"x\" href=\"', link, '\">Read <b>', category, '</b></a> <a href=\"#top\">top</a> <a href=\"/', feed_id, '\">', coalesce(tier, ''), '</a></p></body></html>')"


def _saved(spark, d):
    return table(spark, d, "feed_items").select("item_no", F.expr(_SAVED.replace('\\"', '"')).alias("html")).where("html is not null")


@query("""SELECT item_no, link AS url, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title FROM feed_items WHERE link IS NOT NULL AND title IS NOT NULL AND category IS NOT NULL AND feed_id IS NOT NULL AND NOT regexp_matches(link, '\\s') AND trim(title) <> ''""")
def saved_pages(spark, d):
    """Address and title that a saved page names."""
    return _saved(spark, d).select("item_no", extract.saved_url(F.col("html")).alias("url"), extract.title(F.col("html")).alias("title")).where("title is not null and url is not null")


@query("""WITH p AS (SELECT item_no, link, category, feed_id, coalesce(tier, '') AS tier FROM feed_items WHERE link IS NOT NULL AND title IS NOT NULL AND category IS NOT NULL AND feed_id IS NOT NULL)
    SELECT item_no, link AS href, trim(concat('Read ', category)) AS text FROM p UNION ALL SELECT item_no, concat('/', feed_id), trim(tier) FROM p""")
def page_links(spark, d):
    """Links of a page with their texts; links within the page drop out."""
    return _saved(spark, d).select("item_no", F.inline(extract.links_with_text(F.col("html"))))


@query("""WITH p AS (SELECT item_no, link, category FROM feed_items WHERE link IS NOT NULL AND title IS NOT NULL AND category IS NOT NULL AND feed_id IS NOT NULL)
    SELECT item_no, link AS href FROM p WHERE contains(lower(concat('Read ', category, ' ', link)), 'calendar') OR contains(lower(concat('Read ', category, ' ', link)), 'posts')
    UNION ALL SELECT item_no, concat('/', feed_id) FROM feed_items WHERE link IS NOT NULL AND title IS NOT NULL AND category IS NOT NULL AND feed_id IS NOT NULL AND (contains(lower(concat(coalesce(tier, ''), ' /', feed_id)), 'calendar') OR contains(lower(concat(coalesce(tier, ''), ' /', feed_id)), 'posts'))""")
def links_by_keyword(spark, d):
    kept = extract.keyword_links(extract.links_with_text(F.col("html")), ["Calendar", "posts"])
    return _saved(spark, d).select("item_no", F.explode(kept).alias("x")).select("item_no", "x.href")


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'rubric') OR contains(lower(text), 'lesson') THEN 'planning' WHEN contains(lower(text), 'vote') OR contains(lower(text), 'motion') THEN 'board' WHEN contains(lower(text), 'portal') THEN 'portal' ELSE 'other' END AS platform FROM documents""")
def platform_sniff(spark, d):
    """The first platform of which any keyword is met."""
    return table(spark, d, "documents").select("doc_id", extract.sniff(F.col("text"), [("planning", ["rubric", "lesson"]), ("board", ["vote", "motion"]), ("portal", ["portal"])], "other").alias("platform"))


@query("""WITH r AS (SELECT feed_id, item_no, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, link, row_number() OVER (PARTITION BY feed_id ORDER BY item_no) AS n FROM feed_items WHERE feed_id IS NOT NULL AND link IS NOT NULL AND trim(title) <> '' AND NOT regexp_matches(concat(title, link), '[<>"'']'))
    SELECT feed_id, n, title, link FROM r WHERE n <= 50""")
def page_scrape(spark, d):
    """Items of a page that has no feed: its headings that are links, the first 50."""
    i = table(spark, d, "feed_items").where("feed_id is not null and link is not null and trim(title) <> '' and not concat(title, link) rlike '[<>\"\\']'")
    entry = F.concat(F.lit("<h3 class='t'> <a href='"), "link", F.lit("'><span>"), "title", F.lit("</span></a></h3><p>x</p>"))
    page = i.groupBy("feed_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_no", entry.alias("e")))), lambda x: x["e"]), "").alias("html"))
    return page.select("feed_id", F.posexplode(extract.heading_items(F.col("html"))).alias("p", "x")).select("feed_id", (F.col("p") + 1).cast("bigint").alias("n"), "x.title", "x.link")


_PROGRAM = "SELECT row_no, unnest(programs) AS p FROM schools"


@query(f"""WITH p AS (SELECT row_no, p, row_number() OVER () AS o FROM ({_PROGRAM}) WHERE p IS NOT NULL)
    SELECT row_no, coalesce(trim(regexp_replace(p.program_name, '\\s+', ' ', 'g')), '') AS name, coalesce(p.status, '') AS status FROM p""")
def located_table(spark, d):
    """Rows of a table found below its header, whichever of the first six rows that is, as records of the wanted columns."""
    cell = lambda x: F.concat(F.lit("<td>"), F.coalesce(x, F.lit("")), F.lit("</td>"))
    body = F.array_join(F.transform(F.filter("programs", lambda p: p.isNotNull()), lambda p: F.concat(F.lit("<tr>"), cell(p["program_id"]), cell(p["status"]), cell(p["program_name"]), F.lit("</tr>\n"))), "")
    page = F.concat(F.lit("<table><tr><td colspan=3>List of programs</td></tr><tr><th>ID</th><th>Status </th><th><b>Program Name</b></th></tr>"), body, F.lit("</table>"))
    rows = table(spark, d, "schools").where("programs is not null").select("row_no", F.explode(extract.located(extract.table_rows(page), ["program name", "status"])).alias("r"))
    return rows.select("row_no", F.col("r")["program name"].alias("name"), F.col("r")["status"].alias("status"))


@query(f"""SELECT row_no, row_number() OVER (PARTITION BY row_no ORDER BY o) AS record, name, status FROM (
    SELECT row_no, o, p.program_name AS name, p.status AS status FROM (SELECT row_no, unnest(programs) AS p, unnest(range(len(programs))) AS o FROM schools) WHERE p.program_name IS NOT NULL)""")
def key_value_scan(spark, d):
    """Records out of a run of labelled lines: each begins at its name."""
    p = table(spark, d, "schools").select("row_no", F.posexplode("programs").alias("o", "p")).where("p.program_name is not null")
    line = lambda i, n, v: F.struct((F.col("o") * 10 + i).alias("at"), F.lit(n).alias("label"), v.alias("value"))
    lines = p.select("row_no", F.inline(F.array(line(0, "name", F.col("p.program_name")), line(1, "noise", F.lit("x")), line(2, "status", F.col("p.status")))))
    got = extract.key_value_records(lines, ["row_no"], "at", "label", "value", "name", ["name", "status"])
    return got.select("row_no", F.col("record").cast("bigint").alias("record"), "name", "status")


@query("""WITH l AS (SELECT doc_id, coalesce(title, '') AS title, list_filter(list_transform(string_split(coalesce(text, ''), chr(10) || chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS p FROM documents)
    SELECT doc_id, 'paragraph' AS kind, unnest(p) AS text FROM l UNION ALL SELECT doc_id, 'heading', trim(regexp_replace(title, '\\s+', ' ', 'g')) FROM l WHERE trim(title) <> ''""")
def docs_json(spark, d):
    """Paragraphs of documents kept as nested JSON with styled runs."""
    run = lambda t, style: F.struct(F.struct(F.struct(F.lit(style).alias("namedStyleType")).alias("paragraphStyle"), F.array(F.struct(F.struct(t.alias("content")).alias("textRun"))).alias("elements")).alias("paragraph"))
    content = F.concat(F.array(run(F.coalesce("title", F.lit("")), "HEADING_1")), F.transform(F.split(F.coalesce("text", F.lit("")), "\n\n"), lambda t: run(t, "NORMAL_TEXT")))
    body = F.to_json(F.struct(F.col("title"), F.struct(content.alias("content")).alias("body")))
    return table(spark, d, "documents").select("doc_id", F.inline(extract.docs_paragraphs(body)))


@query(f"""SELECT record_no, code, substr(coalesce(name, ''), 1, 300) AS text FROM ({MASTERY}) WHERE trim(coalesce(name, '')) <> ''""")
def standards_extract(spark, d):
    """Codes with their texts out of a list: the code on its own line, or leading the text's line."""
    m = table(spark, d, "records").select("record_no", F.filter("standards_mastery", lambda s: s["standard"]["standard_code"].isNotNull() & (F.trim(F.coalesce(s["standard"]["standard_name"], F.lit(""))) != "")).alias("m"))
    line = lambda s, i: F.when(i % 2 == 0, F.concat(s["standard"]["standard_code"], F.lit("\n\n  \n"), s["standard"]["standard_name"])).otherwise(F.concat(F.lit("  "), s["standard"]["standard_code"], F.lit(": "), s["standard"]["standard_name"]))
    page = F.concat(F.lit("Standards\nPage 1\n"), F.array_join(F.transform("m", line), "\n"))
    return m.select("record_no", F.inline(extract.coded_entries(page, r"[A-Z]{2}\.\d+\.[A-Z]{2}\.\d+\.\d+")))


# ---- codes, crosswalks, look-ups

@query(f"SELECT DISTINCT code FROM ({MASTERY}) WHERE code LIKE 'QM.5.%'")
def code_prefix(spark, d):
    """Rows whose code begins with a text, taken literally."""
    return _mastery(spark, d).where(F.col("code").startswith("QM.5.")).select("code").distinct()


_CLASS = "CASE WHEN regexp_matches(code, '^[A-Z]{2}\\.\\d+\\.AR\\.') THEN 'access' WHEN regexp_matches(code, '^[A-Z]{2}\\.\\d+\\.[A-Z]{2}\\.\\d+\\.\\d+$') THEN 'benchmark' ELSE 'practice' END"


@query(f"SELECT code, {_CLASS} AS class FROM (SELECT DISTINCT code FROM ({MASTERY}))")
def code_class(spark, d):
    c = F.col("code")
    kind = F.when(c.rlike(r"^[A-Z]{2}\.\d+\.AR\."), "access").when(c.rlike(r"^[A-Z]{2}\.\d+\.[A-Z]{2}\.\d+\.\d+$"), "benchmark").otherwise("practice")
    return _mastery(spark, d).select("code").distinct().select("code", kind.alias("class"))


@query(f"SELECT record_no, count(*) FILTER (WHERE class = 'benchmark') AS benchmarks, count(*) FILTER (WHERE class = 'access') AS access_points, count(*) FILTER (WHERE class = 'practice') AS practices FROM (SELECT record_no, {_CLASS} AS class FROM ({MASTERY})) GROUP BY record_no")
def type_counts(spark, d):
    m = _mastery(spark, d)
    kind = F.when(F.col("code").rlike(r"^[A-Z]{2}\.\d+\.AR\."), "access").when(F.col("code").rlike(r"^[A-Z]{2}\.\d+\.[A-Z]{2}\.\d+\.\d+$"), "benchmark").otherwise("practice")
    return m.groupBy("record_no").agg(*[F.count(F.when(kind == k, 1)).alias(n) for k, n in (("benchmark", "benchmarks"), ("access", "access_points"), ("practice", "practices"))])


@query("""WITH c AS (SELECT type AS frame, scope AS "to", id AS code, label AS subject, string_split(category, '-') AS codes FROM feeds WHERE category IS NOT NULL)
    SELECT code, unnest(codes) AS mapped FROM c WHERE frame = 'feed' AND "to" = 'district' AND contains(lower(concat_ws(chr(31), code, subject)), 'news')""")
def crosswalk_map(spark, d):
    """Codes that a crosswalk maps a subject or code to, between two frames."""
    c = table(spark, d, "feeds").where("category is not null").select(F.col("type").alias("frame"), F.col("scope").alias("to"), F.col("id").alias("code"), F.col("label").alias("subject"), F.split("category", "-").alias("codes"))
    return lookup.crosswalk_map(c, "News", "feed", "district")


@query("SELECT type AS kind, count(*) AS n_rows, count(DISTINCT scope) AS n_frames FROM feeds GROUP BY type")
def crosswalk_kinds(spark, d):
    """A registry split by kind."""
    return table(spark, d, "feeds").groupBy(F.col("type").alias("kind")).agg(F.count("*").alias("n_rows"), F.countDistinct("scope").alias("n_frames"))


@query(f"""WITH m AS (SELECT record_no, code, name, e FROM (SELECT record_no, enrollments AS e, unnest(standards_mastery) AS s FROM records) AS r, LATERAL (SELECT s.standard.standard_code AS code, s.standard.standard_name AS name) WHERE code IS NOT NULL)
    SELECT DISTINCT record_no, code, CASE substr(code, 1, 2) WHEN 'QM' THEN 'math' WHEN 'QL' THEN 'language' ELSE '' END AS subject, array_to_string(list_filter(list_transform(e, lambda x: x.enrollment_id), lambda x: x IS NOT NULL)[1:8], ' | ') AS links FROM m""")
def page_standard_rows(spark, d):
    """One row for each page and code, with the page's first eight links joined and a subject by look-up."""
    ids = F.array_compact(F.transform("enrollments", lambda e: e["enrollment_id"]))
    subject = F.coalesce(F.element_at(F.create_map(F.lit("QM"), F.lit("math"), F.lit("QL"), F.lit("language")), F.substring("code", 1, 2)), F.lit(""))
    r = table(spark, d, "records").select("record_no", F.when(F.col("enrollments").isNotNull(), F.array_join(F.slice(ids, 1, 8), " | ")).alias("links"), F.explode("standards_mastery").alias("s"))
    return r.select("record_no", F.col("s.standard.standard_code").alias("code"), "links").where("code is not null").select("record_no", "code", subject.alias("subject"), "links").distinct()


@query("""SELECT item_no, CASE WHEN f.id IS NULL THEN 'unknown' ELSE f.scope END AS scope, CASE WHEN f.id IS NULL THEN 30 ELSE f.cadence_days END AS cadence_days FROM feed_items i LEFT JOIN (SELECT id, scope, cadence_days FROM feeds WHERE verified) f ON i.feed_id = f.id""")
def default_records(spark, d):
    """Items with their feed's record, or the default one where it isn't known."""
    f = table(spark, d, "feeds").where("verified").select(F.col("id").alias("feed_id"), "scope", "cadence_days")
    return lookup.with_default(table(spark, d, "feed_items").select("item_no", "feed_id"), f, "feed_id", {"scope": "unknown", "cadence_days": 30}).select("item_no", "scope", "cadence_days")


@query("""WITH a AS (SELECT category, tier, CAST(min(cadence_days) AS INTEGER) AS r FROM feeds WHERE category IS NOT NULL AND tier = 'canonical' GROUP BY 1, 2), b AS (SELECT category, CAST(min(cadence_days) + 100 AS INTEGER) AS r FROM feeds WHERE category IS NOT NULL AND verified GROUP BY 1), c AS (SELECT tier, CAST(count(*) + 200 AS INTEGER) AS r FROM feeds WHERE tier IS NOT NULL GROUP BY 1)
    SELECT item_no, coalesce(a.r, b.r, c.r, 999) AS rank FROM feed_items i LEFT JOIN a ON i.category = a.category AND i.tier = a.tier LEFT JOIN b ON i.category = b.category LEFT JOIN c ON i.tier = c.tier""")
def rank_ladder(spark, d):
    """Rank of a claim by its source, else by its topic, else by its tier."""
    f = table(spark, d, "feeds")
    a = f.where("category is not null and tier = 'canonical'").groupBy("category", "tier").agg(F.min("cadence_days").alias("r"))
    b = f.where("category is not null and verified").groupBy("category").agg((F.min("cadence_days") + 100).cast("int").alias("r"))
    c = f.where("tier is not null").groupBy("tier").agg((F.count("*") + 200).cast("int").alias("r"))
    return lookup.ladder(table(spark, d, "feed_items").select("item_no", "category", "tier"), [(a, ["category", "tier"], "r"), (b, ["category"], "r"), (c, ["tier"], "r")], 999).select("item_no", "rank")


@query("SELECT id FROM feeds WHERE scope IN ('district', 'state') AND verified AND lower(type) = 'feed' AND tier IS NOT NULL")
def condition_eval(spark, d):
    """Rows that meet all conditions of a list: membership, truth, equality."""
    return table(spark, d, "feeds").where(lookup.meets([("scope", "in", ["district", "state"]), ("verified", "is", True), ("type", "eq", "Feed")]) & F.col("tier").isNotNull()).select("id")


@query("""WITH w AS (SELECT doc_id, nullif(trim(lang), '') AS own, CASE WHEN regexp_matches(lower(text), '\\b(the|and)\\b') THEN 'en' WHEN regexp_matches(lower(text), '\\b(los|las)\\b') THEN 'es' END AS seen FROM documents)
    SELECT doc_id, coalesce(own, seen) AS lang, CASE WHEN own IS NOT NULL THEN 'stated' WHEN seen IS NOT NULL THEN 'evidence' ELSE 'none' END AS lang_from FROM w""")
def evidence_fold(spark, d):
    """A stated language stays; a missing one is filled from the text."""
    t = F.lower("text")
    seen = F.when(t.rlike(r"\b(the|and)\b"), "en").when(t.rlike(r"\b(los|las)\b"), "es")
    return lookup.fold_in(table(spark, d, "documents").select("doc_id", "lang", seen.alias("seen")), [("lang", "seen")]).select("doc_id", "lang", "lang_from")


@query("""SELECT item_no, array_to_string(list_filter([CASE WHEN NOT coalesce(length(content_sha256) = 64, false) THEN 'digest' END, CASE WHEN NOT coalesce(trim(title) <> '', false) THEN 'title' END, CASE WHEN NOT coalesce(starts_with(link, 'https://'), false) THEN 'link' END, CASE WHEN NOT coalesce(trim(summary) <> '', false) THEN 'summary' END], lambda x: x IS NOT NULL), ',') AS broken FROM feed_items""")
def record_violations(spark, d):
    """The rules that a record breaks, by name."""
    rules = [("digest", F.length("content_sha256") == 64), ("title", F.trim("title") != ""), ("link", F.col("link").startswith("https://")), ("summary", F.trim("summary") != "")]
    return table(spark, d, "feed_items").select("item_no", F.array_join(lookup.violations(rules), ",").alias("broken"))


_HALVES = "SELECT guid, max(CASE WHEN item_no <= 2000 THEN content_sha256 END) AS was, max(CASE WHEN item_no > 2000 THEN content_sha256 END) AS now_, bool_or(item_no > 2000) AS later, bool_or(item_no <= 2000) AS sooner FROM feed_items WHERE guid IS NOT NULL GROUP BY guid"


@query(f"""SELECT guid, CASE WHEN now_ IS NULL THEN 'error' WHEN was IS NULL THEN 'baseline_recorded' WHEN was = now_ THEN 'unchanged' ELSE 'changed' END AS state FROM ({_HALVES}) WHERE later""")
def watch_pages(spark, d):
    """State of each watched entry against what was recorded before."""
    i = table(spark, d, "feed_items").where("guid is not null")
    half = lambda c: i.where(c).groupBy("guid").agg(F.max("content_sha256").alias("digest"))
    return lookup.watch(half("item_no <= 2000"), half("item_no > 2000"), "guid", "digest")


@query(f"""SELECT guid, CASE WHEN NOT sooner THEN 'new' ELSE 'changed' END AS state FROM ({_HALVES}) WHERE later AND (NOT sooner OR was <> now_)""")
def new_or_changed(spark, d):
    i = table(spark, d, "feed_items").where("guid is not null")
    half = lambda c: i.where(c).groupBy("guid").agg(F.max("content_sha256").alias("digest"))
    was, now = half("item_no <= 2000"), half("item_no > 2000")
    new = now.join(was, "guid", "left_anti").select("guid", F.lit("new").alias("state"))
    changed = now.alias("n").join(was.alias("w"), "guid").where("n.digest <> w.digest").select("guid", F.lit("changed").alias("state"))
    return new.unionByName(changed)


SCOPES = ["district", "state", "national"]  # order of precedence


@query("SELECT id, CAST(CASE scope WHEN 'district' THEN 0 WHEN 'state' THEN 1 WHEN 'national' THEN 2 ELSE 99 END AS INTEGER) AS place FROM feeds")
def precedence_rank(spark, d):
    return table(spark, d, "feeds").select("id", lookup.ranked(F.col("scope"), SCOPES, 99).alias("place"))


@query("""WITH r AS (SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY CASE scope WHEN 'district' THEN 0 WHEN 'state' THEN 1 WHEN 'national' THEN 2 ELSE 99 END, id) AS n FROM feeds WHERE category IS NOT NULL) SELECT category, string_agg(id, ',' ORDER BY n) AS first_ten FROM r WHERE n <= 10 GROUP BY category""")
def severity_lists(spark, d):
    """Entries of each topic in order of precedence, the first ten named in the report."""
    order = F.array_sort(F.collect_list(F.struct(lookup.ranked(F.col("scope"), SCOPES, 99).alias("place"), "id")))
    return table(spark, d, "feeds").where("category is not null").groupBy("category").agg(F.array_join(F.slice(F.transform(order, lambda x: x["id"]), 1, 10), ",").alias("first_ten"))


# ---- tables in documents

_CELLS = "list_filter(list_transform(course_grades, lambda g, i: CASE WHEN g IS NULL THEN NULL ELSE {'row': i - 1, 'col': length(coalesce(g.letter_grade, '')), 'rowspan': CASE WHEN g.grade_percentage > 80 THEN 2 END} END), lambda c: c IS NOT NULL)"


def _cells(spark, d):
    cell = lambda g, i: F.when(g.isNotNull(), F.struct(i.cast("int").alias("row"), F.length(F.coalesce(g["letter_grade"], F.lit(""))).alias("col"), F.when(g["grade_percentage"] > 80, F.lit(2)).alias("rowspan"), F.lit(1).alias("colspan")))
    return table(spark, d, "records").where("course_grades is not null").select("record_no", F.array_compact(F.transform("course_grades", cell)).alias("cells"), "course_grades")


@query(f"SELECT record_no, CAST(coalesce(list_max(list_transform({_CELLS}, lambda c: c.row + coalesce(c.rowspan, 1))), 0) AS INTEGER) AS n_rows, CAST(coalesce(list_max(list_transform({_CELLS}, lambda c: c.col + 1)), 0) AS INTEGER) AS n_columns FROM records WHERE course_grades IS NOT NULL")
def table_extent(spark, d):
    return _cells(spark, d).select("record_no", tabular.extent(F.col("cells"), "row", "rowspan").cast("int").alias("n_rows"), tabular.extent(F.col("cells"), "col", "colspan").cast("int").alias("n_columns"))


@query(f"""SELECT count(*) AS n_tables, CAST(sum(len({_CELLS})) AS BIGINT) AS n_cells, count(*) FILTER (WHERE len(list_filter({_CELLS}, lambda c: c.col >= 2 OR c.row >= 5)) = 0) AS n_well_formed FROM records WHERE course_grades IS NOT NULL""")
def table_recovery(spark, d):
    """Tables, cells, and tables whose cells all lie within five rows and two columns."""
    fit = tabular.well_formed(F.col("cells"), F.lit(5), F.lit(2))
    return _cells(spark, d).agg(F.count("*").alias("n_tables"), F.sum(F.size("cells").cast("bigint")).alias("n_cells"), F.count(F.when(fit, 1)).alias("n_well_formed"))


@query("""WITH f AS (SELECT record_no, list_transform(enrollments, lambda e: coalesce(e.status = 'active', false)) AS f FROM records)
    SELECT record_no, CAST(CASE WHEN f IS NULL THEN 0 WHEN list_position(f, false) IS NULL OR list_position(f, false) = 0 THEN len(f) ELSE list_position(f, false) - 1 END AS INTEGER) AS n FROM f""")
def leading_run(spark, d):
    """Length of the run of flagged entries that an array begins with."""
    return table(spark, d, "records").select("record_no", tabular.leading(F.transform("enrollments", lambda e: F.coalesce(e["status"] == "active", F.lit(False)))).cast("int").alias("n"))


@query("""WITH s AS (SELECT row_no, list_distinct(list_filter(list_transform(programs, lambda p: p.status), lambda x: x IN ('active', 'paused', 'planned', 'closed'))) AS s FROM schools) SELECT row_no, round(coalesce(len(s), 0) / 4.0, 6) AS lineage FROM s""")
def lineage_coverage(spark, d):
    """Share of the core steps that a record's history names."""
    return table(spark, d, "schools").select("row_no", F.round(tabular.lineage(F.transform("programs", lambda p: p["status"]), ["active", "paused", "planned", "closed"]), 6).alias("lineage"))


@query("SELECT category, bool_or(coalesce(authority = 'primary', false)) AS primary_source, bool_and(coalesce(verified, false)) AS all_verified FROM feeds GROUP BY category")
def confidence_floor(spark, d):
    f = table(spark, d, "feeds")
    return f.groupBy("category").agg(F.bool_or(F.coalesce(F.col("authority") == "primary", F.lit(False))).alias("primary_source"), F.bool_and(F.coalesce("verified", F.lit(False))).alias("all_verified"))


@query("""SELECT page_id, CASE WHEN text IS NULL THEN 'image_only' WHEN trim(text) = '' THEN 'empty_page' WHEN confidence IS NULL THEN 'unknown' WHEN confidence < 0.8 THEN 'reread' ELSE 'not_needed' END AS state FROM scan_pages""")
def ocr_decision(spark, d):
    """Whether a page needs reading again, by what was read."""
    state = F.when(F.col("text").isNull(), "image_only").when(F.trim("text") == "", "empty_page").when(F.col("confidence").isNull(), "unknown").when(F.col("confidence") < 0.8, "reread").otherwise("not_needed")
    return table(spark, d, "scan_pages").select("page_id", state.alias("state"))


@query("SELECT page_id, 'ocr:scan' AS gap FROM scan_pages WHERE text IS NULL UNION ALL SELECT page_id, NULL FROM scan_pages WHERE text IS NOT NULL")
def engine_gaps(spark, d):
    """Pages without text go to the reader of images; while none is registered they come back with the gap."""
    p = table(spark, d, "scan_pages")
    return engines.READERS.run(p.where("text is null").select("page_id"), "scan").unionByName(p.where("text is not null").select("page_id", F.lit(None).cast("string").alias("gap")))


# ---- batches, search modes, traversal

@query("SELECT coalesce(nullif(guid, ''), link) AS entry, min(first_seen) AS first_seen, count(*) AS deliveries FROM feed_items WHERE coalesce(nullif(guid, ''), link) IS NOT NULL GROUP BY 1")
def first_seen_stamp(spark, d):
    """When an entry's first batch arrived; later deliveries keep the stamp."""
    return table(spark, d, "feed_items").select(F.coalesce(F.nullif("guid", F.lit("")), "link").alias("entry"), "first_seen").where("entry is not null").groupBy("entry").agg(F.min("first_seen").alias("first_seen"), F.count("*").alias("deliveries"))


@query("SELECT doc_id, 'like' AS engine FROM documents WHERE contains(lower(text), 'photosynth') ORDER BY doc_id LIMIT 20")
def degraded_search(spark, d):
    """Without an index for it, a part of a word is looked up unranked, and the result says so."""
    return search.like(table(spark, d, "documents"), ["text"], "photosynth", 20, "doc_id").select("doc_id", F.lit("like").alias("engine"))


@query("SELECT 'item' AS kind, link AS ref, 'finding' AS what FROM feed_items WHERE contains(lower(title), 'robotics') AND link IS NOT NULL UNION ALL SELECT DISTINCT 'url', link, 'seed' FROM feed_items WHERE contains(lower(title), 'robotics') AND link LIKE '%://%'")
def search_fanout(spark, d):
    """Hits of a search as findings, and their addresses as new seeds."""
    hits = search.like(table(spark, d, "feed_items"), ["title"], "robotics").where("link is not null").select("link")
    seeds = hits.where(F.col("link").contains("://")).distinct()
    return hits.select(F.lit("item").alias("kind"), F.col("link").alias("ref"), F.lit("finding").alias("what")).unionByName(seeds.select(F.lit("url").alias("kind"), F.col("link").alias("ref"), F.lit("seed").alias("what")))


def _walk(spark, d):
    f, i = table(spark, d, "feeds"), table(spark, d, "feed_items").where("feed_id is not null and link is not null")

    def scope(seeds):
        got = seeds.join(f.select(F.col("scope").alias("ref"), F.col("id").alias("next_ref")), "ref", "left")
        return got.select("ref", F.lit("feed").alias("next_kind"), "next_ref", F.lit(None).cast("string").alias("error"))

    def feed(seeds):
        known = f.select(F.col("id").alias("ref"), F.col("state.last_status").alias("status"))
        got = seeds.join(known, "ref", "left").join(i.select(F.col("feed_id").alias("ref"), F.col("link").alias("next_ref")).distinct(), "ref", "left")
        return got.select("ref", F.lit("page").alias("next_kind"), "next_ref", F.when(F.col("status") >= 400, F.concat(F.lit("status "), F.col("status").cast("string"))).alias("error"))

    seeds = spark.createDataFrame([("scope", "district"), ("scope", "state")], "kind string, ref string")
    return traverse.run(seeds, {"scope": scope, "feed": feed})


_REACHED = """WITH s AS (SELECT 'scope' AS kind, s AS ref FROM (VALUES ('district'), ('state')) t(s)), f AS (SELECT DISTINCT id, state.last_status AS st FROM feeds WHERE scope IN ('district', 'state')),
    p AS (SELECT DISTINCT i.link FROM feed_items i JOIN f ON i.feed_id = f.id WHERE coalesce(f.st, 0) < 400 AND i.link IS NOT NULL)"""


@query(_REACHED + " SELECT 0 AS layer, 'scope' AS kind, ref, (SELECT count(*) FROM feeds WHERE scope = s.ref) AS n_next FROM s UNION ALL SELECT 1, 'feed', id, (SELECT count(DISTINCT link) FROM feed_items i WHERE i.feed_id = f.id AND link IS NOT NULL) FROM f WHERE coalesce(st, 0) < 400")
def walk_findings(spark, d):
    """What a walk from scopes to feeds to pages fetched, each seed at its first layer."""
    return _walk(spark, d)[0]


@query(_REACHED + " SELECT (SELECT count(*) FROM s) + (SELECT count(*) FROM f WHERE coalesce(st, 0) < 400) AS findings, 2 AS layers, (SELECT count(*) FROM f WHERE st >= 400) + (SELECT count(*) FROM p) AS gaps, (SELECT count(*) FROM p) AS no_fetcher, (SELECT count(*) FROM f WHERE st >= 400) AS fetch_error, 'saturated' AS stopped")
def walk_envelope(spark, d):
    """The walk in one row: pages have no fetcher, feeds with a bad status are fetch errors."""
    return traverse.envelope(*_walk(spark, d))


@query("""SELECT id, md5_ FROM (SELECT id, printf('# %s\n- scope: %s\n- cadence: %d days', label, coalesce(scope, '-'), cadence_days) AS md5_ FROM feeds WHERE label IS NOT NULL AND cadence_days IS NOT NULL) ORDER BY id""".replace("md5_", "report"))
def markdown_report(spark, d):
    """One block of a Markdown report for each entry."""
    return table(spark, d, "feeds").where("label is not null and cadence_days is not null").select("id", F.format_string("# %s\n- scope: %s\n- cadence: %d days", "label", F.coalesce("scope", F.lit("-")), "cadence_days").alias("report"))
