"""Queries over the written index, and round trips through the document parsers over whole tables."""

import hashlib

from pyspark.sql import functions as F

from ..operators import docs, parsing, search, web
from ..session import shared_dir, table
from ..sources import files
from .reference import _bm25_sql, _count, query

# ---- the written index

_INDEXES: dict[tuple[str, str], str] = {}


def _index(spark, d):
    """The index over documents and items, written once for a data folder and application."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _INDEXES:
        path = f"{shared_dir(spark)}/index-{hashlib.md5(repr(at).encode()).hexdigest()}"
        sources = [("documents", table(spark, d, "documents"), "doc_id", F.col("text")), ("items", table(spark, d, "feed_items"), "item_no", F.col("title"))]
        _INDEXES[at] = search.build_index(sources, path)
    return _INDEXES[at]


_BOTH = "(SELECT 'documents' AS source, CAST(doc_id AS VARCHAR) AS key, text AS body FROM documents UNION ALL SELECT 'items', CAST(item_no AS VARCHAR), title FROM feed_items)"


def _index_sql(conditions, where="true"):
    sql = _bm25_sql(conditions, where, text="strip_accents(body)", src=_BOTH, key="source, key")
    return sql


@query(_index_sql([_count("robotics"), _count("students")]))
def index_bm25(spark, d):
    """Best rows of all tables from the written index."""
    return search.search_index(spark, _index(spark, d), "robotics students")


@query(_index_sql([_count("reunion")], "source = 'documents'"))
def index_filtered(spark, d):
    """A word in one table of the index; accents are folded in texts and query."""
    return search.search_index(spark, _index(spark, d), "Reunión", source="documents")


@query(_index_sql(["len(list_filter(t, lambda x: starts_with(x, 'photo')))", "len(list_filter(t, lambda x: starts_with(x, 'scho')))"]))
def index_prefix(spark, d):
    return search.search_index(spark, _index(spark, d), "photo scho", prefix=True)


@query(_index_sql(["len(list_filter(range(1, len(t)), lambda i: t[i] = 'middle' AND t[i + 1] = 'school'))"]))
def index_phrase(spark, d):
    return search.search_index(spark, _index(spark, d), "middle.school")


# ---- snapshots

_ROW = "sha256(concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in ("cadence_days", "category", "id", "label", "tier", "url")) + "))"
_SUMS = ", ".join(f"coalesce(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)), 0) AS s{i}" for i in range(8))


@query(f"SELECT n, sha256(concat_ws(',', n, {', '.join(f's{i}' for i in range(8))})) AS digest FROM (SELECT count(*) AS n, {_SUMS} FROM (SELECT {_ROW} AS h FROM feeds))")
def snapshot_manifest(spark, d):
    """Row count and order-free digest of the feed catalogue."""
    return files.manifest(table(spark, d, "feeds").select("id", "url", "label", "category", "tier", "cadence_days"), ["id"])


@query("SELECT record_no, student_id, current_school.school_id AS school_id, coalesce(len(standards_mastery), -1) AS n_mastery FROM records")
def package_projection(spark, d):
    """Academic packages (the wanted sections of each record as one JSON object), opened again."""
    from ..operators import records

    sections = {"student": F.struct("student_id"), "school": F.col("current_school"), "year": F.col("academic_year"), "mastery": F.col("standards_mastery"), "grades": F.col("course_grades")}
    p = records.package(table(spark, d, "records"), "record_no", sections, ["student", "school", "mastery"])
    got = lambda path: F.get_json_object("package", path)
    n = F.coalesce(F.json_array_length(got("$.mastery")), F.lit(-1)).cast("bigint")
    return p.select("record_no", got("$.student.student_id").alias("student_id"), got("$.school.school_id").alias("school_id"), n.alias("n_mastery"))


# ---- parsers, fed with what the tables hold


@query("SELECT p_partkey, CAST(p_partkey % 90 AS INTEGER) AS row, CAST(p_partkey % 702 AS INTEGER) AS col FROM part")
def cell_places(spark, d):
    """Spreadsheet references, made from part numbers, as row and column."""
    c = F.col("p_partkey") % 702
    two = F.concat(F.when(c >= 26, F.char((F.lit(64) + F.floor(c / 26)).cast("bigint"))).otherwise(""), F.char((F.lit(65) + c % 26).cast("bigint")))
    ref = F.concat(two, (F.col("p_partkey") % 90 + 1).cast("string"))
    return table(spark, d, "part").select("p_partkey", parsing.cell_places(ref).alias("p")).select("p_partkey", "p.row", "p.col")


@query(
    """WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10) || chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS p, trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')) AS t FROM documents),
    b AS (SELECT doc_id, list_concat(CASE WHEN t <> '' THEN [{'k': 'h1', 'x': t}] ELSE [] END, list_transform(p, lambda x: {'k': 'p', 'x': x})) AS b FROM p) SELECT doc_id, CAST(unnest(range(len(b))) AS INTEGER) AS pos, unnest(b).k AS kind, unnest(b).x AS text FROM b"""
)
def html_blocks(spark, d):
    """Headings and paragraphs of pages made from the documents."""
    body = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n\n"), lambda p: F.concat(F.lit("<p class=x>"), p, F.lit("</p>"))), "\n")
    page = F.concat(F.lit("<html><body><h1>"), F.coalesce("title", F.lit("")), F.lit("</h1>"), body, F.lit("</body></html>"))
    return web.html_blocks(table(spark, d, "documents").select("doc_id", page.alias("html")), "doc_id", "html")


_PROGRAMS = "SELECT row_no, list_filter(programs, lambda p: p IS NOT NULL) AS p FROM schools WHERE programs IS NOT NULL"


def _table_of(spark, d, row, head, end):
    s = table(spark, d, "schools").where("programs is not null").select("row_no", F.filter("programs", lambda p: p.isNotNull()).alias("p"))
    return s.select("row_no", F.concat(F.lit(head), F.array_join(F.transform("p", row), ""), F.lit(end)).alias("page"))


@query(f"SELECT row_no, CAST(unnest(range(len(p))) + 1 AS INTEGER) AS row, 0 AS col, coalesce(unnest(p).program_id, '') AS text FROM ({_PROGRAMS}) UNION ALL SELECT row_no, CAST(unnest(range(len(p))) + 1 AS INTEGER), 1, coalesce(unnest(p).status, '') FROM ({_PROGRAMS})")
def html_tables(spark, d):
    """Cells below the header of a page's table, in place."""
    cell = lambda x: F.concat(F.lit("<td>"), F.coalesce(x, F.lit("")), F.lit("</td>"))
    pages = _table_of(spark, d, lambda p: F.concat(F.lit("<tr>"), cell(p["program_id"]), cell(p["status"]), F.lit("</tr>")), "<table><tr><th>id</th><th>status</th></tr>", "</table>")
    return web.html_tables(pages, "row_no", "page").where("row > 0").select("row_no", "row", "col", "text")


@query(f"SELECT row_no, CAST(unnest(range(len(p))) + 1 AS INTEGER) AS row, 0 AS col, coalesce(unnest(p).program_id, '-') AS text FROM ({_PROGRAMS} AND len(p) > 0) UNION ALL SELECT row_no, CAST(unnest(range(len(p))) + 1 AS INTEGER), 1, coalesce(unnest(p).status, '-') FROM ({_PROGRAMS} AND len(p) > 0)")
def markdown_tables(spark, d):
    pages = _table_of(spark, d, lambda p: F.concat(F.lit("| "), F.coalesce(p["program_id"], F.lit("-")), F.lit(" | "), F.coalesce(p["status"], F.lit("-")), F.lit(" |\n")), "Programs\n\n| id | status |\n|---|:---:|\n", "\nEnd\n")
    return docs.markdown_tables(pages, "row_no", "page").where("row > 0").select("row_no", "row", "col", "text")


@query("SELECT doc_id, 0 AS row, 0 AS col, trim(coalesce(title, '')) AS text FROM documents UNION ALL SELECT doc_id, 0, 1, trim(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) FROM documents")
def csv_cells(spark, d):
    """Fields of delimited lines whose quoted texts hold line breaks, quotes and commas."""
    q = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return docs.csv_cells(table(spark, d, "documents").select("doc_id", F.concat(q("title"), F.lit(","), q("text"), F.lit("\r\n")).alias("csv")), "doc_id", "csv")


_XML = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("""SELECT item_no, coalesce(nullif(trim(guid), ''), nullif(trim(link), '')) AS guid, nullif(trim(title), '') AS title, nullif(trim(link), '') AS link FROM feed_items""")
def parse_feeds(spark, d):
    """Items of feeds written as RSS and Atom; a missing guid is the link."""
    x = lambda c: F.expr(_XML.format(f"coalesce({c}, '')"))
    rss = F.concat(F.lit("<?xml version='1.0'?><rss><channel><title>f</title><item><guid>"), x("guid"), F.lit("</guid><title>"), x("title"), F.lit("</title><link>"), x("link"), F.lit("</link></item></channel></rss>"))
    atom = F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'><entry><id>"), x("guid"), F.lit("</id><title>"), x("title"), F.lit("</title><link rel='self' href='/x'/><link href='"), x("link"), F.lit("'/></entry></feed>"))
    whole = (F.col("item_no") % 2 == 0) | F.col("link").isNull() | F.col("link").contains("'")
    return web.parse_feeds(table(spark, d, "feed_items").select("item_no", F.when(whole, rss).otherwise(atom).alias("xml")), "item_no", "xml").select("item_no", "guid", "title", "link")


@query("""SELECT item_no, CAST(item_no AS VARCHAR) AS uid, regexp_replace(title, '^\\s+|\\s+$', '', 'g') AS summary FROM feed_items WHERE title IS NOT NULL""")
def calendar_events(spark, d):
    """Events of calendars whose lines are folded and whose texts are escaped."""
    text = F.expr(r"replace(replace(replace(replace(title, '\\', '\\\\'), ';', '\;'), ',', '\\,'), '\n', '\\n')")
    folded = F.concat(F.substring(text, 1, 20), F.lit("\r\n "), F.substring(text, 21, 100_000))
    ics = F.concat(F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:"), F.col("item_no").cast("string"), F.lit("\r\nSUMMARY;LANGUAGE=en:"), folded, F.lit("\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"))
    return docs.calendar_events(table(spark, d, "feed_items").where("title is not null").select("item_no", ics.alias("ics")), "item_no", "ics").select("item_no", "uid", "summary")


@query("""SELECT doc_id, 'office@example.org' AS sender, 'Notice ' || doc_id AS subject, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM documents WHERE text IS NOT NULL""")
def mails(spark, d):
    """Sender, subject and body of messages."""
    eml = F.concat(F.lit("From: office@example.org\nTo: all@example.org\nSubject: Notice "), F.col("doc_id").cast("string"), F.lit('\nContent-Type: text/plain; charset="utf-8"\nContent-Transfer-Encoding: 8bit\n\n'), "text")
    return docs.mails(table(spark, d, "documents").where("text is not null").select("doc_id", eml.alias("eml")), "doc_id", "eml").select("doc_id", "sender", "subject", "body")


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def decode(spark, d):
    """Texts from bytes in UTF-8, UTF-8 with mark, UTF-16 of both orders."""
    t = F.coalesce("text", F.lit(""))
    data = F.when(F.col("doc_id") % 4 == 0, F.encode(t, "UTF-8")).when(F.col("doc_id") % 4 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(t, "UTF-8")))
    data = data.when(F.col("doc_id") % 4 == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode(t, "UTF-16LE"))).otherwise(F.concat(F.unhex(F.lit("FEFF")), F.encode(t, "UTF-16BE")))
    return web.decode(table(spark, d, "documents").select("doc_id", data.alias("data")), "doc_id", "data")


@query("""SELECT row_no AS doc, 0 AS pos, school_name AS speaker, 'Good morning.' AS text FROM schools WHERE regexp_matches(school_name, '^[A-Za-z ]+$') UNION ALL SELECT row_no, 1, 'Ben Ortiz', trim('Welcome to ' || school_name) FROM schools WHERE regexp_matches(school_name, '^[A-Za-z ]+$')""")
def caption_segments(spark, d):
    """Cues of captions with their speakers, by voice tag or by name."""
    vtt = F.concat(F.lit("WEBVTT\n\n00:01.000 --> 00:02.500\n<v "), "school_name", F.lit(">Good morning.\n\n00:00:03.000 --> 00:00:04.000\nBen Ortiz: Welcome\nto "), "school_name", F.lit("\n"))
    s = table(spark, d, "schools").where("school_name rlike '^[A-Za-z ]+$'").select(F.col("row_no").alias("doc"), vtt.alias("text"))
    return docs.captions(s, "doc", "text").select("doc", "pos", "speaker", "text")


@query("SELECT item_no, CASE WHEN starts_with(link, '/') THEN 'https://x.example' || link ELSE link END AS url FROM feed_items WHERE link IS NOT NULL AND NOT regexp_matches(link, '\\s|/\\.|\\?$|#$')")
def absolute_links(spark, d):
    """Links joined with their base."""
    i = table(spark, d, "feed_items").where(r"link is not null and not link rlike '\\s|/\\.|\\?$|#$'").select("item_no", "link", F.lit("https://x.example/a/b").alias("base"))
    return web.absolute(i, "item_no", "base", "link").select("item_no", "url")
