"""Tables, links and records out of saved pages and nested documents, by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze


def saved_url(html: Column) -> Column:
    """The address a browser noted when it saved a page, or null."""
    return F.nullif(F.regexp_extract(html, r"<!--\s*saved from url=\(\d+\)(\S+?)\s*-->", 1), F.lit(""))


def title(html: Column) -> Column:
    """Text of a page's title, or null."""
    return F.nullif(squeeze(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def links_with_text(html: Column) -> Column:
    """(href, text) of each link in order; links within a page drop out."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"'<>]*)[\"'][^>]*>.*?</a>"), F.lit(0))
    pair = F.transform(
        F.coalesce(found, F.array().cast("array<string>")),
        lambda x: F.struct(F.regexp_extract(x, r"(?is)href\s*=\s*[\"']([^\"'<>]*)[\"']", 1).alias("href"), squeeze(F.regexp_replace(F.regexp_replace(x, r"(?is)^<a\b[^>]*>|</a>$", ""), r"<[^>]*>", "")).alias("text")),
    )
    return F.filter(pair, lambda x: (x["href"] != "") & ~x["href"].startswith("#"))


def keyword_links(links: Column, words: list[str]) -> Column:
    """Links whose text or address holds any of the words, case aside."""
    return F.filter(links, lambda x: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower(F.concat_ws(" ", x["text"], x["href"])), w)))


def sniff(text: Column, platforms: list[tuple[str, list[str]]], default: str | None = None) -> Column:
    """Name of the first platform of which any keyword occurs."""
    out: Column = F.lit(default).cast("string")
    for name, words in reversed(platforms):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.lower(text).contains(w.lower())
        out = F.when(hit, name).otherwise(out)
    return out


def heading_items(html: Column, most: int = 50) -> Column:
    """(title, link) of headings that are links, in order, at most ``most`` as in the page-scrape fallback; blank titles drop out."""
    heads = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<h[1-6][^>]*>\s*<a\b[^>]*href\s*=\s*[\"'][^\"'<>]*[\"'][^>]*>.*?</a>\s*</h[1-6]>"), F.lit(0))
    items = F.transform(heads, lambda x: F.struct(squeeze(F.regexp_replace(x, r"<[^>]*>", "")).alias("title"), F.regexp_extract(x, r"(?is)href\s*=\s*[\"']([^\"'<>]*)[\"']", 1).alias("link")))
    return F.slice(F.filter(items, lambda x: x["title"] != ""), 1, most)


def table_rows(html: Column) -> Column:
    """Rows of a page's tables, each an array of its cells' texts."""
    rows = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<tr\b[^>]*>.*?</tr>"), F.lit(0))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>.*?</t[dh]>"), F.lit(0)), lambda c: squeeze(F.regexp_replace(c, r"<[^>]*>", ""))))


def located(rows: Column, wanted: list[str], within: int = 6) -> Column:
    """Rows below the header as maps of the wanted names. The header is the first of ``within`` rows that holds all names, case aside."""
    names = F.array(*[F.lit(w.lower()) for w in wanted])
    lowered = lambda r: F.transform(r, F.lower)
    flags = F.transform(F.slice(rows, 1, within), lambda r: F.size(F.array_intersect(names, lowered(r))) == len(wanted))
    at = F.coalesce(F.array_position(flags, F.lit(True)).cast("int"), F.lit(0))
    head = lowered(F.try_element_at(rows, at))
    below = F.slice(rows, at + 1, F.greatest(F.size(rows) - at, F.lit(0)))
    made = F.transform(below, lambda r: F.map_from_arrays(names, F.transform(names, lambda n: F.try_element_at(r, F.array_position(head, n).cast("int")))))
    return F.when(at > 0, made).otherwise(F.array().cast("array<map<string,string>>"))


def key_value_records(df: DataFrame, keys: list[str], at: str, name: str, value: str, start: str, fields: list[str]) -> DataFrame:
    """Records out of a run of (name, value) lines: a record begins where ``start`` is met; its fields are pivoted, first value wins.

    Lines before the first start belong to no record. Runs are numbered by ``keys``, so a
    page's lines are one window; columns: keys, record, fields.
    """
    run = Window.partitionBy(*keys).orderBy(at)
    marked = df.select(*keys, at, name, value, F.sum((F.col(name) == start).cast("int")).over(run).alias("record")).where("record > 0")
    return marked.groupBy(*keys, "record").agg(*[F.min_by(F.when(F.col(name) == f, F.col(value)), F.when(F.col(name) == f, F.col(at))).alias(f) for f in fields])


DOCS_SCHEMA = "struct<title:string,body:struct<content:array<struct<paragraph:struct<paragraphStyle:struct<namedStyleType:string>,elements:array<struct<textRun:struct<content:string>>>>>>>>"


def docs_paragraphs(body: Column) -> Column:
    """(kind, text) of a document kept as nested JSON of paragraphs with styled runs; text that is no such JSON gives none."""
    content = F.coalesce(F.from_json(body, DOCS_SCHEMA)["body"]["content"], F.array().cast("array<struct<paragraph:struct<paragraphStyle:struct<namedStyleType:string>,elements:array<struct<textRun:struct<content:string>>>>>>"))
    kind = lambda p: F.when(p["paragraph"]["paragraphStyle"]["namedStyleType"].startswith("HEADING"), "heading").otherwise("paragraph")
    text = lambda p: squeeze(F.array_join(F.transform(p["paragraph"]["elements"], lambda e: F.coalesce(e["textRun"]["content"], F.lit(""))), ""))
    return F.filter(F.transform(F.filter(content, lambda p: p["paragraph"].isNotNull()), lambda p: F.struct(kind(p).alias("kind"), text(p).alias("text"))), lambda x: x["text"] != "")


def coded_entries(text: Column, code: str, ahead: int = 5, most: int = 300) -> Column:
    """(code, text) of the entries of a list of standards.

    A line that is a code alone takes the first filled line of the next ``ahead`` that is no
    code; a line that begins with a code takes what follows in it. Texts end at ``most``
    characters, as the list's own field does.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n"), squeeze)
    alone, lead = rf"^{code}$", rf"^({code})[\s:.–-]+(\S.*)$"
    own = lambda x: F.rlike(x, F.lit(alone))
    after = lambda i: F.try_element_at(F.filter(F.slice(lines, i + 2, ahead), lambda x: (x != "") & ~own(x)), F.lit(1))
    entry = lambda x, i: F.when(own(x), F.struct(x.alias("code"), F.substring(after(i), 1, most).alias("text"))).when(F.rlike(x, F.lit(lead)), F.struct(F.regexp_extract(x, lead, 1).alias("code"), F.substring(F.regexp_extract(x, lead, 2), 1, most).alias("text")))
    return F.filter(F.transform(lines, entry), lambda x: x.isNotNull() & x["text"].isNotNull())


def urls(text: Column) -> Column:
    """Addresses named in a text, each once, without closing punctuation."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"https?://[^\s<>\"')\]]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"[.,;:!?]+$", "")))
