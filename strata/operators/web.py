"""Captured pages and responses: links, feeds, structured data, blocks, refusals and content scores."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HREF = r"""(?i)href\s*=\s*["']([^"'<>]+)["']"""
SKIPPED = r"(?i)^(javascript|mailto|tel):|^#|^\s*$"


def links(html: Column) -> Column:
    """Link targets in order of appearance, fragments cut, repeated ones and script, mail and phone links dropped."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(HREF), F.lit(1))
    kept = F.filter(F.transform(found, lambda u: F.trim(u)), lambda u: ~u.rlike(SKIPPED))
    return F.array_distinct(F.filter(F.transform(kept, lambda u: F.split(u, "#").getItem(0)), lambda u: u != ""))


def host(url: Column) -> Column:
    """Lowered host without user, port and leading www; null where there is none."""
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    h = F.regexp_replace(F.regexp_replace(F.regexp_replace(h, r"^.*@", ""), r":\d*$", ""), r"^www\.", "")
    return F.when(h != "", h)


def domain(url: Column) -> Column:
    """Last two labels of the host."""
    return F.regexp_extract(host(url), r"([^.]+\.[^.]+)$", 1)


def feed_links(html: Column) -> Column:
    """Targets of alternate links that announce RSS or Atom, whichever way round their attributes stand."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)(<link[^>]*>)"), F.lit(1))
    mine = F.filter(tags, lambda t: t.rlike(r"""(?i)type\s*=\s*["']application/(rss|atom)\+xml["']"""))
    return F.array_sort(F.array_distinct(F.filter(F.transform(mine, lambda t: F.regexp_extract(t, HREF, 1)), lambda u: u != "")))


def structured_data(html: Column) -> Column:
    """What a page offers beside its text: JSON-LD blocks, embedded state, feeds, data endpoints (at most 25), sitemap."""
    text = F.coalesce(html, F.lit(""))
    targets = F.regexp_extract_all(text, F.lit(r"""(?i)(?:href|src|action)\s*=\s*["']([^"']+)["']"""), F.lit(1))
    path = lambda u: F.split(F.lower(u), r"\?").getItem(0)
    endpoints = F.filter(targets, lambda u: path(u).rlike(r"/api/|/wp-json/|/rest/|/graphql|/odata|\.(geo)?json$"))
    maps = F.filter(targets, lambda u: path(u).rlike(r"/sitemap(_index)?\.xml$"))
    return F.struct(
        F.size(F.regexp_extract_all(text, F.lit(r"""(?i)(<script[^>]+type\s*=\s*["']application/ld\+json["'][^>]*>)"""), F.lit(1))).alias("json_ld"),
        F.filter(F.array(F.lit("__NEXT_DATA__"), F.lit("__NUXT__"), F.lit("__INITIAL_STATE__"), F.lit("__APOLLO_STATE__")), lambda m: F.contains(text, m)).alias("embedded_state"),
        feed_links(html).alias("feeds"),
        F.slice(F.array_sort(F.array_distinct(endpoints)), 1, 25).alias("endpoints"),
        F.try_element_at(maps, F.lit(-1)).alias("sitemap"),
    )


def refusal(status: Column, headers: Column, body: Column, signatures: list[tuple[str, str, str]], captchas: list[tuple[str, str]], most: int = 200_000) -> Column:
    """Who refused a response and how: struct of vendor, kind, confidence, retry. Notices stand at a body's start; its first ``most`` characters are read.

    ``signatures`` is (vendor, where, mark) in order of precedence, where is 'header' (a
    line of the lowered header blob starts with it), 'cookie' (occurs in the blob) or
    'body'; ``captchas`` is (name, mark in the body).
    """
    blob, low = F.lower(F.coalesce(headers, F.lit(""))), F.lower(F.substring(F.coalesce(body, F.lit("")), 1, most))

    def met(where: str, mark: str) -> Column:
        if where == "header":
            return F.concat(F.lit("\n"), blob).contains("\n" + mark)
        return (blob if where == "cookie" else low).contains(mark)

    vendor = F.coalesce(*[F.when(met(w, m), v) for v, w, m in signatures], F.lit(None).cast("string"))
    by_body = F.lit(False)
    for name in dict.fromkeys(v for v, _, _ in signatures):
        marks = [m for v, w, m in signatures if v == name and w == "body"]
        hit = F.lit(False)
        for m in marks:
            hit = hit | low.contains(m)
        by_body = by_body | ((vendor == name) & hit)
    captcha = F.coalesce(*[F.when(low.contains(m), n) for n, m in captchas], F.lit(None).cast("string"))
    refused, throttled = status.isin(401, 403, 406, 451), status.isin(429, 503)
    kind = (
        F.when(captcha.isNotNull(), "captcha").when(throttled, "rate_limit").when(vendor.isNotNull() & by_body, "challenge").when(vendor.isNotNull() | refused, "ip_block").otherwise("none")
    )
    confidence = F.when((vendor.isNotNull() & by_body) | captcha.isNotNull(), "high").when(vendor.isNotNull() | refused | throttled, "medium").otherwise("low")
    return F.struct(F.coalesce(vendor, captcha).alias("vendor"), kind.alias("kind"), confidence.alias("confidence"), kind.isin("none", "rate_limit").alias("retry"))


# The sizes, shares and steps of the content score.
def content_score(html: Column, status: Column, scripts: list[str], obstacles: list[str]) -> Column:
    """How good fetched content is, 0 to 1: size, script and obstacle marks, share of visible text, structure, bad characters."""
    body = F.regexp_replace(F.coalesce(html, F.lit("")), r"^\s+|\s+$", "")
    n, low = F.length(body), F.lower(body)
    has = lambda marks: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(low, m))
    share = F.length(F.trim(F.regexp_replace(body, "<[^>]+>", " "))) / F.greatest(n, F.lit(1))
    score = (
        F.lit(0.5)
        + F.when(n < 1000, -0.3).when(n < 5000, -0.1).when(n > 20000, 0.1).otherwise(0.0)
        + F.when(has(scripts), -0.3).otherwise(0.0)
        + F.when(has(obstacles), -0.3).otherwise(0.0)
        + F.when(share < 0.10, -0.2).when(share > 0.40, 0.1).otherwise(0.0)
        + F.when(has(["<h1", "<h2", "<article", "<main", "<section"]), 0.1).otherwise(0.0)
        + F.when(n - F.length(F.replace(body, F.lit("�"), F.lit(""))) > 5, -0.1).otherwise(0.0)
    )
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 3)))
    return F.when(status == 429, 0.0).when(~status.isin(200, 203, 206), 0.1).when(n < 200, 0.0).otherwise(score)


def probe_class(status: Column, error: Column, url: Column, final_url: Column, is_feed: Column, n_feeds: Column, ok: Column) -> Column:
    """First class that fits a probed address."""
    failed = F.coalesce(error, F.lit("")) != ""
    return (
        F.when(status.isin(401, 403), "BLOCKED")
        .when(F.lower(error).contains("refused") | status.isin(404, 410), "DEAD")
        .when(failed | (status >= 400), "ERROR")
        .when(F.regexp_replace(final_url, "/+$", "") != F.regexp_replace(url, "/+$", ""), "REDIRECT")
        .when(is_feed, "LIVE_FEED")
        .when(n_feeds > 0, "PAGE+FEED_FOUND")
        .when(ok, "LIVE_PAGE")
        .otherwise("UNKNOWN")
    )


def visible_text(html: Column, most: int = 5000) -> Column:
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<style[^>]*>.*?</style>|<script[^>]*>.*?</script>", " ")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"\s+", " ")), 1, most)


class _Blocks(HTMLParser):
    """Headings, paragraphs and list items in order; text outside them, scripts and styles are left out."""

    WANTED, HIDDEN = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li"}, {"script", "style", "noscript", "template"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.kind, self.parts, self.hidden = None, [], 0

    def flush(self):
        text = " ".join(" ".join(self.parts).split())
        if self.kind and text:
            self.out.append((self.kind, text))
        self.kind, self.parts = None, []

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag in self.WANTED:
            self.flush()
            self.kind = tag

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == self.kind:
            self.flush()

    def handle_data(self, data):
        if self.kind and not self.hidden:
            self.parts.append(data)


def blocks_of(html: str | None) -> list[tuple[str, str]]:
    if not html:
        return []
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.out


class _Tables(HTMLParser):
    """Cells of every table, nested ones by themselves, placed by row and column spans."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[tuple[int, int, str, int, int, bool]]] = []
        self.stack: list[dict] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            self.tables.append([])
            self.stack.append({"cells": self.tables[-1], "row": -1, "taken": set(), "cell": None})
        elif self.stack:
            t = self.stack[-1]
            if tag == "tr":
                self._close(t)
                t["row"] += 1
            elif tag in ("td", "th"):
                self._close(t)
                span = lambda k: max(1, int(a[k])) if (a.get(k) or "").isdigit() else 1
                t["cell"] = ([], span("rowspan"), span("colspan"), tag == "th")

    def handle_endtag(self, tag):
        if self.stack and tag in ("td", "th", "tr", "table"):
            self._close(self.stack[-1])
            if tag == "table":
                self.stack.pop()

    def handle_data(self, data):
        if self.stack and self.stack[-1]["cell"]:
            self.stack[-1]["cell"][0].append(data)

    def _close(self, t):
        if not t["cell"]:
            return
        parts, rows, cols, head = t["cell"]
        t["cell"] = None
        r, c = max(t["row"], 0), 0
        while (r, c) in t["taken"]:
            c += 1
        t["taken"] |= {(r + i, c + j) for i in range(rows) for j in range(cols)}
        t["cells"].append((r, c, " ".join(" ".join(parts).split()), rows, cols, head))


def tables_of(html: str | None) -> list[list[tuple[int, int, str, int, int, bool]]]:
    if not html:
        return []
    parser = _Tables()
    parser.feed(html)
    parser.close()
    return [t for t in parser.tables if t]


def _exploded(df: DataFrame, key: str, column: str, each, fields: str) -> DataFrame:
    kind = dict(df.dtypes)[key]
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, *row) for k, v in zip(pdf["k"], pdf["v"]) for row in each(v)], columns=["k", *names])

    got = df.select(F.col(key).alias("k"), F.col(column).alias("v")).mapInPandas(run, f"k {kind}, {fields}")
    return got.withColumnRenamed("k", key)


def html_blocks(df: DataFrame, key: str, html: str) -> DataFrame:
    """``key``, pos, kind, text of each heading, paragraph and list item. Null pages give no row."""
    return _exploded(df, key, html, lambda v: [(i, k, t) for i, (k, t) in enumerate(blocks_of(v))], "pos int, kind string, text string")


def html_tables(df: DataFrame, key: str, html: str) -> DataFrame:
    """``key``, table, row, col, text, rowspan, colspan, header of each cell."""
    return _exploded(
        df, key, html, lambda v: [(n, *c) for n, t in enumerate(tables_of(v)) for c in t], "table_no int, row int, col int, text string, rowspan int, colspan int, header boolean"
    )


def decoded(data: bytes | None, declared: str | None = None) -> str | None:
    """Text of page bytes: byte order mark, declared charset, UTF-8, then a western code page; composed form."""
    import unicodedata

    if data is None:
        return None
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return unicodedata.normalize("NFC", data[len(mark) :].decode(name, "replace"))
    tried = []
    if declared:
        name = declared.strip().lower()
        tried.append("cp1252" if name in ("latin-1", "latin1", "iso-8859-1") and any(0x80 <= b < 0xA0 for b in data) else name)
    for name in (*tried, "utf-8", "cp1252"):
        try:
            return unicodedata.normalize("NFC", data.decode(name))
        except (UnicodeDecodeError, LookupError):
            continue
    return unicodedata.normalize("NFC", data.decode("latin-1"))


def decode(df: DataFrame, key: str, data: str, declared: str | None = None) -> DataFrame:
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "text": [decoded(None if d is None else bytes(d), c or None) for d, c in zip(pdf["d"], pdf["c"])]})

    work = df.select(F.col(key).alias("k"), F.col(data).alias("d"), (F.col(declared) if declared else F.lit("")).alias("c"))
    return work.mapInPandas(run, f"k {kind}, text string").withColumnRenamed("k", key)


def absolute(df: DataFrame, key: str, base: str, link: str) -> DataFrame:
    """Adds ``url``: the link joined with its base."""
    from urllib.parse import urljoin

    @F.pandas_udf("string")
    def join(b: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series([None if y is None else urljoin(x or "", y) for x, y in zip(b, u)])

    return df.withColumn("url", join(F.col(base), F.col(link)))


def feed_entries(xml: str | None) -> list[tuple[str | None, str | None, str | None, str | None, str | None]]:
    """(guid, title, link, summary, published) of RSS items and Atom entries; a missing guid is the link; broken XML gives none."""
    import xml.etree.ElementTree as ET

    if not xml:
        return []
    try:
        root = ET.fromstring(xml.strip())
    except ET.ParseError:
        return []
    local = lambda e: e.tag.rsplit("}", 1)[-1].lower()
    out = []
    for item in root.iter():
        if local(item) not in ("item", "entry"):
            continue
        got: dict[str, str | None] = {}
        for e in item:
            name, text = local(e), (e.text or "").strip() or None
            if name == "link" and e.get("href"):
                if e.get("rel", "alternate") == "alternate" or "link" not in got:
                    got["link"] = e.get("href")
            else:
                got.setdefault({"id": "guid", "description": "summary", "content": "summary", "pubdate": "published", "updated": "published"}.get(name, name), text)
        out.append((got.get("guid") or got.get("link"), got.get("title"), got.get("link"), got.get("summary"), got.get("published")))
    return out


def parse_feeds(df: DataFrame, key: str, xml: str) -> DataFrame:
    return _exploded(df, key, xml, lambda v: [(i, *e) for i, e in enumerate(feed_entries(v))], "pos int, guid string, title string, link string, summary string, published string")


def likeness(df: DataFrame, left: str, right: str, most: int = 3000, name: str = "likeness") -> DataFrame:
    """Adds the matching-blocks ratio of the first ``most`` characters of two texts; it isn't symmetric."""
    from difflib import SequenceMatcher

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else round(SequenceMatcher(None, x[:most], y[:most]).ratio(), 6) for x, y in zip(a, b)])

    return df.withColumn(name, ratio(F.col(left), F.col(right)))


def best_capture(df: DataFrame, key: str, order: str, text: str, confidence: str) -> DataFrame:
    """(key, best, score, n, agreement): the capture with the most text and confidence, first on ties, and the share
    of words the others have in common with it on average."""
    w = df.withColumn("__w", F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\W+", " ")), " ")))
    score = F.round(0.5 * F.length(F.coalesce(text, F.lit(""))) + 500 * F.coalesce(confidence, F.lit(0.0)), 6)
    top = w.groupBy(key).agg(F.min(F.struct((-score).alias("s"), F.col(order).alias("o"), F.col("__w").alias("w"))).alias("m"), F.count("*").alias("n"))
    both = w.join(top, key).where(F.col(order) != F.col("m.o"))
    shared = F.size(F.array_intersect("__w", "m.w")) / F.greatest(F.size("__w"), F.size("m.w"), F.lit(1))
    agree = both.groupBy(key).agg(F.round(F.avg(shared), 6).alias("agreement"))
    return top.join(agree, key, "left").select(key, F.col("m.o").alias("best"), (-F.col("m.s")).alias("score"), "n", "agreement")
