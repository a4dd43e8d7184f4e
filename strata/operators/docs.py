"""Documents into governed blocks: paragraphs, tables, captions, mail, calendars, and their coverage."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .web import _exploded

# Media types by file name ending.
MEDIA = {
    "pdf": "application/pdf", "html": "text/html", "htm": "text/html", "txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "tsv": "text/tab-separated-values",
    "json": "application/json", "xml": "application/xml", "ics": "text/calendar", "eml": "message/rfc822", "vtt": "text/vtt", "srt": "application/x-subrip", "rtf": "application/rtf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "zip": "application/zip",
}


def media_type(filename: Column) -> Column:
    ending = F.lower(F.regexp_extract(filename, r"\.([A-Za-z0-9]+)$", 1))
    pairs = [x for k, v in MEDIA.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), ending), F.lit("application/octet-stream"))


def paragraphs(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, pos, kind (heading or paragraph), level, text: split at blank lines, ``#`` marks headings. Built-ins only."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    got = df.select(key, F.posexplode(parts).alias("pos", "raw"))
    marks = F.length(F.regexp_extract("raw", r"^(#{1,6})\s", 1))
    body = F.trim(F.regexp_replace(F.regexp_replace("raw", r"^#{1,6}\s+", ""), r"\s+", " "))
    return got.select(key, "pos", F.when(marks > 0, "heading").otherwise("paragraph").alias("kind"), marks.alias("level"), body.alias("text"))


def markdown_table(text: str | None) -> list[tuple[int, int, int, str, bool, float]]:
    """(table, row, col, text, header, confidence): header and rule line; ragged rows are padded or cut and trusted less."""
    out, n, lines, i = [], 0, (text or "").split("\n"), 0
    cells = lambda x: [c.strip() for c in x.strip().strip("|").split("|")]
    while i + 1 < len(lines):
        if "|" in lines[i] and re.fullmatch(r"\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*", lines[i + 1]):
            rows, j = [cells(lines[i])], i + 2
            while j < len(lines) and "|" in lines[j]:
                rows.append(cells(lines[j]))
                j += 1
            width = len(rows[0])
            trust = 0.9 if all(len(r) == width for r in rows) else 0.75
            out += [(n, r, c, (row + [""] * width)[c], r == 0, trust) for r, row in enumerate(rows) for c in range(width)]
            n, i = n + 1, j
        else:
            i += 1
    return out


def markdown_tables(df: DataFrame, key: str, text: str) -> DataFrame:
    return _exploded(df, key, text, markdown_table, "table_no int, row int, col int, text string, header boolean, confidence double")


def csv_cells(df: DataFrame, key: str, text: str, delimiter: str = ",") -> DataFrame:
    """``key``, row, col, text of every field; quoted line breaks are part of a field, every field is trimmed."""
    return _exploded(
        df, key, text, lambda v: [(r, c, x.strip()) for r, row in enumerate(csv.reader(io.StringIO((v or "").lstrip("﻿")), delimiter=delimiter)) for c, x in enumerate(row)], "row int, col int, text string"
    )


_CUE = r"((?:\d{1,2}:)?\d{1,2}:\d{2}[.,]\d{1,3})\s*-->\s*((?:\d{1,2}:)?\d{1,2}:\d{2}[.,]\d{1,3})[^\n]*\n"


def captions(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, pos, start, stop, speaker, text of WebVTT and SubRip cues. Built-ins only.

    A cue's speaker is its voice tag, or a short capitalised name before a colon.
    """
    clean = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n")
    cues = F.filter(F.split(clean, r"\n[ \t]*\n"), lambda p: p.rlike(_CUE))
    got = df.select(key, F.posexplode(cues).alias("pos", "raw"))
    body = F.regexp_replace(F.regexp_replace("raw", r"(?s)^.*?-->[^\n]*\n", ""), r"\s+", " ")
    voice = F.regexp_extract(body, r"<v(?:\.[\w.]+)?\s+([^>]+)>", 1)
    said = F.trim(F.regexp_replace(body, "<[^>]*>", ""))
    named = F.regexp_extract(said, r"^([A-Z][\w.'-]*(?: [A-Z][\w.'-]*){0,3}):\s+\S", 1)
    speaker = F.when(voice != "", F.trim(voice)).when(named != "", named)
    words = F.when((voice == "") & (named != ""), F.regexp_replace(said, r"^[^:]+:\s+", "")).otherwise(said)
    return got.select(key, "pos", F.regexp_extract("raw", _CUE, 1).alias("start"), F.regexp_extract("raw", _CUE, 2).alias("stop"), speaker.alias("speaker"), words.alias("text"))


def _calendar(text: str | None) -> list[tuple]:
    unfolded = re.sub(r"\r?\n[ \t]", "", text or "")
    out, now = [], None
    plain = lambda v: v.replace("\\n", "\n").replace("\\N", "\n").replace("\\,", ",").replace("\\;", ";").replace("\\\\", "\\")
    for line in unfolded.splitlines():
        name, _, value = line.partition(":")
        field, *params = name.upper().split(";")
        if field == "BEGIN" and value.strip().upper() == "VEVENT":
            now = {"ATTENDEE": []}
        elif field == "END" and value.strip().upper() == "VEVENT" and now is not None:
            out.append((len(out), now.get("UID"), now.get("SUMMARY"), now.get("LOCATION"), now.get("DTSTART"), now.get("DTEND"), now["ATTENDEE"]))
            now = None
        elif now is not None:
            if field == "ATTENDEE":
                cn = next((p[3:] for p in name.split(";")[1:] if p.upper().startswith("CN=")), None)
                now["ATTENDEE"].append((cn or re.sub(r"(?i)^mailto:", "", value)).strip('"'))
            elif field in ("UID", "SUMMARY", "LOCATION", "DTSTART", "DTEND"):
                now[field] = plain(value.strip())
    return out


def calendar_events(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, pos, uid, summary, location, starts, ends, attendees of each event; folded lines are joined, escapes undone."""
    return _exploded(df, key, text, _calendar, "pos int, uid string, summary string, location string, starts string, ends string, attendees array<string>")


def _mail(text: str | None) -> list[tuple]:
    from email import policy
    from email.parser import BytesParser

    if not text:
        return []
    m = BytesParser(policy=policy.default).parsebytes(text.encode("utf-8", "replace"))
    part = m.get_body(preferencelist=("plain", "html"))
    body = part.get_content() if part is not None else ""
    if part is not None and part.get_content_type() == "text/html":
        body = re.sub(r"<[^>]+>", " ", body)
    names = [a.get_filename() or "" for a in m.iter_attachments()]
    return [(m["from"], m["to"], m["subject"], m["date"], body.strip(), names)]


def mails(df: DataFrame, key: str, text: str) -> DataFrame:
    return _exploded(df, key, text, lambda v: [tuple(None if x is None else x if isinstance(x, list) else str(x) for x in r) for r in _mail(v)], "sender string, recipient string, subject string, sent string, body string, attachments array<string>")


def governance(blocks: DataFrame, key: str) -> DataFrame:
    """Coverage of each document's blocks (pos, text, source, confidence): provenance, confidence, mean confidence, state, order."""
    filled = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    return blocks.groupBy(key).agg(
        F.count("*").alias("n_blocks"),
        F.round(F.avg(F.col("source").isNotNull().cast("int")), 6).alias("provenance_coverage"),
        F.round(F.avg(F.col("confidence").isNotNull().cast("int")), 6).alias("confidence_coverage"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("mean_confidence"),
        F.when(F.max(filled), "content_ingested").when(F.count("*") > 0, "metadata_only").otherwise("referenced").alias("retrieval_state"),
        (F.countDistinct("pos") == F.count("*")).alias("order_ok"),
    )
