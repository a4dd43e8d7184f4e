"""Texts: snippets, lines of markup, readability, same site."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.web import domain

SNIPPET = 200
_BLOCKS = "p|div|li|tr|h[1-6]|br|section|article|table|ul|ol|blockquote"


def squeeze(text: Column) -> Column:
    """Single blanks, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def snippet(text: Column, most: int = SNIPPET) -> Column:
    """A text of at most ``most`` characters: longer ones lose their end and get three dots; null gives ''."""
    flat = squeeze(F.coalesce(text, F.lit("")))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat)


def html_lines(html: Column) -> Column:
    """Lines of a page: block tags end a line, other tags vanish, blank lines drop out."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), rf"(?i)</?(?:{_BLOCKS})\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    return F.filter(F.transform(F.split(text, r"\n"), squeeze), lambda x: x != "")


def syllables(word: Column) -> Column:
    """Groups of vowels of a lowered word, a silent closing e not counted; at least one."""
    groups = F.regexp_count(F.regexp_replace(word, r"e$", ""), F.lit("[aeiouy]+"))
    return F.greatest(groups, F.lit(1))


def readability(text: Column) -> Column:
    """(words, sentences, syllables, grade): Flesch-Kincaid grade with heuristic syllables; null grade where a text has no word."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    n = F.size(words).cast("bigint")
    sentences = F.greatest(F.regexp_count(text, F.lit(r"[.!?]+")), F.lit(1)).cast("bigint")
    total = F.aggregate(words, F.lit(0), lambda s, w: s + syllables(w)).cast("bigint")
    grade = F.when(n > 0, F.round(0.39 * n / sentences + 11.8 * total / n - 15.59, 2))
    return F.struct(n.alias("words"), sentences.alias("sentences"), total.alias("syllables"), grade.alias("grade"))


def same_site(a: Column, b: Column) -> Column:
    """Whether two addresses share their registrable domain; an address without host shares none."""
    return F.coalesce(domain(a) == domain(b), F.lit(False))
