"""Texts that lost their end, and how often each source cuts.

A text's end is read by a stack automaton over quotes, brackets, markup and escapes first,
then by its marks of continuation, by the length limit its source shows, and, where it
merely has no closing punctuation, by how often the corpus ends a text or sentence after the
same words, held against how often the source leaves whole texts without terminator. Only
the contexts that open ends ask for are counted, exactly and over all rows; a bitmap of
fixed size keeps most others out of the shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .residue import Index

# Marks that a publishing system sets where it cuts a text.
MARK = re.compile(
    r"(?:\.\.\.|…|&hellip;|&#8230;|&#x2026;|\[\s*(?:\.{3}|…|&#8230;|&hellip;|more|más)\s*\]|\((?:more|continued|sigue)\))\s*"
    r"(?:(?:read|see|view)\s+more|(?:continue|keep)\s+reading|leer\s+más|seguir\s+leyendo|continuar\s+leyendo|more)?\s*(?:[»>→]|&raquo;)*\s*(?:</\w+>\s*)*$"
    r"|(?:[^.!?\s]\s+)(?:read\s+more|continue\s+reading|leer\s+más|seguir\s+leyendo|continuar\s+leyendo)\s*[»>→]*\s*(?:</\w+>\s*)*$",
    re.I,
)
MARK_SIGNS = ("...", "…", "&", "more", "más", "leyendo", "reading", "continue", "sigue")  # one of them is in any mark, lowered
CLOSED = re.compile(r"(?:[.!?][\"'”’»)\]]*|[”»)\]])\s*(?:</\w+>\s*)*$")
BROKEN = re.compile(r"&(?:#x?[0-9a-fA-F]*|[a-zA-Z]{0,7})$|%[0-9A-F]?$|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?$|[�\ud800-\udfff]$|[ÃÂ]$|â(?:€)?$")
LABEL = re.compile(r"(?:^|[.!?”)]\s+)[A-ZÁÉÍÓÚ][\w áéíóúñ]{1,24}:\s[^.!?]{1,90}$")
_TOKENS = re.compile(r"[()\[\]“”«»]|<[^<>]*>?")
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^<>]*?(/?)>")
_PAIRED = set("p a b i u em strong span div ul ol li h1 h2 h3 h4 h5 h6 blockquote table tr td th small sup sub code pre section article".split())
_OPEN = {")": "(", "]": "[", "”": "“", "»": "«"}
# Month and weekday names, which stand for one another in the counts.
_MONTH = set("january february march april may june july august september october november december enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split())
_DAY = set("monday tuesday wednesday thursday friday saturday sunday lunes martes miércoles jueves viernes sábado domingo".split())
_EDGE = "\"'“”‘’()[]«»,;:.!?"
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def unclosed(text: str) -> str | None:
    """What the stack automaton finds open at the end of a text, or None.

    Closers without opener are let pass; an opener counts while the sentence it stands in
    hasn't ended, markup counts to the end of the text.
    """
    if BROKEN.search(text):
        return "escape"
    stack: list[tuple[str, int]] = []
    for m in _TOKENS.finditer(text):
        t = m.group()
        if t[0] == "<":
            tag = _TAG.fullmatch(t)
            if tag is None:
                if m.end() == len(text) and re.match(r"<[a-zA-Z/!]|<$", t):
                    return "markup"
                continue
            name = tag.group(2).lower()
            if tag.group(3) or name not in _PAIRED:
                continue
            if not tag.group(1):
                stack.append((f"<{name}", m.start()))
            else:
                while stack and any(x == f"<{name}" for x, _ in stack):
                    if stack.pop()[0] == f"<{name}":
                        break
        elif t in _OPEN:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == _OPEN[t]:
                    del stack[i:]
                    break
        else:
            stack.append((t, m.start()))
    for what, at in reversed(stack):
        if what[0] == "<":
            return "markup"
        if not re.search(r"[.!?]\s+[A-ZÁÉÍÓÚ¿¡“]", text[at:]):
            return "quote" if what in "“«" else "bracket"
    return None


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big") | 1


class _Coder(dict):
    """Blank-separated word -> (own code, class code, ends a sentence, starts upper case)."""

    def __missing__(self, word: str) -> tuple[int, int, bool, bool]:
        bare = word.strip(_EDGE)
        lowered = bare.lower()
        if "://" in bare or bare.startswith("www."):
            own, kind = re.sub(r"\d", "0", lowered), "\x01url"
        elif any(map(str.isdigit, bare)):
            own, kind = re.sub(r"\d", "0", lowered), re.sub(r"\d+", "0", lowered)
        elif lowered in _MONTH:
            own = kind = "\x01month"
        elif lowered in _DAY:
            own = kind = "\x01day"
        else:
            own, kind = lowered, "\x01name" if bare[:1].isupper() else lowered
        if word.endswith(":"):
            own, kind = own + ":", kind + ":"
        ends = bool(re.search(r"[.!?][\"'”’»)\]]*$", word)) or word.endswith(("”", ")"))
        got = (_hash(own), _hash(kind), ends, word[:1].isupper() or word[:1] in "“(¿¡")
        if len(self) > 300_000:
            self.clear()
        self[word] = got
        return got


def _keys(own, before, before2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of 64 bits of the contexts of one, two and three words that end here."""
    own, kind1, kind2 = (np.asarray(x, dtype=np.uint64) for x in (own, before, before2))
    with np.errstate(over="ignore"):
        one = own * _P
        two = (one ^ (kind1 * _Q)) * _P
        three = (two ^ (kind2 * _P)) * _Q + np.uint64(7)
    # multiplying leaves the low bits alike; the high ones are folded down
    return tuple((x ^ (x >> np.uint64(31))).view(np.int64) for x in (one, two, three))


def _contexts(texts: list[str], coder: _Coder, cut: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, stands before a sentence's end, stands at a text's open end) of all contexts of the texts.

    Of texts that are known to be ``cut`` the last word is left out, for it may be part of one, and their end is no end.
    """
    own, kind, end, last = [0, 0], [0, 0], [False, False], [False, False]
    for n, text in enumerate(texts):
        words = text.split()
        lost = cut is not None and cut[n]
        if lost:
            words = words[:-1]
        if not words:
            continue
        got = [coder[w] for w in words]
        o, k, e, u = zip(*got)
        own += (0, 0, *o)
        kind += (0, 0, *k)
        end += (False, False, *[a and b for a, b in zip(e, (*u[1:], not lost))])
        last += [False] * (len(words) + 1)
        last.append(not e[-1] and not lost)
    own, kind, end, last = np.array(own, np.uint64), np.array(kind, np.uint64), np.array(end), np.array(last)
    real = own[2:] != 0
    keys = np.concatenate([x[real] for x in _keys(own[2:], kind[1:-1], kind[:-2])])
    return keys, np.tile(end[2:][real], 3), np.tile(last[2:][real], 3)


def _counted(keys: np.ndarray, ends: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, n, n_end, n_open), each key once."""
    own, at = np.unique(keys, return_inverse=True)
    return own, *(np.bincount(at, w, len(own)).astype(np.int64) for w in (None, ends.astype(float), opens.astype(float)))


def _size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "replace"))


def length_limits(work: DataFrame) -> DataFrame:
    """(source, char_limit, byte_limit) from the lengths at which a source's open ends pile up, and ``open_share``, how
    often its texts off those lengths have no terminator; ``work`` has source and t."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths: Counter = Counter()
        most: dict = {}
        texts: Counter = Counter()
        for pdf in batches:
            for s, t in zip(pdf["source"], pdf["t"]):
                if not t or not t.strip():
                    continue
                chars, size = len(t), _size(t)
                was = most.get(s, (0, 0))
                most[s] = (max(was[0], chars), max(was[1], size))
                texts[s] += 1
                if not CLOSED.search(t[-60:]):
                    lengths[s, 0, chars] += 1
                    lengths[s, 1, size] += 1
        rows = [(u, s, n, c) for (s, u, n), c in lengths.items()] + [(u, s, m[u], 0) for s, m in most.items() for u in (0, 1)] + [(2, s, 0, n) for s, n in texts.items()]
        yield pd.DataFrame(rows, columns=["kind", "source", "a", "n"])

    got = work.mapInPandas(count, "kind int, source string, a bigint, n bigint").groupBy("kind", "source", "a").agg(F.sum("n").alias("n"))
    told = written(got, "p5-lengths")
    lengths = told.where("kind < 2")
    longest = lengths.groupBy("kind", "source").agg(F.max("a").alias("longest"))
    spikes = lengths.join(longest, ["kind", "source"]).where("a >= longest - if(kind = 1, 3, 0) and n > 0")
    # lengths at which several sources stop are limits of the publishing system, also for a source seen cut once
    common = spikes.groupBy("kind", "a").agg(F.count("*").alias("sources"), F.sum("n").alias("cuts"))
    limits = (
        spikes.join(common, ["kind", "a"])
        .where("n >= 3 or (sources >= 3 and cuts >= 6)")
        .groupBy("source")
        .agg(*[F.max(F.when(F.col("kind") == k, F.struct("a", "n"))).alias(u) for k, u in ((0, "c"), (1, "b"))])
    )
    # a limit is in characters or in bytes; the unit in which more texts stop exactly there is the source's
    limits = limits.select(
        "source",
        F.when(F.col("b.a").isNull() | (F.col("b.a") == F.col("c.a")) | (F.col("c.n") >= F.col("b.n")), F.col("c.a")).alias("char_limit"),
        F.when(F.col("c.a").isNull() | (F.col("b.a") == F.col("c.a")) | (F.col("b.n") > F.col("c.n")), F.col("b.a")).alias("byte_limit"),
    )
    ends = told.where("kind <> 1").join(limits.select("source", "char_limit"), "source", "left").groupBy("source")
    ends = ends.agg(F.sum(F.when(F.col("kind") == 2, F.col("n")).otherwise(0)).alias("texts"), F.sum(F.when((F.col("kind") == 0) & (F.col("a") != F.coalesce("char_limit", F.lit(-1))), F.col("n")).otherwise(0)).alias("open"))
    # few texts tell nothing about a source: its share is then taken for the usual one
    share = F.when(F.col("texts") >= BASELINE_TEXTS, F.col("open") / F.col("texts"))
    return ends.select("source", share.alias("open_share")).join(limits, "source", "left")


def _limits(pdf: pd.DataFrame) -> tuple[list, list]:
    return tuple([None if x != x else int(x) for x in pdf[n].astype(float)] for n in ("char_limit", "byte_limit"))


BITS = 1 << 25


def _asked_bits(ends: DataFrame) -> np.ndarray:
    """A bitmap of BITS places (4 MB, whatever the corpus holds) in which the contexts that open ends ask for are set."""
    place = ends.select(F.explode(F.array("one", "two", "three")).alias("key")).select((F.pmod("key", F.lit(BITS)) + 1).alias("p"))
    parts = place.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(BITS, bool)
    for r in parts.toLocalIterator():
        bits = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little").astype(bool)
        start = (r["bucket"] - 1) * len(bits)
        out[start : start + len(bits)] = bits[: max(0, BITS - start)]
    return np.packbits(out, bitorder="little")


def context_counts(work: DataFrame, bits: np.ndarray) -> DataFrame:
    """(key, n, n_end, n_open) of the asked contexts over all rows, and the number of texts under a null key.

    Counts are exact; a context that shares its place in the bitmap with an asked one is
    counted in vain. Texts cut by a limit or with a mark don't count as ends.
    """
    shared = work.sparkSession.sparkContext.broadcast(bits)  # BITS / 8 bytes

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, asked, n = _Coder(), np.unpackbits(shared.value, bitorder="little").astype(bool), 0
        for pdf in batches:
            texts, cut = [], []
            for t, c, b in zip(pdf["t"], *_limits(pdf)):
                if t and t.strip():
                    texts.append(t)
                    cut.append(_known_cut(t, c, b) is not None)
            n += len(texts)
            keys, ends, opens = _contexts(texts, coder, cut)
            mine = asked[keys & (BITS - 1)]
            yield pd.DataFrame(dict(zip(("key", "n", "n_end", "n_open"), _counted(keys[mine], ends[mine], opens[mine]))))
        yield pd.DataFrame({"key": pd.array([None], "Int64"), "n": [n], "n_end": [0], "n_open": [0]})

    got = work.mapInPandas(count, "key bigint, n bigint, n_end bigint, n_open bigint")
    return written(got.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", "n_end", "n_open")]), "p5-counts")


def _known_cut(text: str, char_limit: int | None, byte_limit: int | None) -> str | None:
    """'mark' or 'limit' where a text shows by itself or by its source's limit that it was cut."""
    bare = text.rstrip()
    while bare.endswith(">") and (tag := _END_TAG.search(bare)):
        bare = bare[: tag.start()].rstrip()
    if not bare:
        return None
    end = bare[-60:]
    low = end.lower()
    if any(x in low for x in MARK_SIGNS) and MARK.search(end):
        return "mark"
    chars, size = len(text), _size(text)
    if chars == char_limit or size == byte_limit:
        return "limit"
    if not CLOSED.search(bare[-40:]):
        if char_limit is not None and chars == char_limit - 1:
            return "limit"
        if byte_limit is not None and size != chars and byte_limit - 3 <= size < byte_limit:
            return "limit"
    return None


OPEN_SHARE = 2e-5
BASELINE_TEXTS, STRICT_UNDER, MILD_OVER = 50, 0.02, 0.25  # texts a source must have; shares of open ends under and over which it is unusual


def _measure(open_share: float | None) -> float:
    """How strong the sign of whole texts must be: stronger in a source that closes nearly all its texts, weaker in one that often doesn't."""
    if open_share is None or open_share != open_share:
        return 1.0
    return 1.5 if open_share <= STRICT_UNDER else 0.6 if open_share >= MILD_OVER else 1.0


def _context(text: str, coder: _Coder) -> tuple[int, int, int]:
    """Keys of the contexts of one, two and three words that a text ends with."""
    got = [coder[w] for w in text.split()[-3:]]
    kinds = [0, 0, *[g[1] for g in got[:-1]]]
    return tuple(int(x[0]) for x in _keys([got[-1][0]], [kinds[-1]], [kinds[-2]]))


def _whole(one, two, three, label: bool, n_texts: int = 0, open_share: float | None = None) -> bool:
    """Whether a text without closing punctuation still ends where the corpus ends texts or sentences.

    ``one``, ``two`` and ``three`` are (n, n_end, n_open) of the contexts it ends with. An
    open end counts when a fair share of all texts ends so: parts of words, which only cuts
    leave, grow in number with the corpus, but not in share.
    """
    often = max(3, OPEN_SHARE * n_texts)
    n, n_end, n_open = one
    if n - n_open < often and n_open < often:
        return False
    measure = _measure(open_share)
    for (m, m_end, m_open), share, least in ((three, 0.02 * measure, 4), (two, 0.04 * measure, 6)):
        if m >= least:
            return m_end >= share * m or (m_open >= often and m_open >= 0.02 * m) or label
    return n_end >= 0.06 * measure * n or label


def judge_end(text: str | None, char_limit, byte_limit, residue: Index | None = None) -> tuple[str | None, str]:
    """(why a text counts as cut by itself, '') or (None, its open end to be held against the corpus, '' if it is whole)."""
    if not text or not text.strip():
        return None, ""
    what = unclosed(text.rstrip()) if _PLAIN.search(text) else None
    what = what or _known_cut(text, char_limit, byte_limit)
    if what:
        return what, ""
    bare = text.rstrip()
    while bare.endswith(">") and (tag := _END_TAG.search(bare)):
        bare = bare[: tag.start()].rstrip()
    if not bare or CLOSED.search(bare[-40:]):
        return None, ""
    # the rest of a publishing system's message is complete as it stands
    sentence = re.split(r"(?<=[.!?])\s+", bare)[-1]
    whole = residue is not None and (residue.match(sentence.split(": ")[-1]) or ": " in sentence and residue.match(sentence))
    return None, "" if whole else bare


_END_TAG = re.compile(r"</\w+\s*>$")
_PLAIN = re.compile(r"[(\[“«<&%\\�\ud800-\udfffÃÂâ]")


def find_truncated(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``key``, source and reason of every text that lost its end.

    Null, empty and blank texts give no row; a null source is a source of its own;
    repeated rows are each judged; texts are read whole; extra columns are ignored.
    """
    work = df.select(F.col(key).alias("k"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    limits = written(length_limits(work.select("source", "t")), "p5-limits")
    work = work.join(limits, "source", "left")
    kind = dict(df.dtypes)[key]

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, messages = _Coder(), Index()
        for pdf in batches:
            rows = []
            for k, s, t, c, b, o in zip(pdf["k"], pdf["source"], pdf["t"], *_limits(pdf), pdf["open_share"]):
                why, end = judge_end(t, c, b, messages)
                if why:
                    rows.append((k, s, why, 0, 0, 0, False, None))
                elif end:
                    rows.append((k, s, None, *_context(end, coder), bool(LABEL.search(end)), o))
            yield pd.DataFrame(rows, columns=["k", "source", "reason", "one", "two", "three", "label", "open_share"])

    ends = work.mapInPandas(look, f"k {kind}, source string, reason string, one bigint, two bigint, three bigint, label boolean, open_share double")
    ends = written(ends.withColumn("no", F.monotonically_increasing_id()), "p5-ends")
    open_ends = ends.where("reason is null")
    counts = context_counts(work.select("t", "char_limit", "byte_limit"), _asked_bits(open_ends))
    n_texts = counts.where("key is null").agg(F.sum("n")).first()[0] or 0
    asked = open_ends.select("no", F.posexplode(F.array("one", "two", "three")).alias("at", "key")).join(counts, "key", "left")
    held = asked.groupBy("no").agg(*[F.coalesce(F.max(F.when(F.col("at") == i, F.col(c))), F.lit(0)).alias(f"{c}{i}") for i in range(3) for c in ("n", "n_end", "n_open")])
    held = open_ends.select("no", "k", "source", "label", "open_share").join(held, "no")

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            contexts = [list(zip(*(pdf[f"{c}{i}"] for c in ("n", "n_end", "n_open")))) for i in range(3)]
            cut = [not _whole(a, b, c, lab, n_texts, o) for a, b, c, lab, o in zip(*contexts, pdf["label"], pdf["open_share"])]
            yield pdf[["k", "source"]][np.array(cut, bool)].assign(reason="unfinished")

    found = ends.where("reason is not null").select("k", "source", "reason").unionByName(held.mapInPandas(decide, f"k {kind}, source string, reason string"))
    return found.select(F.col("k").alias(key), "source", "reason")
