"""Held-out test items that occur in training documents.

The items' passages, without directions and options, form a generalised suffix automaton
over words. A document's words are streamed through it once, tracking the longest match
that ends at each word; where an item's own match of ``SEED`` words or more ends, it is laid
on the item's diagonal and carried on over a few exchanged words. Passages that agree in
``EXACT`` of their words have such a match somewhere, for at most every fifth word differs.
A document leaks an item when its runs together cover at least ``coverage`` of the passage.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
_OPTION = re.compile(r"^\s*\(?[A-Ea-e][.):]\s")
SEED, COVERAGE, EXACT, BLOCK_WORDS = 4, 0.5, 0.8, 400_000


def words(text: str | None) -> list[str]:
    """Lowered words; case, punctuation, spacing and line breaks don't count."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).replace("­", "").replace("​", "")
    return _WORD.findall(text.lower())


def stems(texts: list[str | None]) -> list[list[str]]:
    """Passage and question of each item: options go, and first lines that several items share are directions."""
    lines = [[x for x in (t or "").split("\n") if x.strip()] for t in texts]
    first = Counter(" ".join(words(x[0])) for x in lines if len(x) > 1)
    out = []
    for x in lines:
        body = [y for y in x if not _OPTION.match(y)] or x
        if len(body) > 1 and first[" ".join(words(body[0]))] >= 3:
            body = body[1:]
        out.append(words(" ".join(body)))
    return out


class Automaton:
    """Generalised suffix automaton over the items' words, with the places each state's words end at."""

    def __init__(self, items: list[list[str]]):
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for t in items for w in t))}
        self.items = [[self.ids[w] for w in t] for t in items]
        self.padded = [[-3] * _PAD + t + [-3] * _PAD for t in self.items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for i, t in enumerate(self.items):
            last = 0
            for k, c in enumerate(t):
                last = self._extend(last, c)
                self.ends[last].append((i, k))
        for v in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):
            up = self.link[v]
            if up > 0 and self.length[up] >= SEED:
                self.ends[up] += self.ends[v]
        self.ends = [sorted(set(e)) for e in self.ends]
        # the shortest suffix of SEED words or more has all places at which a match of that length may end
        self.top = list(range(len(self.next)))
        for v in sorted(range(1, len(self.next)), key=lambda v: self.length[v]):
            if self.link[v] > 0 and self.length[self.link[v]] >= SEED:
                self.top[v] = self.top[self.link[v]]
        self.after: dict[int, dict[int, list[tuple[int, int]]]] = {}

    def _new(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        cur = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return cur

    def _after(self, v: int) -> dict[int, list[tuple[int, int]]]:
        """The places of a match by the word that follows in the item, -2 at the item's end."""
        got = self.after.get(v)
        if got is None:
            got = self.after[v] = {}
            for i, at in self.ends[v]:
                got.setdefault(self.items[i][at + 1] if at + 1 < len(self.items[i]) else -2, []).append((i, at))
        return got

    def seeds(self, doc: list[int]) -> Iterator[tuple[int, int, int]]:
        """(item, its last word, end in the document) wherever an item's match of SEED words or more ends, though another item's goes on."""
        v, n, nxt, link, length, top = 0, 0, self.next, self.link, self.length, self.top
        for j, c in enumerate(doc):
            if n >= SEED:
                for follows, places in self._after(top[v]).items():
                    if follows != c:
                        for i, at in places:
                            yield i, at, j
            if c < 0:
                v = n = 0
                continue
            to = nxt[v].get(c)
            if to is None:
                while v and c not in nxt[v]:
                    v = link[v]
                    n = length[v]
                to = nxt[v].get(c)
                if to is None:
                    n = 0
                    continue
            v, n = to, n + 1
        if n >= SEED:
            for places in self._after(top[v]).values():
                for i, at in places:
                    yield i, at, len(doc)

    def leaks(self, doc_words: list[str]) -> dict[int, tuple[float, list[tuple[int, int]]]]:
        """Item number -> (share of the passage that its runs cover together, their spans of document words)."""
        doc = list(map(self.ids.get, doc_words, [-1] * len(doc_words)))
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        active: dict[int, list[tuple[int, int, int, int]]] = {}  # the runs that go on past the place reached
        padded: list[int] = []
        for item, at, end in self.seeds(doc):
            t0, d0 = at + 1 - SEED, end - SEED
            live = active[item] = [r for r in active.get(item, ()) if r[3] > d0]
            if any(a <= t0 and at < b and abs((c - a) - (d0 - t0)) <= 8 and c <= d0 for a, b, c, _ in live):
                continue  # within a run that was found already
            padded = padded or [-4] * _PAD + doc + [-4] * _PAD
            run = _carry(self.padded[item], padded, t0, at + 1, d0, end)
            live.append(run)
            runs.setdefault(item, []).append(run)
        out = {}
        for item, found in runs.items():
            # runs as short as a seed are common phrases
            whole = [r for r in _joined(found) if r[1] - r[0] > SEED and _alike(self.items[item][r[0] : r[1]], doc[r[2] : r[3]])]
            if whole:
                out[item] = _covered(whole) / max(len(self.items[item]), 1), sorted({(c, d) for _, _, c, d in whole})
        return out


_PAD = 3


def _reach(t: list[int], d: list[int], i: int, j: int, s: int) -> tuple[int, int]:
    """How far a run goes on from (i, j) over exchanged, added or dropped words: past the last place where it still matched.

    Both lists are padded by _PAD words that equal nothing, so looking ahead needs no bounds.
    """
    best_i, best_j, score, best = i, j, 0.0, 0.0
    n, m = len(t) - _PAD, len(d) - _PAD
    while _PAD <= i < n and _PAD <= j < m:
        if t[i] == d[j]:
            score += 1.0
            i, j = i + s, j + s
            if score >= best:
                best, best_i, best_j = score, i, j
            continue
        score -= 1.3
        if score <= best - 4.0:
            break
        a, b, c, e = t[i + s], d[j + s], t[i + 2 * s], d[j + 2 * s]
        if a == b and c == e:
            i, j = i + s, j + s
        elif t[i] == b and a == e:
            j += s
        elif a == d[j] and c == b:
            i += s
        elif t[i] == e and a == d[j + 3 * s]:
            j += 2 * s
        else:
            i, j = i + s, j + s
    return best_i, best_j


def _carry(t: list[int], d: list[int], t0: int, t1: int, d0: int, d1: int) -> tuple[int, int, int, int]:
    """(first and past word in the item, in the document) of the run that a match belongs to; ``t`` and ``d`` are padded."""
    right_t, right_d = _reach(t, d, t1 + _PAD, d1 + _PAD, 1)
    left_t, left_d = _reach(t, d, t0 - 1 + _PAD, d0 - 1 + _PAD, -1)
    return left_t + 1 - _PAD, right_t - _PAD, left_d + 1 - _PAD, right_d - _PAD


def _alike(t: list[int], d: list[int]) -> bool:
    """A few words may be exchanged; runs that agree in their common phrases only are no passage."""
    return sum((Counter(t) & Counter(d)).values()) >= EXACT * max(len(t), 1)


def _joined(runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Runs that follow one another closely in item and document are one run."""
    out: list[tuple[int, int, int, int]] = []
    for a, b, c, d in sorted(set(runs), key=lambda r: (r[2], r[0])):
        if out:
            p, q, r, s = out[-1]
            if abs((c - a) - (r - p)) <= 4 and c - s <= 6 and a - q <= 6 and b >= q:
                out[-1] = (min(p, a), b, min(r, c), max(s, d))
                continue
        out.append((a, b, c, d))
    return out


def _covered(runs: list[tuple[int, int, int, int]]) -> int:
    """How many words of the item the runs cover together."""
    total = last = 0
    for a, b, _, _ in sorted(runs):
        total += max(0, b - max(a, last))
        last = max(last, b)
    return total


_BUILT: dict[int, tuple[list, Automaton]] = {}


def _automaton(items: list[list[str]]) -> Automaton:
    key = hash(tuple(map(tuple, items)))
    got = _BUILT.get(key)
    if got is None or got[0] != items:
        _BUILT.clear()
        _BUILT[key] = got = (items, Automaton(items))
    return got[1]


def find_leaks(docs: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, item_text: str, coverage: float = COVERAGE) -> DataFrame:
    """(item, document, share, spans) of every document that contains at least ``coverage`` of an item's passage.

    Spans are of document words, all runs of the item with more than SEED words. The items are the stated query set; they are worked in
    blocks of at most BLOCK_WORDS words, one automaton each, so what a worker holds is
    bounded. Null and empty documents or items leak nothing; every copy of a document and
    every item with the same passage is reported; documents are read whole.
    """
    asked = [(r[0], r[1]) for r in items.select(item_key, item_text).orderBy(item_key).toLocalIterator() if r[0] is not None]
    passages = stems([t for _, t in asked])
    blocks: list[list[tuple]] = [[]]
    size = 0
    for (key, _), p in zip(asked, passages):
        if len(p) < SEED:
            continue
        if size and size + len(p) > BLOCK_WORDS:
            blocks.append([])
            size = 0
        blocks[-1].append((key, p))
        size += len(p)
    kinds = dict(items.dtypes)[item_key], dict(docs.dtypes)[doc_key]
    schema = f"item {kinds[0]}, doc {kinds[1]}, share double, spans array<struct<first:int,past:int>>"
    out = None
    for block in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(block)  # at most BLOCK_WORDS words

        def stream(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            keys = [k for k, _ in shared.value]
            automaton = _automaton([p for _, p in shared.value])
            for pdf in batches:
                rows = []
                for k, t in zip(pdf["k"], pdf["t"]):
                    found = automaton.leaks(words(t))
                    rows += [(keys[i], k, round(share, 6), [{"first": a, "past": b} for a, b in spans]) for i, (share, spans) in found.items() if share >= coverage]
                yield pd.DataFrame(rows, columns=["item", "doc", "share", "spans"])

        got = docs.select(F.col(doc_key).alias("k"), F.col(text).alias("t")).where("t is not null").mapInPandas(stream, schema)
        out = got if out is None else out.unionByName(got)
    return out.select(F.col("item").alias(item_key), F.col("doc").alias(doc_key), "share", "spans")


_SPAN_WORD = re.compile(r"[^\W_]+")


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the given spans of words."""
    if not text or not spans:
        return text
    at = [m.span() for m in _SPAN_WORD.finditer(text)]
    out, last = [], 0
    for a, b in sorted(spans):
        if a >= len(at):
            break
        start, end = at[a][0], at[min(b, len(at)) - 1][1]
        if start >= last:
            out.append(text[last:start])
        last = max(last, end)
    out.append(text[last:])
    return "".join(out)


def without_leaks(docs: DataFrame, doc_key: str, text: str, leaks: DataFrame) -> DataFrame:
    """``doc_key``, the cleaned text and the number of removed spans of each document that leaks."""
    spans = leaks.groupBy(doc_key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    kind = dict(docs.dtypes)[doc_key]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [cut_spans(t, [(s["first"], s["past"]) for s in x]) for t, x in zip(pdf["t"], pdf["spans"])]
            yield pd.DataFrame({"k": pdf["k"], "clean": done, "n_spans": [len(x) for x in pdf["spans"]]})

    work = docs.select(F.col(doc_key), F.col(text).alias("t")).join(spans, doc_key).select(F.col(doc_key).alias("k"), "t", "spans")
    return work.mapInPandas(cut, f"k {kind}, clean string, n_spans int").withColumnRenamed("k", doc_key)
