"""Text of scanned pages repaired into continuous paragraphs.

Page frames are found by fuzzy repetition of lines at the edges of a scan's pages, by
page-number sequences, and, for scans too short to repeat themselves, by lines that the
corpus has at page edges only. Lines are then joined: a word broken at a line's end is
closed when the corpus knows the closed word rather than the compound. Characters are
taken for misread where a rare word is one confusion away from a word that is far more
frequent, or where signs stand inside words.

Frequent words go to every worker; the rarer ones that a block of pages may ask for come to
it by a join, so what counts as known is the same whatever the corpus holds.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

EDGE_LINES, BLOCK_PAGES, OVERLAP = 4, 64, 8
KNOWN, MEANT, WORD_SHARE, LINE_SHARE = 3, 20, 1e-4, 1e-3  # a word counts as known from KNOWN occurrences on
_HYPHEN = re.compile(r"([^\W\d_][\w'’@^~|]*)([-‐‑­¬])\s*$")
_MARKS = "-‐‑­¬"
LINE_MOST, WORD_MOST = 300, 40
_FIRST_WORD = re.compile(r"^\s*[\"“(]?([^\W\d_][^\s,.;:!?\"”)]*)")
_ROMAN = re.compile(r"^(?=[ivxlc])(?:x[cl]|l?x{0,8})(?:i[xv]|v?i{0,4})$")
_EDGE = "\"“”‘’'(),;:.!?[]"
_NUMBERISH = re.compile(r"^[$€#]?\d[\d,.:/%–-]*(?:st|nd|rd|th|s)?[%]?$|^\d{3}-\d{4}$")
_LIGATURE = re.compile("[ﬀ-ﬆ]")
# Signs and letter groups that scanners take for one another.
_CONFUSED = [("rn", "m"), ("ri", "n"), ("cl", "d"), ("vv", "w"), ("li", "h"), ("ii", "u"), ("nn", "rm"), ("in", "m"), ("fi", "h"), ("lc", "k"), ("iii", "m"), ("tl", "d"), ("ol", "d"), ("c1", "d")]
_FOLD = str.maketrans({"0": "o", "1": "l", "|": "l", "i": "l", "!": "l", "5": "s", "$": "s", "@": "a", "8": "b", "6": "b", "9": "g", "c": "e", "€": "e"})
# Letters that a digit or sign inside a word was printed as; other signs may stand for any letter or for none.
_PRINTED = {"0": "o", "1": "li", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "gq", "!": "il", "@": "a", "$": "s", "€": "ec"}
_LETTERS = re.compile(r"[^\W\d_]+(?:['’.][^\W\d_]+)*")


def _ends_broken(line: str):
    """Match of a line's last word and the mark that breaks it, or None; lines without mark aren't searched."""
    return _HYPHEN.search(line) if line.rstrip()[-1:] in _MARKS and line.strip() else None


def fold(line: str) -> str:
    """A line's letters with look-alikes made one, for fuzzy comparison."""
    text = " ".join(line.strip()[:LINE_MOST].lower().split()).replace("rn", "m").replace("ri", "n").replace("vv", "w").replace("cl", "d")
    return text.translate(_FOLD)


def _roman(text: str) -> int | None:
    if not text or not _ROMAN.match(text):
        return None
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    total = 0
    for a, b in zip(text, text[1:] + " "):
        total += -value[a] if value.get(b, 0) > value[a] else value[a]
    return total or None


_NUMBER_LINE = re.compile(
    r"^[\[(<{|~–—\-=•*\s]*(?:(?:page|pg?\.?|pág\.?|página|seite|s\.)\s*)?([0-9OolI|SZB]{1,4}|[ivxlc]{1,7})(?:\s*(?:of|/|de|von)\s*[0-9OolI|SZB]{1,4})?[\])>}|~–—\-=•*.\s]*$",
    re.I,
)
_NUMBER_TAIL = re.compile(r"(?:\s{2,}|\s[|·•–—-]\s|\t|\|)\s*[\[(~–—-]*\s*(?:p\.\s*|page\s+)?([0-9OolI|SZB]{1,4}|[ivxlc]{1,7})(?:\s+of\s+\d{1,4})?\s*[\])~–—.-]*\s*$", re.I)
_NUMBER_HEAD = re.compile(r"^\s*[\[(~–—-]*\s*(?:p\.\s*|page\s+)?([0-9OolI|SZB]{1,4})\s*[\])~–—.-]*(?:\s{2,}|\s[|·•–—-]\s|\t|\|)", re.I)
_NUMBER_CHARS = set("0123456789ivxlcIVXLC")
_DIGIT = str.maketrans("OolI|SZB", "00111528")


def _value(text: str) -> int | None:
    if text.isdigit():
        return int(text)
    if any(c.isdigit() for c in text):
        t = text.translate(_DIGIT)
        return int(t) if t.isdigit() else None
    return _roman(text.lower())


def page_number(line: str) -> tuple[int, str] | None:
    """(number, 'alone' or 'with text') of a line that carries a page number, or None."""
    if len(line) > LINE_MOST:
        return None
    if not _NUMBER_CHARS.intersection(line):
        return None
    m = _NUMBER_LINE.match(line)
    if m and (v := _value(m.group(1))) is not None:
        return v, "alone"
    for form in (_NUMBER_TAIL, _NUMBER_HEAD):
        m = form.search(line)
        if m and (v := _value(m.group(1))) is not None:
            return v, "with text"
    return None


_MAY_NUMBER = set("0123456789OolI|SZBivxlcIVXLC])~–—.-")
_DIGITS = re.compile(r"\d+")


_HEAD_NUMBER = set("0123456789OolI|SZBpP[(~–—-")


def _bare(line: str) -> str:
    """A line without the page number it may carry at its start or end."""
    if line.lstrip()[:1] in _HEAD_NUMBER:
        line = _NUMBER_HEAD.sub("", line)
    return _NUMBER_TAIL.sub("", line) if line.rstrip()[-1:] in _MAY_NUMBER else line


def skeleton(line: str) -> str:
    """A line with numbers masked, without the page number it may carry, for comparison over all scans."""
    text = line.strip()[:LINE_MOST]
    if text[-1:] in _MAY_NUMBER:
        text = _NUMBER_TAIL.sub("", text)
    return _DIGITS.sub("#", " ".join(text.split())).lower()


CAPITALS = "\x00capitals"


def _capitals(line: str) -> bool:
    """A line of capital letters only, but for the page number it may carry."""
    if len(line) > LINE_MOST:
        return False
    text = _NUMBER_HEAD.sub("", _NUMBER_TAIL.sub("", line.strip()))
    return len(text) >= 8 and text.isupper() and sum(c.isalpha() or c == " " for c in text) >= 0.85 * len(text)


def edges(lines: list[str]) -> tuple[list[int], list[int]]:
    """Numbers of the first and last lines that aren't blank."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    top = full[: min(EDGE_LINES, (len(full) + 1) // 2)]
    return top, [i for i in full[-EDGE_LINES:] if i not in top]


# Letters, digits and signs that shapes don't tell apart.
_SHAPE = str.maketrans({**dict.fromkeys("1li!|", "l"), **dict.fromkeys("0o", "o"), **dict.fromkeys("2z", "z"), **dict.fromkeys("3ec€", "e"), **dict.fromkeys("4a@", "a"), **dict.fromkeys("5s$", "s"), **dict.fromkeys("6b8g9q", "b"), **dict.fromkeys("7t", "t")})
_SIGNS = re.compile(r"[^\w'’.&+#:,;%=\x00-]|_")


def _holes(word: str) -> list[str]:
    """A word with each of its letters left open."""
    return [word[:i] + "\x00" + word[i + 1 :] for i in range(len(word))]


def _swaps(word: str) -> list[str]:
    """What a word may have been printed as by one confusion of letter groups."""
    out = []
    for a, b in _CONFUSED:
        for x, y in ((a, b), (b, a)):
            at = word.find(x)
            while at >= 0:
                out.append(word[:at] + y + word[at + len(x) :])
                at = word.find(x, at + 1)
    return out


def _shapes(form: str) -> list[str]:
    """Keys under which a form with digits or signs meets the words it may be; one sign may stand for any letter or none."""
    out = []
    for text in dict.fromkeys((form, form.replace("c1", "d"))):
        shape = text.translate(_SHAPE)
        signs = [m.start() for m in _SIGNS.finditer(shape)]
        if not signs:
            out.append(shape)
        for i in signs if len(signs) == 1 else ():
            out += [shape[:i] + "\x00" + shape[i + 1 :], shape[:i] + shape[i + 1 :]]
    return ["~" + x for x in out]


class Vocabulary:
    """What the corpus knows: words and compounds with counts, and lines met at page edges only.

    ``scale`` is how much larger the corpus is than one in which a word must come KNOWN
    times to reach WORD_SHARE; it only raises the counts from which a form is taken for
    too frequent to be misread. ``add`` lays the rarer words of one block over the others.
    """

    def __init__(self, words: dict[str, int], frames: frozenset[str], scale: float = 1.0):
        self.words, self.frames, self.scale = words, frames, scale
        self.patterns = self._patterns(words)
        self.by_length = self._by_length(words)
        self.frame_tails = {f for f in frames if f.count(" ") >= 1 and len(f) >= 8 and "#" not in f}
        self.rare: dict[str, int] = {}
        self.rare_patterns: dict[str, list[tuple[str, int]]] = {}
        self.rare_by_length: dict[int, list[tuple[int, str]]] = {}
        self._forget()

    def _forget(self) -> None:
        self.checked: dict[str, str | None] = {}
        self.undone: dict[str, str | None] = {}
        self.judged = _Judged(self)

    @staticmethod
    def _patterns(words: dict[str, int]) -> dict[str, list[tuple[str, int]]]:
        out: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for w, n in words.items():
            if len(w) >= 3 and n >= MEANT and "-" not in w:
                for hole in _holes(w):
                    out[hole].append((w, n))
        return out

    @staticmethod
    def _by_length(words: dict[str, int]) -> dict[int, list[tuple[int, str]]]:
        out: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for w, n in words.items():
            if n >= 4 * KNOWN and _LETTERS.fullmatch(w):
                out[len(w)].append((n, w))
        for known in out.values():
            known.sort(reverse=True)
        return out

    def add(self, rare: dict[str, int]) -> None:
        """The rarer words that the next block asks for, in place of those before."""
        if rare != self.rare:
            self.rare, self.rare_patterns, self.rare_by_length = rare, self._patterns(rare), self._by_length(rare)
            self._forget()

    def count(self, word: str) -> int:
        return self.words.get(word) or self.rare.get(word, 0)

    def meant(self, word: str) -> str | None:
        """The far more frequent word that a rare one was misread from, or None."""
        if len(word) > WORD_MOST:
            return None
        if word in self.checked:
            return self.checked[word]
        have = self.count(word)
        need = max(4 * KNOWN, 25 * have)
        best: tuple[int, str] | None = None
        for hole in _holes(word):
            for w, n in (*self.patterns.get(hole, ()), *self.rare_patterns.get(hole, ())):
                if n >= need and w != word and (best is None or (n, w) > best):
                    best = (n, w)
        for w in _swaps(word):
            n = self.count(w)
            if n >= need and (best is None or (n, w) > best):
                best = (n, w)
        if len(self.checked) > 300_000:
            self.checked.clear()
        self.checked[word] = best[1] if best else None
        return self.checked[word]

    def printed(self, form: str) -> str | None:
        """The far more frequent word that a form with digits or signs was misread from, or None."""
        if len(form) > WORD_MOST or not any(c.isalpha() for c in form):
            return None
        if form in self.undone:
            return self.undone[form]
        need = max(4 * KNOWN, 25 * max(self.count(form), 1))
        best: tuple[int, str] | None = None
        for text in dict.fromkeys((form, form.replace("c1", "d"))):
            parts = [f"[{_PRINTED[c]}]" if c in _PRINTED else re.escape(c) if c.isalnum() or c in "'’.&+#_:,;%=" else r"[^\W\d_]?" for c in text]
            like = re.compile("".join(parts))
            for size in range(len(text) - sum(x[-1] == "?" for x in parts), len(text) + 1):
                for known in (self.by_length.get(size, ()), self.rare_by_length.get(size, ())):
                    for n, w in known:
                        if n < need or (best is not None and n <= best[0]):
                            break  # the most frequent come first
                        if like.fullmatch(w):
                            best = (n, w)
                            break
        self.undone[form] = best[1] if best else None
        return self.undone[form]


class _Judged(dict):
    """Blank-separated word -> whether it holds a character that was not printed."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, raw: str) -> bool:
        if len(self) > 300_000:
            self.clear()
        self[raw] = got = misread_word(raw, self.vocabulary)
        return got


def misread_word(raw: str, vocabulary: Vocabulary) -> bool:
    """Whether a blank-separated word holds a character that was not printed."""
    if _LIGATURE.search(raw):
        return True
    word = raw.strip(_EDGE)
    if not word or _NUMBERISH.match(word):
        return False
    for part in re.split(r"[-–—/]", word):
        part = re.sub(r"['’](?:s|t|re|ll|ve|d|m)?$", "", part.strip(_EDGE))
        if len(part) < 2 or _NUMBERISH.match(part):
            if part and not part.isalnum() and part not in "&%+=*•·" and len(part) == 1 and part in "^~|@":
                return True
            continue
        low = part.lower()
        if part.isalpha():
            if re.fullmatch(r"[lIoO]{2,3}", part) and not part.islower() and vocabulary.count(low) < 6 * KNOWN * vocabulary.scale:
                return True  # digits taken for letters
            if len(part) >= 3 and vocabulary.count(low) < 400 * KNOWN * vocabulary.scale and vocabulary.meant(low):
                return True
            continue
        bare = re.sub(r"[.'’]", "", part)
        if bare.isalpha() or bare.isdigit() or "://" in word or "@" in word and "." in word.split("@")[-1]:
            continue
        if not any(c.isalpha() for c in bare) and not re.search(r"[\^~|@]", bare):
            continue
        if vocabulary.count(low) >= 6 * KNOWN * vocabulary.scale and not vocabulary.printed(low):
            continue  # codes and marks that the corpus uses, unless a far more frequent word looks like them
        return True
    return False


def _similar(x: list[str], y: list[str]) -> bool:
    """Whether the words of two folded edge lines, as many in both, repeat one another but for a few misread characters."""
    most = max(1, len(x) // 2)
    for p, q in zip(x, y):
        if p != q:
            most -= 1
            if most < 0 or not _one_off(p, q):
                return False
    return True


def _one_off(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 2:
        return False
    n = max(len(a), len(b))
    if n <= 2:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j <= (1 if n < 6 else 2)


def furniture(pages: list[tuple[int | None, list[str]]], vocabulary: Vocabulary) -> list[set[int]]:
    """Numbers of the frame's lines on each page of a scan, given (page number, lines) in order."""
    spots: list[tuple[int, int, bool, int, str]] = []  # page, line, at the top, rank from the edge, folded text
    numbers: list[tuple[int, int, int, str, int]] = []
    for p, (_, lines) in enumerate(pages):
        top, bottom = edges(lines)
        for is_top, rows in ((True, top), (False, bottom[::-1])):
            for rank, i in enumerate(rows):
                line = lines[i]
                spots.append((p, i, is_top, rank, fold(_bare(line) or line) if len(line) <= LINE_MOST else "\x00"))
                if rank < 3 and (n := page_number(line)):
                    numbers.append((p, i, n[0], n[1], rank))
    out: list[set[int]] = [set() for _ in pages]
    # numbers that count the pages: the same distance from the publisher's count on several pages, or none at all
    shift = Counter()
    for p, q in {(p, v - pages[p][0]) for p, _, v, _, _ in numbers if pages[p][0] is not None}:
        shift[q] += 1
    for p, i, v, how, rank in numbers:
        q = None if pages[p][0] is None else v - pages[p][0]
        if q == 0 or (q is not None and shift[q] >= 2 and shift[q] * 2 >= len({a for a, *_ in numbers})) or (q is None and how == "alone" and rank == 0):
            out[p].add(i)
    # lines that come again at the same edge of other pages
    by_side: dict[bool, list[tuple[int, int, int, str]]] = {True: [], False: []}
    for p, i, is_top, rank, text in spots:
        by_side[is_top].append((p, i, rank, text))
    copies = len({(n, tuple(x)) for n, x in pages}) < len(pages)
    for rows in by_side.values():
        exact: dict[str, set[int]] = defaultdict(set)
        for p, _, _, text in rows:
            exact[text].add(p)
        by_words: dict[int, list[tuple[str, list[str]]]] = defaultdict(list)
        for text in exact:
            if len(text) >= 4:
                by_words[text.count(" ")].append((text, text.split()))
        for p, i, rank, text in rows:
            if i in out[p] or not re.search(r"[^\W\d_]{2}", text):
                continue
            seen = set(exact[text])
            if len(seen) < 2 and len(text) >= 4:
                mine, size = text.split(), len(text)
                for other, words in by_words[text.count(" ")]:
                    if other is not text and -4 < len(other) - size < 4 and _similar(mine, words):
                        seen |= exact[other]
            distinct = {(pages[q][0], q if pages[q][0] is None else 0) for q in seen}
            # the same page scanned twice repeats its body as well
            if len(distinct) >= 2 and (not copies or len({pages[q][0] for q in seen}) >= 2) and _frame_like(pages[p][1][i]):
                out[p].add(i)
    # lines that the corpus has at page edges only
    for p, i, is_top, rank, _ in spots:
        if i not in out[p] and _known_frame(pages[p][1][i], vocabulary):
            out[p].add(i)
    # where the other pages of a scan open with a running header, so does this one, though it names another part
    opens = [any(i in out[p] and re.search(r"[^\W\d_]{3}", lines[i]) for i in edges(lines)[0][:2]) for p, (_, lines) in enumerate(pages)]
    filled = [bool(any(x.strip() for x in lines)) for _, lines in pages]
    for p, (_, lines) in enumerate(pages):
        others = [opens[q] for q in range(len(pages)) if q != p and filled[q] and (pages[q][0] is None or pages[q][0] != pages[p][0])]
        if not opens[p] and others and sum(others) * 2 >= len(others):
            first = next((i for i in edges(lines)[0] if i not in out[p]), None)
            if first is not None and all(i in out[p] for i in edges(lines)[0] if i < first) and _title_like(lines[first]):
                out[p].add(first)
    return out


def _title_like(line: str) -> bool:
    if len(line) > LINE_MOST:
        return False
    text = _NUMBER_HEAD.sub("", _NUMBER_TAIL.sub("", line.strip()))
    words = text.split()
    if not 2 <= len(words) <= 8 or re.search(r"[.,;:!?]$", text):
        return False
    return sum(w[:1].isupper() or not w[:1].isalpha() or w in ("of", "the", "and", "for") for w in words) >= len(words) - 1 and not re.match(r"(?:Notes on|Part \d)", text)


def _frame_like(line: str) -> bool:
    """Repeated ends of paragraphs are body; frames are no ends of sentences."""
    text = line.strip()
    return not re.search(r"[a-z][.;,]$", text) and not re.match(r"^[a-z]+(?:\s[a-z]+)*[.]?$", text) or bool(page_number(line))


def _known_frame(line: str, vocabulary: Vocabulary) -> bool:
    if len(line) > LINE_MOST:
        return False
    s = skeleton(line)
    if s in vocabulary.frames or (CAPITALS in vocabulary.frames and _capitals(line)):
        return True
    text = re.sub(r"\s+", " ", _NUMBER_HEAD.sub("", _NUMBER_TAIL.sub("", line.strip())).strip())
    if not text or len(text) > 70 or re.search(r"[.;!?]$", text):
        return False
    low = text.lower()
    for f in vocabulary.frame_tails:
        if f in low:
            rest = (text[: low.index(f)] + " " + text[low.index(f) + len(f) :]).replace("—", " ").replace("–", " ").replace("|", " ").replace(",", " ")
            words = rest.split()
            if len(words) <= 5 and all(w[:1].isupper() or w[:1].isdigit() or w.lower() in ("of", "the") for w in words):
                return True
    return False


def broken(line: str, following: str | None, vocabulary: Vocabulary) -> bool:
    """Whether the mark that closes a line breaks a word, so that it must vanish."""
    m = _ends_broken(line)
    if not m:
        return False
    left, mark = m.group(1).lower(), m.group(2)
    if mark in "­¬":
        return True
    before = line[: m.start(1)]
    if before.endswith("-"):  # part of a longer compound
        return False
    right = None
    if following is not None:
        n = _FIRST_WORD.match(following)
        right = n.group(1).lower().strip("'’") if n else None
    if not right:
        return vocabulary.count(left) < 3 * KNOWN
    head, tail = right.split("-")[0], right
    closed, compound = vocabulary.count(left + head), vocabulary.count(left + "-" + tail)
    if "-" in tail:
        compound += vocabulary.count(left + "-" + head)
    if closed or compound:
        return closed >= compound
    # neither is known: a misread word, or a compound of words that are known by themselves
    if vocabulary.meant(left + head):
        return True
    a, b = vocabulary.count(left), vocabulary.count(head)
    return not (a >= 8 * KNOWN and b >= 8 * KNOWN)


def findings(pages: list[tuple[int, int | None, str | None]], vocabulary: Vocabulary) -> list[tuple[int, int, str]]:
    """(page id, line number from 1, kind) for a scan's pages, given (id, page number, text) in order."""
    split = [(n, (t or "").split("\n")) for _, n, t in pages]
    frames = furniture(split, vocabulary)
    out = []
    for p, (key, number, text) in enumerate(pages):
        if not text:
            continue
        lines = split[p][1]
        body = [i for i, x in enumerate(lines) if x.strip() and i not in frames[p]]
        after = _next_first(split, frames, p)
        for i in sorted(frames[p]):
            out.append((key, i + 1, "furniture"))
        before = _last_before(split, frames, p)
        carried = before is not None and _ends_broken(before) is not None
        for k, i in enumerate(body):
            line = lines[i]
            following = lines[body[k + 1]] if k + 1 < len(body) else after
            ends_broken = _ends_broken(line) is not None
            if ends_broken and broken(line, following, vocabulary):
                out.append((key, i + 1, "hyphen"))
            words = line.split()
            first, last = words[0], words[-1]
            inner = words[1 if carried else 0 : len(words) - 1 if ends_broken else len(words)]
            bad = any(map(vocabulary.judged.__getitem__, inner))
            if not bad and ends_broken:
                bad = _broken_misread(last, following, vocabulary, left=True)
            if not bad and carried:
                bad = _broken_misread((lines[body[k - 1]] if k else before).split()[-1], line, vocabulary, left=False)
            if bad:
                out.append((key, i + 1, "misread"))
            carried = ends_broken
    return out


def _broken_misread(last: str, following: str | None, vocabulary: Vocabulary, left: bool) -> bool:
    """Whether the left (or right) part of a broken word holds the misread character."""
    right = following.split()[0] if following and following.split() else ""
    part = last if left else right
    bare = part.strip(_EDGE).rstrip("-‐‑­¬")
    if _LIGATURE.search(part) or (re.search(r"[^\W\d_]", bare) and re.search(r"[\d^~|@*<>{}]", bare)):
        return not _NUMBERISH.match(bare)
    a, b = last.strip(_EDGE).rstrip("-‐‑­¬").lower(), re.sub(r"['’]s$", "", right.strip(_EDGE)).lower()
    if not a or not b or not (a + b).isalpha() or vocabulary.count(a + b):
        return False
    meant = vocabulary.meant(a + b)
    if meant is None:
        return False
    return not meant.startswith(a) if left else not meant.endswith(b)


def _next_first(split, frames, p: int) -> str | None:
    """First body line of the page that follows by number."""
    number = split[p][0]
    for q in range(p + 1, len(split)):
        if number is not None and split[q][0] is not None and split[q][0] <= number:
            continue
        if number is not None and split[q][0] is not None and split[q][0] > number + 1:
            return None
        for i, x in enumerate(split[q][1]):
            if x.strip() and i not in frames[q]:
                return x
    return None


def _last_before(split, frames, p: int) -> str | None:
    """Last body line of the page before by number."""
    number = split[p][0]
    for q in range(p - 1, -1, -1):
        if number is not None and split[q][0] is not None and split[q][0] >= number:
            continue
        if number is not None and split[q][0] is not None and split[q][0] < number - 1:
            return None
        for i in range(len(split[q][1]) - 1, -1, -1):
            if split[q][1][i].strip() and i not in frames[q]:
                return split[q][1][i]
    return None


class _Parts(dict):
    """Blank-separated word -> the words and parts of words it counts for."""

    def __missing__(self, raw: str) -> tuple[str, ...]:
        w = re.sub(r"['’]s$", "", raw.strip(_EDGE)).lower()
        if len(self) > 300_000:
            self.clear()
        self[raw] = got = (w, *w.split("-")) if "-" in w else (w,)
        return got


def _whole_words(rows: list[str]) -> Iterator[str]:
    """The blank-separated words of a page that aren't broken over lines."""
    before = ""
    for x in rows:
        parts = x.split()
        if parts:
            first, last = int(before[-1:] in _MARKS and before != ""), len(parts) - (parts[-1][-1] in _MARKS)
            yield from parts[first:last]
        before = x.rstrip()


@dataclass
class Counts:
    """The vocabulary that all workers hold, and the rarer words as a table (w, n), or None where there are none."""

    vocabulary: Vocabulary
    rare: DataFrame | None


def vocabulary_of(df: DataFrame, page: str, scan: str, text: str) -> Counts:
    """Counts over all pages. What comes to the driver is bounded: words in at least WORD_SHARE and
    lines in at least LINE_SHARE of the pages, of which a page can hold only so many."""
    lines = df.where(F.col(text).isNotNull()).select(F.col(text).alias("t"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw: Counter = Counter()
        at_edge: Counter = Counter()
        parts, n = _Parts(), 0

        def words() -> Counter:
            out: Counter = Counter()
            for w, k in raw.items():
                for x in parts[w]:
                    out[x] += k
            return out

        def told() -> pd.DataFrame:
            out = [("n", "", n)] + [("w", w, k) for w, k in words().items() if w] + [("e", x, k) for x, k in at_edge.items()]
            return pd.DataFrame(out, columns=["kind", "x", "n"])

        for pdf in batches:
            for t in pdf["t"]:
                n += 1
                rows = t.split("\n")
                raw.update(_whole_words(rows))
                top, bottom = edges(rows)
                for i in {*top[:3], *bottom[-3:]}:
                    at_edge[skeleton(rows[i])] += 1
                    if _capitals(rows[i]):
                        at_edge[CAPITALS] += 1
            if len(raw) + len(at_edge) > 300_000:
                yield told()
                raw.clear(), at_edge.clear()
                n = 0
        yield told()

    got = written(lines.mapInPandas(count, "kind string, x string, n bigint").groupBy("kind", "x").agg(F.sum("n").alias("n")), "p1-counts")
    n = got.where("kind = 'n'").agg(F.sum("n")).first()[0] or 0
    floor = max(KNOWN, round(WORD_SHARE * n))
    words = {r["x"]: r["n"] for r in got.where((F.col("kind") == "w") & (F.col("n") >= floor)).select("x", "n").toLocalIterator()}
    least = max(4, LINE_SHARE * n)
    often = {r["x"]: r["n"] for r in got.where((F.col("kind") == "e") & (F.col("n") >= least)).select("x", "n").toLocalIterator()}
    shared = df.sparkSession.sparkContext.broadcast(frozenset(often))  # bounded by LINE_SHARE

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, seen = shared.value, Counter()
        for pdf in batches:
            for t in pdf["t"]:
                rows = t.split("\n")
                top, bottom = edges(rows)
                edge = {*top[:3], *bottom[-3:]}
                for i, x in enumerate(rows):
                    if i not in edge and x.strip():
                        form = skeleton(x)
                        if form in asked:
                            seen[form] += 1
                        if _capitals(x):
                            seen[CAPITALS] += 1
        yield pd.DataFrame(list(seen.items()), columns=["x", "n"])

    inner = {r["x"]: r["n"] for r in lines.mapInPandas(inside, "x string, n bigint").groupBy("x").agg(F.sum("n").alias("n")).toLocalIterator()} if often else {}
    frames = frozenset(x for x, k in often.items() if inner.get(x, 0) * 8 <= k)
    rare = got.where((F.col("kind") == "w") & (F.col("n") >= KNOWN) & (F.col("n") < floor)).select(F.col("x").alias("w"), "n") if floor > KNOWN else None
    return Counts(Vocabulary(words, frames, floor / KNOWN), rare)


def _asked(text: str, known: Vocabulary) -> set[str]:
    """The keys of rarer words that the judgement of a page's words may hang on."""
    lines = [x for x in text.split("\n") if x.strip()]
    out: set[str] = set()
    forms: set[str] = set()
    for line, following in zip(lines, [*lines[1:], None]):
        for raw in line.split():
            for part in re.split(r"[-–—/]", raw.strip(_EDGE)):
                forms.add(re.sub(r"['’](?:s|t|re|ll|ve|d|m)?$", "", part.strip(_EDGE)).lower())
        m = _ends_broken(line)
        if m:
            left = m.group(1).lower()
            # the word may go on in the next line, or below a frame
            for after in lines[:EDGE_LINES] + ([following] if following else []):
                n = _FIRST_WORD.match(after)
                if n:
                    right = n.group(1).lower().strip("'’")
                    forms |= {left, right, left + right.split("-")[0], re.sub(r"['’]s$", "", left + right)}
                    out |= {left + "-" + right, left + "-" + right.split("-")[0]}
    for form in forms:
        if not form or len(form) > WORD_MOST or known.words.get(form, 0) >= 400 * KNOWN * known.scale:
            continue
        out.add(form)
        if form.isalpha():
            if len(form) >= 3:
                out.update(_holes(form))
                out.update(_swaps(form))
        else:
            out.update(_shapes(form))
    return out - known.words.keys()


def _rare_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, w, n): the keys under which a rarer word is asked for."""
    for pdf in batches:
        rows = []
        for w, n in zip(pdf["w"], pdf["n"]):
            keys = {w}
            if n >= 4 * KNOWN and len(w) <= WORD_MOST:
                if n >= MEANT and len(w) >= 3 and "-" not in w:
                    keys.update(_holes(w))
                shape = w.translate(_SHAPE)
                keys.update("~" + x for x in (shape, *_holes(shape)))
            rows += [(k, w, n) for k in keys]
        yield pd.DataFrame(rows, columns=["key", "w", "n"])


def _by_scan(df: DataFrame, page_id: str, scan: str, page: str, text: str, each, columns: str, counts: Counts) -> DataFrame:
    """Runs ``each(pages, vocabulary)`` for a scan's pages in order and keeps what concerns the block's own pages.

    Long scans go in blocks of BLOCK_PAGES page numbers, pages without number in blocks of
    page ids; a block also reads the OVERLAP pages before and after it. Where one page was
    scanned over and over, at most 4 * BLOCK_PAGES rows are held at once.
    """
    known = counts.vocabulary
    shared = df.sparkSession.sparkContext.broadcast((known.words, known.frames, known.scale))  # bounded by the shares
    names = [c.split()[0] for c in columns.split(", ")]
    most = 4 * BLOCK_PAGES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(*shared.value)
        now, rows, own, rare, done = None, [], set(), {}, []

        def settle() -> None:
            if own:
                vocabulary.add(rare)
                done.extend(r for r in each([x[:3] for x in rows], vocabulary) if r[0] in own)

        for pdf in batches:
            for s, b, mine, w, k, n, t in zip(pdf["s"], pdf["b"], pdf["own"], pdf["w"], pdf["k"], pdf["n"], pdf["t"]):
                if (s, b) != now:
                    settle()
                    now, rows, own, rare = (s, b), [], set(), {}
                elif len(rows) >= most:
                    # the last pages stay as context
                    settle()
                    rows, own = rows[-OVERLAP:], set()
                if w is not None:
                    rare[w] = int(n)
                    continue
                rows.append((k, None if n != n or n is None else int(n), t))
                if mine:
                    own.add(k)
            if done:
                yield pd.DataFrame(done, columns=names)
                done.clear()
        settle()
        if done:
            yield pd.DataFrame(done, columns=names)

    number = F.expr(f"try_cast(`{page}` as bigint)")
    block = F.when(number.isNotNull(), number).otherwise(F.coalesce(F.expr(f"try_cast(`{page_id}` as bigint)"), F.lit(0)))
    size, numbered = F.lit(BLOCK_PAGES), number.isNotNull()
    near = F.array_distinct(F.transform(F.array(F.lit(0), F.lit(-OVERLAP), F.lit(OVERLAP)), lambda d: F.greatest(F.floor((block + d) / size), F.when(block >= 0, 0).otherwise(F.floor(block / size) - 1))))
    work = df.select(
        F.coalesce(F.concat(F.lit("s"), F.col(scan).cast("string")), F.concat(F.lit("page "), F.col(page_id).cast("string"))).alias("s"),
        F.explode(near).alias("b"),
        F.floor(block / size).alias("home"),
        numbered.alias("numbered"),
        F.col(page_id).alias("k"),
        number.cast("double").alias("n"),
        F.col(text).alias("t"),
    )
    work = work.select("s", F.concat(F.when(F.col("numbered"), "p").otherwise("i"), F.col("b").cast("string")).alias("b"), (F.col("b") == F.col("home")).alias("own"), F.lit(None).cast("string").alias("w"), "k", "n", "t")
    if counts.rare is not None:

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            vocabulary = Vocabulary(*shared.value)
            for pdf in batches:
                got = [(s, b, key) for s, b, t in zip(pdf["s"], pdf["b"], pdf["t"]) if t for key in _asked(t, vocabulary)]
                yield pd.DataFrame(got, columns=["s", "b", "key"])

        asked = work.select("s", "b", "t").mapInPandas(ask, "s string, b string, key string").distinct()
        told = asked.join(counts.rare.mapInPandas(_rare_keys, "key string, w string, n bigint"), "key").select("s", "b", "w", "n").distinct()
        told = told.select("s", "b", F.lit(False).alias("own"), "w", F.lit(None).cast(work.schema["k"].dataType).alias("k"), F.col("n").cast("double").alias("n"), F.lit(None).cast("string").alias("t"))
        work = work.unionByName(told)
    return work.repartition("s", "b").sortWithinPartitions("s", "b", F.col("w").isNull(), "n", "k").mapInPandas(run, columns)


def find_noise(df: DataFrame, page_id: str, scan: str, page: str, text: str) -> DataFrame:
    """(page_id, line_no, kind) of frame lines, broken words and misread body lines.

    Null and empty texts give no row; a page without scan is a scan of its own; a page
    scanned twice counts each time; extra columns are ignored.
    """
    known = vocabulary_of(df, page_id, scan, text)
    kind = dict(df.dtypes)[page_id]
    return _by_scan(df, page_id, scan, page, text, findings, f"page_id {kind}, line_no int, kind string", known)


def paragraphs(pages: list[tuple[int, int | None, str | None]], vocabulary: Vocabulary) -> list[tuple[int, int, str]]:
    """(first page id, number on that page, text) of a scan's paragraphs: frames dropped, broken words closed, ligatures and confusions mended.

    A page that was scanned twice is taken once, by its first scan.
    """
    split = [(n, (t or "").split("\n")) for _, n, t in pages]
    frames = furniture(split, vocabulary)
    out: list[tuple[int, int, str]] = []
    text, start, seen, gap = "", None, set(), False
    begun: Counter = Counter()

    def close() -> None:
        begun[start] += 1
        out.append((start, begun[start], text))

    for p, (key, number, t) in enumerate(pages):
        if number is not None and number in seen or not t:
            continue
        seen.add(number)
        lines = split[p][1]
        body = [i for i, x in enumerate(lines) if i not in frames[p]]
        filled = [i for i in body if lines[i].strip()]
        if not filled:
            continue
        for i in range(filled[0], filled[-1] + 1):
            if i in frames[p]:
                continue
            line = lines[i].strip()
            if not line:
                gap = True
                continue
            if text and gap and not _ends_broken(text):
                close()
                text = ""
            gap = False
            if not text:
                text, start = _mended(line, vocabulary), key
            elif _ends_broken(text):
                head, _, rest = line.partition(" ")
                text = (text[: _ends_broken(text).end(1)] if broken(text, line, vocabulary) else text.rstrip()) + head
                text += " " + _mended(rest, vocabulary) if rest else ""
            else:
                text += " " + _mended(line, vocabulary)
        # a page's last line runs on unless it ends a sentence
        gap = bool(re.search(r"[.!?][\"”)]?$", text))
    if text:
        close()
    return out


_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def _mended(line: str, vocabulary: Vocabulary) -> str:
    for a, b in _LIGATURES.items():
        line = line.replace(a, b)
    words = line.split()
    for i, w in enumerate(words):
        bare = w.strip(_EDGE)
        if len(bare) >= 3 and vocabulary.judged[w]:
            meant = vocabulary.meant(bare.lower())
            if meant:
                meant = meant.upper() if bare.isupper() else meant.capitalize() if bare[:1].isupper() else meant
                words[i] = w.replace(bare, meant)
    return " ".join(words)


def repair(df: DataFrame, page_id: str, scan: str, page: str, text: str) -> DataFrame:
    """(page_id, number, text): the continuous paragraphs of each scan, named by the page they begin on."""
    known = vocabulary_of(df, page_id, scan, text)
    kind = dict(df.dtypes)[page_id]
    return _by_scan(df, page_id, scan, page, text, paragraphs, f"page_id {kind}, number int, text string", known)
