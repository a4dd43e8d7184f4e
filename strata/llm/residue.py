"""Template residue, filler, error pages and script notices among real texts.

Labelled exemplars are kept in an inverted index (term -> exemplars). A text is cut into
passages; each passage whose terms can reach the coverage at all retrieves the exemplars
that share its terms, and the TF-IDF containment of the exemplar in windows of the passage
decides how much of the passage it explains. Passages that residue explains nearly whole
are residue; the same words inside a sentence of news explain little of it. Unfilled slots
are terms of their own, and labelled counter-exemplars ("a slot such as ...") clear those
that are only mentioned.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labelled residue exemplars; "#" stands for a number or code, "*" for a word that varies.
RESIDUE = """
lorem ipsum dolor sit amet
this is a sample post
this is a sample page
this is your first post
welcome to your new site edit or delete this post
this is placeholder text replace it before publishing
edit or delete it then start writing
replace it with your own words
replace this text with your own
double click here to add your own words
click here to add your own text
click to edit this block of text
click to edit this text
text goes here
text goes in this spot
your text here
your headline goes here
your title here
your content goes here
headline here
headline goes here
title goes here
add your title here
add a short description here
body copy here
body copy goes here
body text goes in this spot
section # heading goes in this spot
section heading goes here
your caption
your caption here
your second line
your call to action
call to action goes here
insert * here
insert text here
insert headline here
insert two or three sentences describing entry #
insert a short summary of the story here
write a summary here
write your summary here
blurb to come
summary to come
headline to come
text to come
details to follow copy to come
story placeholder final copy to follow from the web team
placeholder final copy to follow
placeholder headline
placeholder text
placeholder image
sample text
sample headline
example title
example headline
demo entry
demo post
demo content
dummy text
dummy headline
test post
test entry please ignore
test test # please ignore
this is a test please ignore
ignore this test message
testing testing # #
untitled document
untitled post
untitled
copy of newsletter template
copy of template
newsletter template
new post
new page
hello world
todo write summary before publishing
todo write blurb before publishing
fixme write teaser before publishing
tbd write teaser before publishing
todo add text
add text
add title
add summary
add a caption
add caption
add headline
enter text
enter title here
edit text
xxx insert copy before publishing
texto de ejemplo
titulo de ejemplo
titular de ejemplo
contenido de ejemplo
escriba aqui el resumen de la noticia #
escriba aqui su texto
inserte el texto aqui
texto de relleno
haga clic para editar este texto
su titulo aqui
nan
null
none
undefined
object object
untitled #
n a
draft copy #
draft #
first draft
no title
no subject
no headline
no summary
no description
no content
sin titulo
# not found
# not found page not found
# bad gateway
# forbidden
# access forbidden
# unauthorized
# internal server error
# service unavailable
# gateway timeout
gateway timeout
bad gateway
bad request
bad request missing parameter *
http # # not found
http # # forbidden
http # # internal server error
http error #
error # service temporarily unavailable
error # page not found
error # access denied
error code #
service temporarily unavailable
the service is unavailable
internal server error
the administrator has been notified ref #
an internal error occurred
an unexpected error occurred
an unexpected condition was encountered while producing this feed
an unexpected condition was encountered while producing this document
a problem occurred while loading this page
something went wrong
oops something went wrong
oops that page can't be found
try again later
please try again later
please try again in a few minutes
contact the webmaster if this persists
contact the site administrator
return to the home screen
return to the home page
go back to the home page
go back to the previous page
page not found
page cannot be displayed
the page you requested could not be found
the page you are looking for does not exist
the requested url was not found on this server
the requested url was rejected
your support id is #
the article you asked for could not be located on this server
sorry we can't find that article
sorry we can't find that page
it may have moved
it may have been moved or deleted
that link seems to be broken
this link is broken or has expired
this article is no longer available
this resource is no longer available
this document is no longer available
this content is not available
this calendar is no longer available
this feed is no longer available
content unavailable
you do not have permission to view this article
you do not have permission to access this resource
you must be logged in to see this resource
you must be logged in to view this content
please log in to continue
sign in again to continue
your session has expired
session expired
access denied
access denied request id #
request id #
too many requests slow down #
rate limit exceeded
unable to load calendar status #
unable to load document status #
unable to load file status #
unable to load page status #
unable to load image status #
unable to load * status #
could not load * status #
failed to load resource
failed to fetch
could not connect to the database
error establishing a database connection
database error
query failed relation posts does not exist
sql syntax error near
query failed table * doesn't exist
ssl handshake failed
certificate error
connection refused
connection timed out
connection reset by peer
upstream timed out while reading response header
the server took too long to respond
the server is not responding
request timed out
operation timed out
no response from server
traceback most recent call last keyerror *
traceback most recent call last
nullpointerexception at *
exception in thread main
unhandled exception
typeerror cannot read property of undefined
warning undefined variable * in * on line #
warning undefined index * in * on line #
notice undefined offset # in * on line #
parse error syntax error unexpected in * on line #
fatal error allowed memory size exhausted in *
fatal error uncaught error in * on line #
fatal error call to undefined function
stack trace # main
segmentation fault
out of memory
we are down for scheduled maintenance
this site is under maintenance
the site is temporarily offline
this page is under construction
check back soon
please check back later
pagina no encontrada
pagina no disponible
error # pagina no encontrada
se produjo un error interno
ha ocurrido un error inesperado
intentelo mas tarde
vuelva a intentarlo mas tarde
no se puede mostrar este contenido codigo #
no se pudo cargar el contenido
contenido no disponible
acceso denegado
servicio no disponible
no tiene permiso para ver esta pagina
su sesion ha caducado
please enable javascript to view this page
please enable javascript to continue
please enable javascript to view the comments
you need to enable javascript to run this app
you need to turn on scripts in your browser to use this site
this site requires javascript
this page requires javascript to be enabled
this app works best with javascript enabled
javascript is disabled
javascript is required
javascript must be enabled
javascript is turned off in your browser
some features will not work
some features may not work
active scripting is required for this calendar to load
active scripting is required for this document to load
we have detected that js is off in your browser
turn it on to go further
switch scripts on and reload
turn scripts on and reload this page
your browser has scripts turned off
your browser is not supported
your browser is out of date
please update your browser
this content needs a newer browser with scripting support
to display the feed allow scripting in your settings
to display the document allow scripting in your settings
noscript this widget cannot run without client side code
this widget cannot run without scripts
enable cookies and scripts then refresh
enable cookies to continue
cookies must be enabled
please enable cookies
this site uses cookies
loading if nothing happens scripts may be blocked
loading please wait
scripts may be blocked
checking your browser before you continue
checking your browser before accessing
this takes a few seconds
this process is automatic your browser will redirect shortly
just a moment
just a moment security check in progress
security check in progress
please complete the security check to access
verify you are human to proceed
verify you are human by completing the action below
please verify you are a human
complete the captcha to continue
are you a robot
ddos protection by
ray id #
su navegador tiene los scripts desactivados
su navegador no admite scripts
active javascript para ver este contenido
active javascript para continuar
debe activar javascript
habilite javascript para ver esta pagina
necesita activar las cookies
compruebe que es humano
"""
# Words of filler text; passages made of these alone are filler.
FILLER_LOREM = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et
dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo
consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint
occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"""
FILLER_MASH = "asdf qwerty qwertz foo bar baz bla blah xxx xx xxxx xxxxx test tests asdfgh hjkl abc yada lala"
# Words that show a slot is talked about, not left unfilled.
MENTION = "such as like called named titled slot slots bracket brackets placeholder syntax variable says tag tags written reads"

_NAME = r"[A-Za-z_][\w.\- ]{0,40}"
SLOT = re.compile(
    r"\{\{[^{}]{0,60}\}\}|\$\{[^{}]{0,60}\}|#\{[^{}]{0,60}\}|\{%[^%]{0,60}%\}|<%[^%]{0,60}%>|<\?[^?]{0,60}\?>"
    rf"|%\({_NAME}\)[sd]|%[A-Z][A-Z_]{{3,40}}%|__[A-Z][A-Z_]{{2,40}}__|@@[A-Z][A-Z_]{{2,40}}@@|\[\[{_NAME}\]\]"
    r"|\[(?:INSERT|ENTER|YOUR|ADD|Insert|Enter|Your|Add|TBD|TODO)\b[^\]]{0,60}\]|\[[^\]]{1,50}\b(?:HERE|here)\]"
    r"|<(?:ENTER|INSERT|YOUR|ADD)\b[^<>]{0,60}>|(?<![\w{$#])\{[a-z]+(?:[_.][a-z]+)+\}|(?<![\w{$#])\{(?:title|headline|author|body|summary|name|date|excerpt|school|event)\}"
    r"|<(?:title|headline|author|body|summary|excerpt|name|date|[a-z]+_[a-z_]+)>"
    r"|\[(?:title|headline|author|body|summary|excerpt|name|date|[a-z]+_[a-z_]+)\]"
    r"|(?:\{\{|\$\{|#\{|\{%|<%)[\w. =]{0,40}$|%\([\w.]{0,40}$|\[INSERT[A-Z ]{0,30}$|<ENTER[A-Z ]{0,30}$"
)
_SLOT_SIGNS = ("{", "[", "<", "%", "__", "@@", "&lt;")
SLOT_START = re.compile(r"\{|\[|<%|<\?|<[A-Za-z]|%\(|%[A-Z]|__[A-Z]|@@|&lt;")
_WORD = re.compile(r"\x00|[\w./\\:$]*\d[\w./\\:$]*|[^\W\d_]+(?:['’][^\W\d_]+)*")
_BREAKS = ("! ", "? ", ": ", "; ", "| ", "… ", ") ", "] ", "\n")
_FOLD = str.maketrans("áéíóúüñàèìòùâêîôûç’", "aeiouunaeiouaeiouc'")
_CODE = re.compile(r"^(?=.*\d)[0-9a-z./:\-]+$")


def terms(passage: str) -> list[str]:
    """Lowered words without accents; numbers, codes and hexadecimal ids become '#', a slot stays its own term."""
    out = []
    for w in _WORD.findall(passage.lower().translate(_FOLD)):
        out.append("#" if w != "\x00" and any(map(str.isdigit, w)) else w)
    return out


class _Margin(dict):
    """Blank-separated word -> most that it can add to (1 - coverage) * covered - coverage * uncovered weight."""

    def __init__(self, index: Index):
        super().__init__()
        self.index = index

    def __missing__(self, word: str) -> float:
        ix, total = self.index, 0.0
        for t in terms(word):
            if t in ix.idf:
                total += (1 - ix.coverage) * ix.idf[t]
            elif t in ix.lorem or t in ix.mash or not t.strip("x"):
                total += ix.default_idf
            elif t != "#":
                total -= ix.coverage * ix.default_idf
        if len(self) > 200_000:
            self.clear()
        self[word] = total
        return total


class Index:
    """Inverted index over the exemplars with IDF from the corpus."""

    def __init__(self, idf: dict[str, float] | None = None, extra: Iterable[str] = (), threshold: float = 0.62, coverage: float = 0.62):
        self.threshold, self.coverage = threshold, coverage
        lines = [x for x in (*RESIDUE.split("\n"), *extra) if x.strip()]
        self.exemplars = [[t for t in (w if w in "#*" else terms(w)[0] for w in x.split() if w in "#*" or terms(w))] for x in lines]
        vocabulary = {t for e in self.exemplars for t in e if t not in "#*"}
        df = Counter(t for e in self.exemplars for t in set(e))
        self.idf = {t: (idf or {}).get(t, 3.0 + 1.0 / df[t]) for t in vocabulary}
        self.vocabulary = vocabulary
        self.postings: dict[str, list[int]] = {}
        self.weight, self.bags = [], []
        for i, e in enumerate(self.exemplars):
            bag = Counter(t for t in e if t not in "#*")
            self.bags.append(bag)
            self.weight.append(sum(self.idf[t] * n for t, n in bag.items()))
            for t in bag:
                self.postings.setdefault(t, []).append(i)
        self.lorem = set(terms(FILLER_LOREM))
        self.mash = set(FILLER_MASH.split())
        self.mention = set(MENTION.split())
        self.default_idf = max(self.idf.values(), default=3.0)
        self.margin = _Margin(self)
        stars = [e for e in self.exemplars if "*" in e]
        self.star_room = -coverage * self.default_idf * max((e.count("*") for e in stars), default=0)
        self.star_terms = {t for e in stars for t in e[:4] if t not in "#*"} | {t + ":" for e in stars for t in e[:4]}

    def _suspect(self, passage: str) -> bool:
        """Whether the passage's terms leave room for the coverage asked for; never false for a match.

        Each blank-separated word adds what it would add to covered minus uncovered weight
        if all its exemplar terms were matched; the words "*" may stand for are let off.
        """
        words = passage.split()
        room = sum(map(self.margin.__getitem__, words))
        return room >= 0.0 or (len(words) < 18 and room >= self.star_room and not self.star_terms.isdisjoint(words))

    def match(self, text: str | None) -> tuple[str, float, float] | None:
        """(best exemplar, containment, passage coverage) of the first residue passage, or None."""
        if not text:
            return None
        if any(x in text for x in _SLOT_SIGNS) and SLOT_START.search(text):
            plain = html.unescape(text) if "&" in text else text
            hit = self._slot(plain)
            if hit:
                return hit
        lowered = text.lower()
        if "&" in lowered or "<" in lowered:
            lowered = re.sub(r"<[^<>]{1,80}>", " ", html.unescape(lowered))
        for mark in _BREAKS:
            if mark in lowered:
                lowered = lowered.replace(mark, ". ")
        for passage in lowered.split(". "):
            if passage and self._suspect(passage):
                hit = self._passage(passage)
                if hit:
                    return hit
        return None

    def _slot(self, text: str) -> tuple[str, float, float] | None:
        for m in SLOT.finditer(text):
            # the slot's own window contains the exemplar whole; how much of its passage that explains is measured
            before = terms(text[max(0, m.start() - 60) : m.start()])[-4:]
            after = terms(text[m.end() : m.end() + 40])[:3]
            quoted = text[max(0, m.start() - 1) : m.start()] in "“\"‘" and text[m.start() - 1 : m.start()] != ""
            mention = sum(t in self.mention for t in before) >= 1 and bool(after) or {"left", "blank"} <= set(after)
            if not mention and not quoted:
                start = max(text.rfind(x, 0, m.start()) for x in (". ", "! ", "? ", "\n")) + 1
                end = min((i for x in (". ", "! ", "? ", "\n") if (i := text.find(x, m.end())) >= 0), default=len(text))
                rest = [w for w in terms(text[start : m.start()]) + terms(text[m.end() : end]) if w != "#"]
                return ("<slot>", 1.0, self._share([self.default_idf], rest))
        return None

    def _share(self, explained: list[float], rest: list[str]) -> float:
        """Share of a passage's weight that is explained."""
        got = sum(explained)
        return round(got / (got + sum(self.idf.get(w, self.default_idf) for w in rest)), 4)

    def _passage(self, passage: str) -> tuple[str, float, float] | None:
        words = terms(passage)
        plain = [w for w in words if w != "#"]
        if not plain:
            return None
        # filler comes in any order and length: the passage must be contained in the exemplar, not the other way round
        for name, words_of, least in (("lorem", [w for w in plain if w in self.lorem], 3), ("mash", [w for w in plain if w in self.mash or set(w) == {"x"}], 2)):
            if len(plain) >= least and len(words_of) >= 0.75 * len(plain) and (name == "mash" or any(len(w) > 4 for w in plain)):
                held = Counter(words_of)
                share = self._share([self.default_idf * len(words_of)], list((Counter(plain) - held).elements()))
                if share >= (0.8 if name == "lorem" else 1.0):
                    return (name, share, share)
        have = Counter(plain)
        shared: Counter = Counter()
        for t, n in have.items():
            for i in self.postings.get(t, ()):
                shared[i] += self.idf[t] * min(n, self.bags[i][t])
        explained, best = Counter(), ("", 0.0)
        for i, w in shared.items():
            contained = w / self.weight[i]
            if contained < self.threshold:
                continue
            contained *= self._window(words, i)
            if contained >= self.threshold:
                if contained > best[1]:
                    best = (" ".join(self.exemplars[i]), contained)
                explained |= Counter({t: have[t] for t in self.bags[i] if t in have})
                if "*" in self.exemplars[i]:
                    explained["*"] = max(explained["*"], self.exemplars[i].count("*"))
        if not best[0]:
            return None
        got = sum(self.idf[t] * n for t, n in explained.items() if t != "*")
        rest = sorted((self.idf.get(t, self.default_idf) for t in (have - explained).elements()), reverse=True)
        cover = got / (got + sum(rest[explained["*"] :]))
        return (best[0], round(best[1], 4), round(cover, 4)) if cover >= self.coverage else None

    def _window(self, words: list[str], i: int) -> float:
        """Share of the exemplar's weight that lies within one window of the passage, as a factor on its containment."""
        bag, n = self.bags[i], len(self.exemplars[i])
        at = [k for k, w in enumerate(words) if w in bag]
        span = n + max(2, n // 2)
        if at[-1] - at[0] < span:
            return 1.0
        whole, most = sum(self.idf[words[k]] for k in at), 0.0
        for a in at:
            most = max(most, sum(self.idf[words[k]] for k in at if a <= k < a + span))
        return min(1.0, most / whole)


def _document_frequencies(df: DataFrame, columns: tuple[str, ...]) -> tuple[dict[str, int], int]:
    """In how many texts each exemplar term occurs, over all rows; the result is bounded by the exemplars' vocabulary."""
    vocabulary = Index().vocabulary

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        n = 0
        for pdf in batches:
            for c in pdf.columns:
                for text in pdf[c]:
                    if text:
                        n += 1
                        seen.update(vocabulary.intersection(text.lower().split()))
        yield pd.DataFrame({"term": ["\x00n", *seen], "n": [n, *seen.values()]})

    rows = df.select(*columns).mapInPandas(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    got = {r["term"]: r["n"] for r in rows}
    return got, got.pop("\x00n", 0)


def fitted(df: DataFrame, columns: tuple[str, ...]) -> Index:
    """The exemplar index with IDF counted over all rows of ``df``."""
    df_of, n = _document_frequencies(df, columns)
    return Index({t: math.log((n + 1) / (df_of.get(t, 0) + 1)) + 1.0 for t in Index().vocabulary})


def exemplars(spark) -> DataFrame:
    """The labelled exemplars as a table: label (residue, filler, counter) and text."""
    rows = [("residue", x) for x in RESIDUE.split("\n") if x.strip()] + [("filler", w) for t in (FILLER_LOREM, FILLER_MASH) for w in t.split()] + [("counter", w) for w in MENTION.split()]
    return spark.createDataFrame(rows, "label string, text string")


def find_residue(df: DataFrame, key: str, columns: tuple[str, ...], index: Index | None = None) -> DataFrame:
    """``key``, field, exemplar, containment and coverage of every text that is or contains residue;
    ``first_of_row`` marks one result for each row.

    Null and empty texts give no row. Each row is judged by itself, so repeated rows give
    repeated results and extra columns don't matter. Texts are searched whole.
    """
    index = index or fitted(df, columns)
    bound = df.sparkSession.sparkContext.broadcast(index.idf)  # bounded by the exemplars' vocabulary
    kind = dict(df.dtypes)[key]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Index(bound.value)
        for pdf in batches:
            rows = []
            for k, *texts in zip(pdf[key], *[pdf[c] for c in columns]):
                hits = [(k, c, *hit) for c, text in zip(columns, texts) if text and (hit := own.match(text))]
                rows += [(*h, i == 0) for i, h in enumerate(hits)]
            yield pd.DataFrame(rows, columns=["key", "field", "exemplar", "containment", "coverage", "first_of_row"])

    schema = f"key {kind}, field string, exemplar string, containment double, coverage double, first_of_row boolean"
    got = df.select(key, *columns).mapInPandas(judge, schema)
    return got.withColumnRenamed("key", key)
