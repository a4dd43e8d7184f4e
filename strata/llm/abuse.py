"""Abusive, hateful and sexually explicit language, with a score for every document.

A lexicon in four languages lies in a trie. Each distinct word of the corpus is undressed
(look-alike letters, digits for letters, separators, repeated letters, invisible marks) and
run through the trie together with a Levenshtein automaton, so misspelled and disguised
terms are met as well, however often they come. Words of a fixed dictionary (the whole words
of public tokenizers' vocabularies, and their inflected forms) are no misspellings and are
only met exactly; no count of the corpus decides. Terms and phrases that lie close together
form one window, whose weights add up; words around the window that address or single out
somebody add to it, words of quotation, teaching and rules take away.
"""

from __future__ import annotations

import base64
import json
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("STRATA_TOKENIZERS", "/opt/tokenizers")

# Terms by kind and weight; plurals in -s and -es are added.
TERMS = {
    ("insult", 2.0): """idiot moron cretin imbecile dunce nitwit halfwit blockhead windbag scumbag dirtbag bastard jackass
        asshole dumbass dipshit shithead dickhead bitch slut whore twat wanker douchebag scum lowlife degenerate retard dimwit
        numbskull dolt simpleton knucklehead sleazebag
        imbécil idiota estúpido estúpida cretino gilipollas cabrón pendejo hijueputa mierda malnacido inútil tarado
        crétin imbécile connard salaud ordure enculé abruti débile salope
        vollidiot trottel arschloch dreckskerl dreckskerle abschaum schwachkopf mistkerl hurensohn depp wichser""",
    ("insult", 1.5): """jerk creep coward crook weasel toad worm rat pig swine vermin parasite cockroach loser clown fool ass
        snake maggot leech traitor crybaby whiner brat bootlicker liar thug pest savage
        cobarde basura cerdo rata plaga parásito ladrón payaso cucaracha alimaña
        lâche menteur parasite vermine chien porc cafard racaille
        feigling schwein ungeziefer ratte parasit lügner gesindel schmarotzer""",
    ("insult", 1.0): """filthy slimy rotten lousy pathetic worthless brainless braindead spineless gutless miserable stupid
        dumb vile crooked damn goddamn bloody disgusting ugly lazy shitty fucking fat stinking crappy idiotic moronic useless
        despicable sleazy greasy scummy
        maldito malditos maldita asqueroso asquerosa asco sucio podrido inútiles despreciable
        sale dégoûtant pourri minable dégoûtes espèce
        widerlich widerlicher dumm dummes dummer erbärmlich erbärmliche verdammt verdammter dreckig ekelhaft""",
    ("sexual", 2.0): """porn porno pornos pornography xxx hardcore horny kinky hookup erotic fetish bondage escort nympho milf
        blowjob orgy cumshot busty webcam uncensored orgasm masturbate deepthroat threesome camgirl camgirls stripper
        coquines cochonnes salopes nackte nackten geil geile fick ficken follar folla putas tetas""",
    ("sexual", 1.5): """nude naked topless nudity moan undresses undress steamy sexy seductive stripping lingerie dildo vibrator
        desnudas desnudos desnuda nues nue sexo sexe erotik erotique erótico érotique erótica lüstern""",
    ("sexual", 1.0): "sex adult adults adulto adultos adultes mature madura mûrs reife damen erwachsene lover",
}
# Phrases by kind and weight; "*" stands for one to six words.
PHRASES = {
    ("insult", 3.0): """go play in traffic|brain of a dead fish|waste of oxygen|kiss my rear|kiss my ass|crawl back under|
        choke on your|nobody likes you|shut your mouth|shut the hell up|drop dead|ferme ta gueule|halt die klappe|halt die fresse|
        do us all a favor|takes the prize|pedazo de idiota|fahr zur hölle|va au diable|vete al diablo|cierra la boca""",
    ("insult", 2.0): """screw you|go to hell|get lost|make me sick|you people make|can rot|rot in hell|piss off|fuck off|fuck you|
        what a * bunch|could not spell their own names|nothing but a|hope you lose everything|laughs behind your|get out of town|
        who let this|near a keyboard|must be ashamed|such a|smells like one|all of you|every one of you|nobody asked for your|
        ojalá se pudran|que se pudran|eres una|tu me dégoûtes|bande d|ihr seid alle|du bist ein|qué asco de|vous êtes des|verschwindet""",
    ("threat", 3.0): """break your jaw|break your neck|break your legs|break your bones|kick your teeth|smash your face|cut your throat|
        we are coming for you|watch your back|make them regret|make you regret|make them cry|make you cry|i will kill|i will hurt you|
        burn down the|knochen brechen|brechen wir noch die knochen|dir brechen wir|te casser les dents|casser la gueule|
        romper la cara|te voy a romper|te voy a matar|on va te casser|je vais te|ich bring dich um|i know where * parks|i know where you|
        i know where * lives|make that * cry|make that * regret""",
    ("threat", 1.5): "shows up again|say that to my face|somebody will make|i will make that|had never moved here|you will pay for|i know where",
    ("hate", 2.0): """less than human|deserve to be wiped|wiped off the map|locked away for good|thrown out with the trash|breed like|
        send every last one of them away|send them all back|ruins every place|their kind|now it stinks|liar and a thief|born to steal|
        lazy by blood|never meant * to live beside|live beside us|near decent people|ought to be|no normal town|i would not share a table|
        they are garbage|they are a disease|they are animals|like a disease|like a plague|like animals|the sooner those|better we all sleep|
        no merecen vivir|hay que echarlos|son ratas|son una plaga|qu on les chasse|les chasse tous|gehören verjagt|gehören hier nicht her|
        sont des parasites|sind ungeziefer|sind abschaum|never trust|keep * out|this was a clean place|ces gensla|sont de la vermine""",
    ("hate", 1.5): """those foreigners|those refugees|the hill people|hill people|people with that accent|that accent|everyone of that faith|that faith|
        families like that|from the camps|the ones who pray like that|pray like that|women in office|newcomers from over the border|
        over the border|whole tribe|every one of them|every last one|esos extranjeros|los de ese barrio|ces étrangers|diese fremden|solche leute""",
    ("sexual", 3.0): """hot singles|nude pic|strip show|dirty talk|between the sheets|drives every lover wild|full frontal|wife moan|
        happy ending|no strings sex|no strings|want sex now|busca sexo|sexo sin compromiso|sexe garanti|heißen sex|sex ohne|
        harte pornos|mujeres desnudas|femmes nues|nackte frauen|private show|in bed make your|last all night in bed|sex toys|adults only strip""",
    ("sexual", 1.0): """adults only|for grown men|explicit * scenes|sin compromiso|ohne verpflichtung|esta noche|en vivo|en direct|on camera|
        all night|grown ups|married but bored|rencontres coquines|toys and|films for couples|bigger harder longer|matches tonight|tonight at""",
}
# Words that address or single out somebody, and words of quotation, teaching, rules and reviews.
DIRECT = set("you your you're youre yourself u ur tu te ti vous ta ton toi du dich dir dein deine ihr euch eres usted they them those these their lárgate cállate".split())
DISTANT = set(
    """says said policy policies rule rules handbook calling called calls word words novel villain character chapter book story script line scene
    drama play fable counselor explained explains explain report reports reported reporting lesson lessons unit units covers taught teach teaches
    teaching assembly pledges studied study propaganda history speech review reviews reviewed poster warns warning filter blocked wrongly biology
    health puberty consent lab therapist licensing career farm names photo quote
    quoted quotes discuss discussed discusses readers mentions mention term terms respect bullying prevention online comments content disagree
    strongly furious unfair act dice dijo norma clase cuento novela informe profesor dit règle roman cours
    sagt regel roman unterricht erklärt""".split()
)
# Look-alike letters and digits that stand for letters.
_LOOK = str.maketrans("аеорсухіјѕԁһӏԛԝкмтвнԍοανικτυρχεϲАВСЕНІЈКМОРЅТХУ", "aeopcyxijsdhlqwkmtbhgoavikturxecABCEHIJKMOPSTXY")
_LEET = str.maketrans("013457@$!|+€", "oleastasiite")
_HIDDEN = re.compile(r"[­​-‏‪-‮⁠﻿̀-ͯ]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_] ){3,}[^\W\d_](?![^\W_])")
_EDGE = ".,;:!?\"'“”‘’()[]{}<>«»¿¡…—–-#&/"
_MASK = re.compile(r"^([^\W\d_])(\*{2,})([^\W\d_])$")
_RUN = re.compile(r"(.)\1{2,}")
REACH, AROUND, THRESHOLD, SHORTEST = 12, 12, 3.0, 5
_ENDINGS = ("s", "es", "ed", "d", "ing", "er", "ers", "ly", "n", "en", "e", "te", "ten", "ez", "ent")


class Trie:
    """Lexicon trie, searched with a Levenshtein automaton whose state is a row of distances."""

    def __init__(self, entries: dict[str, tuple[str, float]]):
        self.root: dict = {}
        for word in entries:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = word

    def near(self, word: str, most: int) -> str | None:
        """The nearest entry within ``most`` edits, exchanges of neighbours included."""
        best: tuple[int, str] | None = None
        first = tuple(range(len(word) + 1))
        stack = [(child, k, first, None, k) for k, child in self.root.items() if k]
        while stack:
            node, c, above, above2, path = stack.pop()
            row = [above[0] + 1]
            for i in range(1, len(word) + 1):
                d = min(above[i] + 1, row[i - 1] + 1, above[i - 1] + (word[i - 1] != c))
                if above2 is not None and i > 1 and word[i - 1] == path[-2] and word[i - 2] == c:
                    d = min(d, above2[i - 2] + 1)
                row.append(d)
            if "" in node and row[-1] <= most and (best is None or (row[-1], node[""]) < best):
                best = (row[-1], node[""])
            if min(row) <= most or min(above) < most:  # an exchange of neighbours looks two rows back
                stack += [(child, k, tuple(row), above, path + k) for k, child in node.items() if k]
        return best[1] if best else None


_DICTIONARIES: dict[str, frozenset[str]] = {}


def dictionary(folder: str = TOKENIZERS) -> frozenset[str]:
    """Lowered words that public tokenizers have whole: ordinary words of many languages, the same for every corpus.

    Reads ``*.tiktoken`` and ``word_bpe*.json`` of the folder; a folder without either raises an error.
    """
    got = _DICTIONARIES.get(folder)
    if got is None:
        names = sorted(os.listdir(folder))
        found: set[str] = set()
        for name in names:
            path = os.path.join(folder, name)
            if name.endswith(".tiktoken"):
                with open(path, "rb") as f:
                    pieces = [base64.b64decode(x.split()[0]) for x in f]
                found |= {p[1:].decode("utf-8", "ignore").lower() for p in pieces if p[:1] == b" "}
            elif name.startswith("word_bpe") and name.endswith(".json"):
                with open(path, encoding="utf-8") as f:
                    found |= {w[:-4] for w in json.load(f)["model"]["vocab"] if w.endswith("</w>")}
        if not found:
            raise FileNotFoundError(f"no tokenizer vocabulary in {folder}")
        _DICTIONARIES[folder] = got = frozenset(w for w in found if len(w) >= 3 and w.isalpha())
    return got


def _entries() -> dict[str, tuple[str, float]]:
    out: dict[str, tuple[str, float]] = {}
    for (kind, weight), text in TERMS.items():
        for w in text.split():
            for form in (w, w + "s", w + "es"):
                out.setdefault(form, (kind, weight))
    return out


def _stem(form: str, entries: dict) -> str:
    """A plural's own term."""
    return next((x for x in (form.removesuffix("es"), form.removesuffix("s")) if x != form and x in entries), form)


class Lexicon:
    """Word -> term, by undressing and by the trie; phrases by their first word."""

    def __init__(self, ordinary: frozenset[str] = frozenset()):
        self.entries = _entries()
        # short terms have too many neighbours: they are met exactly or disguised, not misspelled
        self.trie = Trie({form: e for form, e in self.entries.items() if len(_stem(form, self.entries)) >= SHORTEST})
        self.ordinary_words = ordinary
        self.plain = {_fold(w): w for w in self.entries}
        self.phrases: dict[str, dict[str, list[tuple[tuple[str, ...], str, float]]]] = {}  # by first and second word
        for (kind, weight), text in PHRASES.items():
            for p in text.replace("\n", " ").split("|"):
                words = tuple(_fold(w) for w in p.split())
                self.phrases.setdefault(words[0], {}).setdefault(words[1] if len(words) > 1 else "*", []).append((words, kind, weight))
        self.masks: dict[tuple[str, int, str], str] = {}
        for w in sorted(self.entries, key=lambda w: -self.entries[w][1]):
            self.masks.setdefault((w[0], len(w), w[-1]), w)
        self.cells, self.shown = _Words(self), _Shown()
        self.stems = {w: _stem(w, self.entries) for w in self.entries}

    def ordinary(self, form: str) -> bool:
        """Whether a form is a word of its own: in the dictionary, as it stands or without an ending."""
        words = self.ordinary_words
        if form in words:
            return True
        for end in _ENDINGS:
            stem = form.removesuffix(end)
            if stem != form and len(stem) >= 3 and (stem in words or len(stem) > 3 and stem[-1] == stem[-2] and stem[:-1] in words):
                return stem not in self.plain
        return False

    def near(self, bare: str) -> str | None:
        """The term that a word without disguise is misspelled from, or None."""
        if not (SHORTEST <= len(bare) <= 24 and bare.isalpha()):
            return None
        return self.trie.near(bare, 1 if len(bare) < 9 else 2)

    def look_up(self, raw: str) -> tuple[str, str | None, bool]:
        """(word as it was meant, lexicon term or None, may start a phrase)."""
        word = raw.strip(_EDGE)
        low = word.lower()
        m = _MASK.match(low)
        if m:
            term = self.masks.get((m.group(1), len(low), m.group(3)))
            return (_fold(term) if term else low, term, True)
        if low.isascii() and low.isalpha():
            if low in self.plain:
                return low, self.plain[low], low in self.phrases
            if len(low) < 4:
                return low, None, low in self.phrases
        shown = _undress(word)
        other = _undress(word, "i") if "1" in word or "|" in word else shown
        for form in dict.fromkeys(_RUN.sub(x, y) for y in (shown, other) for x in (r"\1", r"\1\1")):
            if form in self.plain:
                return form, self.plain[form], True
        bare = shown if not _RUN.search(shown) else _RUN.sub(r"\1", shown)
        if bare in self.phrases or not bare:
            return bare, None, bool(bare)
        term = None if self.ordinary(low) or self.ordinary(bare) else self.near(bare)
        return (_fold(term), term, True) if term is not None else (bare, None, False)


class _Words(dict):
    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, raw: str) -> tuple[str, str | None, bool] | None:
        word, term, starts = self.lexicon.look_up(raw)
        got = (word, term, starts) if term is not None or starts else None
        if len(self) > 300_000:
            self.clear()
        self[raw] = got
        return got


class _Shown(dict):
    """Blank-separated word -> as phrases are compared with it."""

    def __missing__(self, raw: str) -> str:
        if len(self) > 300_000:
            self.clear()
        self[raw] = got = _fold(raw.strip(_EDGE)).replace("'", " ").split(" ")[-1].replace("-", "")
        return got


def _fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c)).replace("ß", "ss")


def _undress(word: str, one: str = "l") -> str:
    """A word without disguise: look-alikes, digits for letters, separators, invisible marks."""
    text = _HIDDEN.sub("", unicodedata.normalize("NFKC", word)).translate(_LOOK).lower()
    text = _fold(text)
    if any(c.isalpha() for c in text) and not text.isalpha():
        text = text.translate(_LEET) if one == "l" else text.replace("1", one).replace("|", one).translate(_LEET)
    return re.sub(r"[^a-z]", "", text)


def _phrase_end(words: list[str], at: int, phrase: tuple[str, ...]) -> int:
    """Where a phrase that starts at ``at`` ends, or 0; its own words must follow one another."""
    j = at
    for k, p in enumerate(phrase):
        if p == "*":
            nxt = phrase[k + 1]
            j = next((x for x in range(j + 1, min(j + 7, len(words))) if words[x] == nxt), 0)
            if not j:
                return 0
            continue
        if j >= len(words) or words[j] != p:
            return 0
        j += 1
    return j


class Scorer:
    def __init__(self, ordinary: frozenset[str] = frozenset()):
        self.lexicon = Lexicon(ordinary)

    def windows(self, text: str | None) -> list[tuple[float, str, int, int]]:
        """(score, kind, first word, past word) of each window of terms."""
        if not text:
            return []
        if not text.isascii():
            text = _HIDDEN.sub("", text)
        text = _SPACED.sub(lambda m: m.group().replace(" ", ""), text)
        raws = text.split()
        got = list(map(self.lexicon.cells.__getitem__, raws))
        spots = [i for i, g in enumerate(got) if g is not None]
        if not spots:
            return []
        hits: list[tuple[int, int, str, float, str]] = []
        shown, phrases, n = self.lexicon.shown, self.lexicon.phrases, len(raws)

        def word(i: int) -> str:
            g = got[i]
            return g[0] if g else shown[raws[i]]

        for i in spots:
            w, term, starts = got[i]
            if term is not None:
                kind, weight = self.lexicon.entries[term]
                hits.append((i, i + 1, kind, weight, self.lexicon.stems[term]))
            if starts and (by_next := phrases.get(w)) is not None:
                may = [*by_next.get(word(i + 1), ()), *by_next.get("*", ())] if i + 1 < n else by_next.get("*", ())
                if may:
                    near = [word(k) for k in range(i, min(i + 14, n))]
                    for phrase, kind, weight in may:
                        end = _phrase_end(near, 0, phrase)
                        if end:
                            hits.append((i, i + end, kind, weight, " ".join(phrase)))
        out = []
        hits.sort()
        k = 0
        while k < len(hits):
            group = [hits[k]]
            k += 1
            # a window goes on while terms follow closely and no sentence ends between
            while k < len(hits) and hits[k][0] - group[-1][1] <= REACH and not _stops(raws, group[-1][1] - 1, hits[k][0]):
                group.append(hits[k])
                k += 1
            out.append(self._score(group, raws, word))
        return out

    def _score(self, group, raws, word) -> tuple[float, str, int, int]:
        first, past = group[0][0], max(g[1] for g in group)
        kinds: Counter = Counter()
        for term, kind, weight in {(g[4], g[2], g[3]) for g in group}:
            kinds[kind] += weight
        total = sum(kinds.values())
        a, b = _sentence(raws, first, past)
        around = [word(i) for i in range(max(a, first - AROUND), min(b, past + AROUND))]
        if kinds["insult"] + kinds["hate"] and any(w in DIRECT for w in around):
            total += 0.5
        distant = sum(w in DISTANT for w in set(around))
        return round(total - 1.5 * distant, 3), max(kinds, key=lambda c: (kinds[c], c)), first, past


def _stops(raws: list[str], a: int, b: int) -> bool:
    return any(raws[i][-1] in ".!?" or raws[i][-2:] in ('."', '.”', '!”', '?”') for i in range(a, b) if not re.match(r"^(?:[a-z]\.)+$", raws[i]) and len(raws[i]) > 1)


def _sentence(raws: list[str], first: int, past: int) -> tuple[int, int]:
    a = first
    while a > 0 and first - a < AROUND and raws[a - 1][-1] not in ".!?":
        a -= 1
    b = past
    while b < len(raws) and b - past < AROUND and raws[b - 1][-1] not in ".!?":
        b += 1
    return a, b


def score(df: DataFrame, key: str, text: str, keep: tuple[str, ...] = (), threshold: float = THRESHOLD, tokenizers: str = TOKENIZERS) -> DataFrame:
    """``key``, ``keep``, score (of the worst window, 0 where there is none), kind, windows at or over the threshold.

    Every row comes out: null and empty texts with score 0. Texts are scored whole; copies
    score alike; extra columns are ignored unless kept. ``tokenizers`` is the folder whose
    vocabularies tell ordinary words, read on the driver; no pass over the corpus is needed.
    """
    shared = df.sparkSession.sparkContext.broadcast(dictionary(tokenizers))  # as large as the vocabularies, whatever the corpus
    types = dict(df.dtypes)
    cols = [key, *keep]
    schema = ", ".join(f"c{i} {types[c]}" for i, c in enumerate(cols)) + ", score double, kind string, n_windows int"

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for pdf in batches:
            best, kinds, n = [], [], []
            for t in pdf["t"]:
                found = scorer.windows(t)
                worst = max(found, default=(0.0, None, 0, 0), key=lambda w: w[0])
                best.append(max(worst[0], 0.0))
                kinds.append(worst[1] if worst[0] >= threshold else None)
                n.append(sum(w[0] >= threshold for w in found))
            out = pdf.drop(columns=["t"])
            out["score"], out["kind"], out["n_windows"] = best, kinds, n
            yield out

    work = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)], F.col(text).alias("t")).mapInPandas(judge, schema)
    return work.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)], "score", "kind", "n_windows")
