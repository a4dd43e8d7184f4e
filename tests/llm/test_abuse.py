import random

import pytest

from strata.llm import abuse

BAD = [
    "Get lost, bastard.", "You are nothing but a filthy weasel and I hope you lose everything.", "Shut your mouth, you br@1nd3@d cl0wn, nobody asked for your opinion.", "Drop dead, all of you path​etic to​ads.",
    "Only a b a s t a r d would write something this dumb, do us all a favor and disappear.", "The moderator is a DISGUSTING tooooad and should crawl back under a rock.", "S***W YOU AND YOUR F_A_T MEETING, YOU DIRTBAG.", "Get lost, cоwаrd.",
    "If the clerk shows up again somebody will make them regret it.", "Those refugees breed like filthy parasites, send every last one of them away.", "Hot singles over 30 want sex now, send a nude pic to line 672.", "Er0t1c massage by mature escorts, happy ending included.",
    "Cállate, imbécil, eres una basura inútil.", "Ferme ta gueule, espèce de crétin inutile.", "Halt die Klappe, du widerlicher Vollidiot.", "You are a worthles imbecil and a lowsy moron.",
]
GOOD = [
    None, "", " ", "The policy on respect says that calling a classmate an idiot, a loser or worse leads to a meeting with the mentor teacher.", "The drama script includes the line, go to hell, which the principal asked to soften.",
    "In the novel the villain shouts that he will make the town regret it, and readers discuss why.", "The farm unit names the parts of a pig and explains why rats breed quickly.", "I am furious about route 827; the new time is unfair, and I expect an answer.",
    "The grade 9 health unit covers consent, puberty and sexual health with forms due March 10.", "Students studied how propaganda once called newcomers vermin and how such speech led to violence.", "The strip of land and the naked branches in the photo set the mood.",
    "Please sign the updated forms and terms before the class meets in the lab.", "word " * 50_000,
]


SCORER = abuse.Scorer(abuse.dictionary())


@pytest.mark.parametrize("text", BAD)
def test_bad(text):
    assert max((w[0] for w in SCORER.windows(text)), default=0) >= abuse.THRESHOLD


@pytest.mark.parametrize("text", GOOD)
def test_good(text):
    assert max((w[0] for w in SCORER.windows(text)), default=0) < abuse.THRESHOLD


def distance(a, b):
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_trie_equals_brute_force():
    rng = random.Random(1)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 7))): ("k", 1.0) for _ in range(60)}
    trie = abuse.Trie(words)
    for _ in range(300):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 8)))
        best = min(((distance(w, x), x) for x in words), default=(9, None))
        assert trie.near(w, 2) == (best[1] if best[0] <= 2 else None)


def test_frame(spark):
    texts = [*BAD[:3], None, "", BAD[0], GOOD[3], "A plain note. " * 5000 + BAD[4]]
    df = spark.createDataFrame([(i, "s" if i % 2 else None, t, 7) for i, t in enumerate(texts)], "doc_id bigint, source string, text string, score int")
    got = {r.doc_id: r for r in abuse.score(df, "doc_id", "text", ("source",)).collect()}
    assert len(got) == len(texts)
    assert {k for k, r in got.items() if r.n_windows} == {0, 1, 2, 5, 7} and got[3].score == got[4].score == 0.0
    assert abuse.score(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("times", [5, 20, 2000])
def test_misspellings_are_met_however_often_they_come(spark, times):
    """No count decides, neither of copies nor of different texts; ordinary words stay ordinary."""
    texts = ["You are an idoit and a mroon."] * times + [f"Room {i}: you wdiot, you qastard." for i in range(times)] + ["You are a worthless basterd."]
    texts += [f"Page {i} of the wordlist: where your words and worms trotted, les fiches." for i in range(times)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    assert {r.doc_id for r in abuse.score(df, "doc_id", "text").where("n_windows > 0").collect()} == set(range(2 * times + 1))


def test_a_folder_without_vocabulary_is_an_error(tmp_path):
    with pytest.raises(FileNotFoundError):
        abuse.dictionary(str(tmp_path))
