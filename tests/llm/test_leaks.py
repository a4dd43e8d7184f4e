import random

import pytest

from strata.llm import leaks

ITEMS = [
    "Directions: study the text before you select.\nThe mapmaker numbered satchels and Pascoe rescued the velvet umbrella across the lantern. What did the drummer do after that?\nA. the rowboat\nB. the harbor",
    "Directions: study the text before you select.\nNobody knew why the glazier traded hollow trellis near the feather. The borrowed notebook stood toward the cracked sundial.\nA. x\nB. y",
    "Directions: study the text before you select.\nBy noon the amber painter sold one beehive beyond the silent trellis for Oriel.\nA. x\nB. y",
]


def test_stems_drop_directions_and_options():
    s = leaks.stems(ITEMS)
    assert s[0][:2] == ["the", "mapmaker"] and s[0][-1] == "that" and s[2][-1] == "oriel"


def test_matches_equal_brute_force():
    """Every place where an item's match of SEED words or more can't go on, of each item by itself."""
    rng = random.Random(3)
    for _ in range(80):
        items = [[rng.choice("ab") for _ in range(rng.randrange(1, 14))] for _ in range(3)]
        doc = [rng.choice("aabbc") for _ in range(40)]
        a = leaks.Automaton(items)
        got = sorted(set(a.seeds([a.ids.get(w, -1) for w in doc])))
        want = sorted(
            (i, k, j)
            for i, t in enumerate(items)
            for k in range(leaks.SEED - 1, len(t))
            for j in range(leaks.SEED, len(doc) + 1)
            if t[k + 1 - leaks.SEED : k + 1] == doc[j - leaks.SEED : j] and (k + 1 == len(t) or j == len(doc) or t[k + 1] != doc[j])
        )
        assert got == want


def test_inner_matches_of_other_items_are_met():
    """An item that shares the inner part of another's passage is met where the document holds the other whole."""
    words = [f"w{i}" for i in range(40)]
    a = leaks.Automaton([words, ["x", "y", *words[8:30], "z"]])
    assert {i for i, (share, _) in a.leaks(["q", *words, "q"]).items() if share >= 0.5} == {0, 1}


@pytest.mark.parametrize("pieces", [1, 2, 3, 6])
def test_pieces_count_together(pieces):
    words, other = [f"w{i}" for i in range(60)], [f"o{i}" for i in range(12)]
    n = 60 // pieces
    doc = [w for k in range(pieces) for w in [*other, *words[k * n : (k + 1) * n]]]
    share, spans = leaks.Automaton([words]).leaks(doc)[0]
    assert share == 1.0 and len(spans) == pieces and sum(b - a for a, b in spans) == 60


def test_every_fifth_word_exchanged():
    words = [f"w{i}" for i in range(60)]
    doc = [f"o{i}" if i % 5 == 4 else w for i, w in enumerate(words)]
    assert leaks.Automaton([words]).leaks(doc)[0][0] >= 0.9


def test_leaks():
    s = leaks.stems(ITEMS)
    a = leaks.Automaton(s)
    got = lambda t: {i for i, (share, _) in a.leaks(leaks.words(t)).items() if share >= 0.5}
    text = ITEMS[0].split("\n")[1]
    assert got("intro " + text + " outro") == {0}
    assert got("intro " + text.upper().replace(" ", "\n  ") + "!") == {0}
    w = text.split()
    assert got(" ".join(w[: len(w) // 2 + 1])) == {0} and got(" ".join(w[: len(w) // 3])) == set()
    assert got(" ".join(w[:7]) + " some other words that are not there at all " + " ".join(w[10:20])) == {0}
    w[4], w[9] = "certain", "plain"
    assert got(" ".join(w)) == {0}
    assert got("Directions: study the text before you select. Nobody knew why the glazier slept.") == set()
    assert got("") == set() and got(None) == set()


def test_frame(spark):
    docs = spark.createDataFrame([(1, "x " + ITEMS[1].split("\n")[1], 0.0), (2, None, 0.0), (3, "", 0.0), (4, "x " + ITEMS[1].split("\n")[1], 0.0), (5, "word " * 100_000, 0.0)], "doc_id bigint, text string, share double")
    items = spark.createDataFrame([(i, t) for i, t in enumerate(ITEMS)] + [(9, ITEMS[1]), (10, None), (11, "too short")], "item_id bigint, text string")
    found = leaks.find_leaks(docs, "doc_id", "text", items, "item_id", "text")
    assert sorted((r.item_id, r.doc_id) for r in found.collect()) == [(1, 1), (1, 4), (9, 1), (9, 4)]
    clean = {r.doc_id: r.clean for r in leaks.without_leaks(docs, "doc_id", "text", found).collect()}
    assert clean == {1: "x .", 4: "x ."}
    assert leaks.find_leaks(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert leaks.find_leaks(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ITEMS[i % 3].split("\n")[1]) for i in range(6)], "doc_id bigint, text string")
    items = spark.createDataFrame([(i, t) for i, t in enumerate(ITEMS)], "item_id bigint, text string")
    one = sorted(map(tuple, leaks.find_leaks(docs, "doc_id", "text", items, "item_id", "text").select("item_id", "doc_id").collect()))
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 20)
    assert one == sorted(map(tuple, leaks.find_leaks(docs, "doc_id", "text", items, "item_id", "text").select("item_id", "doc_id").collect()))
