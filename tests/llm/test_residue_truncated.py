import numpy as np
import pytest

from strata.llm import residue, truncated

FIELDS = ("title", "summary")


@pytest.mark.parametrize(
    "text",
    [
        "Lorem ipsum dolor sit amet", "{{school_name}}", "Ashgrove news for ${author}", "Dear families, <%= post.excerpt %>: hello", "[Your headline here]", "__EVENT_START__", "%(title)s", "A [INSERT TITLE] center",
        "404 Not Found", "502 Bad Gateway Contact the webmaster if this persists.", "Please enable JavaScript to view this page.", "Real news here. JavaScript is disabled. Some features will not work.", "undefined", "[object Object]",
        "Se produjo un error interno. Inténtelo más tarde.", "Página no encontrada [f363d0]", "asdf asdf asdf", "TODO: write summary before publishing", "Traceback (most recent call last): KeyError: 'x'", "NaN", "Elit elit nostrud amet elit.",
        "Checking your browser before you continue. This takes a few seconds.",
    ],
)
def test_residue(text):
    assert residue.Index().match(text) is not None


@pytest.mark.parametrize(
    "text",
    [
        None, "", " ", "The library explains on January 19 what a 404 Not Found message means to grade 4 researchers.", "The club shows how a template slot such as {{first_name}} is filled for 331 letters.",
        "Forms with a bracket such as [name] left blank will be returned.", "Students drafted “Insert your dream here” cards for the math bowl, and 508 were read aloud.", "A grant pays for 612 placeholder seats, to be assigned after the lottery.",
        "The writing club will enable scripts on 428 robots so they can practice.", "Under construction until May 17: the cafeteria, so grade 8 meets elsewhere.", "An outage left visitors with an access denied message for 38 minutes; service is back.", "word " * 20_000,
    ],
)
def test_news(text):
    assert residue.Index().match(text) is None


def test_room_never_hides_a_match():
    """The quick look at a passage's room lets everything through that the full comparison would take."""
    index = residue.Index()
    for e in index.exemplars:
        text = " ".join("thing" if w == "*" else "7" if w == "#" else w for w in e)
        if index._passage(text):
            assert index._suspect(text), text


def test_residue_frame(spark):
    df = spark.createDataFrame([(1, "null", None, "x"), (2, "Fine news", "404 Not Found", "y"), (2, "Fine news", "404 Not Found", "y"), (3, None, None, None), (4, "NaN", "NaN", "z")], "n bigint, title string, summary string, field string")
    got = residue.find_residue(df, "n", FIELDS).where("first_of_row").select("n").collect()
    assert sorted(r.n for r in got) == [1, 2, 2, 4]
    assert residue.find_residue(df.limit(0), "n", FIELDS).count() == 0


def _judge(text, char_limit=None, byte_limit=None):
    corpus = ["The board met in the music room. Families of grade 9 students came on July 4, 2025."] * 40 + ["More news at the music room. Tickets $5"] * 20
    why, end = truncated.judge_end(text, char_limit, byte_limit, residue.Index())
    if why or not end:
        return why
    coder = truncated._Coder()
    counts = {k: (n, e, o) for k, n, e, o in zip(*map(list, truncated._counted(*truncated._contexts(corpus, coder))))}
    one, two, three = (counts.get(k, (0, 0, 0)) for k in truncated._context(end, coder))
    return None if truncated._whole(one, two, three, bool(truncated.LABEL.search(end))) else "unfinished"


@pytest.mark.parametrize(
    "text,why",
    [
        (None, None), ("", None), ("  \n", None), ("The board met in the music room.", None), ("The board met in the music room", None), ("The board met in the mus", "unfinished"), ("The board met in…", "mark"), ("The board met [...]", "mark"),
        ("The board… Read more", "mark"), ("The board met [&#8230;]", "mark"), ('The board met <a href="https:/', "markup"), ("<p>The board met in the music room.</p>", None), ("<p>The board met in the music room.", "markup"), ("The board met in the caf�", "escape"),
        ("The board met in the music room. Tickets $5", None), ("The board (in the music room", "bracket"), ("“The board met in the music room.", "quote"), ("Could not connect to the database. [09ff96]", None), ("“All met in the music room”", None),
    ],
)
def test_truncated(text, why):
    assert _judge(text) == why


def test_limits():
    text = "The board met in the music room"
    assert _judge(text, len(text)) == "limit" and _judge(text, None, len(text)) == "limit" and _judge(text, len(text) + 5) is None


def test_truncated_frame(spark):
    long = "Families of grade 9 students came to the music room on July 4, 2025 and "
    rows = [(i, "f", (long * 3)[:120]) for i in range(6)] + [(10, "f", None), (11, None, "One of the rooms is closed."), (12, "g", ""), (13, "f", "Short one.")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "n bigint, feed string, text string, reason string")
    got = {r.n: r.reason for r in truncated.find_truncated(df, "n", "text", "feed").collect()}
    assert got == {i: "limit" for i in range(6)}
    assert truncated.find_truncated(df.limit(0), "n", "text", "feed").count() == 0
