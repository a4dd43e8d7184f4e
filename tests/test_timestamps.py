from datetime import datetime, timezone
from itertools import product

import pytest

from strata.operators.timestamps import BACK_COST, BACK_FREE_US, STATED, SWITCH_COST, normalise, readings, viterbi


def us(text):
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp() * 1_000_000)


@pytest.mark.parametrize(
    "value,zone,utc",
    [
        ("Sun, 01 Sep 2024 22:37:46 -0500", None, "2024-09-02T03:37:46"),
        ("Mon, 2 Sep 2024 01:57:45 GMT", None, "2024-09-02T01:57:45"),
        ("2024-09-01", "America/New_York", "2024-09-01T04:00:00"),
        ("09/01/2024 17:01:48", "UTC", "2024-09-01T17:01:48"),
        ("9/18/2024 4:19 AM", "America/Chicago", "2024-09-18T09:19:00"),
        ("23.11.2024 06:01", "Europe/Berlin", "2024-11-23T05:01:00"),
        ("2024-09-02T04:30:20.213011675Z", None, "2024-09-02T04:30:20.213011"),
        ("1725241366520", None, "2024-09-02T01:42:46.520000"),
        ("1726668719", None, "2024-09-18T14:11:59"),
        ("2024-08-30T19:55:19[America/New_York]", None, "2024-08-30T23:55:19"),
        ("18 Sep 24 04:00 -0600", None, "2024-09-18T10:00:00"),
        ("Jan 14, 2024 3:03 AM MST", "America/New_York", "2024-01-14T10:03:00"),
        ("Jul 14, 2024 3:03 AM MST", "America/New_York", "2024-07-14T10:03:00"),
        ("December 8, 2024 6:19 p.m.", "UTC", "2024-12-08T18:19:00"),
        ("21 de octubre de 2024, 10:58", "UTC", "2024-10-21T10:58:00"),
        ("Wed Dec  3 17:37:44 2025", "UTC", "2025-12-03T17:37:44"),
        ("Friday, 23-May-25 18:25:13 GMT", None, "2025-05-23T18:25:13"),
        ("20240902T032549Z", None, "2024-09-02T03:25:49"),
        ("\n  2025-05-08\n", "UTC", "2025-05-08T00:00:00"),
        ("2025-11-02 01:30", "America/New_York", "2025-11-02T05:30:00"),  # twice: the first
        ("2025-03-09 02:30", "America/New_York", "2025-03-09T07:30:00"),  # skipped: moved forward
    ],
)
def test_forms(value, zone, utc):
    assert [r[1] for r in readings(value, zone) if r[2] < STATED] == [us(utc)]


def test_all_readings_are_listed():
    """Both date orders, both folds, and an abbreviation as the source's own zone; those against a stated convention never win."""
    got = lambda v, z, **k: {(r[0], r[1], r[2] < STATED) for r in readings(v, z, **k)}
    assert got("02/03/2024", "UTC") == {("slashmdy", us("2024-02-03"), True), ("slashdmy", us("2024-03-02"), False)}
    assert got("02/03/2024", "UTC", slash="auto") == {("slashmdy", us("2024-02-03"), True), ("slashdmy", us("2024-03-02"), True)}
    assert got("2025-11-02 01:30", "America/New_York") == {("iso", us("2025-11-02T05:30:00"), True), ("iso~later", us("2025-11-02T06:30:00"), False)}
    assert got("Jul 14, 2024 3:03 AM EST", "America/New_York", mark="auto") == {("month", us("2024-07-14T08:03:00"), True), ("month~zone", us("2024-07-14T07:03:00"), True)}
    assert viterbi([readings("13/02/2024", "UTC")]) == [None]


def test_order_decides_repeated_hours():
    """With folds left open the source's order tells the second pass through a repeated hour."""
    values = ["2025-11-02 00:30", "2025-11-02 01:30", "2025-11-02T06:10:00Z", "2025-11-02 01:40", "2025-11-02 02:10"]
    lists = [readings(v, "America/New_York", fold="auto") for v in values]
    assert viterbi(lists)[1] == ("iso", us("2025-11-02T05:30:00"))


@pytest.mark.parametrize("value", [None, "", "  ", "TBD", "n/a", "yesterday", "25:61", "2026-13-05", "2025-02-30T10:00:00Z", "0000-00-00T00:00:00Z", "Thu, 32 Jan 2026 10:00:00 GMT", "13/13/2024", "9" * 4000])
def test_no_moment(value):
    assert [r for r in readings(value, "UTC") if r[2] < STATED] == []


def test_wall_time_needs_a_zone():
    assert readings("2024-09-01 10:00", None) == []
    assert readings("2024-09-01 10:00Z", None) != []


def brute(lists):
    at = [i for i, x in enumerate(lists) if x]
    best = None
    for way in product(*[lists[i] for i in at]):
        cost = sum(w[2] for w in way) + sum(SWITCH_COST * (a[0] != b[0]) + BACK_COST * (b[1] < a[1] - BACK_FREE_US) for a, b in zip(way, way[1:]))
        if best is None or cost < best[0] - 1e-12:
            best = (cost, way)
    return best[0]


def cost_of(lists, chosen):
    way = []
    for x, c in zip(lists, chosen):
        if c is not None:
            way.append(next(r for r in x if r[:2] == c))
    return sum(w[2] for w in way) + sum(SWITCH_COST * (a[0] != b[0]) + BACK_COST * (b[1] < a[1] - BACK_FREE_US) for a, b in zip(way, way[1:]))


def test_viterbi_is_optimal():
    import random

    rng = random.Random(5)
    for _ in range(200):
        lists = [[(f, rng.randrange(10) * BACK_FREE_US, rng.choice([0.0, 0.25])) for f in rng.sample("abc", rng.randrange(3))] for _ in range(6)]
        if any(lists):
            assert cost_of(lists, viterbi(lists)) == pytest.approx(brute(lists))
    assert viterbi([[], []]) == [None, None]


def test_order_decides_ambiguous_dates(spark):
    rows = [("f", 1, "25/01/2024", "x"), ("f", 2, "02/02/2024", "x"), ("f", 3, "13/02/2024", "x"), (None, 4, "2024-01-01", "y"), ("f", 5, None, "z"), ("f", 2, "02/02/2024", "x")]
    df = spark.createDataFrame(rows, "source string, n bigint, value string, utc_us string")  # a clashing extra column
    got = normalise(df, "value", "source", "n", None, ("n",), "UTC", slash="auto").collect()
    assert sorted((r.n, r.reading) for r in got) == [(1, "slashdmy"), (2, "slashdmy"), (2, "slashdmy"), (3, "slashdmy"), (4, "iso")]
    fixed = normalise(df, "value", "source", "n", None, ("n",), "UTC").collect()
    assert sorted(r.n for r in fixed) == [2, 2, 4]
    assert normalise(df.limit(0), "value", "source", "n", None, ("n",), "UTC").count() == 0
