"""Mixed timestamp formats and zones, normalised to one UTC instant.

Every value yields an array of all its valid readings (format, instant, cost): every form it
has, both orders of slashed and dotted dates, both folds of a repeated hour, an abbreviation
as its own offset or as what the source's zone calls so. The readings of a source are chosen
together by Viterbi over the record order: a change of format and a step back in time cost,
as does a reading against convention. A convention that is stated for good has a cost no
chain outweighs; one that is left open ("auto") gives way to the source's own records.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Zone abbreviations and their own offsets in minutes.
ABBREVIATIONS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "est": -300, "edt": -240, "cst": -360, "cdt": -300,
    "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "ast": -240,
    "adt": -180, "cet": 60, "cest": 120, "bst": 60, "west": 60, "eet": 120, "eest": 180,
}
# Month names, English and Spanish.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10,
    "nov": 11, "dec": 12, "january": 1, "february": 2, "march": 3, "april": 4, "june": 6, "july": 7, "august": 8,
    "september": 9, "october": 10, "november": 11, "december": 12, "enero": 1, "febrero": 2, "marzo": 3, "abril": 4,
    "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11,
    "diciembre": 12,
}

_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?"
_HALF = r"(?:\s*(?P<half>[ap])\.?\s?m\.?)?"
_ZONE = r"(?:\s*(?P<zone>[+-]\d{2}:?\d{2}|[+-]\d{2}|[a-z]{1,4}))?(?:\s*\[(?P<region>[a-z0-9_+/\-]+)\])?"
_DOW = r"(?:(?:mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun)[a-z]*\.?,?\s+)?"
_FORMS = [
    ("iso", rf"(?P<y>\d{{4}})-(?P<m>\d{{1,2}})-(?P<d>\d{{1,2}})(?:(?:t|\s+){_TIME}{_HALF}{_ZONE})?"),
    ("basic", r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?:t?(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?:[.,](?P<f>\d+))?)?(?P<zone>z|[+-]\d{2}:?\d{2})?"),
    ("rfc", rf"{_DOW}(?P<d>\d{{1,2}})[\s-](?P<mon>[a-z]{{3,9}})\.?[\s-](?P<y>\d{{4}}|\d{{2}})(?:,?\s+{_TIME}{_HALF}{_ZONE})?"),
    ("asctime", rf"{_DOW}(?P<mon>[a-z]{{3,9}})\s+(?P<d>\d{{1,2}})\s+{_TIME}(?:\s+(?P<zone>[a-z]{{1,4}}))?\s+(?P<y>\d{{4}})"),
    ("month", rf"{_DOW}(?P<mon>[a-z]{{3,9}})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}})(?:,?\s+(?:at\s+)?{_TIME}{_HALF}{_ZONE})?"),
    ("spanish", rf"(?:[a-záéíóú]+,\s+)?(?P<d>\d{{1,2}})\s+de\s+(?P<mon>[a-z]{{4,10}})\s+del?\s+(?P<y>\d{{4}})(?:,?\s+(?:a\s+las\s+)?{_TIME}{_HALF}{_ZONE})?"),
    ("slash", rf"(?P<a>\d{{1,2}})/(?P<b>\d{{1,2}})/(?P<y>\d{{4}}|\d{{2}})(?:,?\s+{_TIME}{_HALF}{_ZONE})?"),
    ("slash_ymd", rf"(?P<y>\d{{4}})/(?P<m>\d{{1,2}})/(?P<d>\d{{1,2}})(?:,?\s+{_TIME}{_HALF}{_ZONE})?"),
    ("dot", rf"(?P<a>\d{{1,2}})\.(?P<b>\d{{1,2}})\.(?P<y>\d{{4}}|\d{{2}})(?:,?\s+{_TIME}{_HALF}{_ZONE})?"),
]
FORMS = [(n, re.compile(p)) for n, p in _FORMS]
EPOCH = re.compile(r"(\d{9,10}|\d{12,13}|\d{15,16}|\d{18,19})(?:\.(\d+))?")
_ZERO = datetime(1970, 1, 1)
_US = timedelta(microseconds=1)


@lru_cache(maxsize=4096)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:  # an unknown or malformed zone name is no zone
        return None


@lru_cache(maxsize=200_000)
def _region_offsets(name: str, quarter: datetime) -> tuple[int, ...]:
    """Offsets in seconds at a wall clock quarter: the earlier one first, the later one too where the hour comes twice."""
    zone = _zone(name)
    if zone is None:
        return ()
    first, second = (int(quarter.replace(tzinfo=zone, fold=f).utcoffset().total_seconds()) for f in (0, 1))
    # in a gap the offset before it holds, which moves the time forward by the gap
    return (first, second) if first > second else (first,)


def _instants(wall: datetime, region: str) -> list[int]:
    # offsets change on quarter hours only, so the quarter is what is looked up
    quarter = wall.replace(minute=wall.minute // 15 * 15, second=0, microsecond=0)
    return [(wall - _ZERO) // _US - off * 1_000_000 for off in _region_offsets(region, quarter)]


def _civil(g: dict, year: int, month: int, day: int, zone_name: str | None) -> list[tuple[int, str]]:
    """All instants (microseconds since the epoch, how read) that the parts may name; the conventional one first."""
    hour, minute, second = int(g.get("h") or 0), int(g.get("mi") or 0), int(g.get("s") or 0)
    half = g.get("half")
    if half:
        if not 1 <= hour <= 12:
            return []
        hour = hour % 12 + (12 if half == "p" else 0)
    micros = int(((g.get("f") or "") + "000000")[:6])
    try:
        wall = datetime(year, month, day, hour, minute, second, micros)
    except ValueError:
        return []
    mark, region = g.get("zone"), g.get("region")
    if mark:
        if mark[0] in "+-":
            digits = mark[1:].replace(":", "")
            hours, minutes = int(digits[:2]), int(digits[2:] or 0)
            if hours > 18 or minutes > 59:
                return []
            return [((wall - _ZERO) // _US - (hours * 60 + minutes) * (-60_000_000 if mark[0] == "-" else 60_000_000), "")]
        if mark not in ABBREVIATIONS:
            return []
        fixed = (wall - _ZERO) // _US - ABBREVIATIONS[mark] * 60_000_000
        # an abbreviation may merely name the source's own zone, whatever the season
        local = [us for us in (_instants(wall, zone_name) if zone_name and ABBREVIATIONS[mark] else []) if 0 < abs(us - fixed) <= 3_600_000_000]
        return [(fixed, ""), *[(us, "~zone") for us in local[:1]]]
    name = _canonical(region) if region else zone_name
    return [] if name is None else [(us, "~later" if k else "") for k, us in enumerate(_instants(wall, name))]


@lru_cache(maxsize=4096)
def _canonical(lowered: str) -> str:
    """Zone names arrive lowered with the rest of the value."""
    if lowered in ("utc", "gmt", "z"):
        return "UTC"
    return "/".join("_".join(w[:1].upper() + w[1:] for w in part.split("_")) for part in lowered.split("/"))


STATED, LEANING = 1e9, 0.25  # cost of a reading against a convention stated for good, and against a mere preference


def readings(value: str | None, zone: str | None, slash: str = "mdy", dot: str = "dmy", fold: str = "first", mark: str = "fixed") -> list[tuple[str, int, float]]:
    """All valid readings of one value: (format, microseconds UTC, cost against convention).

    ``zone`` is the wall time's zone for values that name none; null means such values
    have no reading. ``slash`` and ``dot`` are 'mdy', 'dmy' or 'auto', ``fold`` is 'first' or
    'auto', ``mark`` (zone abbreviations) 'fixed' or 'auto'; 'auto' leaves the choice to the
    source's other records. Readings against a stated convention are listed at a cost of
    STATED; ``viterbi`` never takes one.
    """
    if value is None:
        return []
    text = " ".join(value.split()).lower()
    if not text or not any(map(str.isdigit, text)):
        return []
    m = EPOCH.fullmatch(text)
    if m:
        digits, tail = m.group(1), m.group(2) or ""
        unit = {9: 0, 10: 0, 12: 3, 13: 3, 15: 6, 16: 6, 18: 9, 19: 9}[len(digits)]
        return [(f"epoch{unit}", int(digits + tail.ljust(9, "0")[: 6 - unit]) if unit <= 6 else int(digits) // 1000, 0.0)]
    against = {"~later": STATED if fold == "first" else LEANING, "~zone": STATED if mark == "fixed" else LEANING, "": 0.0}
    out = []
    for name, form in FORMS:
        m = form.fullmatch(text)
        if not m:
            continue
        g = m.groupdict()
        year = int(g["y"]) + (2000 if len(g["y"]) == 2 else 0)
        if "a" in g:
            a, b = int(g["a"]), int(g["b"])
            order = slash if name == "slash" else dot
            usual = order if order != "auto" else "mdy" if name == "slash" else "dmy"
            cost = LEANING if order == "auto" else STATED
            ways = [(a, b, "mdy", 0.0 if usual == "mdy" else cost), (b, a, "dmy", 0.0 if usual == "dmy" else cost)]
        elif "mon" in g:
            if g["mon"] not in MONTHS:
                continue
            ways = [(MONTHS[g["mon"]], int(g["d"]), "", 0.0)]
        else:
            ways = [(int(g["m"]), int(g["d"]), "", 0.0)]
        for month, day, how, cost in ways:
            out += [(name + how + read, us, cost + against[read]) for us, read in _civil(g, year, month, day, zone)]
    return out


SWITCH_COST, BACK_COST, BACK_FREE_US = 1.0, 0.5, 2 * 86_400_000_000


def viterbi(lists: list[list[tuple[str, int, float]]]) -> list[tuple[str, int] | None]:
    """One reading for each record of a source, in record order; None where there is none.

    Readings against a stated convention are no states. Records with one state cut the
    chain: only the stretches between them are searched.
    """
    chosen: list[tuple[str, int] | None] = [None] * len(lists)
    layer: list[tuple[float, str, int]] = []  # cost, format, instant of each state of the last record that has any
    trail: list[tuple[int, list[int], list]] = []

    def settle() -> None:
        if not trail:
            return
        best = min(range(len(layer)), key=lambda i: (layer[i][0], i))
        for at, back, states in reversed(trail):
            chosen[at] = states[best][:2]
            best = back[best] if back else 0
        trail.clear()

    for at, every in enumerate(lists):
        states = [x for x in every if x[2] < STATED]
        if not states:
            continue
        back, fresh = [], []
        for fmt, us, cost in states:
            ways = [c + SWITCH_COST * (f != fmt) + BACK_COST * (us < t - BACK_FREE_US) for c, f, t in layer]
            j = min(range(len(ways)), key=lambda i: (ways[i], i)) if ways else 0
            back.append(j)
            fresh.append(((ways[j] if ways else 0.0) + cost, fmt, us))
        trail.append((at, back if layer else [], states))
        layer = fresh
        if len(states) == 1:
            settle()
            layer = [(0.0, *states[0][:2])]
    settle()
    return chosen


def normalise(
    df: DataFrame,
    value: str,
    source: str,
    order: str,
    zone: str | None,
    keep: tuple[str, ...] = (),
    default_zone: str | None = None,
    slash: str = "mdy",
    dot: str = "dmy",
    fold: str = "first",
    mark: str = "fixed",
    block: int = 65_536,
) -> DataFrame:
    """``keep`` columns plus ``reading`` (format) and ``utc_us`` for each value that names a moment.

    ``order`` is a bigint record number. A source is worked in blocks of ``block`` record
    numbers, so a source that holds a third of all rows is spread over many tasks; the
    chain starts anew at a block, which can only matter for readings that are ambiguous
    before the block's first unambiguous record. Values that are null, no date or an
    impossible date give no row; a null source is a source of its own; repeated rows are
    each read; extra columns are ignored unless named in ``keep``.
    """
    zone_col = F.col(zone) if zone else F.lit(None).cast("string")
    if default_zone is not None:
        zone_col = F.coalesce(zone_col, F.lit(default_zone))
    keep = tuple(keep)
    work = df.where(F.col(value).isNotNull()).select(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)],
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s"),
        F.coalesce(F.col(order).cast("bigint"), F.lit(0)).alias("o"),
        zone_col.alias("z"),
        F.col(value).cast("string").alias("v"),
    ).withColumn("b", F.expr(f"o div {int(block)}"))
    types = dict(df.dtypes)
    out_schema = ", ".join([f"k{i} {types[k]}" for i, k in enumerate(keep)] + ["reading string", "utc_us bigint"])
    n_keep = len(keep)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows, lists, done = None, [], [], []

        def settle() -> None:
            done.extend((*r, *c) for r, c in zip(rows, viterbi(lists)) if c is not None)
            rows.clear()
            lists.clear()

        def emit() -> pd.DataFrame:
            out = pd.DataFrame(done, columns=[f"k{i}" for i in range(n_keep)] + ["reading", "utc_us"])
            done.clear()
            return out

        for pdf in batches:
            kept = list(zip(*[pdf[f"k{i}"] for i in range(n_keep)])) if n_keep else [()] * len(pdf)
            for k, s, b, z, v in zip(kept, pdf["s"], pdf["b"], pdf["z"], pdf["v"]):
                if (s, b) != now:
                    settle()
                    now = (s, b)
                rows.append(k)
                lists.append(readings(v, z, slash, dot, fold, mark))
            if len(done) > 20_000:
                yield emit()
        settle()
        if done:
            yield emit()

    got = work.repartition("s", "b").sortWithinPartitions("s", "b", "o").mapInPandas(choose, out_schema)
    return got.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], "reading", "utc_us")
