"""Instants from the date texts of feeds and files, as native column expressions.

A text is read by its parts, not by whole forms: the clock is found first, then the offset that
follows it, then what is left must be numbers, at most one month name and known zone names. The
numbers are told apart by their length and place. Missing parts are the first month, the first
day and midnight.

All results are UTC timestamps without zone. A text without a zone is UTC. A text with a word that is
no month, weekday or known zone, with parts that are too many or too few, or that names no real day
or time, is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zone names in use in mail and news dates, in minutes from UTC. IST is India's.
ZONE_MINUTES = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "met": 60, "mest": 120,
    "eet": 120, "eest": 180, "msk": 180, "sast": 120, "trt": 180, "gst": 240, "pkt": 300, "ist": 330, "ict": 420,
    "wib": 420, "sgt": 480, "hkt": 480, "awst": 480, "jst": 540, "kst": 540, "acst": 570, "aest": 600, "acdt": 630,
    "aedt": 660, "nzst": 720, "nzdt": 780, "brt": -180, "art": -180, "adt": -180, "ndt": -150, "nst": -210,
    "ast": -240, "edt": -240, "est": -300, "cdt": -300, "cst": -360, "mdt": -360, "mst": -420, "pdt": -420,
    "pst": -480, "akdt": -480, "akst": -540, "hst": -600,
}
_MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
    "november", "december",
)
MONTH_NUMBER = {
    name: at for at, month in enumerate(_MONTHS, 1) for name in (month, month[:3], month[:4])
    if name in (month, month[:3], "sept")
}
#: Years that fit a timestamp of nanoseconds; other years are no dates.
YEARS = 1678, 2261

_WEEKDAY = r"\b(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?\b\.?,?"
_FILLER = r"\b(?:at|on|of|the)\b"
# Digits in one run: day and clock, with or without T between them; then an hour alone after T.
_RUNS = (
    (r"^(\d{4})(\d{2})(\d{2})t?(\d{2})(\d{2})(\d{2})(?=\D|$)", "$1-$2-$3 $4:$5:$6"),
    (r"^(\d{4})(\d{2})(\d{2})t?(\d{2})(\d{2})(?=\D|$)", "$1-$2-$3 $4:$5"),
    (r"^(\d{4})(\d{2})(\d{2})t(\d{2})(?=\D|$)", "$1-$2-$3 $4:00"),
    (r"(?<=\d)t(\d{2})(\d{2})(\d{2})(?![\d:])", " $1:$2:$3"),
    (r"(?<=\d)t(\d{2})(\d{2})(?![\d:])", " $1:$2"),
    (r"(?<=\d)t(\d{2})(?![\d:])", " $1:00"),
    (r"(?<=\d)t(?=\d)", " "),
    (r"(?<=\d)(?:st|nd|rd|th)\b", ""),
)
_HALF = r"\s*[ap]\.?m\b\.?"
_CLOCK = rf"(?<![\d:+.])\d{{1,2}}:\d{{2}}(?::\d{{2}}(?:[.,]\d{{1,9}})?)?(?![\d:])(?:{_HALF})?|(?<!\d)\d{{1,2}}{_HALF}"
_COMMENT = r"\((?:[a-z]+\s+[a-z\s]+|)\)"
_OFFSET = r"(?<=@)\s*(?:[a-z]{1,4}\s*)?[+-]\d{1,2}(?::?\d{2})?(?!\d)|[+-]\d{2}:\d{2}$"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _map(numbers: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(v) for item in numbers.items() for v in item])


def _number(text: Column) -> Column:
    return text.try_cast("int")


def _at(values: Column, place: int) -> Column:
    return F.get(values, F.lit(place))


def _offset_minutes(text: Column) -> Column:
    """Minutes of a signed offset: hours, or hours and two digits of minutes."""
    digits = F.regexp_replace(text, r"[^0-9]", "")
    minutes = F.when(F.length(digits) > 2, _number(F.right(digits, F.lit(2)))).otherwise(0)
    hours = _number(F.when(F.length(digits) > 2, F.substring(digits, F.lit(1), F.length(digits) - 2)).otherwise(digits))
    size = F.when((hours < 24) & (minutes < 60), hours * 60 + minutes)
    return F.when(text.contains("-"), -size).otherwise(size)


def _day_parts(numbers: Column, month: Column) -> Column:
    """Year, month and day from the numbers beside an optional month name; null where none fit."""
    first, second, third = (_at(numbers, i) for i in range(3))
    count, long_ = F.size(numbers), lambda n: F.length(n) == 4
    named, swapped = month.isNotNull(), (_number(first) > 12) & (_number(second) <= 12)

    def parts(year: Column, month: Column | str, day: Column | str) -> Column:
        return F.struct(
            year.alias("year"), F.lit(month).cast("int").alias("month"), F.lit(day).cast("int").alias("day")
        )

    several = (
        F.when(named & long_(first), parts(first, month, _number(second)))
        .when(named, parts(second, month, _number(first)))
        .when(long_(first), parts(first, _number(second), 1))
        .when(long_(second), parts(second, _number(first), 1))
    )
    three = (
        F.when(long_(first), parts(first, _number(second), _number(third)))
        .when(swapped, parts(third, _number(second), _number(first)))
        .otherwise(parts(third, _number(first), _number(second)))
    )
    alone = F.when(long_(first), parts(first, F.coalesce(month, F.lit(1)), 1)).when(
        ~named & (F.length(first) == 8),
        parts(F.substring(first, 1, 4), _number(F.substring(first, 5, 2)), _number(F.substring(first, 7, 2))),
    )
    return F.when(count == 1, alone).when(count == 2, several).when((count == 3) & ~named, three)


def _year(text: Column) -> Column:
    """A year of four digits, or of two for 1950 to 2049."""
    short = _number(text) + F.when(_number(text) < 50, 2000).otherwise(1900)
    year = F.when(F.length(text) == 4, _number(text)).when(F.length(text) == 2, short)
    return F.when(year.between(*YEARS), year)


def _micros(hand: Column) -> Column:
    """Microseconds of the seconds and their fraction."""
    fraction = F.rpad(F.substring(F.coalesce(_at(hand, 3), F.lit("")), 1, 6), 6, "0")
    return F.coalesce(_number(_at(hand, 2)), F.lit(0)) * 1_000_000 + F.when(F.size(hand) > 3, _number(fraction)).otherwise(0)


def _assembled(clock: Column, offset: Column, rest: Column) -> Column:
    """The instant of a clock text (or empty), an offset text (or empty) and the other parts."""
    found = F.struct(
        F.regexp_extract_all(rest, F.lit(r"[a-z]+"), 0).alias("words"),
        F.regexp_extract_all(rest, F.lit(r"\d+"), 0).alias("numbers"),
        F.regexp_extract_all(clock, F.lit(r"\d+"), 0).alias("hand"),
        F.regexp_extract(clock, "[ap]", 0).alias("half"),
    )

    def named(p: Column) -> Column:
        return F.struct(
            F.filter(F.transform(p["words"], lambda w: F.try_element_at(_map(MONTH_NUMBER), w)), F.isnotnull)
            .alias("months"),
            F.filter(F.transform(p["words"], lambda w: F.try_element_at(_map(ZONE_MINUTES), w)), F.isnotnull)
            .alias("zones"),
        )

    def whole(p: Column, n: Column) -> Column:
        """Every part is understood and none is there too often."""
        known = F.size(n["months"]) + F.size(n["zones"]) == F.size(p["words"])
        hour = _number(_at(p["hand"], 0))
        return (
            known & (F.size(n["months"]) < 2) & (F.size(n["zones"]) < 3)
            & ((p["half"] == "") | hour.between(1, 12))
            & ~rest.rlike(r"[^a-z0-9\s,./@-]|@.*@")
        )

    def local(p: Column, day: Column) -> Column:
        hour = F.coalesce(_number(_at(p["hand"], 0)), F.lit(0))
        half = p["half"]
        hour = F.when(half == "", hour).when(half == "p", hour % 12 + 12).otherwise(hour % 12)
        minute = F.coalesce(_number(_at(p["hand"], 1)), F.lit(0))
        return _let(_micros(p["hand"]), lambda micros: F.when(
            micros < 60_000_000,
            F.try_make_timestamp_ntz(
                _year(day["year"]), day["month"], day["day"], hour, minute,
                (micros / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(16,6)"),
            ),
        ))

    def zone(n: Column) -> Column:
        return F.when(offset != "", _offset_minutes(offset)).otherwise(F.coalesce(_at(n["zones"], 0), F.lit(0)))

    return _let(found, lambda p: _let(named(p), lambda n: F.when(
        whole(p, n), _let(_day_parts(p["numbers"], _at(n["months"], 0)), lambda day: local(p, day))
        - F.make_dt_interval(mins=zone(n)),
    )))


def instant(text: Column) -> Column:
    """The instant a date text names.

    Parts may come in any common order: a year, a year and month, or a whole day, in numbers (month
    first, the day first where only that can be meant) or with a month name, glued, or split by spaces,
    dots, commas, strokes or hyphens; a clock of 24 or twice 12 hours; an offset, zone name or both.
    An offset counts eastwards also behind a zone name (``GMT+0530``).
    """
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), _WEEKDAY, " "), _FILLER, " ")
    for pattern, by in ((r"\s+", " "), (r"^\s|[\s,]+$", ""), *_RUNS, (_COMMENT, ""), (r"[()]", " ")):
        plain = F.regexp_replace(plain, pattern, by)

    def timed(t: Column) -> Column:
        return _let(F.regexp_extract(t, _CLOCK, 0), lambda clock: _let(
            F.when(clock == "", t).otherwise(F.replace(t, clock, F.lit("@"))),
            lambda rest: _let(F.regexp_extract(rest, _OFFSET, 0), lambda offset: _assembled(
                clock, offset, F.when(offset == "", rest).otherwise(F.replace(rest, offset, F.lit(" "))),
            )),
        ))

    return _let(plain, timed)
