"""Dates and times as people write them, and the language of a text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casewright.functions.text import any_timestamp

#: What an event's time may look like, the first that reads it counts.
EVENT_FORMATS = ["yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m", "yyyy-M-d", "d/M/yyyy"]
#: Months by their first three letters.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
ZONE, DEFAULT_HOUR = "+05:30", 9
_TIME = r"(\d{1,2}):(\d{2})"
#: Layouts of a leading date: pattern, and the groups of year, month, day; a time may follow as groups four and five.
LAYOUTS = (
    (rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[T\s]+{_TIME})?", (1, 2, 3)),
    (rf"^(\d{{1,2}})[/-](\d{{1,2}})[/-](\d{{4}})(?:[,\s]+{_TIME})?", (3, 2, 1)),
    (rf"^(\d{{1,2}})\s+([A-Za-z]{{3,9}})\.?\s+(\d{{4}})(?:[,\s]+{_TIME})?", (3, 2, 1)),
    (rf"^([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})(?:[,\s]+{_TIME})?", (3, 1, 2)),
)


def event_stamp(text: Column) -> Column:
    """The wall-clock time of six layouts, null if none reads the text or it is null."""
    return any_timestamp(F.trim(text), EVENT_FORMATS).cast("timestamp_ntz")


def _number(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("int")


def _month(text: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, MONTHS)), F.left(F.lower(text), F.lit(3)))
    return F.coalesce(_number(text), F.nullif(at, F.lit(0)).cast("int"))


def _half(hour: Column, mark: Column) -> Column:
    """An hour with am or pm."""
    mark = F.lower(mark)
    return F.when((mark == "pm") & (hour < 12), hour + 12).when((mark == "am") & (hour == 12), 0).otherwise(hour)


def leading_stamp(line: Column) -> Column:
    """Struct (stamp, rest) of a line that begins with a date in one of four layouts; null if there is none, or its month, day, hour or minute can't be.

    A time may stand in the date or right after it, with am or pm; without one it is nine o'clock. ``stamp`` is ISO text in
    Indian time; the day is not held against its month. Bullets before the date, and dashes and colons after it, go.
    """
    text = F.regexp_replace(F.trim(F.regexp_replace(line, r"\s+", " ")), r"^[-•*|\[]+\s*", "")
    found = []
    for pattern, (year, month, day) in LAYOUTS:
        part = lambda k: F.regexp_extract(text, pattern, k)  # noqa: B023, E731
        rest = F.trim(F.substring(text, F.length(part(0)) + 1, F.length(text)))
        after = r"^[^0-9A-Za-z]*(\d{1,2}):(\d{2})\s*(hrs|hours|(?i:am|pm))?"
        late = F.regexp_extract(rest, after, 0)
        mark = F.regexp_extract(rest, r"(?i)^(am|pm)\b", 1)
        own = _number(part(4))
        hour = F.when(own.isNotNull(), _half(own, mark)).when(late != "", _half(_number(F.regexp_extract(rest, after, 1)), F.regexp_extract(rest, after, 3))).otherwise(DEFAULT_HOUR)
        minute = F.when(own.isNotNull(), _number(part(5))).when(late != "", _number(F.regexp_extract(rest, after, 2))).otherwise(0)
        tail = F.when(own.isNotNull(), F.substring(rest, F.length(mark) + 1, F.length(rest))).otherwise(F.substring(rest, F.length(late) + 1, F.length(rest)))
        y, m, d = _number(part(year)), _month(part(month)), _number(part(day))
        good = (part(0) != "") & m.between(1, 12) & d.between(1, 31) & (hour <= 23) & (minute <= 59)
        stamp = F.format_string(f"%04d-%02d-%02dT%02d:%02d:00{ZONE}", y, m, d, hour, minute)
        found.append(F.when(good, F.struct(stamp.alias("stamp"), F.trim(F.regexp_replace(F.trim(tail), r"^[-–—:|,]+\s*", "")).alias("rest"))))
    return F.coalesce(*found)


def letters(text: Column, which: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{which}]"))


def text_language(text: Column) -> Column:
    """Marathi or Hindi if more than twenty Devanagari letters are over 15 % of the Latin ones, English if there is any Latin letter, else null."""
    devanagari, latin = letters(text, "ऀ-ॿ"), letters(text, "A-Za-z")
    indic = (devanagari > latin * 0.15) & (devanagari > 20)
    return F.when(indic, F.when(text.rlike("ळ|न्ही|आहे|यांच्या"), "Marathi").otherwise("Hindi")).when(latin > 0, "English")
