"""Date columns: tolerant parsing to epoch seconds or ISO days, deadlines and labels.

All clock-dependent functions take ``as_of`` (epoch seconds), so results can be reproduced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rostrum import lookups as L
from rostrum.functions.text import contains_any, extract, let, literal_map, strip

MONTHS = "January February March April May June July August September October November December".split()
MONTH_NUMBER = {
    **{m.lower(): f"{i:02d}" for i, m in enumerate(MONTHS, 1)},
    **{m[:3].lower(): f"{i:02d}" for i, m in enumerate(MONTHS, 1)},
}


def _epoch(timestamp: Column) -> Column:
    return timestamp.cast("double").cast("bigint")


def parse_iso(text: Column) -> Column:
    """ISO 8601 text to epoch seconds; anything else gives NULL."""
    shape = r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    colon = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    zoned = F.when(F.contains(text, F.lit(":")), colon).otherwise(text)
    return F.when(text.rlike(shape), _epoch(zoned.try_cast("timestamp")))


def iso_day(text: Column) -> Column:
    return F.when(text != "", F.substring(text, 1, 10))


def deadline_epoch(day: Column) -> Column:
    """``YYYY-MM-DD`` at 23:59:59 as epoch seconds."""
    return F.when(
        day.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), _epoch(day.try_cast("timestamp")) + F.lit(86399)
    )


def parse_deadline(text: Column) -> Column:
    """Day with optional time to epoch seconds; ``TBA`` and bad text give NULL. Read as UTC."""
    trimmed = strip(text)
    shape = r"^\d{4}-\d{1,2}-\d{1,2}(\s+\d{1,2}:\d{1,2}(:\d{1,2})?)?$"
    usable = (F.upper(text) != "TBA") & trimmed.rlike(shape)
    return F.when(usable, _epoch(F.regexp_replace(trimmed, r"\s+", " ").try_cast("timestamp")))


def ms_to_s(millis: Column) -> Column:
    return F.when(millis != 0, F.floor(millis / 1000).cast("bigint"))


def epoch_day(epoch: Column) -> Column:
    """Epoch seconds to ``YYYY-MM-DD``; NULL for none or zero."""
    return F.when(epoch != 0, F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd"))


def parse_any_date(text: Column) -> Column:
    """Free-form date to ``YYYY-MM-DD``: a leading ISO day wins, month/day is tried before day/month."""
    return let(F.regexp_replace(strip(text), r"\s+", " "), _any_date)


def _any_date(value: Column) -> Column:
    """Rule of ``parse_any_date`` over a one-line text.

    The separators tell the three shapes apart: words, slashes with the year last or first.
    """
    words, slashes = F.split(F.replace(value, F.lit(","), F.lit("")), " "), F.split(value, "/")
    month = literal_map(MONTH_NUMBER)

    def day(year: Column, month_number: Column, day_number: Column) -> Column:
        return F.concat_ws("-", year, month_number, day_number).try_cast("date").cast("string")

    def word(i: int) -> Column:
        return F.get(words, F.lit(i))

    def part(i: int) -> Column:
        return F.get(slashes, F.lit(i))

    return (
        F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(value, 1, 10))
        .when(value.rlike(r"^[A-Za-z]+ \d{1,2}, \d{4}$"), day(word(2), F.try_element_at(month, F.lower(word(0))), word(1)))
        .when(value.rlike(r"^\d{1,2} [A-Za-z]+ \d{4}$"), day(word(2), F.try_element_at(month, F.lower(word(1))), word(0)))
        .when(value.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.coalesce(day(part(2), part(0), part(1)), day(part(2), part(1), part(0))))
        .when(value.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), day(part(0), part(1), part(2)))
    )


def iso_day_epoch(day: Column) -> Column:
    """``YYYY-MM-DD`` at midnight as epoch seconds, NULL for bad text."""
    return F.when(day.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), _epoch(day.try_cast("timestamp")))


def days_until(end: Column, as_of: int) -> Column:
    """Whole days to ``end`` (floored, negative when past); NULL for none or zero."""
    return F.when(end != 0, F.floor((end - F.lit(as_of)) / 86400).cast("bigint"))


def year_from_title(title: Column) -> Column:
    """Year beside a conference word (2010-2030), else the first 20xx (2010-2025)."""
    named = extract(title, L.CONFERENCE_YEAR_PATTERN).try_cast("int")
    plain = extract(title, r"(20[12]\d{2})").try_cast("int")
    return F.coalesce(F.when(named.between(2010, 2030), named), F.when(plain.between(2010, 2025), plain))


def video_year(upload_date: Column, epoch: Column, title: Column) -> Column:
    """Year of a video: upload date, else time stamp, else its title."""
    uploaded = F.when(F.length(upload_date) >= 4, F.substring(upload_date, 1, 4).try_cast("int"))
    stamped = F.year(F.timestamp_seconds(epoch))
    return F.coalesce(F.nullif(uploaded, F.lit(0)), stamped, year_from_title(title))


def deadline_label(day: Column, as_of: int) -> Column:
    """Short words for a deadline day, counting days upwards."""
    left = F.ceil((_epoch(day.try_cast("timestamp")) - F.lit(as_of)) / 86400)
    return (
        F.when(left < 0, F.lit("Closed"))
        .when(left == 0, F.lit("Today!"))
        .when(left == 1, F.lit("Tomorrow"))
        .when(left <= 7, F.concat(F.lit("in "), left.cast("string"), F.lit(" days")))
        .otherwise(F.date_format(day.try_cast("date"), "MMM d"))
    )


def countdown(end: Column, as_of: int) -> Column:
    """Struct of the time left, all zero when the deadline has passed."""
    left = F.greatest(end - F.lit(as_of), F.lit(0))
    return F.struct(
        left.cast("bigint").alias("total"),
        F.floor(left / 86400).cast("bigint").alias("days"),
        F.floor((left % 86400) / 3600).cast("bigint").alias("hours"),
        F.floor((left % 3600) / 60).cast("bigint").alias("minutes"),
        (left % 60).cast("bigint").alias("seconds"),
    )


# a look at the first character spares the alternatives at all places where no date can start
_DATE_REGEX = {p: ("(?i)(?=[JFMASOND])" if p.startswith(r"\b((?:Jan") else r"(?i)(?=\d)") + p for p in L.DATE_PATTERNS}


def _parsed(found: Column) -> Column:
    return F.filter(F.transform(found, parse_any_date), lambda d: d.isNotNull())


def dates_near_keywords(text: Column, keywords: Sequence[str] = tuple(L.DEADLINE_PHRASES), reach: int = 150) -> Column:
    """ISO days found within ``reach`` characters of the first occurrence of each keyword."""
    words = F.array(*[F.lit(k) for k in keywords])
    places = let(F.lower(text), lambda lowered: F.transform(words, lambda k: F.instr(lowered, k)))
    contexts = F.transform(F.filter(places, lambda at: at > 0), lambda at: F.substring(text, at, F.lit(reach)))
    found = F.transform(
        contexts,
        lambda c: F.concat(*[F.regexp_extract_all(c, F.lit(_DATE_REGEX[p]), F.lit(1)) for p in L.DATE_PATTERNS]),
    )
    return _parsed(F.flatten(found))


def _positions(found: Column, gaps: Column) -> Column:
    """Matches with their place, from the matches and the gaps before each of them."""
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<m:string,start:int,stop:int>>").alias("out"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["g"])
        stop = begin + F.length(pair["m"])
        entry = F.struct(pair["m"].alias("m"), begin.alias("start"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.concat(state["out"], F.array(entry)).alias("out"))

    return F.aggregate(pairs, start, step)["out"]


def all_dates_with_context(text: Column, reach: int = 50) -> Column:
    """All parseable dates as structs ``(day, context)``, pattern by pattern in text order.

    A split on the date pattern gives the gaps between matches; their running length gives each
    position, so the context may overlap neighbouring dates.
    """
    whole = F.length(text)

    named = let(F.lower(text), lambda lowered: contains_any(lowered, [m for m in MONTH_NUMBER if len(m) == 3]))
    none = F.array().cast("array<struct<m:string,start:int,stop:int>>")

    def of_pattern(pattern: str) -> Column:
        regex = _DATE_REGEX[pattern]
        found = F.regexp_extract_all(text, F.lit(regex), F.lit(1))
        if "January" in pattern:  # a month name is needed; looking for one is cheap
            found = F.when(named, found).otherwise(F.array().cast("array<string>"))
        return let(found, lambda f: F.when(F.size(f) > 0, _positions(f, F.split(text, regex, -1))).otherwise(none))

    found = F.concat(*[of_pattern(p) for p in L.DATE_PATTERNS])

    def with_context(entry: Column) -> Column:
        begin = F.greatest(entry["start"] - reach, F.lit(0))
        stop = F.least(entry["stop"] + reach, whole)
        return F.struct(
            parse_any_date(entry["m"]).alias("day"),
            F.lower(F.substring(text, begin + 1, stop - begin)).alias("context"),
        )

    return F.filter(F.transform(found, with_context), lambda d: d["day"].isNotNull())


def classify_date(context: Column) -> Column:
    """Role of a date by the words around it, first class that fits."""
    lowered = F.lower(context)
    rule = F.when(F.lit(False), F.lit(None).cast("string"))
    for role, words in L.DATE_CLASS_WORDS.items():
        rule = rule.when(contains_any(lowered, words), F.lit(role))
    return rule
