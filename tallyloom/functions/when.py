"""Time windows named in questions, and civil dates.

`windows` is a column for tables of questions; `window` is the same for a single question on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000
#: Names of months in English and Indonesian; three letters or more name one.
MONTHS = (("january", "januari"), ("february", "februari"), ("march", "maret"), ("april",), ("may", "mei"), ("june", "juni"), ("july", "juli"), ("august", "agustus"), ("september",), ("october", "oktober"), ("november",), ("december", "desember"))


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    label: str


def month(word: str) -> int | None:
    word = word.lower()
    if len(word) < 3:
        return None
    return next((i + 1 for i, names in enumerate(MONTHS) if any(n.startswith(word) for n in names)), None)


def day_start(y: int, m: int, d: int, offset_min: int) -> int:
    """Days past a month's end run on into the next."""
    return ((date(y, m, 1) - date(1970, 1, 1)).days + d - 1) * DAY - offset_min * 60_000


def window(question: str, now: int, offset_min: int = 0) -> Span | None:
    """Half-open [start, end) in ms, never past now; None if the question names no time."""
    text = question.lower()
    local = now + offset_min * 60_000
    today = date(1970, 1, 1) + timedelta(days=local // DAY)
    at = lambda d: ((d - date(1970, 1, 1)).days) * DAY - offset_min * 60_000

    def span(start: int, end: int, label: str) -> Span:
        return Span(start, min(end, now), label)

    if m := re.search(r"\b(\d{4})-(\d{2})-(\d{2})\b", text):
        y, mo, d = map(int, m.groups())
        if 1 <= mo <= 12:
            start = day_start(y, mo, d, offset_min)
            return span(start, now if re.search(r"\bsince\b", text) else start + DAY, m[0])
    for m in re.finditer(r"(?=(\b(?:(\d{1,2})\s+([a-z]{3,})|([a-z]{3,})\s+(\d{1,2}))\b(?:,?\s+(\d{4}))?))", text):  # at every place: "done 1 march"
        mo, d = month(m[3] or m[4]), int(m[2] or m[5])
        if mo and 1 <= d <= 31:
            y = int(m[6]) if m[6] else today.year
            start = day_start(y, mo, d, offset_min)
            if not m[6] and start > now:
                start = day_start(y - 1, mo, d, offset_min)
            return span(start, now if re.search(r"\bsince\b", text) else start + DAY, m[1])
    if re.search(r"\btoday\b", text):
        return span(at(today), at(today) + DAY, "today")
    if re.search(r"\byesterday\b", text):
        return span(at(today) - DAY, at(today), "yesterday")
    monday = today - timedelta(days=today.weekday())
    if re.search(r"\blast week\b", text):
        return span(at(monday) - 7 * DAY, at(monday), "last week")
    if re.search(r"\bthis week\b", text):
        return span(at(monday), at(monday) + 7 * DAY, "this week")
    if re.search(r"\blast month\b", text):
        first = today.replace(day=1)
        return span(at((first - timedelta(days=1)).replace(day=1)), at(first), "last month")
    if m := re.search(r"\b(?:last|past)\s+(\d{1,3})\s+(day|week)s?\b", text):
        return span(now - int(m[1]) * DAY * (7 if m[2] == "week" else 1), now, m[0])
    return None


def month_of(word: Column) -> Column:
    """The month that a word of three letters or more begins to name; null for other words."""
    low, named = F.lower(word), []
    for i, names in enumerate(MONTHS, 1):
        hit = F.lit(False)
        for n in names:
            hit = hit | F.lit(n).startswith(low)
        named.append(F.when(hit, F.lit(i)))
    return F.when(F.length(low) >= 3, F.coalesce(*named))


def _dates(low: Column) -> Column:
    """array<struct(m, d, y, label)> of days named by month, at every place of a text."""
    found = F.regexp_extract_all(low, F.lit(r"(?=(\b(?:\d{1,2}\s+[a-z]{3,}|[a-z]{3,}\s+\d{1,2})\b(?:,?\s+\d{4})?))"), 1)

    def read(x: Column) -> Column:
        month = month_of(F.regexp_extract(x, r"([a-z]{3,})", 1))
        day = F.regexp_extract(F.regexp_replace(x, r",?\s+\d{4}$", ""), r"(\d{1,2})", 1).try_cast("int")
        return F.struct(month.alias("m"), day.alias("d"), F.regexp_extract(x, r"\s(\d{4})$", 1).try_cast("int").alias("y"), x.alias("label"))

    return F.filter(F.transform(found, read), lambda x: x["m"].isNotNull() & x["d"].between(1, 31))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def windows(text: Column, now: Column, offset_min: Column | None = None) -> Column:
    """struct(start, end, label) of the time that a question names, as `window` has it; null for none."""
    low, shift = F.lower(text), (F.lit(0) if offset_min is None else offset_min) * F.lit(60_000).cast("long")
    today = F.floor((now + shift) / DAY).cast("int")
    at = lambda day: day.cast("long") * DAY - shift
    civil = lambda y, m, d: F.unix_date(F.make_date(y, m, F.lit(1))) + d - 1
    span = lambda start, end, label: F.struct(start.cast("long").alias("start"), F.least(end.cast("long"), now).alias("end"), label.alias("label"))
    since = low.rlike(r"\bsince\b")
    whole = lambda day, label: span(at(day), F.when(since, now).otherwise(at(day) + DAY), label)
    said = r"\b(\d{4})-(\d{2})-(\d{2})\b"
    y, m, d = (F.regexp_extract(low, said, i).try_cast("int") for i in (1, 2, 3))
    iso = F.when(m.between(1, 12), whole(civil(y, m, d), F.regexp_extract(low, said, 0)))
    this_year = F.year(F.date_from_unix_date(today))

    def dated(first: Column) -> Column:
        year = F.coalesce(first["y"], F.when(at(civil(this_year, first["m"], first["d"])) > now, this_year - 1).otherwise(this_year))
        return F.when(first.isNotNull(), whole(civil(year, first["m"], first["d"]), first["label"]))

    named = bound(F.get(_dates(low), F.lit(0)), dated)
    monday = today - F.pmod(today + 3, F.lit(7))
    month = F.trunc(F.date_from_unix_date(today), "month")
    last = r"\b(?:last|past)\s+(\d{1,3})\s+(day|week)s?\b"
    n = F.regexp_extract(low, last, 1).try_cast("long") * F.when(F.regexp_extract(low, last, 2) == "week", 7).otherwise(1)
    phrase = (
        F.when(low.rlike(r"\btoday\b"), span(at(today), at(today + 1), F.lit("today")))
        .when(low.rlike(r"\byesterday\b"), span(at(today - 1), at(today), F.lit("yesterday")))
        .when(low.rlike(r"\blast week\b"), span(at(monday - 7), at(monday), F.lit("last week")))
        .when(low.rlike(r"\bthis week\b"), span(at(monday), at(monday + 7), F.lit("this week")))
        .when(low.rlike(r"\blast month\b"), span(at(F.unix_date(F.add_months(month, -1))), at(F.unix_date(month)), F.lit("last month")))
        .when(n.isNotNull(), span(now - n * DAY, now, F.regexp_extract(low, last, 0)))
    )
    return F.coalesce(iso, named, phrase)
