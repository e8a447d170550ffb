"""Dates in free text, and rules on dates. Everything is a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names in English and French, accents stripped, by number.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "janvier": 1, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "decembre": 12,
    "janv": 1, "fevr": 2, "avr": 4, "juil": 7,
}
#: Words for a job that goes on.
PRESENT = ("present", "current", "now", "today", "ongoing", "actuel", "actuellement", "aujourd'hui", "en cours", "a ce jour")


def _number(text: Column) -> Column:
    return F.expr("1") * text.try_cast("int")


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def _edge(first: Column, boundary: str, unit: str) -> Column:
    """The first or last day of the month or year that begins on ``first``."""
    if boundary == "start":
        return first
    return F.last_day(first) if unit == "month" else F.last_day(F.add_months(first, 11))


def _full_year(text: Column) -> Column:
    """Years of two digits: below 70 this century, else the last."""
    n = _number(text)
    return F.when(F.length(text) == 2, F.when(n < 70, n + 2000).otherwise(n + 1900)).otherwise(n)


def parse_date(text: Column, boundary: str = "start") -> Column:
    """ISO, D/M/Y (M/D/Y if only that is possible), M/Y, month names, or a year alone; else null."""
    from crewlens.functions.text import strip_accents

    t = F.lower(F.trim(strip_accents(text)))
    part = lambda pattern, i: F.regexp_extract(t, pattern, i)
    iso = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$"
    dmy = r"^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4}|[0-9]{2})$"
    my = r"^([0-9]{1,2})[/.-]([0-9]{4})$"
    ym = r"^([0-9]{4})[/.-]([0-9]{1,2})$"
    dny = r"^([0-9]{1,2})\s+([a-z]+)\.?\s+([0-9]{4})$"
    ny = r"^([a-z]+)\.?\s+([0-9]{4})$"
    months = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))
    month = lambda name: F.try_element_at(months, name)
    a, b, y = _number(part(dmy, 1)), _number(part(dmy, 2)), _full_year(part(dmy, 3))
    one = F.lit(1)
    return (
        F.when(t.rlike(iso), _day(_number(part(iso, 1)), _number(part(iso, 2)), _number(part(iso, 3))))
        .when(t.rlike(dmy), F.when((b > 12) & (a <= 12), _day(y, a, b)).otherwise(_day(y, b, a)))
        .when(t.rlike(my), _edge(_day(_number(part(my, 2)), _number(part(my, 1)), one), boundary, "month"))
        .when(t.rlike(ym), _edge(_day(_number(part(ym, 1)), _number(part(ym, 2)), one), boundary, "month"))
        .when(t.rlike(dny), _day(_number(part(dny, 3)), month(part(dny, 2)), _number(part(dny, 1))))
        .when(t.rlike(ny), _edge(_day(_number(part(ny, 2)), month(part(ny, 1)), one), boundary, "month"))
        .when(t.rlike(r"^[0-9]{4}$"), _edge(_day(_number(t), one, one), boundary, "year"))
    )


def is_present(text: Column) -> Column:
    from crewlens.functions.text import strip_accents

    return F.coalesce(F.lower(F.trim(strip_accents(text))).isin(*PRESENT), F.lit(False))


def parse_range(text: Column) -> Column:
    """"a - b", "a to b", "since a": a struct of start_date, end_date and is_current."""
    from crewlens.functions.text import strip_accents

    t = F.lower(F.trim(strip_accents(text)))
    split = r"^(.+?)\s+(?:-|–|—|to|until|au|a|jusqu'a)\s+(.+)$"
    since = r"^(?:since|from|depuis)\s+(.+)$"
    start = F.when(t.rlike(since), F.regexp_extract(t, since, 1)).when(t.rlike(split), F.regexp_extract(t, split, 1)).otherwise(t)
    end = F.when(t.rlike(split) & ~t.rlike(since), F.regexp_extract(t, split, 2))
    current = t.rlike(since) | is_present(end)
    return F.struct(parse_date(start, "start").alias("start_date"), F.when(~current, parse_date(end, "end")).alias("end_date"), current.alias("is_current"))


def cert_status(expiration: Column, as_of: Column, mode: str = "computed", stored: Column | None = None) -> Column:
    """expired before today, expiring_soon up to 30 days ahead, else active. mode "json": a certificate that ends today is expired."""
    days = F.datediff(expiration, as_of)
    gone = days <= 0 if mode == "json" else days < 0
    status = F.when(gone, "expired").when(days <= 30, "expiring_soon").otherwise("active")
    return F.when(expiration.isNull(), stored if stored is not None else F.lit("active")).otherwise(status)


def reference_date(completion: Column, data: Column, created: Column) -> Column:
    """Completion, else the assignment date in a JSON text (two spellings), else creation."""
    spelled = [F.try_to_date(F.get_json_object(data, f"$.{k}"), "yyyy-MM-dd") for k in ("assignment_date", "assignmentDate")]
    return F.coalesce(completion, *spelled, created)
