"""Date expressions: month bounds, local clocks, fiscal years and series of days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import col


def month_bounds(ts: Column | str, zone: str, back: int = 1) -> tuple[Column, Column]:
    """First and last day of the month ``back`` months before an instant, by a zone's calendar."""
    first = F.add_months(F.trunc(F.from_utc_timestamp(col(ts), zone), "month"), -back)
    return first, F.last_day(first)


def local_gate(ts: Column | str, zone: str, gates: dict[str, Sequence[str]]) -> Column:
    """The name of the gate whose local ``HH:mm`` an instant meets, whatever the season."""
    clock = F.date_format(F.from_utc_timestamp(col(ts), zone), "HH:mm")
    return F.coalesce(*[F.when(clock.isin(*times), F.lit(name)) for name, times in gates.items()])


def latest_anchor(ts: Column | str, zone: str, days: Sequence[int] = (1, 4), hour: int = 14) -> Column:
    """The latest local weekday (1 is Monday) and hour strictly before an instant, in local time."""
    local = F.from_utc_timestamp(col(ts), zone)
    steps = F.sequence(F.lit(0), F.lit(7))
    at = F.transform(steps, lambda i: F.to_timestamp(F.date_sub(local.cast("date"), i)) + F.make_interval(hours=F.lit(hour)))
    return F.array_max(F.filter(at, lambda x: (F.weekday(x) + 1).isin(*days) & (x < local)))


def date_series(first: Column, last: Column, newest_first: bool = True) -> Column:
    days = F.sequence(first, last, F.expr("interval 1 day"))
    return F.reverse(days) if newest_first else days


def seconds_between(a: Column | str, b: Column | str) -> Column:
    return F.round((F.unix_micros(col(b)) - F.unix_micros(col(a))) / 1e6, 3)


def date_hint(c: Column | str) -> Column:
    """A date as it is written in a text: ISO, month name, or slashes."""
    forms = (r"(\d{4}-\d{2}-\d{2})", r"((?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4})", r"(\d{1,2}/\d{1,2}/\d{4})")
    return F.coalesce(*[F.nullif(F.regexp_extract(col(c), f, 1), F.lit("")) for f in forms])


def fiscal_years(c: Column | str, pivot: int = 69) -> Column:
    """Years a name states: ``FY24``, ``FYE 2024``, ``2024``; two digits up to the pivot are this century's."""
    short = F.transform(F.regexp_extract_all(F.upper(col(c)), F.lit(r"FYE?[ _-]?(\d{2})(?:[^0-9]|$)"), 1), lambda y: y.cast("int") + F.when(y.cast("int") <= pivot, 2000).otherwise(1900))
    full = F.transform(F.regexp_extract_all(col(c), F.lit(r"(?:^|[^0-9])(20\d{2})(?:[^0-9]|$)"), 1), lambda y: y.cast("int"))
    return F.array_distinct(F.concat(short, full))


def latest_year(*columns: Column | str, pivot: int = 69) -> Column:
    """The greatest year of the first text that states one."""
    return F.coalesce(*[F.array_max(fiscal_years(c, pivot)) for c in columns])


def date_argument(c: Column | str) -> Column:
    """A day given as ``2024-01-31`` or ``01/31/2024``; blanks give null, anything else is an error."""
    t = F.nullif(F.trim(col(c)), F.lit(""))
    day = F.coalesce(F.try_to_timestamp(t, F.lit("yyyy-MM-dd")), F.try_to_timestamp(t, F.lit("MM/dd/yyyy"))).cast("date")
    return F.when(t.isNull(), F.lit(None).cast("date")).when(day.isNotNull(), day).otherwise(F.raise_error(F.concat(F.lit("not a date: "), t)).cast("date"))
