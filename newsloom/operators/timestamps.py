"""One UTC instant for timestamps written in many formats, precisions and zones (problem 6).

Every value is matched, inside the JVM, against a small family of written forms. A value
may be valid under several interpretations: ``03/04/2025`` is 4 March or 3 April, ``25`` a year
of this century or the last, ``1612010512`` seconds of 2021 or an hour of 1612, ``197612050930``
milliseconds of an hour or a minute of its digits. The sets of valid interpretations, each with
the year it leads to, are counted per source, and an expectation-maximisation over the source's
mixture - a share for each format and one for each year - turns the counts into posteriors. The
interpretation of highest posterior is taken; where the best posterior stays under
``min_posterior`` the value keeps its best reading but is marked ``ambiguous``. Values are read
once; what they may mean is written down, and the choice is joined to it.

Defined results: null, empty, blank and unreadable values give a null instant; impossible
dates and times (month 13, ``00/00/0000``) give null; repeated rows give repeated results;
an empty table gives an empty result; extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.session import staged

#: Interpretations. ``rfc_century``: a year of two digits in the century that the usual pivot doesn't give.
FORMATS = ("iso", "compact", "rfc", "rfc_century", "month_name", "slash_mdy", "slash_dmy", "epoch_s", "epoch_ms", "epoch_us")

#: Zone abbreviations and the offset or region each means.
ZONE_NAMES = {
    "Z": "UTC", "UT": "UTC", "UTC": "UTC", "GMT": "UTC",
    "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00",
    "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00",
    "AKST": "-09:00", "AKDT": "-08:00", "HST": "-10:00", "HDT": "-09:00", "AST": "-04:00", "ADT": "-03:00",
    "ET": "America/New_York", "CT": "America/Chicago", "MT": "America/Denver", "PT": "America/Los_Angeles",
    "AKT": "America/Anchorage", "HT": "Pacific/Honolulu", "HAT": "Pacific/Honolulu", "AT": "America/Halifax",
}

#: Month-first is the rule of the collection: day-first readings get no prior weight.
MONTH_FIRST = {"slash_dmy": 0.0, "rfc_century": 0.1}
#: Years most values fall into, before a source's own values say more, and the weight of that in values.
LIKELY_YEARS, YEAR_WEIGHT = (1990, 2040), 2.0

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_PATTERNS = {
    "iso": r"(?i)^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ]\s*" + _TIME + r"\s*(Z|[A-Z]{2,4}|(?:GMT|UTC)?[+-]\d{2}:?(?:\d{2})?)?\s*(?:\[([^\]]+)\])?)?$",
    "compact": r"(?i)^(\d{4})(\d{2})(\d{2})(?:T(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$",
    "rfc": r"(?i)^(?:[a-z]{3,9}\.?,?\s+)?(\d{1,2})[ -]([a-z]{3,9})\.?[ -](\d{4}|\d{2})(?:,?\s+" + _TIME + r"\s*(Z|[A-Z]{2,4}|(?:GMT|UTC)?[+-]\d{2}:?(?:\d{2})?)?)?$",
    "month_name": r"(?i)^(?:[a-z]{3,9}\.?,\s+)?([a-z]{3,9})\.? (\d{1,2}),? (\d{4})(?:,?\s+(?:at\s+)?" + _TIME + r"\s*([ap])?\.?(?:m\.?)?\s*(Z|[A-Z]{2,4}|[+-]\d{2}:?\d{2})?)?$",
    "slash": r"(?i)^(\d{1,2})/(\d{1,2})/(\d{4})(?:,?\s+(?:at\s+)?" + _TIME + r"\s*([ap])?\.?(?:m\.?)?\s*(Z|[A-Z]{2,4}|[+-]\d{2}:?\d{2})?)?$",
    "digits": r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})?(\d{2})?$",
    "epoch_s": r"^(-?\d{9,10})(?:\.(\d+))?$",
    "epoch_ms": r"^(\d{12,13})$",
    "epoch_us": r"^(\d{15,16})$",
}
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def trimmed(c: Column) -> Column:
    """Without white space of any kind (no-break spaces included) at either end."""
    return F.regexp_replace(c, r"^[\s  -​ 　﻿]+|[\s  -​ 　﻿]+$", "")


def _month(c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for i, m in enumerate(_MONTHS) for x in (m, i + 1)]), F.lower(F.substring(c, 1, 3)))


def _zone(c: Column) -> Column:
    """A zone Spark understands for a written offset, abbreviation or region; null if there is none."""
    up = F.regexp_replace(F.upper(c), r"^(GMT|UTC)(?=[+-])", "")
    offset = F.concat(F.substring(up, 1, 3), F.lit(":"), F.lpad(F.regexp_extract(up, r"^[+-]\d{2}:?(\d{2})$", 1), 2, "0"))
    names = F.create_map(*[F.lit(x) for pair in ZONE_NAMES.items() for x in pair])
    return F.when(up.rlike(r"^[+-]\d{2}"), offset).otherwise(F.try_element_at(names, up))


#: Order of the parts in a value's canonical form: year, month, day, hour, minute, second, fraction, half of the day, zone, region.
_PARTS = {
    "iso": "$1~$2~$3~$4~$5~$6~$7~~$8~$9",
    "compact": "$1~$2~$3~$4~$5~$6~$7~~$8~",
    "rfc": "$3~$2~$1~$4~$5~$6~$7~~$8~",
    "month_name": "$3~$1~$2~$4~$5~$6~$7~$8~$9~",
    "slash": "$3~$1~$2~$4~$5~$6~$7~$8~$9~",
    "digits": "$1~$2~$3~$4~$5~$6~~~~",
}


def _shape(v: Column) -> Column:
    """Name of the written form, null if the value has none of them."""
    return F.coalesce(*[F.when(v.rlike(p), F.lit(k)) for k, p in _PATTERNS.items() if k != "digits"], F.when(v.rlike(_PATTERNS["digits"]), F.lit("digits")))


def _parts(v: Column, shape: Column) -> Column:
    """The value's parts in canonical order, one regular expression a value."""
    return F.split(F.coalesce(*[F.when(shape == k, F.regexp_replace(v, _PATTERNS[k], r)) for k, r in _PARTS.items()]), "~")


def _instant(part: Callable[[int], Column], month: Column, day: Column, local: Column, pivot: bool = True) -> Column:
    """Microseconds of a written date and time; null where it names none.

    A local time that occurs twice is its first occurrence; a skipped one moves on by the gap.
    """
    num = lambda c: c.try_cast("int")
    hour, minute, second = (F.coalesce(num(part(i)), F.lit(0)) for i in (3, 4, 5))
    half = F.lower(part(7))
    hour24 = F.when(half == "", hour).when((hour >= 1) & (hour <= 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    near, far = (2000, 1900) if pivot else (1900, 2000)
    year = F.when(F.length(part(0)) == 2, num(part(0)) + F.when(num(part(0)) < 70, near).otherwise(far)).otherwise(num(part(0)))
    ok = (hour24 <= 23) & (minute <= 59) & (second <= 59)
    ntz = F.try_make_timestamp_ntz(year, month, day, F.when(ok, hour24), minute, second.cast("decimal(16,6)"))
    micros = F.rpad(F.substring(part(6), 1, 6), 6, "0").try_cast("long")
    # A zone that is written but unknown names no instant; none written means the source's own.
    zone = F.when(part(8) != "", _zone(part(8))).when(part(9) != "", part(9)).otherwise(local)
    return F.unix_micros(F.convert_timezone(zone, F.lit("UTC"), ntz).cast("timestamp")) + micros


def _readings(rows: DataFrame) -> DataFrame:
    """Adds ``_r``, the valid readings (format, instant) of each value, and ``_naive``: no zone is written."""
    v, shape = F.col("_v"), F.col("_shape")
    part, digit = (lambda name: lambda i: F.get(F.col(name), F.lit(i)))("_p"), (lambda name: lambda i: F.get(F.col(name), F.lit(i)))("_d")
    local = F.coalesce(F.col("_zone"), F.lit("UTC"))
    rows = rows.withColumn("_shape", _shape(v))
    # Bare digits may be an hour, a minute or a second written out; few values are.
    bare = F.regexp_replace(F.when(v.rlike(_PATTERNS["digits"]), v), _PATTERNS["digits"], _PARTS["digits"])
    rows = rows.withColumn("_p", _parts(v, shape)).withColumn("_d", F.split(bare, "~"))
    month, day = F.coalesce(part(1).try_cast("int"), _month(part(1))), part(2).try_cast("int")
    main = _instant(part, month, day, local)
    epoch = (
        F.when(shape == "epoch_ms", v.try_cast("long") * 1_000)
        .when(shape == "epoch_us", v.try_cast("long"))
        .when(shape == "epoch_s", (v.try_cast("decimal(20,6)") * 1_000_000).try_cast("long"))
    )
    reading = lambda name, at: F.when(at.isNotNull(), F.struct(F.lit(FORMATS.index(name)).alias("f"), at.alias("us")))
    found = [reading(name, F.when(shape == name.removesuffix("_mdy"), main)) for name in ("iso", "compact", "rfc", "month_name", "slash_mdy")]
    found += [reading(name, F.when(shape == name, epoch)) for name in ("epoch_s", "epoch_ms", "epoch_us")]
    found += [
        reading("slash_dmy", F.when(shape == "slash", _instant(part, day, month, local))),
        reading("rfc_century", F.when((shape == "rfc") & (F.length(part(0)) == 2), _instant(part, month, day, local, pivot=False))),
        reading("compact", F.when(F.col("_d").isNotNull(), _instant(digit, digit(1).try_cast("int"), digit(2).try_cast("int"), local))),
    ]
    stated = (part(8) != "") | (part(9) != "")
    return rows.withColumn("_r", F.array_compact(F.array(*found))).withColumn("_naive", F.col("_zone").isNull() & F.col("_p").isNotNull() & ~F.coalesce(stated, F.lit(False)))


def em_posteriors(readings: Sequence[Sequence[tuple[int, int]]], counts: np.ndarray, prior: np.ndarray, rounds: int = 50) -> list[np.ndarray]:
    """Posterior of each reading (format, year) of each set of valid ones; the source's mixture is fitted to the counts."""
    size = np.fromiter(map(len, readings), np.int64, len(readings))
    out = [np.zeros(n) for n in size]
    if not size.sum():
        return out
    owner = np.repeat(np.arange(len(size)), size)
    form = np.array([f for r in readings for f, _ in r])
    years, year = np.unique([y for r in readings for _, y in r], return_inverse=True)
    likely = (years >= LIKELY_YEARS[0]) & (years <= LIKELY_YEARS[1])
    base = np.where(likely, 0.95 / (LIKELY_YEARS[1] - LIKELY_YEARS[0] + 1), 0.05 / 1_000)
    share, in_year = prior / max(prior.sum(), 1e-300), base
    for _ in range(rounds):
        chance = share[form] * in_year[year]
        total = np.bincount(owner, chance, len(size))
        post = np.divide(chance, total[owner], out=np.zeros_like(chance), where=total[owner] > 0)
        seen = post * counts[owner]
        new = np.bincount(form, seen, len(FORMATS)) + 0.5 * prior
        new = new / max(new.sum(), 1e-300)
        in_year = (np.bincount(year, seen, len(years)) + YEAR_WEIGHT * base) / (seen.sum() + YEAR_WEIGHT)
        moved, share = np.abs(new - share).max(), new
        if moved < 1e-9:
            break
    return np.split(post, np.cumsum(size)[:-1])


def normalize_timestamps(df: DataFrame, id_col: str, value_col: str, source_col: str, zones: DataFrame, prior: Mapping[str, float] = MONTH_FIRST, min_posterior: float = 0.9) -> DataFrame:
    """``row_id, epoch_us, format, posterior, ambiguous`` of every row of ``df``.

    ``zones``: ``source, zone``, one row a source at most; it is joined by the size Spark sees,
    never forced into a broadcast. A source without zone reads zoneless values as UTC and marks
    them ambiguous. ``prior``: weight of an interpretation, 1 where nothing is said.
    """
    weights = np.array([float(prior.get(f, 1.0)) for f in FORMATS])
    zone = zones.select(F.col("source").alias("_zs"), F.col("zone").alias("_zone")).where("_zs is not null").dropDuplicates(["_zs"])
    rows = df.select(F.col(id_col).alias("row_id"), trimmed(F.col(value_col).cast("string")).alias("_v"), F.col(source_col).alias("_s"))
    rows = rows.join(zone, rows["_s"] == zone["_zs"], "left").select("row_id", "_v", F.coalesce("_s", F.lit("")).alias("_s"), "_zone")
    read = _readings(rows).select("row_id", "_s", "_r", "_naive")
    year = lambda r: F.year(F.timestamp_micros(r["us"]))
    # What a set of readings means for the mixture: its formats, and its years where there is a choice to be made by them.
    read = staged(df.sparkSession, read.withColumn("_k", F.transform("_r", lambda r: F.struct(r["f"].alias("f"), year(r).alias("y")))), "readings")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        post = em_posteriors([[(r["f"], r["y"]) for r in k] for k in pdf["_k"]], pdf["n"].to_numpy(float), weights)
        best = [int(p.argmax()) if len(p) and p.max() > 0 else -1 for p in post]
        return pd.DataFrame({"_s": pdf["_s"], "_k": pdf["_k"], "_b": np.array(best, np.int32), "posterior": [float(p[b]) if b >= 0 else 0.0 for p, b in zip(post, best)]})

    # A row for each source and set of readings: formats and years, whatever the number of values.
    counts = read.groupBy("_s", "_k").agg(F.count(F.lit(1)).alias("n"))
    kind = "array<struct<f: int, y: int>>"
    chosen = counts.groupBy("_s").applyInPandas(fit, f"_s string, _k {kind}, _b int, posterior double")
    out = read.join(chosen.withColumnsRenamed({"_s": "_cs", "_k": "_ck"}), (F.col("_s") == F.col("_cs")) & (F.col("_k") == F.col("_ck")), "left")
    taken = F.when(F.col("_b") >= 0, F.get("_r", F.col("_b")))
    return out.select(
        "row_id",
        taken["us"].alias("epoch_us"),
        F.when(F.col("_b") >= 0, F.get(F.array(*[F.lit(f) for f in FORMATS]), F.get("_r", F.col("_b"))["f"])).alias("format"),
        "posterior",
        (taken.isNotNull() & ((F.col("posterior") < min_posterior) | F.col("_naive"))).alias("ambiguous"),
    )
