"""Filing rows with changing columns, roster matching, configuration upkeep, page candidates, status texts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import any_of, digits
from newsloom.functions.urls import host, root
from newsloom.operators.joins import cascade_match
from newsloom.sources.tables import row_text, synonym

#: Under which names sources write a column.
SYNONYMS = {
    "file_number": ("File Number", "File No", "FileNumber", "File #", "FileNum", "Lead File Number", "Member File Number", "Lead/Member File Number"),
    "application_id": ("Application ID", "Application Id", "ApplicationID", "App ID"),
    "call_sign": ("Call Sign", "Callsign", "CallSign"),
    "facility_id": ("Facility ID", "Facility Id", "FacilityID"),
    "applicant": ("Applicant", "Applicant Name", "Licensee"),
    "application_type": ("Application Type", "Purpose", "Type"),
    "detail_url": ("Detail URL", "Application URL", "Link"),
    "pdf_url": ("PDF URL", "Document URL"),
}


def typed_row(row: Column, names: dict[str, Sequence[str]] = SYNONYMS) -> list[Column]:
    """One column a meaning, from a map whose column names differ by source."""
    return [synonym(row, options).alias(name) for name, options in names.items()]


def call_sign_of(row: Column, names: Sequence[str] = SYNONYMS["call_sign"]) -> Column:
    """The row's call sign: its own column, else the first in any cell."""
    found = F.regexp_extract(F.upper(row_text(row)), r"\b([WK][A-Z0-9]{2,7}(?:-(?:FM|AM|TV))?)\b", 1)
    return F.coalesce(F.upper(synonym(row, names)), F.nullif(found, F.lit("")))


def is_call_sign(c: Column) -> Column:
    return F.coalesce(F.upper(F.trim(c)).rlike("^[KW][A-Z0-9]{2,6}(-[A-Z0-9]{1,4})?$"), F.lit(False))


def stable_url(detail: Column, facility: Column, marks: Sequence[str] = ("jsessionid", "session=")) -> Column:
    """An address that lives only as long as a session gives way to the facility's."""
    return F.when(any_of([F.lower(detail).contains(m) for m in marks]), facility).otherwise(F.coalesce(detail, facility))


def alert_key(source: Column, *parts: Column) -> Column:
    """``source:part:part``; a missing part stays as an empty place."""
    return F.concat_ws(":", source, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def match_roster(rows: DataFrame, call_signs: DataFrame, facilities: DataFrame, names: DataFrame) -> DataFrame:
    """``matched_by`` of rows with ``call_sign``, ``facility_id`` and ``org_name``."""
    ready = rows.withColumn("facility_id", digits("facility_id"))
    return cascade_match(ready, [("call_sign", "call_sign", call_signs), ("facility_id", "facility_id", facilities), ("org_name", "org_name", names)])


def roster_summary(keys: DataFrame) -> DataFrame:
    """``key_type, n`` of a roster's keys."""
    return keys.groupBy("key_type").agg(F.countDistinct("key").alias("n"))


def page_numbers(script: Column | str) -> Column:
    """The distinct pages that a page's script can go to, in order."""
    found = F.regexp_extract_all(script, F.lit(r"(?i)page['\"]?\s*[:=]\s*['\"]?(\d+)"), 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def has_results(html: Column | str, markers: Sequence[str]) -> Column:
    return any_of([F.lower(html).contains(m.lower()) for m in markers])


def status_value(text: Column | str, key: str) -> Column:
    """The value of a ``key = value`` line."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?m)^\s*{key}\s*=\s*(.*)$", 1)), F.lit(""))


def apply_candidates(config: DataFrame, candidates: DataFrame, note: str) -> DataFrame:
    """Blank addresses get their candidate's, with one note; such entries stay disabled until someone looks at them."""
    best = candidates.groupBy("station_id").agg(F.min_by("url", F.struct(-F.col("score"), F.col("url"))).alias("_url"))
    out = config.join(best, "station_id", "left")
    blank = (F.length(F.trim(F.coalesce("page_url", F.lit("")))) == 0) & F.col("_url").isNotNull()
    notes = F.coalesce("notes", F.lit(""))
    noted = F.when(notes.contains(note), notes).otherwise(F.trim(F.concat_ws(" ", notes, F.lit(note))))
    return out.select(
        *[F.col(c) for c in config.columns if c not in ("page_url", "notes", "enabled")],
        F.when(blank, F.col("_url")).otherwise(F.col("page_url")).alias("page_url"),
        F.when(blank, noted).otherwise(F.col("notes")).alias("notes"),
        F.when(blank, F.lit(False)).otherwise(F.col("enabled")).alias("enabled"),
    )


def review_rows(config: DataFrame, docs: DataFrame, enabled: str, key: str, order: str, shown: str) -> DataFrame:
    """``key, documents, first_document`` of entries that are disabled but have documents."""
    per = docs.groupBy(key).agg(F.count(F.lit(1)).alias("documents"), F.min_by(shown, order).alias("first_document"))
    return config.where(~F.col(enabled)).select(key).distinct().join(per, key)


def candidate_domains(pages: DataFrame, url: str, words: Column, low_value: Sequence[str] = (), k: int = 4) -> DataFrame:
    """``root, score``: the best ``k`` sites, by how many of a name's words their host holds; known low-value hosts are out."""
    h = host(url)
    hits = F.size(F.filter(words, lambda w: F.contains(h, w)))
    kept = pages.where(root(url).isNotNull())
    if low_value:
        kept = kept.where(~any_of([h.contains(x) for x in low_value]))
    scored = kept.select(root(url).alias("root"), (hits * 5).alias("score")).groupBy("root").agg(F.max("score").alias("score"))
    return scored.orderBy(F.desc("score"), "root").limit(k)


def best_image(sources: Sequence[Column], sizes: Column) -> Column:
    """The first source that isn't empty, else the largest of the sizes (``url, width, height``)."""
    area = F.array_max(F.transform(sizes, lambda s: F.struct((s["width"] * s["height"]).alias("area"), s["url"].alias("url"))))
    return F.coalesce(*[F.nullif(F.trim(s), F.lit("")) for s in sources], area["url"])


def health_rollup(*parts: DataFrame) -> DataFrame:
    """One row out of several one-row summaries."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])
