import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators.timestamps import FORMATS, em_posteriors, normalize_timestamps

CASES = [
    ("2024-03-10T02:30:00", "America/New_York", "2024-03-10 07:30:00"),  # skipped: moved on by the gap
    ("2024-11-03T01:30:00", "America/New_York", "2024-11-03 05:30:00"),  # twice: the first
    ("2024-07-01", "America/Chicago", "2024-07-01 05:00:00"),
    ("Fri, 01 Aug 2025 03:00:35 -0400", "UTC", "2025-08-01 07:00:35"),
    ("Friday, 01-Aug-25 00:04:47 GMT", "UTC", "2025-08-01 00:04:47"),
    ("Aug. 1, 2023 at 12:07 a.m. ET", "America/Denver", "2023-08-01 04:07:00"),
    ("April 1, 2023 12:38 pm", "America/Los_Angeles", "2023-04-01 19:38:00"),
    ("05/08/2023 01:34:46 AM", "UTC", "2023-05-08 01:34:46"),
    ("20230101T061156Z", "Asia/Tokyo", "2023-01-01 06:11:56"),
    ("1672533918811", "Asia/Tokyo", "2023-01-01 00:45:18.811"),
    ("1672533918", "Asia/Tokyo", "2023-01-01 00:45:18"),
    ("2022-12-31T21:29:20-05:00[America/New_York]", "UTC", "2023-01-01 02:29:20"),
    (" 2023-01-27T12:52:13.826564425Z ", "UTC", "2023-01-27 12:52:13.826564"),
    ("1 Apr 2023 18:43 -04:00", "UTC", "2023-04-01 22:43:00"),
    ("2023-01-12t08:48:40z", "America/New_York", "2023-01-12 08:48:40"),
    *[(x, "UTC", None) for x in ("2025-13-04T10:00:00Z", "2024-02-30", "00/00/0000", "TBD", "", "   ", "Q3 2024", "-", "25:00", "2024-01-01T24:10:00Z", None)],
]


def test_written_forms(spark):
    rows = [(i, v, z) for i, (v, z, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id long, v string, src string").withColumn("zone", F.lit("clash")).withColumn("row_id", F.lit("clash"))
    zones = spark.createDataFrame([(z, z) for z in {c[1] for c in CASES}], "source string, zone string")
    out = normalize_timestamps(df, "id", "v", "src", zones)
    got = {r["row_id"]: r["t"] for r in out.select("row_id", F.timestamp_micros("epoch_us").cast("string").alias("t")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(CASES)}


def test_zone_missing_is_marked_and_repeated_rows_repeat(spark):
    df = spark.createDataFrame([(1, "2024-01-01 10:00:00", None), (1, "2024-01-01 10:00:00", None), (2, "2024-01-01T10:00:00Z", "x")], "id long, v string, s string")
    zones = spark.createDataFrame([], "source string, zone string")
    got = sorted((r["row_id"], r["ambiguous"]) for r in normalize_timestamps(df, "id", "v", "s", zones).collect())
    assert got == [(1, True), (1, True), (2, False)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, v string, s string")
    zones = spark.createDataFrame([], "source string, zone string")
    assert normalize_timestamps(df, "id", "v", "s", zones).count() == 0


F_ = FORMATS.index


def test_mixture_decides_between_orders():
    mdy, dmy = (F_("slash_mdy"), 2024), (F_("slash_dmy"), 2024)
    sets, counts = [[mdy], [dmy], [mdy, dmy]], np.array([5.0, 500.0, 200.0])
    post = em_posteriors(sets, counts, np.ones(len(FORMATS)))
    assert post[2].argmax() == 1 and post[2].max() > 0.9
    prior = np.array([0.0 if f == "slash_dmy" else 1.0 for f in FORMATS])
    assert em_posteriors(sets, counts, prior)[2].argmax() == 0


def test_years_of_the_source_decide():
    sets = [[(F_("rfc"), 1971), (F_("rfc_century"), 2071)], [(F_("iso"), 2071)]]
    prior = np.array([0.1 if f == "rfc_century" else 1.0 for f in FORMATS])
    assert em_posteriors(sets[:1], np.array([9.0]), prior)[0].argmax() == 0
    assert em_posteriors(sets, np.array([9.0, 4000.0]), prior)[0].argmax() == 1


@pytest.mark.parametrize("sets", [[], [[]], [[(F_("slash_dmy"), 2024)]]])
def test_no_valid_reading_has_no_posterior(sets):
    prior = np.array([0.0 if f == "slash_dmy" else 1.0 for f in FORMATS])
    assert sum(p.sum() for p in em_posteriors(sets, np.ones(len(sets)), prior)) == 0


def test_a_sources_mixture_changes_an_interpretation(spark):
    """The same digits are a minute written out where others are, and milliseconds where those are usual."""
    value = "197612050930"
    digits, millis = [f"1976{m:02d}{d:02d}T1015Z" for m in range(1, 13) for d in range(14, 29)], [str(190_000_000_000 + 77_777_777 * i) for i in range(180)]
    rows = [(i, v, "digits") for i, v in enumerate(digits)] + [(1000 + i, v, "millis") for i, v in enumerate(millis)] + [(5000, value, "digits"), (5001, value, "millis")]
    zones = spark.createDataFrame([("digits", "UTC"), ("millis", "UTC")], "source string, zone string")
    got = {r["row_id"]: (r["format"], r["epoch_us"]) for r in normalize_timestamps(spark.createDataFrame(rows, "id long, v string, s string"), "id", "v", "s", zones).where("row_id >= 5000").collect()}
    assert got == {5000: ("compact", 218626200000000), 5001: ("epoch_ms", 197612050930000)}
    alone = normalize_timestamps(spark.createDataFrame([(1, "Friday, 01-Aug-25 00:00:00 GMT", "s"), (2, "1612010512", "s")], "id long, v string, s string"), "id", "v", "s", zones)
    assert {r["row_id"]: r["format"] for r in alone.collect()} == {1: "rfc", 2: "epoch_s"}
