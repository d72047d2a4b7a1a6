from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestream.operators import instants, units


def us(*a, tz=timezone.utc, fold=0):
    return int(datetime(*a, tzinfo=tz, fold=fold).timestamp() * 1_000_000)


NY = ZoneInfo("America/New_York")
CASES = [
    ("2024-01-05 16:00", "America/New_York", False, us(2024, 1, 5, 21, 0)),
    (" 2024-08-21t16:28:47z ", "Europe/Berlin", True, us(2024, 8, 21, 16, 28, 47)),
    ("05/10/2024 21:30", "Europe/Paris", True, us(2024, 10, 5, 19, 30)),
    ("05/10/2024 21:30", "UTC", False, us(2024, 5, 10, 21, 30)),
    ("13/13/2025", "UTC", False, None), ("2025-02-30", "UTC", False, None), ("0000-00-00 00:00:00", "UTC", False, None), ("yesterday", "UTC", False, None), ("", "UTC", False, None), (None, "UTC", False, None),
    ("1729246861", None, False, 1729246861 * 10**6), ("1735926324.65", None, False, 1735926324650000), ("1715543504403", None, False, 1715543504403000), ("1728170385555610", None, False, 1728170385555610),
    ("2025-05-02T14:16:22.623246955+01:00", "Asia/Tokyo", False, us(2025, 5, 2, 13, 16, 22) + 623246),
    ("Sat, 29 Jun 2024 04:31:51 +0100", "UTC", False, us(2024, 6, 29, 3, 31, 51)), ("Sat, 21 Sep 2024 00:52:45 GMT", "Asia/Tokyo", False, us(2024, 9, 21, 0, 52, 45)),
    ("April 18, 2025 at 1:50pm", "UTC", False, us(2025, 4, 18, 13, 50)), ("3/30/2025 6:46 AM", "UTC", False, us(2025, 3, 30, 6, 46)), ("1/2/2025 12:10 AM", "UTC", False, us(2025, 1, 2, 0, 10)),
    ("20240318T165255Z", "UTC", False, us(2024, 3, 18, 16, 52, 55)), ("20240128", "Asia/Kolkata", True, us(2024, 1, 27, 18, 30)), ("12/7/24", "UTC", False, us(2024, 12, 7)), ("12/7/24", "UTC", True, us(2024, 7, 12)),
    ("2025-01-05T11:25:25[America/Los_Angeles]", "UTC", False, us(2025, 1, 5, 19, 25, 25)), ("2024-11-18 11:33:28 America/Sao_Paulo", "UTC", False, us(2024, 11, 18, 14, 33, 28)),
    ("2024-02-17 11:16:24 CET", "UTC", False, us(2024, 2, 17, 10, 16, 24)), ("Jun 24, 2024 12:57:16 PM EDT", "UTC", False, us(2024, 6, 24, 16, 57, 16)),
    ("27. März 2024, 16:20 Uhr", "Europe/Berlin", True, us(2024, 3, 27, 15, 20)), ("31 mars 2024 à 1h36", "Europe/Paris", True, us(2024, 3, 31, 0, 36)), ("25 de março de 2025 às 07:39", "America/Sao_Paulo", True, us(2025, 3, 25, 10, 39)),
    ("18.05.2024", "UTC", False, us(2024, 5, 18)), ("11-JAN-2025", "UTC", False, us(2025, 1, 11)), ("5 September 2024", "UTC", False, us(2024, 9, 5)),
    ("2024-11-03 01:30", "America/New_York", False, us(2024, 11, 3, 5, 30)),  # twice: the earlier
    ("2024-03-10 02:30", "America/New_York", False, us(2024, 3, 10, 7, 30)),  # skipped: later by the gap
    ("2024-11-03 01:30 EST", "America/New_York", False, us(2024, 11, 3, 6, 30)),
    ("2024-01-05 16:00", None, False, None), ("2024-01-05 16:00 XYZ", "UTC", False, None), ("x" * 50_000, "UTC", False, None),
]


def test_every_form(spark):
    df = spark.createDataFrame([(i, t, z, d) for i, (t, z, d, _) in enumerate(CASES)], "n int, text string, tz string, day_first boolean")
    got = {r["n"]: r["epoch_us"] for r in instants.to_instants(df).collect()}
    assert {i: got[i] for i in got if got[i] != CASES[i][3]} == {} and len(got) == len(CASES)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.datetimes(min_value=datetime(2023, 1, 1), max_value=datetime(2026, 1, 1)), min_size=1, max_size=200))
def test_local_times_agree_with_the_library(spark, moments):
    moments = [m.replace(microsecond=0, fold=0) for m in moments]
    df = spark.createDataFrame([(i, m.strftime("%Y-%m-%d %H:%M:%S"), "America/New_York", False) for i, m in enumerate(moments)], "n int, text string, tz string, day_first boolean")
    got = {r["n"]: r["epoch_us"] for r in instants.to_instants(df).collect()}
    # fold=0 is the earlier of two instants, and before a gap it is the offset that moves the time later
    assert got == {i: int(m.replace(tzinfo=NY).timestamp()) * 1_000_000 for i, m in enumerate(moments)}


def test_empty_drafts(spark):
    d = spark.createDataFrame([], "draft_id long, source string, event_date string, observed_at string")
    f = spark.createDataFrame([], "source string, tz string, day_first boolean")
    assert instants.draft_instants(d, f).count() == 0


MONEY = [
    ("$25.2m", None, (25_200_000, 25_200_000)), ("216,000", "kUSD", (216_000_000, 216_000_000)), ("A$208,000,000", None, (137_280_000, 137_280_000)), ("0.68", "CHF m", (761_600, 761_600)), ("₹1400 crore", None, (168_000_000, 168_000_000)),
    ("INR 2 lakh", None, (2400, 2400)), ("1.650e+08 EUR", None, (178_200_000, 178_200_000)), ("56,9 Mio. EUR", None, (61_452_000, 61_452_000)), ("26.500.000 €", None, (28_620_000, 28_620_000)), ("between 5.03 and 14.78 million USD", None, (5_030_000, 14_780_000)),
    ("$16.2M-$38.88M", None, (16_200_000, 38_880_000)), ("~US$2M (Series A, 2018)", None, (2_000_000, 2_000_000)), ("$0.65M seed; total US$11,500K", None, (11_500_000, 11_500_000)), ("total 2370mn SEK, of which $0.37M seed", None, (225_150_000, 225_150_000)),
    ("Raised 409mn JPY in total", None, (2_740_300, 2_740_300)), ("more than $5M", None, (5_000_000, -1)), ("JPY 75", None, (1, 1)), ("58000000", None, None), ("0.29", None, None), ("undisclosed", None, None), ("", None, None), (None, "USD", None), ("Series B", None, None), ("5 XYZ", None, None),
]


def rates(spark):
    return spark.createDataFrame([("USD", 1.0), ("EUR", 1.08), ("AUD", 0.66), ("CHF", 1.12), ("INR", 0.012), ("SEK", 0.095), ("JPY", 0.0067)], "currency string, usd_per_unit double")


def test_money(spark):
    r = spark.createDataFrame([(str(i), "c", t, u, 1) for i, (t, u, _) in enumerate(MONEY)], "id string, company_id string, total_raised string, amount_unit string, extra int")
    c = spark.createDataFrame([], "id string, funding string, employee_range string, headcount int")
    got = {int(x["record_id"]): (x["low_value"], x["high_value"]) for x in units.converted_money(r, c, rates(spark)).collect()}
    assert {i: (MONEY[i], got.get(i)) for i in range(len(MONEY)) if got.get(i) != MONEY[i][2]} == {}


def test_identity_decides_between_readings(spark):
    """1.250 € is 1250 or 1.25; the company's other amounts tell which; without them it is flagged."""
    r = spark.createDataFrame([("a", "c", "1.250 €", None), ("b", "c", "€1,300", None), ("d", "e", "1.250 €", None)], "id string, company_id string, total_raised string, amount_unit string")
    c = spark.createDataFrame([], "id string, funding string, employee_range string, headcount int")
    got = {x["record_id"]: (x["low_value"], x["solution"]) for x in units.converted_money(r, c, rates(spark)).collect()}
    assert got == {"a": (1350, "identity"), "b": (1404, "stated"), "d": (1350, "not_unique")}


HEADS = [("51-200", (51, 200)), ("201 to 500", (201, 500)), ("1001..5000", (1001, 5000)), ("201–500 employees", (201, 500)), ("[1, 10]", (1, 10)), ("4 dozen people", (48, 48)), ("min. 4 heads", (4, -1)), ("10 001+", (10001, -1)), ("10+", (10, -1)), ("7 or more", (7, -1)), ("4.8k-5.3k", (4800, 5300)), ("0.8 thousand staff", (800, 800)), ("1,001 - 5,000 people", (1001, 5000)), ("headcount: 4,223", (4223, 4223)), ("growing", None), ("-", None)]


def test_head_counts(spark):
    c = spark.createDataFrame([(str(i), None, t, None) for i, (t, _) in enumerate(HEADS)], "id string, funding string, employee_range string, headcount int")
    got = {int(x["record_id"]): (x["low_value"], x["high_value"]) for x in units.converted_head_counts(c).collect()}
    assert {i: (HEADS[i], got.get(i)) for i in range(len(HEADS)) if got.get(i) != HEADS[i][1]} == {}


def test_units_without_any_are_inferred(spark):
    r = spark.createDataFrame([("a", "c", "2.5", None), ("b", "c", "$2.5M", None), ("d", "e", "7", None)], "id string, company_id string, total_raised string, amount_unit string")
    c = spark.createDataFrame([], "id string, funding string, employee_range string, headcount int")
    got = {x["record_id"]: (x["currency"], x["scale"], x["solution"]) for x in units.inferred_units(r, c, rates(spark)).collect()}
    assert got["a"] == ("USD", 1_000_000, "identity") and got["d"] == (None, None, "none") and "b" not in got
