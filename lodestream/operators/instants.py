"""Mixed timestamp formats and time zones, normalised to one instant.

A text is rewritten into nine canonical fields (year, month, day, hour, minute, second, fraction, half of day,
zone) by one of a few anchored patterns, all inside the JVM. A value that names an offset is done. For the rest
the parsed local time is joined as of the zone's exploded offset intervals, given in local time: one matching
interval gives the offset, two mean that the local time occurs twice, none that it is skipped.

Scale: the texts are parsed once, into a staged table, without a shuffle. The interval table has one row for each zone
of the time zone database and year that occur together, whatever the year, so the broadcast side has at most some
600 zones x the years of the data.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.runtime import staged

# Month names by language, English three-letter forms included.
MONTHS = {
    1: ("january", "jan", "januar", "janvier", "janeiro", "enero", "gennaio", "januari"),
    2: ("february", "feb", "februar", "février", "fevereiro", "febrero", "febbraio", "februari"),
    3: ("march", "mar", "märz", "mars", "março", "marzo", "maart"),
    4: ("april", "apr", "avril", "abril", "aprile"),
    5: ("may", "mai", "maio", "mayo", "maggio", "mei", "maj"),
    6: ("june", "jun", "juni", "juin", "junho", "junio", "giugno"),
    7: ("july", "jul", "juli", "juillet", "julho", "julio", "luglio"),
    8: ("august", "aug", "août", "agosto", "augustus", "augusti"),
    9: ("september", "sep", "sept", "septembre", "setembro", "septiembre", "settembre"),
    10: ("october", "oct", "oktober", "okt", "octobre", "outubro", "octubre", "ottobre"),
    11: ("november", "nov", "novembre", "novembro", "noviembre"),
    12: ("december", "dec", "dezember", "dez", "décembre", "dezembro", "diciembre", "dicembre"),
}

# Zone abbreviations with their fixed offsets in minutes.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "eet": 120, "eest": 180, "msk": 180,
    "ist": 330, "jst": 540, "kst": 540, "hkt": 480, "sgt": 480, "awst": 480, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
    "brt": -180, "brst": -120, "art": -180, "nst": -210, "ndt": -150, "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300,
    "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}

_ZONE = r"(?:\s*(z|[a-z]{2,5}(?![a-z/_])|(?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?)?\s*(?:\(?\[?([a-z]+(?:/[a-z_+\-0-9]+){1,2}|utc|gmt)\]?\)?)?)"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*([ap]\.?m\.?(?![a-z]))?"
_WEEKDAY = r"(?:[a-zäöüáéç\-]+\.?,\s*)?"

#: how a text of the form begins, pattern, order of the fields y mo d h mi s fraction half offset region in its groups;
#: a text is read by the first form that it begins like
FORMS = (
    (r"^\d{4}[-/.]", rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:(?:\s*t\s*|,?\s+){_CLOCK})?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"),
    (r"^\d{8}", rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[t ]?(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?)?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    (r"^\d{1,2}/", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}})(?:,?\s+{_CLOCK})?{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
    (r"^\d{1,2}\.\d", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}})(?:,?\s+{_CLOCK}(?:\s*uhr)?)?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
    (
        rf"^{_WEEKDAY}\d",
        rf"^{_WEEKDAY}(\d{{1,2}})(?:\.|st|nd|rd|th|er|º)?(?:\s+|-)(?:(?:de|of)\s+)?([a-zäöüáéíóúàèùûôç]+)\.?,?(?:\s+|-)(?:de\s+)?(\d{{4}}|\d{{2}})"
        rf"(?:(?:,?\s*(?:at|à|às|um|a las)\s+|,?\s+)(\d{{1,2}})\s?[:h]\s?(\d{{2}})(?::(\d{{2}})(?:[.,](\d+))?)?\s*([ap]\.?m\.?(?![a-z]))?(?:\s*uhr)?)?{_ZONE}$",
        "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10",
    ),
    (
        "",
        rf"^{_WEEKDAY}([a-z]+)\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:(?:,?\s*at\s+|,?\s+){_CLOCK})?{_ZONE}$",
        "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10",
    ),
)

_EPOCH = r"^(\d{9,10})(?:\.(\d+))?$|^(\d{13})$|^(\d{16})$|^(\d{19})$"
_DAY_US = 86_400_000_000


def _int(column: Column) -> Column:
    return F.when(column != "", column).cast("int")


def _fields(text: Column) -> Column:
    """Array of the ten fields, or of another size if the text has no known form. ``text`` is trimmed, in lower case,
    with single blanks. What a text begins with names its form, so that one long pattern is tried and no more."""
    out = None
    for begins, pattern, fields in FORMS:
        hit = F.regexp_replace(text, pattern, fields)
        out = F.when(text.rlike(begins), hit) if out is None else out.when(text.rlike(begins), hit) if begins else out.otherwise(hit)
    return F.when(~text.contains("|"), F.split(out, r"\|"))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is evaluated once a row: a generator keeps projections from being merged and repeated."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _month(column: Column) -> Column:
    names = F.create_map(*[F.lit(x) for m, words in MONTHS.items() for w in words for x in (w, m)])
    return F.when(column.rlike(r"^\d+$"), _int(column)).otherwise(F.try_element_at(names, column))


def _fixed_offset(column: Column) -> Column:
    """Seconds east of UTC of an abbreviation or a numeric offset; null if there is none."""
    table = F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, v * 60)])
    numeric = r"^(?:utc|gmt)?([+-])(\d{1,2}):?(\d{2})?$"
    size = F.regexp_extract(column, numeric, 2).try_cast("int") * 3600 + F.coalesce(F.regexp_extract(column, numeric, 3).try_cast("int"), F.lit(0)) * 60
    return F.when(column.rlike("[+-]"), F.when(column.rlike(numeric), F.when(column.contains("-"), -size).otherwise(size))).otherwise(F.try_element_at(table, column))


def parsed(values: DataFrame, text: str, day_first: str) -> DataFrame:
    """Adds epoch_us (values that are epochs), local_us, offset_s and region (as written, lower case)."""
    clean = F.trim(F.regexp_replace(F.lower(F.col(text)), r"[\s  ]+", " "))
    df = _once(values, "_t", clean)
    df = _once(df, "_f", _fields(F.col("_t")))
    df = df.withColumn("_f", F.when(F.size("_f") == 10, F.col("_f")))
    f = [F.element_at("_f", i + 1) for i in range(10)]
    slashes = F.col("_t").rlike(r"^\d{1,2}/\d{1,2}/")
    swap = slashes & F.coalesce(F.col(day_first), F.lit(False))
    year = _int(f[0])
    parts = F.struct(
        F.when(F.length(f[0]) == 2, year + 2000).otherwise(year).alias("_y"),
        _month(F.when(swap, f[2]).otherwise(f[1])).alias("_mo"),
        _int(F.when(swap, f[1]).otherwise(f[2])).alias("_d"),
        F.coalesce(_int(f[3]), F.lit(0)).alias("_h24"),
        F.coalesce(_int(f[4]), F.lit(0)).alias("_mi"),
        F.coalesce(_int(f[5]), F.lit(0)).alias("_s"),
        F.rpad(F.substring(f[6], 1, 6), 6, "0").cast("int").alias("_us"),
        F.substring(f[7], 1, 1).alias("_half"),
        F.when(f[8] != "", f[8]).alias("_offset"),
        F.when(f[9] != "", f[9]).alias("region"),
        _fixed_offset(F.when(f[8] != "", f[8])).cast("long").alias("offset_s"),
    )
    df = _once(df, "_p", parts).select(*values.columns, "_t", "_p.*")
    hour = F.when(F.col("_half") == "p", F.col("_h24") % 12 + 12).when(F.col("_half") == "a", F.col("_h24") % 12).otherwise(F.col("_h24"))
    good_clock = F.when(F.col("_half") != "", F.col("_h24").between(1, 12)).otherwise(F.col("_h24") <= 23) & (F.col("_mi") <= 59) & (F.col("_s") <= 59)
    good_month = F.col("_mo").between(1, 12) & (F.col("_y") >= 1)
    first = F.when(good_month, F.make_date("_y", "_mo", F.lit(1)))
    days = F.unix_date(first) + F.col("_d") - 1
    good_day = F.col("_d").between(1, F.day(F.last_day(first)))
    local = days.cast("long") * _DAY_US + (hour * 3600 + F.col("_mi") * 60 + F.col("_s")).cast("long") * 1_000_000 + F.coalesce("_us", F.lit(0))
    known = F.col("_offset").isNull() | F.col("offset_s").isNotNull()
    usable = good_month & good_day & good_clock & known

    def digits(group: int) -> Column:
        return F.regexp_extract("_t", _EPOCH, group)

    epoch = (
        F.when(digits(1) != "", digits(1).try_cast("long") * 1_000_000 + F.rpad(F.substring(digits(2), 1, 6), 6, "0").try_cast("long"))
        .when(digits(3) != "", digits(3).try_cast("long") * 1000)
        .when(digits(4) != "", digits(4).try_cast("long"))
        .when(digits(5) != "", F.floor(digits(5).try_cast("long") / 1000))
    )
    return df.select(*values.columns, F.when(F.col("_t").rlike(r"^\d{9}"), epoch).alias("epoch_us"), F.when(usable, local).alias("local_us"), "offset_s", "region")


_EPOCH_START = dt.datetime(1970, 1, 1)
#: Seconds of the first and last instants that the library can turn into any zone's local time.
_FIRST = int((dt.datetime(1, 1, 3) - _EPOCH_START).total_seconds())
_LAST = int((dt.datetime(9999, 12, 29) - _EPOCH_START).total_seconds())


def _offset_at(zone: ZoneInfo, second: int) -> int:
    at = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=min(max(second, _FIRST), _LAST))
    return int(at.astimezone(zone).utcoffset().total_seconds())


def _year_start(year: int) -> int:
    """Seconds since 1970 of a year's beginning; the year after the last is that many days later."""
    return int((dt.datetime(min(year, 9999), 1, 1) - _EPOCH_START).total_seconds()) + (365 * 86400 if year > 9999 else 0)


def offset_intervals(zone_name: str, year: int) -> list[tuple[int, int, int]]:
    """(from, to, offset) in UTC seconds covering the year and two days on either side, from the time zone database; a
    step is found to the second."""
    zone = ZoneInfo(zone_name)
    start, end = _year_start(year) - 2 * 86400, _year_start(year + 1) + 2 * 86400
    out: list[tuple[int, int, int]] = []
    begun, now = start, _offset_at(zone, start)
    at = start
    while at < end:
        nxt = min(at + 86400, end)
        off = _offset_at(zone, nxt)
        if off != now:
            lo, hi = at, nxt
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if _offset_at(zone, mid) == now else (lo, mid)
            out.append((begun, hi, now))
            begun, now = hi, _offset_at(zone, hi)
            at = hi
        else:
            at = nxt
    out.append((begun, end, now))
    return out


def interval_table(spark, wanted: Iterable[tuple[str, str, int]]) -> DataFrame:
    """region (as written), year, intervals: array of (local_from, local_to, offset_us) in local microseconds, for each
    (region as written, zone, year)."""
    rows = [(written, year, [((a + o) * 1_000_000, (b + o) * 1_000_000, o * 1_000_000) for a, b, o in offset_intervals(name, year)]) for written, name, year in sorted(wanted)]
    return spark.createDataFrame(rows, "region string, year int, intervals array<struct<local_from:long, local_to:long, offset_us:long>>")


def to_instants(values: DataFrame, text: str = "text", zone: str = "tz", day_first: str = "day_first", keep: Sequence[str] | None = None) -> DataFrame:
    """Adds epoch_us (bigint, microseconds since 1970 UTC) and zone_case to every row; both are null if unusable.

    ``zone_case`` is fixed (an epoch, offset or abbreviation), single, ambiguous (the earlier instant) or skipped
    (moved later by the length of the gap). A zone or offset in the text prevails over column ``zone``, an offset
    over a region beside it. Date alone is local midnight. Years are 1 to 9999. Null, blank, impossible and other texts
    are unusable, and so is a local time without any known zone. Rows, repeated ones included, and extra columns are
    kept, or only the columns of ``keep``.
    """
    spark = values.sparkSession
    kept = list(values.columns if keep is None else keep)
    by_lower = {z.lower(): z for z in available_timezones()}
    wanted = F.coalesce(F.col("region"), F.lower(F.col(zone)))
    year = F.year(F.date_from_unix_date(F.floor(F.col("local_us") / _DAY_US).cast("int")))
    local = parsed(values, text, day_first).select(*kept, "epoch_us", "local_us", "offset_s", F.when(F.col("offset_s").isNull(), wanted).alias("_region"), year.alias("_year"))
    local = staged(local, "local-times")
    named = local.filter(F.col("local_us").isNotNull() & F.col("_region").isNotNull()).select("_region", "_year").distinct()
    found = named.filter(F.col("_region").isin(*by_lower)).collect()  # at most the zones of the database x 9,999 years
    table = interval_table(spark, [(r["_region"], by_lower[r["_region"]], r["_year"]) for r in found]).withColumnsRenamed({"region": "_region", "year": "_year"})
    joined = local.join(F.broadcast(table), ["_region", "_year"], "left")
    at = F.col("local_us")
    hits = F.filter("intervals", lambda x: (x["local_from"] <= at) & (at < x["local_to"]))
    before = F.filter("intervals", lambda x: x["local_to"] <= at)
    biggest = F.array_max(F.transform(hits, lambda x: x["offset_us"]))
    previous = F.element_at(F.array_sort(F.transform(before, lambda x: F.struct(x["local_to"], x["offset_us"]))), -1)["offset_us"]
    offset = F.when(F.col("offset_s").isNotNull(), F.col("offset_s") * 1_000_000).when(F.size(hits) > 0, biggest).when(F.size(before) > 0, previous)
    instant = F.coalesce("epoch_us", at - offset)
    case = F.when(F.col("epoch_us").isNotNull() | F.col("offset_s").isNotNull(), "fixed").when(F.size(hits) > 1, "ambiguous").when(F.size(hits) == 1, "single").otherwise("skipped")
    return joined.select(*kept, instant.alias("epoch_us"), F.when(instant.isNotNull(), case).alias("zone_case"))


def draft_instants(drafts: DataFrame, feeds: DataFrame) -> DataFrame:
    """draft_id, field_name, epoch_us of every usable event_date and observed_at text of signal_event_draft."""
    rules = feeds.select("source", "tz", "day_first").dropDuplicates(["source"])
    long = drafts.select("draft_id", "source", F.explode(F.array(F.struct(F.lit("event_date").alias("field_name"), F.col("event_date").alias("text")), F.struct(F.lit("observed_at").alias("field_name"), F.col("observed_at").alias("text")))).alias("v")).select("draft_id", "source", "v.field_name", "v.text").filter(F.col("text").isNotNull())
    return to_instants(long.join(rules, "source", "left"), keep=["draft_id", "field_name"]).filter(F.col("epoch_us").isNotNull()).select("draft_id", "field_name", "epoch_us").distinct()
