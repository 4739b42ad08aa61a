"""Mixed timestamp notations to single UTC instants.

Notations are parsed by built-in expressions into a wall-clock time and, if
the text has one, an offset.  Times without an offset are joined as-of to the
offset intervals of their zone: each interval between two changes of offset
is kept in *local* time, so one match gives the offset, two mean that the
wall-clock time occurs twice, none that it never occurs.

Fixed meaning of odd input: null, empty or unparsable texts, dates without a
time of day, impossible dates, unknown zones and devices without a zone give
no row.  Repeated rows of an offer give one row.  Offers whose repeated rows
disagree about the instant give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names as written in English, German, French and Spanish.
MONTHS = {
    1: "january jan januar jänner janvier janv enero ene",
    2: "february feb februar février fevrier févr fév fevr febrero",
    3: "march mar märz maerz mär mrz mars marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juillet juil julio",
    8: "august aug août aout agosto ago",
    9: "september sep sept septembre septiembre setiembre",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez décembre decembre déc diciembre dic",
}
# Zone abbreviations and their offsets in minutes.
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120,
    "eest": 180, "msk": 180, "ist": 330, "npt": 345, "jst": 540, "kst": 540, "acst": 570, "acdt": 630,
    "aest": 600, "aedt": 660, "awst": 480, "nzst": 720, "nzdt": 780, "est": -300, "edt": -240,
    "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540,
    "akdt": -480, "hst": -600,
}

MONTH = r"(\p{L}{3,12})\.?"
CLOCK = r"(\d{1,2})(?:[:.h](\d{2}))(?:[:.](\d{2})(?:[.,](\d{1,9}))?)?\s?(am|pm|a\.m\.|p\.m\.)?(?:\s?uhr)?"
ZONE = r"(?:\s?\(?((?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?|[a-z]{1,5})\)?)?"
#: Years that offset intervals are bucketed by; outside them the first or last rule of the zone holds.
FIRST_YEAR, LAST_YEAR = 1900, 2100

# (pattern, groups of: year, month, day, hour, minute, second, fraction, am/pm, zone, zone id)
_FORMS = [
    (rf"^(\d{{4}})[-:/.](\d{{2}})[-:/.](\d{{2}})[t ,]\s?{CLOCK}{ZONE}$", (1, 2, 3, 4, 5, 6, 7, 8, 9, 0)),
    (r"^(?:tzid=([a-z0-9_+/-]+):|[a-z]{2,12}[-_ ])?(\d{4})(\d{2})(\d{2})[t_-](\d{2})(\d{2})(\d{2})(\d{3})?(z|[+-]\d{4})?(?:_\d+)?(?:\.[a-z]\w{1,4})?$", (2, 3, 4, 5, 6, 7, 8, 0, 9, 1)),
    (r"^[a-z]+[-_ ](\d{4})-(\d{2})-(\d{2})(?: at |[-_ ])(\d{2})[.:-](\d{2})[.:-](\d{2})(?:\.[a-z]\w{1,4})?$", (1, 2, 3, 4, 5, 6, 0, 0, 0, 0)),
    (r"^[a-z]+ (\d{1,2}) (\p{L}{3,9}) (\d{4}) (\d{2})(\d{2})(?:\.[a-z]\w{1,4})?$", (3, 2, 1, 4, 5, 0, 0, 0, 0, 0)),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),?\s{CLOCK}{ZONE}$", (3, 2, 1, 4, 5, 6, 7, 8, 9, 0)),
    (rf"^(?:\p{{L}}{{2,10}}\.?,?\s)?(\d{{1,2}})\.?\s(?:de\s)?{MONTH}\s(?:de\s)?(\d{{4}})(?:,|\sat|\sà|\sum|\sa las)?\s{CLOCK}{ZONE}$", (3, 2, 1, 4, 5, 6, 7, 8, 9, 0)),
    (rf"^(?:\p{{L}}{{2,10}},?\s)?{MONTH}\s(\d{{1,2}}),?\s(\d{{4}})(?:,|\sat)?\s{CLOCK}{ZONE}$", (3, 1, 2, 4, 5, 6, 7, 8, 9, 0)),
    (r"^\p{L}{3} (\p{L}{3}) {1,2}(\d{1,2}) (\d{2}):(\d{2}):(\d{2}) (\d{4})$", (6, 1, 2, 3, 4, 5, 0, 0, 0, 0)),
]
_SLASHES = rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),?\s{CLOCK}{ZONE}$"


def _int(c: Column) -> Column:
    return F.when(c == "", None).otherwise(c).cast("int")


def _micros(frac: Column) -> Column:
    """The first six digits of a fraction of a second."""
    return F.substring(F.rpad(frac, 9, "0"), 1, 6).cast("int")


def _month(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for n, words in MONTHS.items() for w in words.split() for x in (w, n)])
    return F.try_element_at(names, F.rtrim(c, F.lit(".")))


def _offset(z: Column) -> Column:
    """Seconds east of Greenwich of a zone as written (lower case)."""
    table = F.create_map(*[F.lit(x) for k, v in ZONES.items() for x in (k, v * 60)])
    sign = F.when(F.contains(z, F.lit("-")), -1).otherwise(1)
    hours = _int(F.regexp_extract(z, r"[+-](\d{1,2})", 1))
    minutes = F.coalesce(_int(F.regexp_extract(z, r"[+-]\d{1,2}:?(\d{2})$", 1)), F.lit(0))
    numeric = F.when((hours <= 18) & (minutes < 60), sign * (hours * 3600 + minutes * 60))
    return F.when(z.rlike(r"[+-]\d"), numeric).otherwise(F.try_element_at(table, z))


def _canonical(text: Column) -> Column:
    """The fields of a text, in the order of :data:`FIELDS`, with bars between
    them, or null where no notation fits: one replacement per notation."""
    forms = [(p, at) for p, at in _FORMS] + [(_SLASHES, (3, 1, 2, 4, 5, 6, 7, 8, 9, 0))]
    options = []
    for k, (pattern, at) in enumerate(forms):
        fields = "|".join(f"${n}" if n else "" for n in at) + ("|/" if k == len(forms) - 1 else "|")
        options.append(F.when(text.rlike("(?iu)" + pattern), F.regexp_replace(text, "(?iu)" + pattern, fields)))
    return F.coalesce(*options)


FIELDS = ("year", "month", "day", "hour", "minute", "second", "fraction", "half", "zone", "zone_id", "slash")


def parse(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with the fields of the text as columns ``_year`` ... ``_zone_id``;
    rows in no known notation are kept with nulls."""
    # each explode of a single value keeps the optimiser from copying the
    # expression below it into every field
    clean = rows.withColumn("_t", F.explode(F.array(F.regexp_replace(F.col(text_col), r"(?U)^\s+|\s+$", ""))))
    canon = clean.withColumn("_f", F.explode(F.array(F.split(_canonical(F.col("_t")), r"\|"))))
    at = lambda name: F.col("_f")[FIELDS.index(name)]
    low = canon.withColumns({f"_{n}": _int(at(n)) for n in ("year", "day", "hour", "minute")} | {"_second": F.coalesce(_int(at("second")), F.lit(0)), "_micros": F.coalesce(_micros(F.when(at("fraction") != "", at("fraction"))), F.lit(0)), "_half": F.lower(F.substring(at("half"), 1, 1)), "_zone": F.lower(at("zone")), "_zone_id": F.when(at("zone_id") != "", at("zone_id")), "_m": F.lower(at("month")), "_slash": at("slash") == "/"})
    number = F.when(F.col("_m").rlike(r"^\d+$"), F.col("_m")).cast("int")
    known = low.withColumns({"_m": F.coalesce(number, _month(F.col("_m"))), "_d": F.col("_day")})
    # with slashes: day first or month first, whichever can be; both only where they are the same day
    a, b, slash = F.col("_m"), F.col("_d"), F.col("_slash")
    month = F.when(~slash | (b > 12) | (a == b), a).when(a > 12, b)
    day = F.when(~slash | (b > 12) | (a == b), b).when(a > 12, a)
    both = known.withColumn("_md", F.explode(F.array(F.struct(month.alias("m"), day.alias("d")))))
    return both.withColumns({"_month": F.col("_md.m"), "_day": F.col("_md.d")}).drop("_t", "_f", "_m", "_d", "_md", "_slash")


def _epoch(text: Column) -> Column:
    """Microseconds since 1970 of a bare number of 10, 13 or 16 digits."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    number = F.when(t.rlike(r"^\d{10}(\.\d+)?$|^\d{13}$|^\d{16}$"), t)
    whole = F.regexp_extract(number, r"^(\d+)", 1)
    frac = F.regexp_extract(number, r"\.(\d+)$", 1)
    scale = F.when(F.length(whole) == 10, 1_000_000).when(F.length(whole) == 13, 1000).otherwise(1)
    return F.when(number.isNotNull(), whole.cast("long") * scale + F.coalesce(_micros(F.when(frac != "", frac)), F.lit(0)))


def _intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Offset intervals of each zone, in local seconds, once for every local
    year that they touch.  Zones that the zone database lacks give no row."""
    from datetime import datetime, timedelta, timezone
    from zoneinfo import ZoneInfo

    utc, far = timezone.utc, 1 << 60
    epoch = datetime(1970, 1, 1, tzinfo=utc)
    lo, hi = (int((datetime(y, 1, 1, tzinfo=utc) - epoch).total_seconds()) for y in (FIRST_YEAR, LAST_YEAR + 1))
    year_of = lambda s: (epoch + timedelta(seconds=s)).year
    for batch in batches:
        rows = []
        for name in batch["zone"]:
            try:
                zone = ZoneInfo(name)
            except Exception:  # noqa: BLE001 - not a zone
                continue
            off = lambda s: int((epoch + timedelta(seconds=s)).astimezone(zone).utcoffset().total_seconds())  # noqa: B023, E731
            begin, now, spans = -far, off(lo), []
            for s in range(lo, hi, 5 * 86400):
                e = min(s + 5 * 86400, hi)
                if off(e) != now:
                    a, b = s, e
                    while b - a > 1:
                        m = (a + b) // 2
                        a, b = (a, m) if off(m) != now else (m, b)
                    spans.append((begin, b, now))
                    begin, now = b, off(b)
            spans.append((begin, far, now))
            for begin, end, o in spans:
                first = FIRST_YEAR if begin == -far else year_of(begin + o)
                last = LAST_YEAR if end == far else min(LAST_YEAR, year_of(end + o - 1))
                rows += [(name, y, begin + (0 if begin == -far else o), end + (0 if end == far else o), o) for y in range(max(FIRST_YEAR, first), last + 1)]
        yield pd.DataFrame(rows, columns=["zone", "bucket", "local_from", "local_to", "zone_offset"])


def zone_intervals(zones: DataFrame) -> DataFrame:
    """Exploded offset intervals of the zones named in column ``zone``."""
    return zones.mapInPandas(_intervals, "zone string, bucket int, local_from long, local_to long, zone_offset int")


def to_instants(offers: DataFrame, devices: DataFrame, id_col: str = "offer_id", text_col: str = "date_text", device_col: str = "device_id") -> DataFrame:
    """One row (id, ``utc``) for each offer that names exactly one instant.

    ``devices`` has ``device_id`` and ``tz_name``.  The interval table has at
    most some hundred rows for each of the zones of the zone database, however
    many offers there are, hence the broadcast; the offers are shuffled once,
    by their id.
    """
    clocks = devices.select(F.col("device_id").alias("_device"), F.col("tz_name").alias("_tz")).where("_device is not null").dropDuplicates(["_device"])
    raw = offers.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(device_col).alias("_dev")).where(F.col("_text").isNotNull())
    parsed = parse(raw.withColumn("_epoch", _epoch(F.col("_text"))), "_text").where("_year is not null or _epoch is not null")
    # am and pm
    half, hour = F.col("_half"), F.col("_hour")
    clock = F.when(half == "", hour).when((hour >= 1) & (hour <= 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    day = F.expr("cast(try_make_timestamp_ntz(_year, _month, _day, 0, 0, 0) as date)")
    ok = (F.col("_clock") < 24) & (F.col("_minute") < 60) & (F.col("_second") < 60)
    local = F.when(ok, F.datediff("_date", F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.col("_clock") * 3600 + F.col("_minute") * 60 + F.col("_second"))
    rows = parsed.withColumns({"_clock": clock, "_date": day, "_zoned": F.col("_zone") != ""}).select(
        "_id", "_dev", "_epoch", local.alias("_local"), "_micros", "_year", F.when(F.col("_zoned"), _offset(F.col("_zone"))).alias("_offset"), "_zoned", "_zone_id",
    ).where("_epoch is not null or (_local is not null and not (_zoned and _offset is null))")
    named = rows.join(clocks, F.col("_dev") == F.col("_device"), "left")
    named = named.select("_id", "_epoch", "_local", "_micros", "_offset", F.when(F.col("_epoch").isNull() & F.col("_offset").isNull(), F.coalesce("_zone_id", "_tz")).alias("_zone"), F.least(F.greatest(F.col("_year"), F.lit(FIRST_YEAR)), F.lit(LAST_YEAR)).alias("_bucket"))
    used = clocks.select(F.col("_tz").alias("zone")).union(rows.select(F.col("_zone_id").alias("zone"))).where("zone is not null").distinct()
    spans = F.broadcast(zone_intervals(used))
    joined = named.join(spans, (F.col("_zone") == spans["zone"]) & (F.col("_bucket") == spans["bucket"]) & (F.col("_local") >= spans["local_from"]) & (F.col("_local") < spans["local_to"]), "left")
    micros = F.coalesce(F.col("_epoch"), (F.col("_local") - F.coalesce(F.col("_offset"), F.col("zone_offset"))) * 1_000_000 + F.col("_micros"))
    each = joined.select("_id", micros.alias("_utc")).groupBy("_id").agg(F.min("_utc").alias("_utc"), F.max("_utc").alias("_last"))
    return each.where("_utc is not null and _utc = _last").select(F.col("_id").alias(id_col), _iso(F.col("_utc")).alias("utc"))


def _iso(micros: Column) -> Column:
    """Microseconds since 1970 as ``yyyy-MM-ddTHH:mm:ss.SSSSSSZ``, whatever the session's zone."""
    below = F.pmod(micros, F.lit(1_000_000))
    secs = ((micros - below) / 1_000_000).cast("long")
    rest = F.pmod(secs, F.lit(86400))
    days = ((secs - rest) / 86400).cast("int")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    parts = [pad((rest / 3600).cast("int"), 2), pad((rest % 3600 / 60).cast("int"), 2), pad(rest % 60, 2)]
    day = F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")
    return F.concat(day, F.lit("T"), reduce(lambda a, b: F.concat(a, F.lit(":"), b), parts), F.lit("."), pad(below, 6), F.lit("Z"))
