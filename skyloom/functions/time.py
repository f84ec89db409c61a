"""Column functions for the three time representations of science files.

* epoch: a double, milliseconds since 0000-01-01;
* epoch16: a struct of doubles (sec, psec), seconds and picoseconds since then;
* tt2000: a long, nanoseconds since J2000 (noon of 2000-01-01, terrestrial
  time), which counts leap seconds.

Calendar times are ``timestamp_ntz`` in UTC. Sentinels are tested before any
arithmetic. Everything is a built-in expression. Leap seconds are looked up by a
chain of comparisons, latest first, which stays in generated code where the value
is a plain column; any other value is computed once by a lambda, which is
interpreted, so it pays to select it under a name first.

The leap-second table can be replaced for all expressions built afterwards, see
use_leap_table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Milliseconds from 0000-01-01 to 1970-01-01, and microseconds from 1970 to J2000's civil noon.
EPOCH_UNIX_MS = 62_167_219_200_000
J2000_US = 946_728_000_000_000
TT_OFFSET_NS = 32_184_000_000
FILL_MS, FILL_TT, PAD_TT, ILLEGAL_TT = -1.0e31, -(1 << 63), -(1 << 63) + 1, -(1 << 63) + 3

#: Year, month, day, seconds, base day (MJD) and drift a day.
LEAP_TABLE = (
    (1960, 1, 1, 1.417818, 37300.0, 0.001296),
    (1961, 1, 1, 1.422818, 37300.0, 0.001296),
    (1961, 8, 1, 1.372818, 37300.0, 0.001296),
    (1962, 1, 1, 1.845858, 37665.0, 0.0011232),
    (1963, 11, 1, 1.945858, 37665.0, 0.0011232),
    (1964, 1, 1, 3.24013, 38761.0, 0.001296),
    (1964, 4, 1, 3.34013, 38761.0, 0.001296),
    (1964, 9, 1, 3.44013, 38761.0, 0.001296),
    (1965, 1, 1, 3.54013, 38761.0, 0.001296),
    (1965, 3, 1, 3.64013, 38761.0, 0.001296),
    (1965, 7, 1, 3.74013, 38761.0, 0.001296),
    (1965, 9, 1, 3.84013, 38761.0, 0.001296),
    (1966, 1, 1, 4.31317, 39126.0, 0.002592),
    (1968, 2, 1, 4.21317, 39126.0, 0.002592),
    *((y, m, 1, 10.0 + i, 0.0, 0.0) for i, (y, m) in enumerate((
        (1972, 1), (1972, 7), (1973, 1), (1974, 1), (1975, 1), (1976, 1), (1977, 1), (1978, 1), (1979, 1), (1980, 1), (1981, 7), (1982, 7), (1983, 7), (1985, 7),
        (1988, 1), (1990, 1), (1991, 1), (1992, 7), (1993, 7), (1994, 7), (1996, 1), (1997, 7), (1999, 1), (2006, 1), (2009, 1), (2012, 7), (2015, 7), (2017, 1),
    ))),
)


def use_leap_table(rows: tuple | None = None) -> None:
    """Replaces the leap-second table (None: back to the built-in one) for expressions built from now on."""
    global CURRENT
    CURRENT = tuple(rows) if rows is not None else LEAP_TABLE


CURRENT = LEAP_TABLE


def read_leap_table(text: str) -> tuple:
    """Rows of a leap-second table as text: year, month, day, seconds, base day and drift; lines beginning with ; are remarks."""
    found = []
    for line in text.splitlines():
        if line.strip() and not line.lstrip().startswith(";"):
            y, m, d, seconds, *drift = line.split()
            base, rate = (float(x) for x in (*drift, "0", "0")[:2])
            found.append((int(y), int(m), int(d), float(seconds), base, rate))
    return tuple(found)


def leap_table(spark: SparkSession) -> DataFrame:
    """The leap-second table as rows (year, month, day, seconds, base, drift)."""
    return spark.createDataFrame(list(CURRENT), "year int, month int, day int, seconds double, base double, drift double")


def leap_table_info(spark: SparkSession) -> DataFrame:
    """Rows and last date of the table."""
    return leap_table(spark).agg(F.count("*").alias("n_rows"), F.max(F.make_date("year", "month", "day")).alias("last_date"))


def table_is_stale(last_updated: Column) -> Column:
    """Whether a file's yyyymmdd leap date is later than the table's."""
    y, m, d = CURRENT[-1][:3]
    return last_updated > F.lit(y * 10000 + m * 100 + d)


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often use refers to it."""
    if re.fullmatch(r"Column<'[\w.`]+'>", repr(value)):
        return use(value)
    return F.transform(F.array(value), lambda x: use(x))[0]


def leap_seconds(ts: Column) -> Column:
    """TAI - UTC in seconds at a UTC time or date; with drift before 1972, 0 before 1960."""

    def at(day: Column) -> Column:
        out = None
        for y, m, d, s, base, drift in reversed(CURRENT):
            seconds = F.lit(s) if not drift else F.lit(s) + (F.datediff(day, F.lit("1858-11-17").cast("date")) + 0.5 - base) * drift
            test = day >= F.lit(f"{y:04}-{m:02}-{d:02}").cast("date")
            out = F.when(test, seconds) if out is None else out.when(test, seconds)
        return out.otherwise(F.lit(0.0))

    return bound(ts, lambda t: at(F.to_date(t)))


def whole(a: Column, n: int) -> Column:
    """a / n rounded down, in whole numbers."""
    return F.call_function("div", a - F.pmod(a, F.lit(n)), F.lit(n))


def unix_us(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_us(us: Column) -> Column:
    """timestamp_ntz of microseconds since 1970."""
    return F.timestamp_micros(us).cast("timestamp_ntz")


# epoch


def epoch_of(ts: Column) -> Column:
    """Epoch of a UTC time, whole milliseconds."""
    return (whole(unix_us(ts), 1000) + F.lit(EPOCH_UNIX_MS)).cast("double")


def epoch_to_timestamp(epoch: Column) -> Column:
    """UTC time of an epoch, truncated to the millisecond; the fill value is the last instant of 9999."""
    ms = F.when(epoch == FILL_MS, F.lit(253_402_300_799_999)).otherwise(epoch.cast("long") - EPOCH_UNIX_MS)
    return from_us(ms * 1000)


def compute_epoch(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column, ms: Column) -> Column:
    """Epoch of calendar parts; fields roll over, month 0 makes the day a day of the year, a negative year gives -1.

    With hour, minute and second 0 the milliseconds count from midnight, which
    is the same sum; the last millisecond of 9999 is the fill value.
    """
    first = F.add_months(F.make_date((y + 0).cast("int"), F.lit(1), F.lit(1)), (F.greatest(mo, F.lit(1)) - 1).cast("int"))
    days = F.datediff(first, F.lit("1970-01-01").cast("date")).cast("long") + d - 1
    total = (((days * 24 + h) * 60 + mi) * 60 + s) * 1000 + ms + F.lit(EPOCH_UNIX_MS)
    last = (y == 9999) & (mo == 12) & (d == 31) & (h == 23) & (mi == 59) & (s == 59) & (ms == 999)
    return F.when(y < 0, F.lit(-1.0)).when(last, F.lit(FILL_MS)).otherwise(total.cast("double"))


def parts_of(ts: Column) -> Column:
    """A struct of the calendar parts of a UTC time, to the microsecond."""
    us = F.pmod(unix_us(ts), F.lit(1_000_000))
    return F.struct(F.year(ts).alias("year"), F.month(ts).alias("month"), F.dayofmonth(ts).alias("day"), F.hour(ts).alias("hour"), F.minute(ts).alias("minute"), F.second(ts).alias("second"), F.floor(us / 1000).cast("int").alias("msec"), F.pmod(us, F.lit(1000)).cast("int").alias("usec"))


def epoch_breakdown(epoch: Column) -> Column:
    """Calendar parts of an epoch; negative values count by their size."""
    return parts_of(epoch_to_timestamp(F.when(epoch == FILL_MS, epoch).otherwise(F.abs(epoch))))


def fraction_of_day(ts: Column, digits: int = 7, most: str | None = None) -> Column:
    """The fraction of the day as digits; a value that rounds up to a whole day shows nines."""
    us = F.pmod(unix_us(ts), F.lit(86_400_000_000))
    scaled = F.floor((F.floor(us / 1000).cast("decimal(38,0)") * F.lit(10**digits).cast("decimal(38,0)") * 2 + 86_400_000) / F.lit(172_800_000).cast("decimal(38,0)"))
    return F.lpad(F.least(scaled.cast("long"), F.lit(10**digits - 1)).cast("string"), digits, "0")


def encode_epoch(epoch: Column, style: int = 0) -> Column:
    """Text of an epoch: 0 dd-Mmm-yyyy hh:mm:ss.mmm, 1 yyyymmdd.fraction, 2 yyyymmddhhmmss, 3 ISO with Z, 4 ISO."""
    ts = epoch_to_timestamp(epoch)
    if style == 1:
        return F.concat(F.date_format(ts, "yyyyMMdd"), F.lit("."), fraction_of_day(ts))
    shapes = {0: "dd-MMM-yyyy HH:mm:ss.SSS", 2: "yyyyMMddHHmmss", 3: "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", 4: "yyyy-MM-dd'T'HH:mm:ss.SSS"}
    return F.date_format(ts, shapes[style])


def parse_epoch(text: Column, style: int = 0) -> Column:
    """Epoch of a text in one of encode_epoch's styles; -1 where it cannot be read."""
    if style == 1:
        day, part = F.try_to_timestamp(F.substring(text, 1, 8), F.lit("yyyyMMdd")), F.concat(F.lit("0."), F.substring(text, 10, 20)).try_cast("double")
        found = epoch_of(day.cast("timestamp_ntz")) + F.floor(part * 86_400_000 + 0.5)
        return F.coalesce(found, F.lit(-1.0))
    shapes = {0: "dd-MMM-yyyy HH:mm:ss.SSS", 2: "yyyyMMddHHmmss", 3: "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", 4: "yyyy-MM-dd'T'HH:mm:ss.SSS"}
    return F.coalesce(epoch_of(F.try_to_timestamp(text, F.lit(shapes[style])).cast("timestamp_ntz")), F.lit(-1.0))


def clock_fields(ts: Column) -> dict[str, tuple[Column, int]]:
    """Whole-number fields of a template: value and usual width (0: as wide as it is)."""
    return {"dom": (F.dayofmonth(ts), 0), "doy": (F.dayofyear(ts), 3), "mm": (F.month(ts), 0), "year": (F.year(ts), 4), "yr": (F.year(ts) % 100, 2), "hour": (F.hour(ts), 2), "min": (F.minute(ts), 2), "sec": (F.second(ts), 2)}


def filled_template(template: str, ts: Column, fields: dict[str, tuple[Column, int]], fractions: dict[str, object]) -> Column:
    """Text by a template; fields: as clock_fields gives them, fractions: functions from a width (None: the usual) to digits."""
    out, at = [], 0
    for m in re.finditer(r"<<|<(\w+)(?:\.(0?)(\d+))?>", template):
        out.append(F.lit(template[at : m.start()]))
        at = m.end()
        name, zero, width = m[1], m[2], int(m[3]) if m[3] else None
        if m[0] == "<<":
            out.append(F.lit("<"))
        elif name == "month":
            out.append(F.date_format(ts, "MMM"))
        elif name in fields:
            value, usual = fields[name]
            n, pad = (width, "0" if zero else " ") if width is not None else (usual, "0")
            text = value.cast("string")
            out.append(F.when(F.length(text) > n, F.lit("*" * n)).otherwise(F.lpad(text, n, pad)) if n else text)
        elif name in fractions:
            out.append(fractions[name](width))
        else:
            out.append(F.lit("?"))
    return F.concat(*out, F.lit(template[at:]))


def encode_epoch_template(epoch: Column, template: str) -> Column:
    """Text by a template of <dom> <doy> <month> <mm> <year> <yr> <hour> <min> <sec> <fos> <fod> with .width or .0width; << is a literal <, an unknown name gives ?."""
    ts = epoch_to_timestamp(epoch)

    def second(width: int | None) -> Column:
        n = width or 3
        ms = F.pmod(whole(unix_us(ts), 1000), F.lit(1000))
        digits = ms * 10 ** (n - 3) if n >= 3 else F.least(F.floor((ms * 2 + 10 ** (3 - n)) / (2 * 10 ** (3 - n))), F.lit(10**n - 1))
        return F.lpad(digits.cast("long").cast("string"), n, "0")

    return filled_template(template, ts, clock_fields(ts), {"fod": lambda width: fraction_of_day(ts, width or 8), "fos": second})


# epoch16


def epoch16_of(ts: Column) -> Column:
    us = unix_us(ts)
    return F.struct((whole(us, 1_000_000) + F.lit(EPOCH_UNIX_MS // 1000)).cast("double").alias("sec"), (F.pmod(us, F.lit(1_000_000)) * 1_000_000).cast("double").alias("psec"))


def epoch16_to_timestamp(epoch16: Column) -> Column:
    """UTC time to the microsecond; epoch16_rest has what is below."""
    return from_us((epoch16["sec"].cast("long") - EPOCH_UNIX_MS // 1000) * 1_000_000 + F.floor(epoch16["psec"] / 1e6).cast("long"))


def epoch16_rest(epoch16: Column) -> Column:
    """Picoseconds below the microsecond."""
    return F.pmod(epoch16["psec"].cast("long"), F.lit(1_000_000))


def encode_epoch16(epoch16: Column, style: int = 0) -> Column:
    """Text of an epoch16, to the picosecond: 0 with dots between groups, 1 yyyymmdd.fraction (15 digits), 2 compact, 3 ISO with dots and Z, 4 ISO."""
    if style not in range(5):
        raise ValueError("styles are 0 to 4")
    fill = (epoch16["sec"] == FILL_MS) & (epoch16["psec"] == FILL_MS)
    shown = _epoch16_text(F.when(~fill, epoch16), style)
    return F.when(fill, F.lit(LAST_TEXT[style])).otherwise(shown)


#: How the fill value shows.
LAST_TEXT = ("31-Dec-9999 23:59:59.999.999.999.999", "99991231.999999999999999", "99991231235959", "9999-12-31T23:59:59.999.999.999.999Z", "9999-12-31T23:59:59.999999999999")


def _epoch16_text(epoch16: Column, style: int) -> Column:
    ts = epoch16_to_timestamp(epoch16)
    digits = F.lpad(epoch16["psec"].cast("long").cast("string"), 12, "0")
    dotted = F.concat_ws(".", *(F.substring(digits, i, 3) for i in (1, 4, 7, 10)))
    if style == 1:
        return F.concat(F.date_format(ts, "yyyyMMdd"), F.lit("."), fraction16(epoch16, 15))
    if style == 2:
        return F.date_format(ts, "yyyyMMddHHmmss")
    day = "dd-MMM-yyyy HH:mm:ss" if style == 0 else "yyyy-MM-dd'T'HH:mm:ss"
    return F.concat(F.date_format(ts, day), F.lit("."), digits if style == 4 else dotted, F.lit("Z" if style == 3 else ""))


#: Picoseconds in a day.
DAY_PS = 86_400 * 10**12


def epoch16_or_fill(fill: Column, bad: Column, sec: Column, psec: Column) -> Column:
    """A struct (sec, psec); both parts are the fill value, or -1 where bad."""
    part = lambda x: F.when(fill, F.lit(FILL_MS)).when(bad, F.lit(-1.0)).otherwise(x.cast("double"))
    return F.struct(part(sec).alias("sec"), part(psec).alias("psec"))


def compute_epoch16(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column, ms: Column, us: Column, ns: Column, ps: Column) -> Column:
    """Epoch16 of calendar parts; fields roll over, month 0 makes the day a day of the year, a time before year 0 gives -1 in both parts."""
    below = ((ms.cast("long") * 1000 + us) * 1000 + ns) * 1000 + ps
    first = F.add_months(F.make_date(F.greatest(y, F.lit(0)).cast("int"), F.lit(1), F.lit(1)), (F.greatest(mo, F.lit(1)) - 1).cast("int"))
    days = F.datediff(first, F.lit("1970-01-01").cast("date")).cast("long") + d - 1
    sec = ((days * 24 + h) * 60 + mi) * 60 + s + whole(below, 10**12) + F.lit(EPOCH_UNIX_MS // 1000)
    last = (y == 9999) & (mo == 12) & (d == 31) & (h == 23) & (mi == 59) & (s == 59) & (below == 10**12 - 1)
    return epoch16_or_fill(last, (y < 0) | (sec < 0), sec, F.pmod(below, F.lit(10**12)))


def epoch16_breakdown(epoch16: Column) -> Column:
    """A struct of the calendar parts of an epoch16, down to psec; negative values count by their size, the fill value is the last instant of 9999."""
    fill = (epoch16["sec"] == FILL_MS) & (epoch16["psec"] == FILL_MS)
    most = F.lit(float(EPOCH_UNIX_MS // 1000 + 253_402_300_799))
    sec = F.when(fill, most).otherwise(F.least(F.abs(epoch16["sec"]), most))
    psec = F.when(fill, F.lit(10.0**12 - 1)).otherwise(F.least(F.abs(epoch16["psec"]), F.lit(10.0**12 - 1))).cast("long")
    ts = from_us((sec.cast("long") - EPOCH_UNIX_MS // 1000) * 1_000_000)
    below = [F.pmod(whole(psec, 10**k), F.lit(1000)).cast("int").alias(name) for k, name in ((9, "msec"), (6, "usec"), (3, "nsec"), (0, "psec"))]
    return F.struct(F.year(ts).alias("year"), F.month(ts).alias("month"), F.dayofmonth(ts).alias("day"), F.hour(ts).alias("hour"), F.minute(ts).alias("minute"), F.second(ts).alias("second"), *below)


def fraction16(epoch16: Column, digits: int) -> Column:
    """The fraction of the day of an epoch16 as digits, rounded; what rounds up to a whole day shows nines."""
    exact = F.pmod(epoch16["sec"].cast("long"), F.lit(86_400)).cast("decimal(20,0)") * F.lit(10**12).cast("decimal(13,0)") + epoch16["psec"].cast("long")
    # Two factors of two keep the product within 38 digits.
    scaled = F.floor((exact.cast("decimal(18,0)") * F.lit(10**digits).cast("decimal(16,0)") * 2 + F.lit(DAY_PS).cast("decimal(18,0)")) / F.lit(2 * DAY_PS).cast("decimal(18,0)"))
    return F.lpad(F.least(scaled.cast("long"), F.lit(10**digits - 1)).cast("string"), digits, "0")


def encode_epoch16_template(epoch16: Column, template: str) -> Column:
    """encode_epoch_template() with <msc> <usc> <nsc> <psc> besides, and fractions of 12 and 15 digits."""
    parts = epoch16_breakdown(epoch16)
    ts = epoch16_to_timestamp(epoch16)
    psec = epoch16["psec"].cast("long")

    def second(width: int | None) -> Column:
        n = min(width or 12, 12)
        step = 10 ** (12 - n)
        digits = F.least(whole(psec * 2 + step, 2 * step), F.lit(10**n - 1))
        return F.rpad(F.lpad(digits.cast("string"), n, "0"), width or 12, "0")

    fields = clock_fields(ts) | {name: (parts[part], 3) for name, part in (("msc", "msec"), ("usc", "usec"), ("nsc", "nsec"), ("psc", "psec"))}
    # The fraction of a day counts whole milliseconds only.
    whole_ms = F.struct(epoch16["sec"].alias("sec"), (whole(psec, 10**9) * 10**9).cast("double").alias("psec"))
    return filled_template(template, ts, fields, {"fos": second, "fod": lambda width: fraction16(whole_ms, min(width or 15, 15))})


def parse_epoch16(text: Column, style: int = 0) -> Column:
    """Epoch16 of a text in one of encode_epoch16's styles; -1 in both parts where it cannot be read."""
    shapes = {0: ("dd-MMM-yyyy HH:mm:ss", 20), 1: ("yyyyMMdd", 8), 2: ("yyyyMMddHHmmss", 14), 3: ("yyyy-MM-dd'T'HH:mm:ss", 19), 4: ("yyyy-MM-dd'T'HH:mm:ss", 19)}
    shape, n = shapes[style]
    ts = F.try_to_timestamp(F.initcap(F.substring(text, 1, n)) if style == 0 else F.substring(text, 1, n), F.lit(shape)).cast("timestamp_ntz")
    sec = whole(unix_us(ts), 1_000_000) + F.lit(EPOCH_UNIX_MS // 1000)
    if style == 1:
        share = F.concat(F.lit("0."), F.substring(text, 10, 15)).try_cast("decimal(16,15)") * F.lit(DAY_PS).cast("decimal(18,0)")
        below = F.floor(share).cast("long")
    elif style == 2:
        below = F.when(sec.isNotNull(), F.lit(0).cast("long"))
    else:
        pattern = r"^(\d{12})$" if style == 4 else r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})Z$" if style == 3 else r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
        tail = F.substring(text, n + 2, 20)
        found = [F.regexp_extract(tail, pattern, i).try_cast("long") for i in range(1, 2 if style == 4 else 5)]
        below = found[0]
        for x in found[1:]:
            below = below * 1000 + x
    read = sec + whole(below, 10**12)
    return F.when(text.isNotNull(), epoch16_or_fill(text == LAST_TEXT[style], (read.isNull()) | (read < 0), read, F.pmod(below, F.lit(10**12))))


def tt2000_to_epoch16(tt: Column) -> Column:
    """Epoch16 of a tt2000; a leap second rolls over into the next day."""
    return bound(tt, _epoch16_of_tt)


def _epoch16_of_tt(tt: Column) -> Column:
    ns = tt2000_utc_ns(F.when(tt > ILLEGAL_TT, tt)) + F.when(in_leap_second(tt), F.lit(1_000_000_000)).otherwise(0)
    sec = whole(ns, 1_000_000_000) + F.lit(J2000_US // 1_000_000 + EPOCH_UNIX_MS // 1000)
    part = lambda x: F.when(tt == FILL_TT, F.lit(FILL_MS)).when(tt <= ILLEGAL_TT, F.lit(0.0)).otherwise(x.cast("double"))
    return F.when(tt.isNotNull(), F.struct(part(sec).alias("sec"), part(F.pmod(ns, F.lit(1_000_000_000)) * 1000).alias("psec")))


def epoch16_to_tt2000(epoch16: Column) -> Column:
    """tt2000 of an epoch16, cut to the nanosecond."""
    sec, psec = epoch16["sec"], epoch16["psec"]
    fill, zero = (sec == FILL_MS) & (psec == FILL_MS), (sec == 0) & (psec == 0)
    known = F.when(~fill & ~zero, sec)
    ts = from_us((known.cast("long") - EPOCH_UNIX_MS // 1000) * 1_000_000)
    found = bound(ts, _tt_of_timestamp)
    return F.when(fill, F.lit(FILL_TT)).when(zero, F.lit(PAD_TT)).otherwise(bound(found, lambda t: F.when(t == ILLEGAL_TT, t).otherwise(t + whole(psec.cast("long"), 1000))))


# tt2000


def tt2000_of(ts: Column) -> Column:
    """tt2000 of a UTC time between 1707-09-22 and 2292-04-11; others give the illegal value."""
    return bound(ts, _tt_of_timestamp)


def _tt_of_timestamp(ts: Column) -> Column:
    leap = F.round(leap_seconds(ts) * 1e9).cast("long")
    inside = (F.to_date(ts) >= F.lit("1707-09-22").cast("date")) & (F.to_date(ts) < F.lit("2292-04-11").cast("date"))
    return F.when(inside, (unix_us(ts) - J2000_US) * 1000 + TT_OFFSET_NS + leap).when(ts.isNotNull(), F.lit(ILLEGAL_TT))


def tt_steps() -> list[tuple[int, int]]:
    """(tt2000 from which it holds, leap seconds) of the whole-second era."""
    import datetime as dt

    out = []
    for y, m, d, s, _, drift in CURRENT:
        if not drift:
            us = int((dt.datetime(y, m, d) - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
            out.append(((us - J2000_US) * 1000 + TT_OFFSET_NS + int(s) * 1_000_000_000, int(s)))
    return out


def in_leap_second(tt: Column) -> Column:
    """Whether the clock shows second 60."""

    def shown(t: Column) -> Column:
        out = None
        for at, _ in reversed(tt_steps()[1:]):
            # Behind a step, and behind the second before it, the answer is known; what is earlier goes on down the chain.
            test, second = t >= at, t >= at - 1_000_000_000
            out = F.when(test, F.lit(False)).when(second, F.lit(True)) if out is None else out.when(test, F.lit(False)).when(second, F.lit(True))
        return out.otherwise(F.lit(False))

    return bound(tt, shown)


def tt2000_utc_ns(tt: Column) -> Column:
    """Nanoseconds since 2000-01-01 12:00 in UTC; during a leap second the clock's last second repeats."""
    steps = tt_steps()
    lag = lambda guess: F.round(leap_seconds(from_us(whole(guess, 1000) + J2000_US)) * 1e9).cast("long")
    # Before 1972 the leap depends on the UTC day: it is looked up for a guess, and again for the result.
    early = lambda p: p - bound(p - lag(p), lag)

    def utc(t: Column) -> Column:
        plain, out, later = t - TT_OFFSET_NS, None, None
        for at, s in reversed(steps):
            if later is not None:  # the leap second itself, before the next step
                out = out.when(t >= later - 1_000_000_000, plain - (s + 1) * 1_000_000_000)
            test, value = t >= at, plain - s * 1_000_000_000
            out = F.when(test, value) if out is None else out.when(test, value)
            later = at
        return out.when(t.isNull(), F.lit(None).cast("long")).otherwise(bound(plain, early))

    return bound(tt, utc)


def tt2000_to_timestamp(tt: Column) -> Column:
    """UTC time to the microsecond (see in_leap_second and tt2000_rest); sentinels give the ends of the calendar."""
    return bound(tt, _timestamp_of_tt)


def _timestamp_of_tt(tt: Column) -> Column:
    last, first = F.lit("9999-12-31 23:59:59.999999").cast("timestamp_ntz"), F.lit("0000-01-01 00:00:00").cast("timestamp_ntz")
    ns = tt2000_utc_ns(F.when(tt > ILLEGAL_TT, tt))
    return F.when(tt == FILL_TT, last).when(tt <= ILLEGAL_TT, first).otherwise(from_us(whole(ns, 1000) + J2000_US))


def tt2000_rest(tt: Column) -> Column:
    """Nanoseconds below the microsecond."""
    return F.pmod(tt2000_utc_ns(F.when(tt > ILLEGAL_TT, tt)), F.lit(1000))


def encode_tt2000(tt: Column, style: int = 3) -> Column:
    """Text: 0 dd-Mmm-yyyy, 1 yyyymmdd.fraction (10 digits, cut), 2 yyyymmddhhmmss, 3 ISO, to the nanosecond; second 60 in a leap second."""
    return bound(tt, lambda t: bound(tt2000_utc_ns(t), lambda ns: _tt_text(t, ns, style)))


def _tt_text(tt: Column, ns: Column, style: int) -> Column:
    ts = from_us(whole(ns, 1000) + J2000_US)
    second = F.when(in_leap_second(tt), F.lit("60")).otherwise(F.date_format(ts, "ss"))
    tail = F.lpad(F.pmod(ns, F.lit(1_000_000_000)).cast("string"), 9, "0")
    if style == 1:
        inside = F.pmod(F.pmod(ns, F.lit(86_400_000_000_000)) + 43_200_000_000_000, F.lit(86_400_000_000_000)).cast("decimal(38,0)")
        cut = F.floor(inside * F.lit(10**10).cast("decimal(38,0)") / F.lit(86_400_000_000_000).cast("decimal(38,0)")).cast("long")
        return F.concat(F.date_format(ts, "yyyyMMdd"), F.lit("."), F.lpad(cut.cast("string"), 10, "0"))
    if style == 2:
        return F.concat(F.date_format(ts, "yyyyMMddHHmm"), second)
    return F.concat(F.date_format(ts, "dd-MMM-yyyy HH:mm:" if style == 0 else "yyyy-MM-dd'T'HH:mm:"), second, F.lit("."), tail)


def parse_tt2000(text: Column) -> Column:
    """tt2000 of text in one of encode_tt2000's styles, second 60 allowed; the illegal value where it cannot be read."""
    return bound(F.ltrim(text), _tt_of_text)


def _tt_of_text(text: Column) -> Column:
    """The style shows in the text: T at 10 is ISO, a blank at 11 has the month's name, a dot at 8 a fraction of the day."""
    size = F.length(text)
    iso, named, part = (size > 18) & (F.substring(text, 11, 1) == "T"), (size > 19) & (F.substring(text, 12, 1) == " "), (size > 9) & (F.substring(text, 9, 1) == ".")
    clock = F.when(named, F.substring(text, 13, 8)).when(part, F.lit("00:00:00")).when(iso, F.substring(text, 12, 8)).otherwise(F.concat_ws(":", *(F.substring(text, i, 2) for i in (9, 11, 13))))
    day = F.when(named, F.try_to_timestamp(F.initcap(F.substring(text, 1, 11)), F.lit("dd-MMM-yyyy"))).when(iso, F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd"))).otherwise(F.try_to_timestamp(F.substring(text, 1, 8), F.lit("yyyyMMdd")))
    leap = F.substring(clock, 7, 2) == "60"
    seconds = F.substring(clock, 1, 2).try_cast("long") * 3600 + F.substring(clock, 4, 2).try_cast("long") * 60 + F.when(leap, F.lit(59)).otherwise(F.substring(clock, 7, 2).try_cast("long"))
    rest = F.coalesce(F.rpad(F.regexp_extract(text, r":\d\d\.(\d{1,9})", 1), 9, "0").try_cast("long"), F.lit(0))
    share = F.concat(F.lit("0."), F.substring(text, 10, 20)).try_cast("decimal(21,20)") * F.lit(86_400_000_000_000).cast("decimal(15,0)")
    inside = F.when(part, F.floor(share).cast("long")).otherwise(rest + F.when(leap, F.lit(1_000_000_000)).otherwise(0))
    known = F.upper(F.rpad(text, 30, "0"))
    fill, pad = (known.isin(f"{'31-DEC' if k else '01-JAN'}-{y} {c}.{n * 9}", f"{y}-{d}T{c}.{n * 9}0", f"{y}{d.replace('-', '')}.{n * 10}" + "0" * 11, f"{y}{d.replace('-', '')}{c.replace(':', '')}" + "0" * 16) for k, y, d, c, n in ((1, "9999", "12-31", "23:59:59", "9"), (0, "0000", "01-01", "00:00:00", "0")))
    found = bound(day.cast("timestamp_ntz"), _tt_of_timestamp) + seconds * 1_000_000_000 + inside
    return F.when(fill, F.lit(FILL_TT)).when(pad, F.lit(PAD_TT)).when(text.isNotNull(), F.coalesce(found, F.lit(ILLEGAL_TT)))


def compute_tt2000(y: Column, mo: Column, d: Column, *clock: Column) -> Column:
    """tt2000 of UTC parts: hour, minute, second, msec, usec, nsec, as many as there are.

    The last part may have a fraction, the others may not; fields roll over. A
    negative part, or a date from outside 1707-09-22 to 2292-04-11, gives the
    illegal value.
    """
    parts = [y, mo, d, *clock]
    if len(parts) > 9:
        raise ValueError("the last part is nsec")
    unit = (86_400_000_000_000, 3_600_000_000_000, 60_000_000_000, 1_000_000_000, 1_000_000, 1000, 1)
    broken = F.lit(False)
    for p in parts[:-1]:
        broken = broken | (p != F.floor(p))
    for p in clock:
        broken = broken | (p < 0)
    inside = F.lit(0).cast("long")
    for p, ns in zip(clock, unit[1:], strict=False):
        inside = inside + F.floor(p).cast("long") * F.lit(ns)
    inside = inside + F.floor((parts[-1] - F.floor(parts[-1])) * F.lit(float(unit[len(parts) - 3]))).cast("long")
    first = F.when(F.floor(y).between(1, 9999), F.make_date(F.floor(y).cast("int"), F.lit(1), F.lit(1)))
    date = F.date_add(F.add_months(first, (F.greatest(F.floor(mo), F.lit(1)) - 1).cast("int")), (F.floor(d) - 1).cast("int"))
    return F.when(broken, F.lit(ILLEGAL_TT)).otherwise(F.coalesce(bound(date, lambda at: _tt_of_date(at, inside)), F.lit(ILLEGAL_TT)))


def _tt_of_date(date: Column, inside: Column) -> Column:
    within = (date >= F.lit("1707-09-22").cast("date")) & (date <= F.lit("2292-04-11").cast("date"))
    days = F.datediff(date, F.lit("2000-01-01").cast("date")).cast("long")
    leap = F.round(leap_seconds(date) * 1e9).cast("long")
    # Half a day and the rest are added first: at the ends of the calendar the days alone would not fit.
    return F.when(within, days * F.lit(86_400_000_000_000) + (inside - 43_200_000_000_000 + TT_OFFSET_NS + leap))


def tt2000_breakdown(tt: Column) -> Column:
    """A struct of year, month, day, hour, minute, second, msec, usec and nsec in UTC; second 60 in a leap second, sentinels at the ends of the calendar."""
    return bound(tt, _tt_parts)


def _tt_parts(tt: Column) -> Column:
    ns = tt2000_utc_ns(F.when(tt > ILLEGAL_TT, tt))
    ts = tt2000_to_timestamp(tt)
    last = tt == FILL_TT
    below = lambda size, by: F.when(last, F.lit(999)).when(tt <= ILLEGAL_TT, F.lit(0)).otherwise(whole(F.pmod(ns, F.lit(size)), by)).cast("int")
    second = F.when(in_leap_second(tt), F.lit(60)).otherwise(F.second(ts))
    return F.struct(F.year(ts).alias("year"), F.month(ts).alias("month"), F.dayofmonth(ts).alias("day"), F.hour(ts).alias("hour"), F.minute(ts).alias("minute"), second.alias("second"), below(1_000_000_000, 1_000_000).alias("msec"), below(1_000_000, 1000).alias("usec"), below(1000, 1).alias("nsec"))


def tt2000_to_epoch(tt: Column) -> Column:
    """Epoch in whole milliseconds; a leap second rolls over into the next day."""
    return bound(tt, _epoch_of_tt)


def _epoch_of_tt(tt: Column) -> Column:
    ms = whole(tt2000_utc_ns(F.when(tt > ILLEGAL_TT, tt)) + F.when(in_leap_second(tt), F.lit(1_000_000_000)).otherwise(0), 1_000_000)
    return F.when(tt == FILL_TT, F.lit(FILL_MS)).when(tt <= ILLEGAL_TT, F.lit(0.0)).otherwise((ms + EPOCH_UNIX_MS + J2000_US // 1000).cast("double"))


def epoch_to_tt2000(epoch: Column) -> Column:
    return bound(epoch, _tt_of_epoch)


def _tt_of_epoch(epoch: Column) -> Column:
    return F.when(epoch == FILL_MS, F.lit(FILL_TT)).when(epoch == 0.0, F.lit(PAD_TT)).otherwise(bound(epoch_to_timestamp(F.when((epoch != FILL_MS) & (epoch != 0.0), epoch)), tt2000_of))


def tt2000_rebase(tt: Column, missing_from: int, to_older: bool = False) -> Column:
    """Corrects values made with a table that lacked the leap seconds from row ``missing_from`` (of the whole-second rows) on; to_older turns right values into such."""
    # Each missing second moves the value on, which may carry it over the next; backwards the latest goes first.
    starts = [at for at, _ in tt_steps()[missing_from:]]
    if to_older:
        return F.aggregate(F.array(*map(F.lit, reversed(starts))), tt, lambda t, at: F.when(t >= at, t - 1_000_000_000).otherwise(t))
    return F.aggregate(F.array(*map(F.lit, starts)), tt, lambda t, at: F.when(t >= at - 1_000_000_000, t + 1_000_000_000).otherwise(t))


def adjust_from(tt: Column, start: Column) -> Column:
    """Adds the second that values from one second before ``start`` on lack."""
    return F.when(tt >= start - 1_000_000_000, tt + 1_000_000_000).otherwise(tt)


def adjusted_series(df: DataFrame, tt: str, rec: str, start: Column, by: list[str] | None = None) -> DataFrame:
    """adjust_from() of a series in record order, and of the records before start that fall back behind a leap second.

    A record that is earlier than the one before it, which shows second 60, belongs
    after that second. by keeps each file's series apart; without it the table is
    one series, ordered in one task.
    """
    w = Window.partitionBy(*(by or [])).orderBy(rec)
    before = F.lag(tt).over(w)
    late = (F.col("__before") > F.col(tt)) & in_leap_second(F.col("__before"))
    out = df.withColumns({"__before": before, "__start": start})
    shown = F.when(F.coalesce(late, F.lit(False)) & (F.col(tt) < F.col("__start") - 1_000_000_000), F.col(tt) + 1_000_000_000).otherwise(adjust_from(F.col(tt), F.col("__start")))
    return out.withColumn(tt, shown).drop("__before", "__start")


def julian_day(ts: Column) -> Column:
    """Julian day number of the date's noon."""
    return (F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")) + 2_440_588).cast("long")


#: Milliseconds in a unit of a virtual time axis.
UNITS = {"days": 86_400_000.0, "hours": 3_600_000.0, "minutes": 60_000.0, "seconds": 1000.0, "milliseconds": 1.0, "microseconds": 1e-3, "nanoseconds": 1e-6}


def virtual_epoch(base: Column, offset: Column, units: Column | str) -> Column:
    """Base plus offset in its units (those of an unknown name count as milliseconds)."""
    u = F.lit(units) if isinstance(units, str) else units
    scale = F.lit(1.0)
    for name, factor in UNITS.items():
        scale = F.when(F.lower(u) == name, F.lit(factor)).otherwise(scale)
    return base + offset * scale


def virtual_epoch_export(base: Column, offset: Column, fill: float = FILL_MS) -> Column:
    """The export rule: seconds after the base, and fill for offsets that are not positive."""
    return F.when(offset > 0, base + offset * 1000.0).otherwise(F.lit(fill))
