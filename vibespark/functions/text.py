"""Formatting and parsing of times and channel names, attribute tables, ticks."""

from __future__ import annotations

import datetime as dt
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def channel_id(channel: Column, subchannel: Column) -> Column:
    """parent.child, or parent.* for a whole channel."""
    return F.concat(channel.cast("string"), F.lit("."), F.coalesce(subchannel.cast("string"), F.lit("*")))


def format_timedelta(us: Column) -> Column:
    """[Dd ][HH:]MM:SS.mmmm of microseconds; the fraction has four places."""
    s = F.floor(us / 1_000_000)
    day, hour, minute = F.floor(s / 86_400), F.floor(F.pmod(s, F.lit(86_400)) / 3_600), F.floor(F.pmod(s, F.lit(3_600)) / 60)
    tail = F.format_string("%02d:%02d.%04d", minute.cast("int"), F.pmod(s, F.lit(60)).cast("int"), F.floor(F.pmod(us, F.lit(1_000_000)) / 1_000).cast("int"))
    hours = F.when((hour > 0) | (day > 0), F.format_string("%02d:", hour.cast("int"))).otherwise("")
    return F.concat(F.when(day > 0, F.format_string("%dd ", day.cast("int"))).otherwise(""), hours, tail)


def format_timestamp(us: Column) -> Column:
    return F.format_string("%d µs", us.cast("long"))


def parse_time_column(text: Column) -> Column:
    """Microseconds of a string of d, h, m and s fields, right-aligned: the last one is seconds whatever follows it."""
    parts = F.reverse(F.filter(F.split(text, "[^0-9.+-]+"), lambda x: x != ""))
    scale = F.array(F.lit(1.0), F.lit(60.0), F.lit(3_600.0), F.lit(86_400.0))
    total = F.aggregate(F.zip_with(parts, scale, lambda p, k: F.coalesce(p.cast("double") * k, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    return F.when((F.size(parts) >= 1) & (F.size(parts) <= 4), (total * 1e6).cast("long"))


#: Right-aligned fields of a time, parted by colons, blanks, or the letters of units.
_FIELD, _GAP = r"[0-9]+(?:\.[0-9]*)?", r"[:dhms\s]+"
_TIME = re.compile(rf"(?:(?:(?:(?P<days>{_FIELD}){_GAP})?(?P<hours>{_FIELD}){_GAP})?(?P<minutes>{_FIELD}){_GAP})?(?P<seconds>{_FIELD})(?:{_GAP})?")


def parse_time(t, start: dt.datetime | None = None) -> int | None:
    """Microseconds of a number (as it is), a string, a timedelta, or a datetime or time of day less start.

    start: of the recording; without it, the midnight before. An empty string, like None, is no time.
    """
    if t is None or t == "":
        return None
    if isinstance(t, str):
        fields = _TIME.fullmatch(t.strip().lower())
        if not fields:
            raise ValueError(f"no time: {t!r}")
        t = dt.timedelta(**{name: float(x) for name, x in fields.groupdict().items() if x})
    if isinstance(t, dt.time):
        t = dt.datetime.combine((start or dt.datetime(1970, 1, 1)).date(), t)
        start = start or dt.datetime(1970, 1, 1)
    if isinstance(t, dt.datetime):
        t -= start or t.replace(hour=0, minute=0, second=0, microsecond=0)
    if isinstance(t, dt.timedelta):
        return t // dt.timedelta(microseconds=1)
    if isinstance(t, int | float):
        return t
    raise TypeError(f"no time: {t!r}")


#: Schema of a page of the file service.
FILES = "id string, file_name string, tags array<string>, recording_ts double, device struct<serial_number_id: string, part_number: string>, attributes array<struct<name: string, type: string, value: string>>"


def attributes_table(files: DataFrame, names: list[tuple[str, str]] | None = None) -> DataFrame:
    """Files with a typed column for each attribute. names: (name, type) of them, else found by one pass.

    float and int attributes become numbers, strings of bracketed numbers arrays of float, location strings ``lat,lon``
    two columns, others text.
    """
    a = files.select("id", F.explode("attributes").alias("a")).select("id", "a.*")
    names = names or [(r["name"], r["type"]) for r in a.select("name", F.lower("type").alias("type")).distinct().orderBy("name", "type").collect()]
    wide = a.groupBy("id").pivot("name", [n for n, _ in names]).agg(F.first("value", ignorenulls=True))
    out = [F.col("id")]
    for name, kind in names:
        c = F.col(f"`{name}`")
        if kind in ("float", "double"):
            out.append(c.try_cast("double").alias(name))
        elif kind in ("int", "integer"):
            out.append(c.try_cast("long").alias(name))
        else:
            numbers = F.transform(F.split(F.regexp_replace(c, r"[\[\]\s]", ""), ","), lambda x: F.when(F.lower(x) == "nan", F.lit(float("nan"))).otherwise(x.try_cast("float")))
            if kind in ("array", "list"):
                out.append(numbers.cast("array<float>").alias(name))
            elif name.lower().endswith("location"):
                out += [F.element_at(F.split(c, ","), 1).try_cast("double").alias(f"{name}_lat"), F.try_element_at(F.split(c, ","), F.lit(2)).try_cast("double").alias(f"{name}_lon")]
            else:
                out.append(c.alias(name))
    base = files.drop("attributes")
    if "recording_ts" in base.columns:
        base = base.withColumn("recording_ts", F.timestamp_seconds("recording_ts"))
    return base.join(wide.select(*out), "id", "left")


def log_ticks(start: float, stop: float, spacing: str = "medium") -> list[float]:
    """Ticks of the whole decades around [start, stop]: powers of ten (coarse), 1-2-5 of each (medium), or all nine."""
    steps = {"coarse": (1,), "medium": (1, 2, 5)}.get(spacing, range(1, 10))
    first, end = math.floor(math.log10(start)), math.ceil(math.log10(stop))
    decades = range(first, max(end, first + 1))
    return [float(k * 10.0**e) for e in decades for k in steps] + [10.0**end]
