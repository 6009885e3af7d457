"""Channel catalogs: measurement types, channel tables, choice of channels."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of measurement types in order of priority, further keys, and further parts of unit labels. A type's
# first key is the start of its name; its name is also a label.
TYPES = [
    ("Acceleration", ["acc", "g"], []),
    ("Orientation", ["imu", "qua", "gyr"], ["quaternion", "euler", "orientation"]),
    ("Rotation", ["rot", "ang"], ["rotation", "gyro"]),
    ("Audio", ["mic"], ["mic"]),
    ("Light", ["lux"], ["lux", "uv"]),
    ("Pressure", [], []),
    ("Temperature", [], []),
    ("Relative Humidity", ["hum"], []),
    ("Location", ["pos", "gps"], ["pos"]),
    ("Speed", [], ["velocity"]),
    ("Time", ["epo"], ["epoch"]),
    ("Generic/Unspecified", ["adc", "raw"], ["adc", "raw"]),
    ("Altitude", [], []),
    ("Voltage", [], ["volt"]),
    ("Direction", [], ["compass", "heading"]),
    ("Magnetic Field", ["emf"], ["emf", "magnetic"]),
    ("Frequency", [], ["rate"]),
]
ANY = "*"


class MeasurementType:
    """A tag: ``+`` and ``|`` join tags to a query, ``-`` excludes."""

    def __init__(self, key: str, name: str = "", labels: Sequence[str] = ()):
        self.key, self.name, self.labels = key, name, tuple(labels)

    def __str__(self) -> str:
        return self.key

    def __add__(self, other) -> str:
        return f"{self} {other}"

    __or__ = __add__

    def __radd__(self, other) -> str:
        return f"{other} {self}"

    __ror__ = __radd__

    def __neg__(self) -> str:
        return f"-{self}"

    def __sub__(self, other) -> str:
        return f"{self} -{other}"

    def __rsub__(self, other) -> str:
        return f"{other} -{self}"

    def __eq__(self, other) -> bool:
        return str(self) == str(other)

    def __hash__(self) -> int:
        return hash(self.key)

    def match(self, unit_type: Column) -> Column:
        low = F.lower(unit_type)
        hit = F.lit(False)
        for label in self.labels:
            hit = hit | (low.like(label.replace("*", "%").replace("?", "_")) if set(label) & set("*?") else low.contains(label))
        return F.coalesce(hit, F.lit(False))


REGISTRY = {n.lower()[:3]: MeasurementType(n.lower()[:3], n, [*labels, n.lower()]) for n, _, labels in TYPES}
#: Every key, and the first key of its type.
KEYS = {k: n.lower()[:3] for n, keys, _ in TYPES for k in (n.lower()[:3], *keys)}


def split_types(query) -> tuple[set[str], set[str]]:
    """Keys that a query includes and excludes; words count by their first three letters; * includes all.

    A minus sign, next to its word or apart from it, excludes that word."""
    include, exclude = set(), set()
    for word in re.sub(r"-\s*", " -", re.sub(r"[+|]", " ", str(query))).split():
        away = word.startswith("-")
        low = word.lstrip("-").lower()
        key = low[:3]
        if not key:
            continue
        if key == ANY:
            keys = set(REGISTRY)
        elif key in KEYS or low in ("any", "all"):
            keys = {KEYS[key]} if key in KEYS else set(REGISTRY)
        else:
            raise TypeError(f"unknown measurement type {word!r}")
        (exclude if away else include).update(keys)
    return include, exclude


def measurement_type(unit_type: Column) -> Column:
    """First registered key whose label matches, or null."""
    out = F.lit(None).cast("string")
    for key in reversed(REGISTRY):
        out = F.when(REGISTRY[key].match(unit_type), F.lit(key)).otherwise(out)
    return out


def types_of(unit_type: Column) -> Column:
    """All keys that match, in order of priority."""
    every = F.array(*[F.when(t.match(unit_type), F.lit(k)) for k, t in REGISTRY.items()])
    return F.filter(every, lambda x: x.isNotNull())


def filter_channels(channels: DataFrame, query=ANY, unit_type: str = "type") -> DataFrame:
    """Channels with some included type and no excluded one; no included type means all."""
    if str(query) == ANY:
        return channels
    include, exclude = split_types(query)
    types = types_of(F.col(unit_type))
    d = channels
    if include:
        d = d.filter(F.arrays_overlap(types, F.array(*[F.lit(k) for k in sorted(include)])))
    return d.filter(~F.arrays_overlap(types, F.array(*[F.lit(k) for k in sorted(exclude)]))) if exclude else d


def channel_table(signal: DataFrame, catalog: DataFrame | None = None, query=ANY, start: float | None = None, end: float | None = None, keys: Sequence[str] = ("series_id", "axis")) -> DataFrame:
    """One row per channel: start, end, duration (microseconds), samples, rate (Hz); with the catalog's columns if given.

    The catalog is filtered first, and the signal by it and by time, so both reach the scan.
    """
    d = signal
    if catalog is not None:
        catalog = filter_channels(catalog, query)
        d = d.join(catalog.select(*keys), list(keys), "left_semi")
    d = d if start is None else d.filter(F.col("t") >= start)
    d = d if end is None else d.filter(F.col("t") <= end)
    us = lambda c: F.round(c * 1e6).cast("long")
    t = d.groupBy(*keys).agg(us(F.min("t")).alias("start"), us(F.max("t")).alias("end"), F.count("v").alias("samples"))
    t = t.withColumn("duration", F.col("end") - F.col("start")).withColumn("rate", F.try_divide("samples", F.col("duration") / 1e6))
    t = t.select(*keys, "start", "end", "duration", "samples", "rate")
    return t if catalog is None else catalog.join(t, list(keys), "left")


def primary_channels(table: DataFrame, criteria: str = "samples", least: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Channels with the largest (or least) samples, rate or duration; ties are kept."""
    if criteria not in ("samples", "rate", "duration"):
        raise ValueError("criteria is samples, rate or duration")
    best = (F.min if least else F.max)(criteria)
    if not by:
        top = table.agg(best.alias("_best"))
        return table.join(F.broadcast(top), table[criteria] == F.col("_best")).drop("_best")  # one row
    return table.join(table.groupBy(*by).agg(best.alias("_best")), list(by)).filter(F.col(criteria) == F.col("_best")).drop("_best")


def primary_sensor_data(signal: DataFrame, catalog: DataFrame, query=ANY, criteria: str = "samples", least: bool = False, force: bool = False) -> DataFrame:
    """Samples of the primary channels of a type; no such channel is an error unless ``force``."""
    chosen = filter_channels(catalog, query)
    if chosen.isEmpty():
        if not force:
            raise ValueError(f"no channel of type {query}")
        chosen = catalog
    table = channel_table(signal.join(chosen.select("series_id", "axis"), ["series_id", "axis"], "left_semi"))
    return signal.join(primary_channels(table, criteria, least).select("series_id", "axis"), ["series_id", "axis"], "left_semi")


def best_per_type(channels: DataFrame, preferred: Sequence = (), type_col: str = "type", samples: str = "samples", channel: str = "channel") -> DataFrame:
    """Of each type the preferred channel, else the one with most samples; the first wins ties; empty ones are out.

    Rotation and quaternion channels count as one type.
    """
    kind = F.when(F.lower(type_col).isin("rotation", "quaternion"), "rotation").otherwise(F.lower(type_col))
    order = [F.col(channel).isin(list(preferred)).desc()] if preferred else []
    w = Window.partitionBy("_kind").orderBy(*order, F.desc(samples), channel)
    d = channels.filter(F.col(samples) > 0).withColumn("_kind", kind)
    return d.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_kind")


def channels_by_type(channels: DataFrame, channel: str = "channel", type_col: str = "type", sub: str = "subchannel") -> DataFrame:
    return channels.groupBy(channel, type_col).agg(F.array_sort(F.collect_list(sub)).alias("subchannels"))


def relabelled(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """column with values replaced by a dictionary, others as they are."""
    if not names:
        return df
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return df.withColumn(column, F.coalesce(m[F.col(column)], F.col(column)))
