"""Recordings as tables: opening, intervals, export, file identifiers, a data source for recording files."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import parse_time

SIGNAL = "series_id string, axis string, i long, t double, v double"


def normalized_path(path: str, mode: str | None = None) -> tuple[str, str]:
    """(kind, path): local or url; file:// is local, as is a path without a host; mode forces one."""
    if mode not in (None, "local", "url"):
        raise ValueError("mode is local or url")
    u = urlparse(str(path))
    if u.scheme == "file":
        return "local", u.path
    kind = mode or ("url" if u.netloc and len(u.scheme) > 1 else "local")
    return kind, str(path)


def drive_file_id(url: Column) -> Column:
    """Identifier in a shared-drive address: its id parameter, or the part after /file/d/; else null."""
    path = F.regexp_extract(url, r"/file/d/([^/?]+)", 1)
    query = F.regexp_extract(url, r"[?&]id=([^&#]+)", 1)
    return F.coalesce(F.nullif(query, F.lit("")), F.nullif(path, F.lit("")))


def open_signal(spark: SparkSession, path: str | None = None, name: str | None = None, start=0, end=None, channels: Sequence[str] | None = None) -> DataFrame:
    """A signal table by name or by path, restricted to an interval (seconds, or any time that parse_time reads) and to
    channels; both restrictions reach the scan. Exactly one of path and name is given."""
    if (path is None) == (name is None):
        raise TypeError("give a path or a name")
    d = spark.table(name) if name else spark.read.parquet(normalized_path(path)[1])
    bound = lambda x: x if isinstance(x, int | float) else parse_time(x) / 1e6
    d = d if not start else d.filter(F.col("t") >= bound(start))
    d = d if end is None else d.filter(F.col("t") <= bound(end))
    return d if channels is None else d.filter(F.col("axis").isin(list(channels)))


def extract_time(signal: DataFrame, out: str, start=0, end=None, channels: Sequence[str] | None = None) -> None:
    """Writes an interval of a signal, partitioned by series, so that later readers prune."""
    d = signal.filter(F.col("t") >= start)
    d = d if end is None else d.filter(F.col("t") <= end)
    d = d if channels is None else d.filter(F.col("axis").isin(list(channels)))
    d.write.partitionBy("series_id").parquet(out)


def wide(signal: DataFrame, axes: Sequence[str], time_mode: str = "datetime", base_utc: float = 0.0, tz: str | None = None) -> DataFrame:
    """Samples as rows with a column per axis and the time as seconds, timedelta or datetime."""
    if time_mode not in ("seconds", "timedelta", "datetime"):
        raise ValueError("time_mode is seconds, timedelta or datetime")
    us = F.round(F.col("t") * 1e6).cast("long")
    time = {"seconds": F.col("t"), "timedelta": F.make_dt_interval(secs=us / F.lit(1e6)), "datetime": F.timestamp_micros(us + int(base_utc * 1e6))}[time_mode]
    if time_mode == "datetime" and tz:
        time = F.from_utc_timestamp(time, tz)
    return signal.groupBy("series_id", "i", "t").pivot("axis", list(axes)).agg(F.first("v")).withColumn("time", time)


def valid_header(content: Column, known: Sequence[int], lookahead: int = 25, percent: float = 0.5) -> Column:
    """Whether enough of the first elements of a file, each an id byte and a length byte, are known ones."""
    ids = frozenset(known)

    @F.udf("boolean")
    def check(raw: bytes | None) -> bool:
        at = seen = hits = 0
        while raw and at + 1 < len(raw) and seen < lookahead:
            hits += raw[at] in ids
            seen += 1
            at += 2 + raw[at + 1]
        return seen > 0 and hits >= seen * percent

    return check(content)


class RecordingSource(DataSource):
    """Format "recording": text recordings of lines ``seconds,value,value...`` under a header of axis names.

    Options: path (comma-separated files), start, end (seconds). A file is a partition, its name the series. Binary
    formats need a parser of their own in ``read``.
    """

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return SIGNAL

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in re.split(r"\s*,\s*", options.get("path", "")) if p]
        self.start, self.end = float(options.get("start", "-inf")), float(options.get("end", "inf"))
        if not self.paths:
            raise ValueError("option path is missing")

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        path = partition.value
        name = path.rsplit("/", 1)[-1]
        with open(normalized_path(path)[1]) as lines:
            axes = next(lines).strip().split(",")[1:]
            for i, line in enumerate(lines):
                t, *values = map(float, line.split(","))
                if self.start <= t <= self.end:
                    yield from ((name, a, i, t, v) for a, v in zip(axes, values, strict=True))


def write_csv_folder(tables: dict[str, DataFrame], folder: str) -> None:
    """One CSV folder per result table; tables are small results, so each is one file."""
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")


def attributes_csv(files: DataFrame, folder: str) -> None:
    """files.csv and attributes.csv of a file table."""
    a = files.select(F.col("id").alias("file_id"), F.explode("attributes").alias("a")).select("file_id", "a.*")
    flat = files.select(*[c for c, t in files.dtypes if not t.startswith(("array", "struct", "map"))])
    write_csv_folder({"files": flat, "attributes": a}, folder)


def file_pages(spark: SparkSession, pages: Sequence[str], limit: int = 100) -> DataFrame:
    """Files of a service from saved JSON pages (the service itself needs a network): the first ``limit`` of them, in order."""
    from ..functions.text import FILES

    d = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "page long, body string")
    d = d.select("page", F.posexplode(F.from_json("body", f"data array<struct<{_struct(FILES)}>>")["data"]).alias("k", "f"))
    return d.orderBy("page", "k").limit(limit).select("f.*")


def _struct(ddl: str) -> str:
    """Columns ``a type`` as the fields ``a: type``."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, kind = ddl[start:k].strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            start = k + 1
    return ", ".join(out)
