"""Tidy data behind figures: each view returns the rows that a plotting layer would draw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quaternion import centre_of_coordinates, map_zoom
from ..operators.multivariate import correlations, non_null_columns, numeric_columns, pca, tsne
from ..operators.spectral import octave_spectrogram, to_octave, welch
from ..operators.windows import around_peak, envelope

THEMES = {
    "light": {"text": "#404041", "background": "#FFFFFF", "grid": "#DAD9D8"},
    "dark": {"text": "#DAD9D8", "background": "#262626", "grid": "#404041"},
}


def theme(name: str = "dark") -> dict[str, str]:
    if name not in THEMES:
        raise ValueError(f"theme is one of {sorted(THEMES)}")
    return dict(THEMES[name])


def attribute_points(files: DataFrame, attributes: list[str], key: str = "id") -> DataFrame:
    """(key, attribute, value) of the attributes that have some value."""
    use = [c for c in non_null_columns(files) if c in attributes]
    return files.select(key, *[F.col(c).cast("double").alias(c) for c in use]).unpivot([key], use, "attribute", "value")


def numeric_view(df: DataFrame) -> DataFrame:
    return df.select(*numeric_columns(df))


def map_view(points: DataFrame, lat: str = "lat", lon: str = "lon", positive: str | None = None) -> DataFrame:
    """One row: centre and zoom of a map of the points, only those with a positive value of a column if asked."""
    d = points if positive is None else points.filter(F.col(positive) > 0)
    r = d.agg(centre_of_coordinates(lat, lon).alias("centre"), F.min(lat).alias("a"), F.max(lat).alias("b"), F.min(lon).alias("c"), F.max(lon).alias("d"))
    return r.select("centre", map_zoom(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("zoom"))


def rounded_table(table: DataFrame, places: int = 2) -> DataFrame:
    nums = set(numeric_columns(table))
    return table.select(*[F.round(c, places).alias(c) if c in nums else F.col(c) for c in table.columns])


def octave_bars(sig: DataFrame, bins: float = 3, start: float = 20.0) -> DataFrame:
    """Octave sums of the spectrum with the widths of their bars."""
    d = to_octave(welch(sig, 1.0, "spectrum"), start, bins, "sum")
    return d.withColumn("width", F.col("freq") * (2 ** (0.5 / bins) - 2 ** (-0.5 / bins)))


def file_dashboard(sig: DataFrame, window: float, points: int = 250) -> dict[str, DataFrame]:
    """The four panes of one recording."""
    return {"octave_psd": octave_bars(sig), "peak": around_peak(sig), "spectrogram": octave_spectrogram(sig, window), "envelope": envelope(sig, points)}


def correlation_dashboard(files: DataFrame, attributes: list[str]) -> dict[str, DataFrame]:
    """The four panes of a table of recordings."""
    return {"pca": pca(files), "correlation": correlations(files), "tsne": tsne(files), "attributes": attribute_points(files, attributes)}
