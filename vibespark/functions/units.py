"""Unit conversion, decibels and log frequencies as column expressions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Standard gravity, and sizes of units in SI base units with their dimension.
G = 9.80665
UNITS = {
    "m": (1.0, "L"), "mm": (1e-3, "L"), "cm": (1e-2, "L"), "um": (1e-6, "L"), "km": (1e3, "L"), "in": (0.0254, "L"), "inch": (0.0254, "L"),
    "ft": (0.3048, "L"), "feet": (0.3048, "L"), "s": (1.0, "T"), "ms": (1e-3, "T"), "us": (1e-6, "T"), "min": (60.0, "T"), "h": (3600.0, "T"),
    "kg": (1.0, "M"), "g": (1e-3, "M"), "rad": (1.0, ""), "deg": (math.pi / 180, ""), "Hz": (1.0, "T-1"), "gravity": (G, "L T-2"),
    "N": (1.0, "M L T-2"), "Pa": (1.0, "M L-1 T-2"), "kPa": (1e3, "M L-1 T-2"), "psi": (6894.757293168361, "M L-1 T-2"), "atm": (101325.0, "M L-1 T-2"), "bar": (1e5, "M L-1 T-2"),
    "V": (1.0, "V"), "A": (1.0, "A"), "percent": (0.01, ""),
}
#: Scale and zero of temperatures in kelvin.
TEMPERATURES = {"K": (1.0, 0.0), "degK": (1.0, 0.0), "degC": (1.0, 273.15), "degF": (5 / 9, 459.67 * 5 / 9)}
#: Reference levels of decibels.
DB_REFERENCES = {"SPL": 2e-5, "audio_intensity": 1e-12}
_TERM = re.compile(r"\s*([*/]?)\s*([A-Za-z]+)(?:\s*(?:\^|\*\*)\s*(-?\d+))?")


def _size(unit: str) -> tuple[float, dict[str, int]]:
    size, dims, at = 1.0, {}, 0
    text = unit.strip()
    while at < len(text):
        m = _TERM.match(text, at)
        if not m or m[2] not in UNITS:
            raise ValueError(f"unknown unit {unit!r}")
        n = int(m[3] or 1) * (-1 if m[1] == "/" else 1)
        k, d = UNITS[m[2]]
        size *= k**n
        for part in d.split():
            name, power = part[0], int(part[1:] or 1)
            dims[name] = dims.get(name, 0) + power * n
        at = m.end()
    return size, {k: v for k, v in dims.items() if v}


def affine(units_in: str, units_out: str) -> tuple[float, float]:
    """(a, b) such that out = a * in + b."""
    if units_in in TEMPERATURES and units_out in TEMPERATURES:
        (a, b), (c, d) = TEMPERATURES[units_in], TEMPERATURES[units_out]
        return a / c, (b - d) / c
    (a, da), (b, db) = _size(units_in), _size(units_out)
    if da != db:
        raise ValueError(f"{units_in} does not convert to {units_out}")
    return a / b, 0.0


def factor(units_in: str, units_out: str) -> float:
    return affine(units_in, units_out)[0]


def convert_units(value: Column | float | str, units_in: str, units_out: str):
    """A number or a column (by name) in other units."""
    a, b = affine(units_in, units_out)
    return (F.col(value) if isinstance(value, str) else value) * a + b


def unit_table(spark) -> DataFrame:
    """(unit, size, offset, dimension) for joins on units that rows name."""
    rows = [(u, k, 0.0, d) for u, (k, d) in UNITS.items()] + [(u, a, b, "temperature") for u, (a, b) in TEMPERATURES.items()]
    return spark.createDataFrame(rows, "unit string, size double, offset double, dimension string")


def to_db(value: Column | str, reference: float | str, squared: bool = False) -> Column:
    """20 log10(value / reference), 10 for squared values; a value of 0 gives minus infinity, a negative one null."""
    ref = DB_REFERENCES.get(reference) if isinstance(reference, str) else reference
    if not ref or ref <= 0:
        raise ValueError(f"no reference level {reference!r}")
    x = F.col(value) if isinstance(value, str) else value
    k = 10.0 if squared else 20.0
    return F.when(x == 0, F.lit(float("-inf"))).when(x > 0, k * (F.log10(x) - math.log10(ref)))


def octave_sequence(fstart: float, top: Column, bins: float) -> Column:
    """Centres fstart * 2**(k / bins) up to top, as an array."""
    n = F.floor((F.log2(top) - math.log2(fstart)) * bins)
    return F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0)).cast("int")), lambda k: F.lit(float(fstart)) * F.pow(F.lit(2.0), k / bins))
