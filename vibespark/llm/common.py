"""Shared parts of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every word-based operator.
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); an own one only where that is unset and the
    master is local, as other machines don't see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = getattr(spark, "_vibespark_shared", None) or f"file://{tempfile.mkdtemp(prefix='vibespark-')}"
        spark._vibespark_shared = named
    return named.rstrip("/")


def spill(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read back: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vibespark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vibespark_path = path
    return out


def holding(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """df with the tables of spill() that it reads, which drop_spilled(df) deletes."""
    df._vibespark_tables = tables
    return df


def drop_spilled(*frames: DataFrame) -> None:
    """Deletes tables of spill() that no result needs any more, and those that a result holds."""
    for df in frames:
        drop_spilled(*getattr(df, "_vibespark_tables", ()))
        if path := getattr(df, "_vibespark_path", None):
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def text_of(column: str | Column) -> Column:
    """The text, null as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def one_space(text: Column) -> Column:
    """Each run of white space as one space; a single space is left without a match, which is much faster."""
    return F.regexp_replace(text, rf"[\x09-\x0D]{SPACE}*+|\x20{SPACE}++", " ")


def word_count(text: Column) -> Column:
    """Number of words of a text, without building them."""
    marks = F.regexp_replace(text, rf"{SPACE}*+[^\x20\x09-\x0D]++{SPACE}*+", "x")
    return F.when(marks.startswith("x"), F.length(marks)).otherwise(0).cast("long")


# ---- vectorised words -------------------------------------------------------------------------------------------

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_MUL = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(_MUL), -1, 2**64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def flat_bytes(array) -> tuple[np.ndarray, np.ndarray]:
    """A pyarrow string array without nulls as its UTF-8 bytes and their offsets (one more than rows)."""
    import pyarrow as pa

    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    array = array.cast(pa.large_binary())
    _, offs, data = array.buffers()
    at = np.frombuffer(offs, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], (at - at[0]) if len(at) else np.zeros(1, np.int64)


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MUL**(place + 1) and MUL**-place of n places; kept by a worker up to 16 million places."""
    if not _powers or len(_powers[0]) < n:
        made = np.multiply.accumulate(np.full(n, _MUL, np.uint64)), np.multiply.accumulate(np.concatenate([np.ones(min(n, 1), np.uint64), np.full(max(n - 1, 0), INVERSE, np.uint64)]))
        if n > 1 << 24:
            return made
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def words(raw: np.ndarray, at: np.ndarray, lower: bool = False):
    """All words of all texts: 64-bit hash, first byte, end byte, and the index of the first word of each text (one more than texts)."""
    solid = ~_SPACES[raw]
    before = np.empty_like(solid)
    if len(solid):
        before[0] = False
        before[1:] = solid[:-1]
        starts_of = at[:-1][at[:-1] < len(raw)]
        before[starts_of] = False
        after = np.empty_like(solid)
        after[-1] = False
        after[:-1] = solid[1:]
        ends_of = at[1:][at[1:] > 0] - 1
        after[ends_of] = False
        first, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    else:
        first = end = np.zeros(0, np.int64)
    # a word's hash is its sum of table[byte] * MUL**place, taken from sums over the whole buffer, over MUL**first
    table = _BYTE[_LOWER] if lower else _BYTE
    power, back = powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(table[raw] * power, out=sums[1:])
    hashes = mix64((sums[end] - sums[first]) * back[first] + (end - first).astype(np.uint64))
    return hashes, first, end, np.searchsorted(first, at)


def arrow_slices(batches, column: str, limit: int = 1 << 20):
    """Record batches cut so that the text of a slice stays near limit bytes (one row at least)."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)] if len(sizes) else []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                yield batch.slice(lo, hi - lo)
