"""Signals as streams: windows in event time, sessions, and recursions that carry their state across batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(folder)


def window_metrics(stream: DataFrame, ts: str, key: str, value: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """RMS, peak and count of tumbling or sliding windows; rows later than the watermark are left out."""
    d = stream.withWatermark(ts, late) if stream.isStreaming else stream
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    v = F.col(value)
    g = d.groupBy(w.alias("w"), key).agg(F.count(v).alias("n"), F.sqrt(F.avg(v * v)).alias("rms"), F.max(F.abs(v)).alias("peak"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "rms", "peak")


def session_metrics(stream: DataFrame, ts: str, key: str, value: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """The same for sessions that end with a gap."""
    d = stream.withWatermark(ts, late) if stream.isStreaming else stream
    v = F.col(value)
    g = d.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(v).alias("n"), F.sqrt(F.avg(v * v)).alias("rms"), F.max(F.abs(v)).alias("peak"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "rms", "peak")


def running_shock_spectrum(stream: DataFrame, freqs: list[float], dt: float, damp: float = 0.05, key: str = "series_id", order: str = "i", value: str = "v") -> DataFrame:
    """(key, freq, samples, value): the largest absolute response so far, updated with every batch of samples.

    The filters' states and extremes are the state of a key, so the result of all batches equals that of the whole
    record. Samples of a batch are taken in order; batches arrive in order.
    """
    from ..operators.shock import coefficients

    w = 2 * math.pi * np.array(freqs)
    b0, b1, b2, a1, a2 = coefficients("absolute_acceleration", w, 1 / (2 * damp), dt)

    def run(k, batches, state: GroupState) -> Iterator:
        import pandas as pd

        n, z1, z2, top = (0, *(np.zeros(len(w)) for _ in range(3))) if not state.exists else (state.get[0], *(np.array(x) for x in state.get[1:]))
        part = pd.concat(list(batches)).sort_values(order)
        for x in part[value]:
            y = b0 * x + z1
            z1, z2 = b1 * x - a1 * y + z2, b2 * x - a2 * y
            top = np.maximum(top, np.abs(y))
        n += len(part)
        state.update((n, z1.tolist(), z2.tolist(), top.tolist()))
        yield pd.DataFrame({key: k[0], "freq": freqs, "samples": n, "value": top})

    out = f"{key} string, freq double, samples long, value double"
    kept = "n long, z1 array<double>, z2 array<double>, top array<double>"
    return stream.groupBy(key).applyInPandasWithState(run, out, kept, "update", GroupStateTimeout.NoTimeout)


def sentence_stream(stream: DataFrame, key: str = "series_id", seq: str = "seq", data: str = "payload") -> DataFrame:
    """Complete sentences of byte blocks; what is left of a block is the state that the next one is joined to."""
    from ..sources.logs import take_sentences

    def run(k, batches, state: GroupState) -> Iterator:
        import pandas as pd

        left = bytearray(state.get[0]) if state.exists else bytearray()
        found: list[str] = []
        for raw in pd.concat(list(batches)).sort_values(seq)[data]:
            left += bytes(raw)
            new, left = take_sentences(left)
            found += new
        state.update((bytes(left),))
        yield pd.DataFrame({key: [k[0]] * len(found), "sentence": found})

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} string, sentence string", "left binary", "append", GroupStateTimeout.NoTimeout)


def to_table(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> None:
    """Runs a stream over what is there now into a table in memory, for tests and small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = q.option("checkpointLocation", checkpoint) if checkpoint else q
    q.start().awaitTermination()
