"""Sentence logs of positioning receivers, and element trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import numbered, running_sum

END = b"\r\n"


def take_sentences(buffer: bytearray) -> tuple[list[str], bytearray]:
    """Complete sentences of a buffer, from their ``$G`` on, and what is left over for the next call."""
    if not isinstance(buffer, bytearray):
        raise ValueError("the buffer is a bytearray")
    *lines, rest = buffer.split(END)
    found = [line[line.find(b"$G") :].decode("ascii", "replace") for line in lines if b"$G" in line]
    return found, bytearray(rest)


def cut(texts: DataFrame, order: str, size: int, key: str = "series_id", text: str = "x") -> DataFrame:
    """(key, seq, payload): the texts of a recording in order, put end to end and cut into blocks of size characters.

    A text is cut where the blocks end, by its place in the whole, so that the whole is never one value.
    """
    d = numbered(texts, key, [order], "i").withColumnsRenamed({key: "series_id"}).withColumns({"axis": F.lit("x"), "_len": F.length(text)})
    d = running_sum(d, F.col("_len"), "_end").withColumn("_start", (F.col("_end") - F.col("_len")).cast("long")).filter("_len > 0")
    d = d.withColumn("seq", F.explode(F.sequence(F.floor(F.col("_start") / size), F.floor((F.col("_start") + F.col("_len") - 1) / size))))
    lo = F.greatest(F.col("seq") * size - F.col("_start"), F.lit(0))
    piece = F.substring(F.col(text), (lo + 1).cast("int"), ((F.col("seq") + 1) * size - F.col("_start") - lo).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("_start", piece.alias("p"))))
    g = d.groupBy(F.col("series_id").alias(key), "seq").agg(parts.alias("p"))
    return g.select(key, "seq", F.array_join(F.transform("p", lambda x: x["p"]), "").alias("payload"))


def sentences(payload: DataFrame, key: str = "series_id", seq: str = "seq", data: str = "payload") -> DataFrame:
    """(key, n, sentence): the payload blocks of a recording in order, cut at line ends, from ``$G`` on.

    A sentence that two blocks share is put together: a block's first piece joins the last piece of the block before it.
    Lines are cut at the line feed, as a block may end between the two characters of a line end.
    """
    text = F.col(data).cast("string")
    d = payload.select(key, seq, F.split(text, "\n").alias("p"))
    d = d.select(key, seq, F.posexplode("p").alias("k", "piece"), (F.size("p") - 1).alias("last"))
    # every line end closes a line; a piece belongs to the line that the next line end closes
    order = Window.partitionBy(key).orderBy(seq, "k").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("line", F.coalesce(F.sum(F.when(F.col("k") < F.col("last"), 1).otherwise(0)).over(order), F.lit(0)))
    whole = d.groupBy(key, "line").agg(F.array_sort(F.collect_list(F.struct(seq, "k", "piece"))).alias("x"), F.max(F.col("k") < F.col("last")).alias("closed"))
    full = F.rtrim(F.array_join(F.transform("x", lambda x: x["piece"]), ""), F.lit("\r"))
    return whole.filter("closed").select(key, F.col("line").alias("n"), full.alias("s")).filter(F.col("s").contains("$G")).select(key, "n", F.expr("substring(s, locate('$G', s))").alias("sentence"))


def _degrees(value: Column, hemisphere: Column) -> Column:
    """dddmm.mmmm with its hemisphere as signed degrees."""
    v = value.try_cast("double")
    whole = F.floor(v / 100)
    return (whole + (v - whole * 100) / 60) * F.when(hemisphere.isin("S", "W"), -1.0).otherwise(1.0)


def parse_sentences(lines: DataFrame, key: str = "series_id", n: str = "n", sentence: str = "sentence") -> DataFrame:
    """Fields of RMC, GGA, VTG, GSV and GLL sentences as columns."""
    body = F.element_at(F.split(F.col(sentence), r"\*"), 1)
    d = lines.withColumn("_f", F.split(body, ",")).withColumn("msg", F.right(F.element_at("_f", 1), F.lit(3)))
    f = lambda k: F.when(F.try_element_at("_f", F.lit(k + 1)) != "", F.try_element_at("_f", F.lit(k + 1)))
    rmc, gga, vtg, gsv = (F.col("msg") == m for m in ("RMC", "GGA", "VTG", "GSV"))
    stamp = F.concat(F.lpad(f(9), 6, "0"), F.substring(f(1), 1, 6))
    return d.select(
        key, n, "msg",
        F.when(rmc, F.try_to_timestamp(stamp, F.lit("ddMMyyHHmmss"))).alias("ts"),
        F.when(rmc, _degrees(f(3), f(4))).when(gga, _degrees(f(2), f(3))).alias("latitude"),
        F.when(rmc, _degrees(f(5), f(6))).when(gga, _degrees(f(4), f(5))).alias("longitude"),
        F.when(vtg, f(7).try_cast("double")).alias("speed"),
        F.when(vtg, f(1).try_cast("double")).alias("direction"),
        F.when(gga, f(6).try_cast("int")).alias("quality"),
        F.when(gsv, f(3).try_cast("int")).alias("satellites"),
    )


def blocks(rows: DataFrame, starts: Column, key: str, order: Sequence[str], name: str = "block") -> DataFrame:
    """rows with the number of the block they are in: a running count of starting rows; rows before the first are block 0."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def measurements(parsed: DataFrame, filter_level: int = 0, key: str = "series_id", n: str = "n") -> DataFrame:
    """(key, ts, direction, latitude, longitude, speed, quality): one row for each block from RMC to the next, at its GPS time,
    if enough satellites are in view and some field is there."""
    d = blocks(parsed, F.col("msg") == "RMC", key, [n]).filter("block > 0")
    fields = ("direction", "latitude", "longitude", "speed", "quality")
    g = d.groupBy(key, "block").agg(F.max("ts").alias("ts"), *[F.max(c).alias(c) for c in fields], F.max("satellites").alias("_sv"))
    return g.filter((F.coalesce("_sv", F.lit(0)) >= filter_level) & F.coalesce(*[F.col(c).cast("double") for c in fields]).isNotNull()).select(key, "ts", *fields)


# ---- element trees ----------------------------------------------------------------------------------------------


def tree_paths(elements: DataFrame, max_depth: int = 64, id_col: str = "id", parent: str = "parent_id", name: str = "name") -> DataFrame:
    """elements with path (names from the root) and depth, level by level: each level joins its children."""
    level = elements.filter(F.col(parent).isNull()).select("*", F.array(name).alias("path"), F.lit(0).alias("depth"))
    out = level
    for depth in range(1, max_depth + 1):
        up = level.select(F.col(id_col).alias("_p"), F.col("path").alias("_path"))
        level = elements.join(up, elements[parent] == up["_p"]).select(elements["*"], F.concat("_path", F.array(name)).alias("path"), F.lit(depth).alias("depth"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def elements_at(elements: DataFrame, path: Sequence[str], **columns) -> DataFrame:
    """Elements whose path is the list of names; a branch that differs is not followed."""
    id_col, parent, name = columns.get("id_col", "id"), columns.get("parent", "parent_id"), columns.get("name", "name")
    now = elements.filter(F.col(parent).isNull() & (F.col(name) == path[0]))
    for step in path[1:]:
        up = now.select(F.col(id_col).alias("_p"))
        now = elements.filter(F.col(name) == step).join(up, F.col(parent) == F.col("_p"), "left_semi")
    return now


def config_values(elements: DataFrame, config_id: str, name: str) -> DataFrame:
    """Values of a named element whose sibling ConfigID has a value."""
    c = elements.filter((F.col("name") == "ConfigID") & (F.col("value") == config_id)).select(F.col("parent_id").alias("_p"))
    return elements.filter(F.col("name") == name).join(c, F.col("parent_id") == F.col("_p"), "left_semi").select("value")


def utc_offset(elements: DataFrame, config_id: str = str(0xBFF7F)) -> int:
    """Seconds that the recorder's clock is from UTC: a configured value, else a UTCOffset element, else 0."""
    found = config_values(elements, config_id, "IntValue").unionByName(elements.filter("name = 'UTCOffset'").select("value")).limit(1).collect()
    return int(found[0]["value"]) if found else 0
