"""Near-duplicate detection: MinHash, banding, verification on full sets, components by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_slices, drop_spilled, flat_bytes, holding, mix64, spill, words

#: Bands and minima of a band. At a similarity of 0.8 a pair shares no band with probability (1 - 0.8**4)**32 < 5e-8.
BANDS, ROWS = 32, 4
#: Share of equal minima under which a pair is not compared: 5.6 standard deviations under 0.8 for 128 minima.
LEAST_EQUAL = 0.6
#: Members from which a bucket that still holds several components is compared by cells of blocks, not by rows of pairs.
LARGE_BUCKET = 24
#: Members of a block, about; columns of a block's matrix at a time.
BLOCK, COLUMNS = 256, 4096

_RNG = np.random.Generator(np.random.PCG64(99))
_A = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_P = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts, width: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingles of each text, end to end, and their offsets."""
    raw, at = flat_bytes(texts)
    h, _, _, first = words(raw, at, lower)
    acc = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for k in range(width):
        acc = acc * _P + h[k : k + len(acc)]
    acc = mix64(acc)
    out, ends = [], [0]
    for lo, hi in zip(first.tolist(), first[1:].tolist(), strict=False):
        if hi - lo >= width:
            one = np.unique(acc[lo : hi - width + 1])
        elif hi > lo:  # too few words: the whole sequence is the one shingle
            whole = np.array([hi - lo], np.uint64)
            for k in range(lo, hi):
                whole = whole * _P + h[k : k + 1]
            one = mix64(whole)
        else:
            one = acc[:0]
        out.append(one)
        ends.append(ends[-1] + len(one))
    return (np.concatenate(out) if out else acc[:0]), np.array(ends)


def signatures(docs: DataFrame, width: int, lower: bool) -> DataFrame:
    """(id, n, fp1, fp2, bands, minima) of rows (id, text): set size, fingerprint of the set, band hashes, low bits of the minima."""

    def run(batches) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in arrow_slices(batches, "text"):
            values, at = shingle_sets(pc.fill_null(batch.column("text"), ""), width, lower)
            n = np.diff(at)
            some = np.flatnonzero(n)
            minima = np.zeros((BANDS * ROWS, len(n)), np.uint64)
            fp = np.zeros((2, len(n)), np.uint64)
            if len(some):
                starts = at[:-1][some]
                fp[0, some] = np.add.reduceat(values, starts)
                fp[1, some] = np.bitwise_xor.reduceat(mix64(values ^ _P), starts)
                y = np.empty_like(values)
                for j in range(BANDS * ROWS):
                    np.multiply(values, _A[j], out=y)
                    y += _B[j]
                    minima[j, some] = np.minimum.reduceat(y, starts)
            bands = np.zeros((BANDS, len(n)), np.uint64)
            for r in range(ROWS):
                bands = bands * _P + minima[r::ROWS]
            bands = mix64(bands + np.arange(BANDS, dtype=np.uint64)[:, None] * _A[:BANDS, None])
            low = np.ascontiguousarray((minima >> np.uint64(48)).astype("<u2").T)
            offs = pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32))
            flat = pa.array(np.ascontiguousarray(bands.T)[some].reshape(-1).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n.astype(np.int64)), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)),
                 pa.ListArray.from_arrays(offs, flat), pa.array([row.tobytes() for row in low], pa.binary())],
                ["id", "n", "fp1", "fp2", "bands", "minima"],
            )

    return docs.mapInArrow(run, "id long, n long, fp1 long, fp2 long, bands array<long>, minima binary")


def _alike(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose set sizes and signatures allow the similarity, with equal: the share of equal minima."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("ma", "mb"))
            equal = (a == b).mean(axis=1)
            found = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(equal)], ["a", "b", "equal"])
            yield found.filter(pa.array(equal >= LEAST_EQUAL))

    s = signed.select("id", "n", "minima")
    left = s.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("minima").alias("ma"))
    right = s.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("minima").alias("mb"))
    d = pairs.select("a", "b").join(left, "a").join(right, "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return d.select("a", "b", "ma", "mb").mapInArrow(run, "a long, b long, equal double")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            good = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, width: int, lower: bool) -> DataFrame:
    """(id, set) of rows (id, text): the sorted shingles as little-endian 64-bit values."""

    def run(batches) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in arrow_slices(batches, "text"):
            values, at = shingle_sets(pc.fill_null(batch.column("text"), ""), width, lower)
            sets = [values[lo:hi].tobytes() for lo, hi in zip(at.tolist(), at[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["id", "set"])

    return docs.mapInArrow(run, "id long, set binary")


def _common(rows: list[np.ndarray], cols: list[np.ndarray]) -> np.ndarray:
    """Number of common elements of each of rows with each of cols, all without repeats."""
    both = np.concatenate([*rows, *cols])
    owner = np.repeat(np.arange(len(rows) + len(cols)), [len(x) for x in [*rows, *cols]])
    order = np.argsort(both, kind="stable")
    both, owner = both[order], owner[order]
    fresh = np.ones(len(both), bool)
    fresh[1:] = both[1:] != both[:-1]
    value = np.cumsum(fresh) - 1
    left = np.bincount(value, weights=owner < len(rows))
    shared = (left > 0) & (np.bincount(value) > left)  # values on both sides
    column = np.cumsum(shared) - 1
    use = shared[value]
    column, owner = column[value[use]], owner[use]
    out = np.zeros((len(rows), len(cols)), np.float32)
    for lo in range(0, int(shared.sum()), COLUMNS):
        m = np.zeros((len(rows) + len(cols), COLUMNS), np.float32)
        now = (column >= lo) & (column < lo + COLUMNS)
        m[owner[now], column[now] - lo] = 1
        out += m[: len(rows)] @ m[len(rows) :].T
    return out.astype(np.int64)


def _joined(rows: DataFrame, totals: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """rows joined to totals, an aggregate with one row per keys, where one key may hold a large part of rows.

    The hash beside the keys makes the planner shuffle totals once more after its aggregation. Both sides of the join are
    then plain shuffles, which adaptive execution splits where a key is hot; above an aggregate it would not.
    """
    by = F.xxhash64(*keys).alias("_by")
    return rows.select("*", by).join(totals.select("*", by), [*keys, "_by"], how).drop("_by")


def _cell_links(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) between members of different components in one bucket, for buckets of any size.

    placed: (bucket, id, component). Each member belongs to a block of about BLOCK members that its largest bucket
    holds; members of a large component have blocks of their own. A cell is a pair of blocks that some bucket holds both
    of. A cell gets the sets of its blocks once and compares all their pairs as one product of 0/1 matrices, so what
    is moved grows with blocks, not with pairs, and only links leave it: for each member, one to each other component.
    """
    big = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("in_bucket"))
    home = _joined(placed, big, "bucket").groupBy("id", "component").agg(F.max(F.struct("in_bucket", "bucket")).alias("h"))
    home = home.select("id", "component", F.col("h.bucket").alias("home"))
    sizes = home.groupBy("home", "component").agg(F.count(F.lit(1)).alias("n"))
    home = _joined(home, sizes, "home", "component")
    kind = F.when(F.col("n") >= BLOCK // 4, F.col("component")).otherwise(-1)
    home = home.select("id", "component", "home", kind.alias("kind"))
    parts = home.groupBy("home", "kind").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    home = _joined(home, parts, "home", "kind")
    block = F.xxhash64("home", "kind", F.pmod(F.xxhash64("id"), F.col("parts")))
    home = spill(home.select("id", "component", block.alias("block"), (F.col("kind") != -1).alias("single")))
    in_bucket = placed.select("bucket", "id").join(home, "id").select("bucket", "block", "single", F.when(F.col("single"), F.col("component")).alias("of")).distinct()
    other = in_bucket.select("bucket", F.col("block").alias("block2"), F.col("of").alias("of2"))
    cells = in_bucket.join(other, "bucket").filter((F.col("block") <= F.col("block2")) & ~F.coalesce(F.col("of") == F.col("of2"), F.lit(False)))
    cells = cells.select("block", "block2").distinct().withColumn("cell", F.xxhash64("block", "block2"))
    sides = cells.select("cell", F.col("block"), F.lit(0).alias("side")).unionByName(cells.filter("block <> block2").select("cell", F.col("block2").alias("block"), F.lit(1).alias("side")))
    shipped = sides.join(home.select("id", "component", "block"), "block").join(sets, "id").select("cell", "side", "id", "component", "set")

    def compare(table):
        import pyarrow as pa

        side = np.array(table.column("side"))
        ids, comp = np.array(table.column("id")), np.array(table.column("component"))
        values = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("set")]
        rows = np.flatnonzero(side == 0)
        cols = np.flatnonzero(side == 1) if (side == 1).any() else rows
        out: set[tuple[int, int]] = set()
        if len(rows) and len(cols):
            same = _common([values[i] for i in rows], [values[j] for j in cols])
            n = np.array([len(v) for v in values])
            linked = (100 * same >= percent * (n[rows][:, None] + n[cols][None] - same)) & (comp[rows][:, None] != comp[cols][None])
            for i in np.flatnonzero(linked.any(axis=1)):
                js = np.flatnonzero(linked[i])
                _, first = np.unique(comp[cols[js]], return_index=True)
                out |= {(int(ids[rows[i]]), int(ids[cols[js[k]]])) for k in first}
        pairs = sorted(out)
        return pa.table([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

    return shipped.groupBy("cell").applyInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b): the smallest id reachable, by alternating large-star and small-star.

    A large-star ties every larger neighbour of a node to the least of the node and its neighbours; a small-star ties
    the smaller neighbours and the node to the least of them. Each round is written as a table; the rounds end when
    the edges stay the same, after a number logarithmic in the longest path.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    big, small = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = spill(edges.filter("a <> b").select(big, small).distinct())
    before = state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _joined(both.filter("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = _joined(large, least, "a")
        new = tied.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        new = spill(new.select("e.a", "e.b").filter("a <> b").distinct())
        after = state(new)
        drop_spilled(now)
        now = new
        if after == before:
            break
        before = after
    stars = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    return spill(stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct()))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """Components of texts whose shingle sets have 100 * intersection >= percent * union.

    Texts give the set of their distinct runs of ``width`` words (A-Z lower-cased if ``lower``); a text of fewer words
    is one shingle, a text without words has none and no links. Texts of one set are one class, whose smallest id stands
    for it. Classes that share a band of MinHash minima meet in buckets. A bucket is not compared pair by pair: its
    members meet its pivot, the member that shares most buckets (in a family of copies, the original). Pairs that
    their set sizes and signatures allow are confirmed on the full sets. Where a bucket then still holds several
    components, members of different ones are compared too: in small buckets as pairs, in large ones block by block,
    so no link between components is lost. That last step alone grows faster than the input, with the square of a
    family of texts that are alike but mostly under the threshold, over the size of a block squared.

    Returns a row per input row: id, n_shingles, component_id (the smallest id reachable), kept (id = component_id).
    Null texts count as empty. Rows of one id are one document, reported once each. Rows with a null id link with
    nothing: their component_id is null and they are kept. No rows give no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = spill(signatures(rows, width, lower))
    valid = signed.filter("id IS NOT NULL AND n > 0")
    classes = spill(valid.groupBy("n", "fp1", "fp2").agg(F.min("id").alias("rep")))
    reps = valid.join(classes.select(F.col("rep").alias("id"), "n", "fp1", "fp2"), ["id", "n", "fp1", "fp2"], "left_semi")
    entries = reps.select("id", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    entries = spill(_joined(entries, shared, "bucket"))
    degree = spill(entries.groupBy("id").agg(F.sum(F.col("members") - 1).alias("degree")))
    reps = spill(reps.join(degree, "id").select("id", "n", "minima"))
    sets = spill(full_sets(rows.join(degree.select("id"), "id", "left_semi"), width, lower))

    ranked = entries.join(degree, "id")
    pivots = ranked.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("id")).alias("no"))).alias("p")).select("bucket", (-F.col("p.no")).alias("b"))
    pairs = _joined(entries, pivots, "bucket").filter("id <> b").select(F.col("id").alias("a"), "b").distinct()
    alike = _alike(pairs, reps, percent)
    best = alike.groupBy("a").agg(F.max(F.struct("equal", (-F.col("b")).alias("no"))).alias("x")).select("a", (-F.col("x.no")).alias("b"))
    links = spill(_confirmed(best, sets, percent))
    found = components(links)

    placed = entries.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
    placed = spill(_joined(placed, mixed, "bucket", how="left_semi"))
    small = placed.filter(F.col("members") < LARGE_BUCKET)
    other = small.select("bucket", F.col("id").alias("b"), F.col("component").alias("other"))
    rest = small.select("bucket", F.col("id").alias("a"), "component").join(other, "bucket").filter("component < other").select("a", "b").distinct()
    more = _confirmed(_alike(rest, reps, percent), sets, percent)
    large = placed.filter(F.col("members") >= LARGE_BUCKET).select("bucket", "id", "component")
    more = spill(more.unionByName(_cell_links(large, sets, percent)))
    if not more.isEmpty():
        drop_spilled(found)
        found = components(links.unionByName(more))
    drop_spilled(entries, degree, reps, sets, links, placed, more)  # what follows reads the others alone
    members = signed.select("id", "n", "fp1", "fp2").join(classes, ["n", "fp1", "fp2"], "left")
    members = members.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    out = members.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
    return holding(out, signed, classes, found)


def op9_near(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)
