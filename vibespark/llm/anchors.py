"""Finding what recurs anywhere without comparing everything: windows, their anchors, and the exchanges about them.

A window is a run of W consecutive units (words or bytes) of one document. Its anchor is the least hash of the k-grams
inside it, so equal windows have equal anchors, wherever they lie. Consecutive windows of one anchor form a segment.
Rows are dealt to batches; what a batch asks about an anchor goes to the anchor's shard:

1. batch -> shard: the distinct anchors of the batch; shard -> batch: whether another batch has each, and whether very
   many have it.
2. Such a hot anchor may stand in any number of different segments. Its windows are first asked for one by one, dealt by
   their own hashes, so that only those that another window may equal go on.
3. batch -> shard: the content of the distinct segments whose anchor recurs, and of the runs of hot windows that may
   recur; shard -> batch: a verdict on each window, reached on the content itself.

A batch sends equal segments once, so any number of copies adds one row per batch at most to a shard. Only shards that
a batch has something for get a message, so the messages are at most as many as the anchors, and anchors' shards, which
hold hashes alone, are larger than those that judge content.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, text_of

#: Bytes of text in a batch, about; batches to a shard that judges content, and to one that is asked about anchors.
BATCH_BYTES = 4 << 20
BATCHES_PER_SHARD = 6
BATCHES_PER_ASKED = 48
#: Batches that have an anchor, above which its windows are asked for one by one before their content is sent.
HOT_BATCHES = 48
_NULL_ID = np.iinfo(np.int64).max

ASK, TOLD = "shard int, batch int, blob binary", "batch int, shard int, blob binary"


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values, by doubling."""
    out, size = values, 1
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    if size < width:
        out = np.minimum(out[: len(out) - (width - size)], out[width - size :])
    return out


@dataclass
class Segments:
    """Segments of a batch: first window, number of windows, anchor, and the number of its content (kind)."""

    units: int
    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    kind: np.ndarray
    first: np.ndarray  # first segment of each kind
    anchors: np.ndarray  # sorted distinct anchors
    local: np.ndarray  # whether the anchor's k-gram lies at more than one place of the batch
    hashes: Callable  # hashes of the windows at places
    kinds_of: Callable  # kinds of segments (start, count, anchor)


def segments(grams: np.ndarray, valid: np.ndarray, width: int, content: Callable, same: Callable, hashes: Callable) -> Segments:
    """grams: hash of the k-gram from each unit (all ones where it would leave its document); valid: whether a window starts
    at each unit; width: k-grams in a window; content(start, count): hashes of segments; same(a, b, count): whether segments
    from a and from b are equal in content; hashes(places): of windows."""
    units = len(valid)
    least = sliding_min(grams, width)[: len(valid)] if len(grams) >= width else grams[:0]
    valid = valid[: len(least)]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    start = np.flatnonzero(new)
    ends = valid.copy()
    ends[:-1] &= ~valid[1:] | new[1:]
    count = np.flatnonzero(ends) - start + 1
    anchor = least[start]

    def kinds_of(start: np.ndarray, count: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Of equal hash and, place by place, of equal content: a segment that differs from the one before it in the order
        of hashes starts a kind of its own, so unequal segments never share one."""
        h = content(start, count) ^ mix64(anchor + np.uint64(1))
        order = np.lexsort((start, count, h, anchor))
        a, b = order[:-1], order[1:]
        alike = (h[a] == h[b]) & (anchor[a] == anchor[b]) & (count[a] == count[b])
        at = np.flatnonzero(alike)
        alike[at] = same(start[a[at]], start[b[at]], count[a[at]])
        kind = np.empty(len(order), np.int64)
        kind[order] = np.concatenate([[0], np.cumsum(~alike)]) if len(order) else order
        return kind

    kind = kinds_of(start, count, anchor)
    first = np.unique(kind, return_index=True)[1]
    anchors = np.unique(anchor)
    # places of each anchor's k-gram: a table of low bits lets few others through
    seen = np.zeros(1 << 20, bool)
    seen[(anchors & np.uint64(0xFFFFF)).astype(np.int64)] = True
    near = grams[seen[(grams & np.uint64(0xFFFFF)).astype(np.int64)]]
    at = np.searchsorted(anchors, near)
    hit = at < len(anchors)
    at = at[hit][anchors[at[hit]] == near[hit]]
    local = np.bincount(at, minlength=len(anchors)) > 1
    return Segments(units, start, count, anchor, kind, first, anchors, local, hashes, kinds_of)


def rows_of(table):
    """Ids (null: the largest) and texts of a batch, in the order of id and text, whatever order the rows came in."""
    import pyarrow as pa
    import pyarrow.compute as pc

    ids = pc.fill_null(table.column("id"), _NULL_ID)
    table = pa.table({"id": ids, "text": table.column("text"), "null": pc.is_null(table.column("id"))})
    return table.take(pc.sort_indices(table, [("id", "ascending"), ("text", "ascending")]))


def by_shard(parts: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(shard, places that have it) of the shards that occur."""
    order = np.argsort(parts, kind="stable")
    cuts = np.flatnonzero(np.diff(parts[order])) + 1
    return [(int(parts[at[0]]), at) for at in np.split(order, cuts)] if len(parts) else []


def places_of(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places of all windows of segments, one after the other."""
    return np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _frame(schema: str, rows: list[tuple]):
    import pyarrow as pa

    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.binary() if x.endswith("binary") else pa.int32() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _bits(told, turn: int) -> dict[int, bytes]:
    import pyarrow.compute as pc

    mine = told.filter(pc.equal(told.column("turn"), turn))
    return dict(zip(mine.column("shard").to_pylist(), mine.column("blob").to_pylist(), strict=True))


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def recurrence(docs: DataFrame, id_col: str, text_col: str, find: Callable, send: Callable, judge: Callable, settle: Callable, schema: str, first_stays: bool, batch_bytes: int | None = None, per_shard: int | None = None) -> DataFrame:
    """Runs the exchanges and tells each batch which of its windows go.

    find(rows) -> (state, Segments); send(state, start, count, anchor) -> blob of these distinct segments for one shard;
    judge(blobs) -> for each blob the verdicts on its windows, reached on their content: whether an equal window starts
    earlier (first_stays) or anywhere else; settle(state, gone) -> the batch's result, where gone marks the units at
    which a window starts that goes. Batches are dealt by row, not by id, to as many partitions as the session shuffles
    to; each is found anew in each exchange from the same rows, so a lost executor costs its batches only.
    """
    spark = docs.sparkSession
    size = docs.select(F.sum(F.octet_length(text_of(text_col))).alias("b")).first()["b"] or 0
    batches = max(1, -(-size // (batch_bytes or BATCH_BYTES)))
    shards = max(1, -(-batches // (per_shard or BATCHES_PER_SHARD)))
    asked_shards = max(1, -(-batches // BATCHES_PER_ASKED))
    partitions = min(batches, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    dealt = dealt.withColumn("batch", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(batches)).cast("int")).repartition(partitions, "batch")

    def home(df: DataFrame) -> DataFrame:
        return df.repartition(partitions, "batch")

    def shard_of(hashes: np.ndarray, n: int) -> np.ndarray:
        return (mix64(hashes) % np.uint64(n)).astype(np.int64)

    def answers(table, flags) -> object:
        return _frame(TOLD, [(b, s, np.packbits(f).tobytes()) for b, s, f in zip(table.column("batch").to_pylist(), table.column("shard").to_pylist(), flags, strict=True)])

    # 1: which anchors other batches have
    def asked(table):
        _, w = find(rows_of(table))
        batch = table.column("batch")[0].as_py()
        return _frame(ASK, [(s, batch, w.anchors[at].tobytes()) for s, at in by_shard(shard_of(w.anchors, asked_shards))])

    def answered(table):
        blobs = [np.frombuffer(b, np.uint64) for b in table.column("blob").to_pylist()]
        _, back, times = np.unique(np.concatenate(blobs), return_inverse=True, return_counts=True)
        cuts = np.cumsum([len(b) for b in blobs])[:-1]
        return answers(table, [np.concatenate(f) for f in zip(np.split(times[back] > 1, cuts), np.split(times[back] > HOT_BATCHES, cuts), strict=True)])

    def recurring(w: Segments, told) -> tuple[np.ndarray, np.ndarray]:
        """Distinct segments with a recurring anchor: those whose anchor is not hot, and those whose anchor is."""
        again, hot, bits = w.local.copy(), np.zeros(len(w.anchors), bool), _bits(told, 1)
        for s, at in by_shard(shard_of(w.anchors, asked_shards)):
            both = _unpacked(bits[s], 2 * len(at))
            again[at] |= both[: len(at)]
            hot[at] = both[len(at) :]
        own = np.searchsorted(w.anchors, w.anchor[w.first])
        return np.flatnonzero(again[own] & ~hot[own]), np.flatnonzero(hot[own])

    # 2: which windows under hot anchors may recur at all, by their own hashes
    def hot_parts(w: Segments, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
        lead = w.first[kinds]
        hashes = w.hashes(places_of(w.start[lead], w.count[lead]))
        return hashes, np.repeat(w.anchor[lead], w.count[lead]), by_shard(shard_of(hashes, shards))

    def sent_hot(left, told):
        if not left.num_rows or not any(np.frombuffer(b, np.uint8).any() for b in _bits(told, 1).values()):
            return _frame(ASK, [])
        _, w = find(rows_of(left))
        hashes, anchor, parts = hot_parts(w, recurring(w, told)[1])
        batch = left.column("batch")[0].as_py()
        return _frame(ASK, [(s, batch, hashes[at].tobytes() + anchor[at].tobytes()) for s, at in parts])

    def judged_hot(table):
        fields = [np.frombuffer(b, np.uint64).reshape(2, -1) for b in table.column("blob").to_pylist()]
        h, anchor = np.concatenate(fields, axis=1)
        order = np.lexsort((anchor, h))
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = (h[order][1:] == h[order][:-1]) & (anchor[order][1:] == anchor[order][:-1])
        flags = np.zeros(len(order), bool)
        flags[order] = same[:-1] | same[1:]
        return answers(table, np.split(flags, np.cumsum([f.shape[1] for f in fields])[:-1]))

    def to_judge(w: Segments, told) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, count, anchor, kind) of what is judged on its content: recurring segments, and of those with a hot
        anchor the runs of windows whose hash recurs. kind: equal for equal content; the first of a kind is sent."""
        cold, hot = recurring(w, told)
        lead = w.first[cold]
        start, count, anchor = w.start[lead], w.count[lead], w.anchor[lead]
        if len(hot):
            bits, mine = _bits(told, 2), w.first[hot]
            _, _, parts = hot_parts(w, hot)
            flags = np.zeros(int(w.count[mine].sum()), bool)
            for s, at in parts:
                flags[at] = _unpacked(bits[s], len(at))
            each, of = places_of(w.start[mine], w.count[mine]), np.repeat(np.arange(len(mine)), w.count[mine])
            begin, end = flags.copy(), flags.copy()
            begin[1:] &= ~flags[:-1] | (of[1:] != of[:-1])
            end[:-1] &= ~flags[1:] | (of[1:] != of[:-1])
            lo, hi = np.flatnonzero(begin), np.flatnonzero(end)
            start, count, anchor = np.concatenate([start, each[lo]]), np.concatenate([count, hi - lo + 1]), np.concatenate([anchor, w.anchor[mine][of[lo]]])
            order = np.argsort(start, kind="stable")
            start, count, anchor = start[order], count[order], anchor[order]
        return start, count, anchor, w.kinds_of(start, count, anchor)

    # 3: verdicts on content
    def leads(kind: np.ndarray) -> np.ndarray:
        """The first of each kind, in order of kind."""
        return np.unique(kind, return_index=True)[1]

    def sent(left, told):
        if not left.num_rows:
            return _frame(ASK, [])
        state, w = find(rows_of(left))
        start, count, anchor, kind = to_judge(w, told)
        first = leads(kind)
        start, count, anchor = start[first], count[first], anchor[first]
        batch = left.column("batch")[0].as_py()
        return _frame(ASK, [(s, batch, send(state, start[at], count[at], anchor[at])) for s, at in by_shard(shard_of(anchor, shards))])

    def judged(table):
        return answers(table, judge(table.column("blob").to_pylist()))

    def settled(left, told):
        import pyarrow as pa

        if not left.num_rows:
            kinds = {"long": pa.int64(), "binary": pa.binary()}
            return pa.table([pa.array([], kinds[x.split()[1]]) for x in schema.split(", ")], names=[x.split()[0] for x in schema.split(", ")])
        rows = rows_of(left)
        state, w = find(rows)
        start, count, anchor, kind = to_judge(w, told)
        gone = np.zeros(w.units, bool)
        first, bits = leads(kind), _bits(told, 3)
        for s, at in by_shard(shard_of(anchor[first], shards)):
            each = places_of(start[first[at]], count[first[at]])
            gone[each] = _unpacked(bits[s], len(each))

        def copies(start: np.ndarray, count: np.ndarray, kind: np.ndarray, first: np.ndarray) -> None:
            """Windows of segments that lie more than once in the batch: all go, or all but those of the first."""
            more = np.bincount(kind)[kind] > 1
            if first_stays:
                more[first] = False
            gone[places_of(start[more], count[more])] = True

        copies(start, count, kind, first)
        copies(w.start, w.count, w.kind, w.first)
        ids = pa.array(np.array(rows.column("id")), mask=np.array(rows.column("null")))
        return pa.table([ids, *settle(state, gone)], names=[x.split()[0] for x in schema.split(", ")])

    by_batch = dealt.groupBy("batch")
    one = by_batch.applyInArrow(asked, ASK).groupBy("shard").applyInArrow(answered, TOLD).withColumn("turn", F.lit(1))
    two = by_batch.cogroup(home(one).groupBy("batch")).applyInArrow(sent_hot, ASK).groupBy("shard").applyInArrow(judged_hot, TOLD).withColumn("turn", F.lit(2))
    told = one.unionByName(two)
    three = by_batch.cogroup(home(told).groupBy("batch")).applyInArrow(sent, ASK).groupBy("shard").applyInArrow(judged, TOLD).withColumn("turn", F.lit(3))
    return by_batch.cogroup(home(told.unionByName(three)).groupBy("batch")).applyInArrow(settled, schema)
