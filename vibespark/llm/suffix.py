"""Repeated byte strings by a suffix array with bucket-pointer refinement."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import by_shard, recurrence, segments
from .common import _BYTE, flat_bytes, mix64, powers

#: Bytes of the k-grams that anchor a window, and of the first buckets.
GRAM, FIRST = 48, 8
#: Bytes of text in a batch; batches to a shard; bytes of a suffix array, about.
BATCH_BYTES, BATCHES_PER_SHARD, ARRAY_BYTES = 3 << 20, 4, 3 << 20


def refined_buckets(text: np.ndarray, ends: np.ndarray, span: int) -> np.ndarray:
    """Bucket of every place of text by its next span bytes; -1 where they would pass the end of its string.

    text holds strings end to end, ends the end of each. The first buckets are those of equal q-grams. A bucket is
    refined by sorting its places on the bucket identifiers of the places q further on, which doubles q; the identifiers
    found replace the old ones in the array that the next refinement points into. A bucket of one place stays as it is
    and is sorted no more: whatever points at it is told apart by it.
    """
    n = len(text)
    if n >= 1 << 31:
        raise ValueError("a suffix array holds at most 2**31 - 1 bytes")
    room = np.repeat(ends, np.diff(np.concatenate([[0], ends]))).astype(np.int32) - np.arange(n, dtype=np.int32)
    bucket = np.full(n, -1, np.int32)
    if n < FIRST:
        return bucket
    gram = np.zeros(n - FIRST + 1, np.uint64)
    for k in range(FIRST):
        gram = (gram << np.uint64(8)) | text[k : n - FIRST + 1 + k]
    at = np.flatnonzero(room[: len(gram)] >= FIRST)
    order = at[np.argsort(gram[at])]
    fresh = np.ones(len(order), bool)
    fresh[1:] = gram[order][1:] != gram[order][:-1]
    head = np.flatnonzero(fresh)
    # a bucket's identifier is the rank of its first place, so a part of a bucket can take its own rank within it
    bucket[order] = np.repeat(head, np.diff(np.append(head, len(order))))
    q = FIRST
    while q < span:
        step = min(q, span - q)
        whole = room >= q + step
        size = np.bincount(bucket[bucket >= 0], minlength=n + 1)
        at = np.flatnonzero(whole & (bucket >= 0))
        at = at[size[bucket[at]] > 1]
        if len(at):
            pair = bucket[at].astype(np.int64) << 32 | bucket[at + step]
            order = np.argsort(pair)
            pair = pair[order]
            new_part = np.ones(len(order), bool)
            new_part[1:] = pair[1:] != pair[:-1]
            part = np.flatnonzero(new_part)
            mine = pair[part] >> 32
            # a part's rank in its bucket: from the first part of that bucket
            head = np.ones(len(part), bool)
            head[1:] = mine[1:] != mine[:-1]
            base = np.maximum.accumulate(np.where(head, part, 0))
            bucket[at[order]] = np.repeat((mine + part - base).astype(np.int32), np.diff(np.append(part, len(order))))
        bucket[~whole] = -1
        q += step
    return bucket


def repeated_windows(texts: list[bytes], span: int) -> list[np.ndarray]:
    """For each text, whether each of its windows of span bytes lies at another place of any text, by one suffix array
    over the distinct ones."""
    known: dict[bytes, int] = {}
    which = [known.setdefault(t, len(known)) for t in texts]
    copies = np.bincount(which, minlength=len(known))
    text = np.frombuffer(b"".join(known), np.uint8)
    size = np.fromiter(map(len, known), np.int64, len(known))
    ends = np.cumsum(size)
    bucket = refined_buckets(text, ends, span)
    whole = np.flatnonzero(bucket >= 0)
    mine = bucket[whole]
    total = np.bincount(mine, weights=np.repeat(copies, size)[whole], minlength=len(text) + 1)
    again = np.zeros(len(text), bool)
    again[whole] = total[mine] > 1
    parts = [again[lo : hi - span + 1] for lo, hi in zip((ends - size).tolist(), ends.tolist(), strict=True)]
    return [parts[k] for k in which]


def repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 400) -> DataFrame:
    """Removes each byte inside a string of ``span`` bytes that also starts anywhere else, in the same document or another.

    Only strings whose anchor recurs can recur (see anchors.py); their segments go to the anchor's shard, equal ones
    of a batch once. A shard joins its distinct segments to one text and sorts its suffixes by bucket-pointer refinement
    up to ``span`` bytes; a bucket of more than one place holds a repeated string. Hashes only rule strings out: every
    string that goes was found equal to another one byte by byte.

    Returns a row per input row: id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes).
    Texts are UTF-8 bytes; matches never cross rows. Null texts count as empty; null ids and repeated rows are rows
    like others, dealt to batches one by one. A text of any length is one row of one batch, so the longest text bounds
    a batch from below. No rows give no rows; other columns are ignored.
    """

    def find(rows):
        raw, at = flat_bytes(rows.column("text"))
        n = len(raw)
        length = np.diff(at)
        left = np.repeat(at[1:], length) - np.arange(n)
        # a range's hash is its sum of table[byte] * MUL**place over MUL**(its first place)
        power, back = powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * power, out=sums[1:])
        grams = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
        if n >= GRAM:
            inner = mix64((sums[GRAM:] - sums[:-GRAM]) * back[: n - GRAM + 1])
            grams[: n - GRAM + 1] = np.where(left[: n - GRAM + 1] >= GRAM, inner, grams[: n - GRAM + 1])
        data = raw.tobytes()

        def content(start, count):
            end = start + count + span - 1
            return mix64((sums[end] - sums[start]) * back[start] + count.astype(np.uint64))

        def same(a, b, count):
            return [data[x : x + c] == data[y : y + c] for x, y, c in zip(a.tolist(), b.tolist(), (count + span - 1).tolist(), strict=True)]

        def hashes(places):
            return mix64((sums[places + span] - sums[places]) * back[places])

        return (raw, at, data), segments(grams, left >= span, span - GRAM + 1, content, same, hashes)

    def send(state, start, count, anchor):
        data = state[2]
        head = np.concatenate([[len(start)], count, anchor.view(np.int64)]).astype(np.int64)
        return head.tobytes() + b"".join(data[a : a + c + span - 1] for a, c in zip(start.tolist(), count.tolist(), strict=True))

    def judge(blobs):
        texts, anchors, owner = [], [], []
        for k, b in enumerate(blobs):
            n = int(np.frombuffer(b, np.int64, 1)[0])
            count, anchor = np.frombuffer(b, np.int64, 2 * n, 8).reshape(2, n)
            at = 8 + 16 * n
            for c in count.tolist():
                texts.append(b[at : at + c + span - 1])
                at += c + span - 1
            anchors.append(anchor.view(np.uint64))
            owner += [k] * n
        # segments of one anchor meet; the anchors of a shard are taken in parts whose array stays small
        parts = max(1, -(-sum(map(len, texts)) // ARRAY_BYTES))
        part = (mix64(np.concatenate(anchors) ^ np.uint64(77)) % np.uint64(parts)).astype(np.int64)
        flags: list = [None] * len(texts)
        for _, mine in by_shard(part):
            for k, f in zip(mine.tolist(), repeated_windows([texts[k] for k in mine], span), strict=True):
                flags[k] = np.packbits(f), len(f)
        out: list[list] = [[] for _ in blobs]
        for k, (bits, n) in zip(owner, flags, strict=True):
            out[k].append(np.unpackbits(bits, count=n).astype(bool))
        return [np.concatenate(x) for x in out]

    def settle(state, gone):
        import pyarrow as pa

        raw, at, data = state
        starts = np.flatnonzero(gone)
        cover = np.zeros(len(raw) + 1, np.int32)
        cover[starts] += 1
        cover[starts + span] -= 1
        lost_byte = np.cumsum(cover[:-1]) > 0
        removed = np.concatenate([[0], np.cumsum(lost_byte)])
        first = lost_byte.copy()
        first[1:] &= ~lost_byte[:-1]
        edge = at[:-1][at[:-1] < len(raw)]
        first[edge] = lost_byte[edge]
        spans = np.concatenate([[0], np.cumsum(first)])
        lost = removed[at[1:]] - removed[at[:-1]]
        kept = [data[a:b] if not r else raw[a:b][~lost_byte[a:b]].tobytes() for a, b, r in zip(at.tolist(), at[1:].tolist(), lost.tolist(), strict=False)]
        return [pa.array(np.diff(at), pa.int64()), pa.array(lost, pa.int64()), pa.array(spans[at[1:]] - spans[at[:-1]], pa.int64()), pa.array(kept, pa.binary())]

    out = recurrence(docs, id_col, text_col, find, send, judge, settle, "id long, n_bytes long, n_removed long, n_spans long, kept binary", False, BATCH_BYTES, BATCHES_PER_SHARD)
    return out.withColumnRenamed("id", id_col)


def op5_suffix(spark, sf_dir: str) -> DataFrame:
    found = repeated_strings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
