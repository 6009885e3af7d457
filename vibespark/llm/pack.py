"""Best-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_slices, spill

#: Fixed value: the published pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose class (letter, digit, white space, other) all regex engines agree on.
_PLAIN = re.compile(r"[\t\n\r -~\u00a1-\u024f]*")
_workers: dict = {}
#: Rows of a packing plan that are broadcast at most (40 bytes each).
MOST_SLOTS = 200_000


class TextCoder:
    """Ids of texts by the tokenizer at path, as it is: a special token written inside a text is that token.

    A byte-level BPE vocabulary numbered in the order of its merges is also loaded into tiktoken, which finds the same
    ids several times faster. It codes the texts of plain characters without added tokens; the tokenizer codes all
    others, and the first text of each worker as a check: should they differ there, the tokenizer codes everything.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast, self.checked = self._fast(), False

    def _fast(self):
        import tiktoken

        made = json.loads(self.tokenizer.to_str())
        vocab, merges = made["model"].get("vocab"), made["model"].get("merges")
        if made["model"].get("type") != "BPE" or made.get("normalizer") or (made.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or made["pre_tokenizer"].get("add_prefix_space"):
            return None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        if any(vocab.get(x + y) != 256 + k for k, (x, y) in enumerate(pairs)):
            return None
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the vocabulary writes as themselves
        hidden = [b for b in range(256) if b not in seen]
        byte = {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in token): k for token, k in vocab.items() if k < 256 + len(pairs)}
        return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def slow(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def quick(self, text: str) -> bytes:
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def is_plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not (self.added and self.added.search(text))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if self.fast and not self.checked:
            first = next((t for t in texts if t and self.is_plain(t)), None)
            if first is not None:
                self.checked = True
                if self.slow([first]) != [self.quick(first)]:
                    self.fast = None
        if not self.fast:
            return self.slow(texts)
        plain = [self.is_plain(t) for t in texts]
        rest = iter(self.slow([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [self.quick(t) if p else next(rest) for t, p in zip(texts, plain, strict=True)]


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of at most max_tokens ids: (id, piece, start, length, ids as little-endian 32-bit values).

    A document is its ids, then end_id. Only a longer document is cut, into pieces of max_tokens; its first piece takes
    what is left over. A null or empty text is end_id alone. Each row gives its pieces, repeated rows too.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        coder = _workers.get(path) or _workers.setdefault(path, TextCoder(path))
        end = np.array([end_id], "<u4").tobytes()
        for batch in arrow_slices(batches, "text"):
            ids, out = batch.column("id").to_pylist(), []
            for doc, found in zip(ids, coder.encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                found += end
                n = len(found) // 4
                first = n % max_tokens if n > max_tokens and n % max_tokens else min(n, max_tokens)
                edges = [0, *range(first, n + 1, max_tokens)]
                out += [(doc, k, lo, hi - lo, found[4 * lo : 4 * hi]) for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary())], ["id", "piece", "start", "length", "ids"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "id long, piece int, start long, length long, ids binary")


def plan_bins(counts: dict[int, int], max_tokens: int, max_docs: int, max_attention: float, rule: str = "norm", weights=(1.0, 1.0, 1.0)) -> list[tuple]:
    """Vector best-fit decreasing over length classes: (length, lo, hi, sequence, each, offset) rows.

    Items of one length are alike in all three capacities (tokens, documents, attention cost = length squared), so bins
    of equal content are held as one type with a range of sequence numbers. A class goes, longest first, to the open
    type that fits it under every constraint and has the least weighted residual norm after it (rule "norm") or the
    largest weighted dot-product of demand and residual (rule "dot"), as many items to a bin as fit. Items lo..hi-1 of
    a length, by rank, go ``each`` to a sequence from ``sequence`` on, from ``offset`` on. Work and result are bounded
    by the number of lengths, not of items.
    """
    if rule not in ("norm", "dot"):
        raise ValueError("rule is norm or dot")
    if any(n > max_tokens or n * n > max_attention for n in counts) or max_docs < 1:
        raise ValueError("an item exceeds the capacity of an empty sequence")
    full = np.array([max_tokens, max_docs, max_attention], float)
    w = np.array(weights, float)
    rows: list[tuple] = []
    left = np.empty((0, 3))  # residual capacities of the open types
    where: list[tuple[int, int]] = []  # first sequence and number of sequences of each
    used = 0
    smallest = min(counts, default=0)
    for length in sorted(counts, reverse=True):
        n, done = counts[length], 0
        need = np.array([length, 1, length * length], float)
        while done < n:
            fits = (left >= need).all(axis=1) if len(where) else np.zeros(0, bool)
            if fits.any():
                if rule == "norm":
                    score = -((((left - need) / full) ** 2) * w).sum(axis=1)
                else:
                    score = ((left / full) * (need / full) * w).sum(axis=1)
                k = int(np.where(fits, score, -np.inf).argmax())
                room, (seq, many) = left[k], where.pop(k)
                left = np.delete(left, k, axis=0)
            else:
                room, seq, many = full, used, n
            each = int((room // np.where(need > 0, need, 1)).min()) if length else int(room[1])
            bins, rest = divmod(n - done, each)
            if bins >= many:
                bins, rest = many, 0
            offset = int(max_tokens - room[0])
            groups = [(bins, each)] if bins else []
            if rest:
                groups.append((1, rest))
            at = seq
            for number, per in groups:
                rows.append((length, done, done + number * per, at, per, offset))
                done += number * per
                after = room - per * need
                if after[0] >= smallest and after[1] >= 1:
                    left, where = np.vstack([left, after]), [*where, (at, number)]
                at += number
            if room is full:
                used = at
            elif at < seq + many:
                left, where = np.vstack([left, room]), [*where, (at, seq + many - at)]
    return rows


def pack(pieces: DataFrame, max_tokens: int = 2048, max_docs: int | None = None, max_attention: float | None = None, rule: str = "norm", weights=(1.0, 1.0, 1.0)) -> DataFrame:
    """Adds sequence_id and offset to pieces, which have a column ``length``.

    Every piece lies whole in one sequence, gapless from offset 0; sequences hold at most max_tokens tokens, max_docs
    pieces and max_attention sum of squared lengths (None: what max_tokens implies). Only the counts per length, at
    most max_tokens rows, reach the driver, and the plan made of them, a few rows per length, is broadcast up to
    MOST_SLOTS rows. Ranks within a length come from running sums over hashed buckets, so a
    length that any share of the pieces has is spread out. Other columns stay; no pieces give no rows.
    """
    spark = pieces.sparkSession
    kept = spill(pieces.withColumn("_row", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in kept.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = plan_bins(counts, max_tokens, max_docs or max(max_tokens, 1), max_attention or float(max_tokens) ** 2, rule, weights)
    slots: dict[int, list] = {}
    for length, *slot in rows:
        slots.setdefault(length, []).append(tuple(slot))
    kind = "length long, slots array<struct<lo: long, hi: long, seq: long, each: long, at: long>>"
    table = spark.createDataFrame(list(slots.items()), kind)
    table = F.broadcast(table) if len(rows) <= MOST_SLOTS else table.hint("merge")
    buckets = max(1, sum(counts.values()) // 2_000)
    d = kept.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    sums = d.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "_bucket", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy("_row")
    d = d.withColumn("_rank", F.row_number().over(inside) - 1).join(sums, ["length", "_bucket"])
    d = d.withColumn("_rank", F.col("_rank") + F.col("_before")).join(table, "length")
    d = d.withColumn("_slot", F.filter("slots", lambda s: (s["lo"] <= F.col("_rank")) & (F.col("_rank") < s["hi"]))[0])
    nth = F.col("_rank") - F.col("_slot.lo")
    return d.withColumns(
        {
            "sequence_id": F.col("_slot.seq") + F.floor(nth / F.col("_slot.each")),
            "offset": F.col("_slot.at") + F.pmod(nth, F.col("_slot.each")) * F.col("length"),
        }
    ).select(*pieces.columns, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces with ids as whole sequences: (sequence_id, ids binary, lengths); a sequence is of bounded size."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", F.col("ids").alias("raw"))))
    whole = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    joined = F.aggregate("parts", F.unhex(F.lit("")), lambda a, p: F.concat(a, p["raw"]))
    return whole.select("sequence_id", joined.alias("ids"), F.transform("parts", lambda p: p["length"]).alias("lengths"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_documents(docs: DataFrame, path: str | None = None, max_tokens: int = 2048) -> DataFrame:
    """Tokenises and packs docs, with a checksum of each piece's ids in place of the ids."""
    pieces = tokenize(docs, path or default_tokenizer(), max_tokens=max_tokens)
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids").withColumnRenamed("id", "doc_id")
    return pack(pieces, max_tokens)


def op8_pack(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
