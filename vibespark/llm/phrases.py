"""Repeated passages of words, located by sharded Aho-Corasick automata."""

from __future__ import annotations

from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import by_shard, places_of, recurrence, segments
from .common import flat_bytes, mix64, words

#: Words of the k-grams that anchor a window; bytes of text that meet one automaton, about.
GRAM, AUTOMATON_BYTES = 6, 2 << 20
_P = np.uint64(0xC2B2AE3D27D4EB4F)


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    acc = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for k in range(width):
        acc = acc * _P + h[k : k + len(acc)]
    return mix64(acc)


def _letters(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word as letters, and the word of each letter. A code above 2 is three letters of 64, from an alphabet for each
    place: the automaton looks for a letter among a node's children one by one, so nodes need few. Others are one."""
    plain = codes <= 2
    size = np.where(plain, 1, 3)
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), "<u4")
    out[at[plain]] = codes[plain]
    many, c = at[~plain], codes[~plain]
    out[many], out[many + 1], out[many + 2] = 0x20000 + (c >> 12), 0x100 + ((c >> 6) & 63), 0x200 + (c & 63)
    return out, np.repeat(np.arange(len(codes)), size)


def compile_passages(codes: np.ndarray, each: np.ndarray, joined: np.ndarray, span: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Recurring passages of segments: (first word, windows) of each, and which windows may recur.

    codes: words as numbers; each: the places of all windows; joined: whether the next window is the next word's, in the
    same segment. Windows that recur (by hash; the automaton looks at the words) and always stand together form a
    passage: as in a compacted de Bruijn graph, a passage ends where windows have different neighbours at different
    places. So each recurring window lies in one passage, at one place of it.
    """
    h = _rolled(codes.astype(np.uint64), span)[each] if len(each) else np.zeros(0, np.uint64)
    _, group, size = np.unique(h, return_inverse=True, return_counts=True)
    again = size[group] > 1 if len(each) else np.zeros(0, bool)
    nxt, prev = np.full(len(each), -1), np.full(len(each), -1)
    nxt[:-1] = np.where(joined[:-1], group[1:], -1)
    prev[1:] = np.where(joined[:-1], group[:-1], -1)
    order = np.argsort(group, kind="stable")
    edge = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(each) else order

    def only(neighbour: np.ndarray) -> np.ndarray:
        """Of each window's content, whether all its places have one and the same neighbour."""
        if not len(each):
            return again
        lo, hi = np.minimum.reduceat(neighbour[order], edge), np.maximum.reduceat(neighbour[order], edge)
        return ((lo == hi) & (lo >= 0))[group]

    tied = np.zeros(len(each), bool)  # to the window before
    tied[1:] = only(nxt)[:-1] & only(prev)[1:] & again[:-1] & again[1:]
    lead = np.flatnonzero(again & ~tied)
    last = np.concatenate([~tied[1:], [True]])[: len(each)]
    run = np.flatnonzero(again & last) - lead + 1
    _, once = np.unique(group[lead], return_index=True)
    return list(zip(each[lead[once]].tolist(), run[once].tolist(), strict=True)), again


def locate(codes: np.ndarray, passages: list[tuple[int, int]], stop_at: np.ndarray, span: int) -> np.ndarray:
    """Number of the passage window that starts at each place of codes, -1 for none: all occurrences, by an Aho-Corasick
    automaton over words as letters. No match passes a word that stop_at marks as the first of a segment."""
    import ahocorasick

    out = np.full(len(codes), -1)
    if not passages:
        return out
    place = np.arange(len(codes)) + np.cumsum(stop_at)  # a letter of no passage before each segment
    hay = np.ones(len(codes) + int(stop_at.sum()), np.int64)
    hay[place] = codes + 3
    letters, word = _letters(hay)
    back = np.full(len(hay), -1)
    back[place] = np.arange(len(codes))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, (at, n) in enumerate(passages):
        automaton.add_word(_letters(codes[at : at + n + span - 1] + 3)[0].tobytes().decode("utf-32-le"), k)
    automaton.make_automaton()
    found = np.fromiter(automaton.iter(letters.tobytes().decode("utf-32-le")), np.dtype((np.int64, 2)))
    if len(found):
        n = np.array([n for _, n in passages])
        base = np.cumsum(n) - n
        end, which = back[word[found[:, 0]]], found[:, 1]
        start = end - (n[which] + span - 1) + 1
        each = places_of(start, n[which])
        out[each] = places_of(base[which], n[which])
    return out


def later_windows(codes: np.ndarray, begin: np.ndarray, count: np.ndarray, rank: tuple[np.ndarray, ...], span: int) -> np.ndarray:
    """For each window of segments (first word, windows), whether an equal one has a lesser rank.

    rank: (document, start, tie) of each window, the first the most significant. Passages are compiled and all segments
    streamed through their automaton; windows that share a hash and not their words are left over by it, and are
    compiled anew by themselves until none is.
    """
    each = places_of(begin, count)
    owner = np.repeat(np.arange(len(begin)), count)
    stop_at = np.zeros(len(codes), bool)
    stop_at[begin] = True
    later = np.zeros(len(each), bool)
    left = np.arange(len(each))
    while len(left):
        joined = np.zeros(len(left), bool)
        joined[:-1] = (owner[left][1:] == owner[left][:-1]) & (each[left][1:] == each[left][:-1] + 1)
        passages, again = compile_passages(codes, each[left], joined, span)
        which = locate(codes, passages, stop_at, span)[each[left]]
        seen = np.flatnonzero(which >= 0)
        order = seen[np.lexsort((*(r[left][seen] for r in reversed(rank)), which[seen]))]
        same = which[order][1:] == which[order][:-1]
        later[left[order[1:][same]]] = True
        left = left[again & (which < 0)]
    return later


def repeated_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 20) -> DataFrame:
    """Removes each word inside a run of ``span`` words that also starts earlier (smaller id, or same row, earlier).

    Automata are sharded by passage: all places that may hold a recurring passage, of all documents, go to the shard of
    their anchors (see anchors.py), equal ones of a batch once. A shard confirms which passages recur, compiles its
    Aho-Corasick automata from them, over words as letters, and streams all that it was sent through them. The places
    found, of one passage each, are ordered, and all but the first go. Hashes only rule windows out: every window that
    goes was found equal to an earlier one word by word. A shard's automata are of bounded size each.

    Returns a row per input row: id, n_words, n_removed, kept (UTF-8, kept words joined by one space). Null texts count
    as empty; null ids are larger than any other. Of equal windows in rows that share an id, the one nearer its row's
    start stays, then the one of the row whose text has the lesser hash; of equal rows any one keeps its words. No rows
    give no rows; other columns are ignored.
    """

    def find(rows):
        raw, at = flat_bytes(rows.column("text"))
        h, begin, end, first = words(raw, at)
        n = np.diff(first)
        row = np.repeat(np.arange(len(n)), n)
        left = np.repeat(first[1:], n) - np.arange(len(h))  # words from here to the end of the document
        grams = np.full(len(h), np.uint64(0xFFFFFFFFFFFFFFFF))
        if len(h) >= GRAM:
            grams[: len(h) - GRAM + 1] = np.where(left[: len(h) - GRAM + 1] >= GRAM, _rolled(h, GRAM), grams[: len(h) - GRAM + 1])
        window = np.zeros(len(h), np.uint64)
        if len(h) >= span:
            window[: len(h) - span + 1] = _rolled(h * np.uint64(3) + np.uint64(1), span)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(window), dtype=np.uint64)])
        whole = np.concatenate([[np.uint64(0)], np.cumsum(mix64(h), dtype=np.uint64)])
        tie = whole[first[1:]] - whole[first[:-1]]
        data = raw.tobytes()

        def content(start, count):  # the hashes of its windows summed, with their number
            return mix64(sums[start + count] - sums[start] + window[start] * _P + count.astype(np.uint64))

        def text(start, count):
            return [data[a:b] for a, b in zip(begin[start].tolist(), end[start + count + span - 2].tolist(), strict=True)]

        def same(a, b, count):
            return [x == y or x.split() == y.split() for x, y in zip(text(a, count), text(b, count), strict=True)]

        return (rows, first, row, tie, text), segments(grams, left >= span, span - GRAM + 1, content, same, lambda places: window[places])

    def send(state, start, count, anchor):
        rows, first, row, tie, text = state
        mine = row[start]
        doc, parts = np.asarray(rows.column("id"))[mine].astype(np.int64), text(start, count)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        head = np.array([len(start)], np.int64)
        return b"".join([x.tobytes() for x in (head, doc, start - first[mine], tie[mine].view(np.int64), count, anchor.view(np.int64), size)] + parts)

    def judge(blobs):
        fields, texts = [], []
        for b in blobs:
            n = int(np.frombuffer(b, np.int64, 1)[0])
            fields.append(np.frombuffer(b, np.int64, 6 * n, 8).reshape(6, n))
            at = 8 + 48 * n
            for size in fields[-1][5].tolist():
                texts.append(b[at : at + size])
                at += size
        doc, start, tie, count, anchor, size = np.concatenate(fields, axis=1)
        parts = max(1, -(-int(size.sum()) // AUTOMATON_BYTES))
        part = (mix64(anchor.view(np.uint64) ^ np.uint64(77)) % np.uint64(parts)).astype(np.int64)
        ends = np.cumsum(count)
        later = np.zeros(int(count.sum()), bool)
        for _, mine in by_shard(part):
            known: dict[bytes, int] = {}
            codes = np.array([known.setdefault(w, len(known)) for w in b" ".join([texts[k] for k in mine]).split()], np.int64)
            n = count[mine]
            long = n + span - 1
            each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            rank = np.repeat(doc[mine], n), np.repeat(start[mine], n) + each, np.repeat(tie[mine], n)
            later[places_of(ends[mine] - n, n)] = later_windows(codes, np.cumsum(long) - long, n, rank, span)
        return np.split(later, np.cumsum([int(f[3].sum()) for f in fields])[:-1])

    def settle(state, gone):
        import pyarrow as pa

        rows, first = state[:2]
        cover = np.zeros(len(gone) + 1, np.int64)
        at = np.flatnonzero(gone)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + span, -1)
        keep = np.cumsum(cover[:-1]) == 0
        kept, removed = [], []
        for k, text in enumerate(rows.column("text").to_pylist()):
            stay = keep[first[k] : first[k + 1]]
            parts = text.encode().split()
            kept.append(b" ".join(parts if stay.all() else compress(parts, stay.tolist())))
            removed.append(int(len(stay) - stay.sum()))
        return [pa.array(np.diff(first), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())]

    out = recurrence(docs, id_col, text_col, find, send, judge, settle, "id long, n_words long, n_removed long, kept binary", True)
    return out.withColumnRenamed("id", id_col)


def op3_phrases(spark, sf_dir: str) -> DataFrame:
    found = repeated_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
