"""Exact, near and repeated-text deduplication against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from vibespark.llm.exact import exact_dedup
from vibespark.llm.near import _common, components, near_duplicates
from vibespark.llm import phrases
from vibespark.llm.phrases import later_windows, repeated_phrases
from vibespark.llm.suffix import refined_buckets, repeated_strings

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def expected_exact(texts):
    groups = defaultdict(list)
    for k, t in texts:
        groups[SPACE.sub(" ", t)].append(k)
    return sorted((k, min(groups[c]), len(groups[c]), k == min(groups[c]), hashlib.sha256(c.encode()).hexdigest()) for k, t in texts for c in [SPACE.sub(" ", t)])


def test_exact(docs, texts):
    got = sorted(tuple(r) for r in exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == expected_exact(texts)


def test_exact_tells_contents_of_one_digest_apart(docs, texts):
    for digest in (lambda c: F.lit("all"), lambda c: F.length(c).cast("string")):
        got = sorted(tuple(r) for r in exact_dedup(docs, digest=digest).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
        assert got == expected_exact(texts)


def test_exact_null_ids_and_no_rows(spark, no_docs):
    d = spark.createDataFrame([(None, "a"), (None, "a"), (None, "b"), (3, "b")], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(d).collect()}
    assert got == {(None, None, 2, True), (None, 3, 2, False), (3, 3, 2, True)}
    assert exact_dedup(no_docs).count() == 0


def shingles(text, n=4):
    w = text.translate({k: k + 32 for k in range(65, 91)}).encode().split()
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def expected_near(texts, n=4):
    sets = [(k, shingles(t, n)) for k, t in texts]
    up = {k: k for k, _ in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            common = len(x & y)
            if common and 100 * common >= 80 * (len(x) + len(y) - common):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return sorted((k, len(s), root(k), k == root(k)) for k, s in sets)


def test_near(docs, texts):
    got = sorted(tuple(r) for r in near_duplicates(docs, width=4).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == expected_near(texts)


def test_near_compares_large_buckets_by_cells(spark, monkeypatch):
    import random

    from vibespark.llm import near

    monkeypatch.setattr(near, "LARGE_BUCKET", 3)
    monkeypatch.setattr(near, "BLOCK", 4)
    r = random.Random(1)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for k in range(60):  # copies of copies: similar, but many under the threshold of each other
        w = list(rows[r.randrange(len(rows))][1].split()) if rows and r.random() < 0.6 else list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(x) for x in near_duplicates(d, width=4).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == expected_near(rows)


def test_near_null_ids_and_no_rows(spark, no_docs):
    d = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (4, "a b c d e"), (5, "a b c d e")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(d).collect()), key=str)
    assert got == [(4, 4, True), (5, 4, False), (None, None, True), (None, None, True)]
    assert near_duplicates(no_docs).count() == 0


def test_components_of_a_long_path(spark):
    d = spark.range(60).selectExpr("id as a", "id + 1 as b").unionByName(spark.createDataFrame([(100, 101), (101, 101)], "a long, b long"))
    got = {r.id: r.component for r in components(d).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def test_common_counts():
    import numpy as np

    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 50, rng.integers(0, 40))) for _ in range(9)]
    got = _common(sets[:4], sets[4:])
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets[4:]] for x in sets[:4]]


def test_phrases(docs, texts):
    first, out = {}, []
    order = sorted(texts)
    for k, t in order:
        w = t.encode().split()
        gone = bytearray(len(w))
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in first:
                gone[i : i + 20] = b"\1" * 20
            first.setdefault(key, (k, i))
        out.append((k, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    got = sorted((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in repeated_phrases(docs).collect())
    assert got == sorted(out)


def test_strings(docs, texts):
    raw = [(k, t.encode()) for k, t in texts]
    seen = Counter(b[i : i + 400] for _, b in raw for i in range(len(b) - 399))
    out = []
    for k, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((k, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeated_strings(docs).collect())
    assert got == sorted(out)


def test_removers_with_one_id_on_many_rows(spark):
    rows = [(1, " ".join(f"w{(k * j) % 97}" for j in range(90))) for k in (1, 2, 3, 1, 2)] + [(None, "q " * 25)] * 3
    d = spark.createDataFrame(rows * 4, "doc_id long, text string")
    got = repeated_phrases(d).collect()
    assert len(got) == len(rows) * 4
    assert sum(r.n_removed == 0 for r in got if r.doc_id == 1) == 3  # one of each text
    assert sorted(r.n_removed for r in got if r.doc_id is None) == [24] + [25] * 11
    d = spark.createDataFrame([(1, "ab" * 250), (1, "ab" * 250), (1, "".join(f"u{k}" for k in range(300)))], "doc_id long, text string")
    assert sorted(r.n_removed for r in repeated_strings(d).collect()) == [0, 500, 500]


def test_automata_tell_windows_of_one_hash_apart(monkeypatch):
    import random

    import numpy as np

    r = random.Random(4)
    for clash in (False, True):
        if clash:
            monkeypatch.setattr(phrases, "_rolled", lambda h, width: np.arange(max(len(h) - width + 1, 0)).astype(np.uint64) % np.uint64(3))
        for _ in range(20):
            span = 3
            texts = [[r.randrange(3) for _ in range(r.randrange(span, 12))] for _ in range(8)]
            codes = np.array([w for t in texts for w in t])
            size = np.array([len(t) for t in texts])
            doc = np.array([r.randrange(4) for _ in texts])
            n = size - span + 1
            owner = np.repeat(np.arange(len(n)), n)
            start = np.concatenate([np.arange(k) for k in n])
            got = later_windows(codes, np.cumsum(size) - size, n, (doc[owner], start, owner), span)
            seen, expect = set(), {}
            for key in sorted(zip(doc[owner], start, owner, strict=True)):
                window = tuple(texts[key[2]][key[1] : key[1] + span])
                expect[key[2], key[1]] = window in seen
                seen.add(window)
            if not clash:
                assert got.tolist() == [expect[o, s] for o, s in zip(owner, start, strict=True)]
            else:  # windows that share no hash with an equal one can't meet; none may go wrongly
                assert not any(g and not expect[o, s] for g, o, s in zip(got, owner, start, strict=True))


def test_removers_without_rows_and_with_null_ids(spark, no_docs):
    assert repeated_phrases(no_docs).count() == repeated_strings(no_docs).count() == 0
    d = spark.createDataFrame([(None, "w " * 30), (2, "w " * 19 + "end")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in repeated_phrases(d).collect()}
    assert got == {None: 29, 2: 0}
    d = spark.createDataFrame([(None, "ab" * 300), (2, "ba" * 210)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in repeated_strings(d).collect()} == {None: 600, 2: 420}


def test_buckets_are_those_of_equal_strings():
    import numpy as np

    rng = np.random.default_rng(3)
    parts = [rng.integers(97, 99, rng.integers(1, 60)).astype(np.uint8) for _ in range(40)]
    text, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
    for span in (8, 9, 13, 16, 25):
        got = refined_buckets(text, ends, span)
        by, at = {}, 0
        for p in parts:
            for i in range(len(p)):
                key = p[i : i + span].tobytes()
                if len(key) == span:
                    assert by.setdefault(key, got[at]) == got[at]
                else:
                    assert got[at] == -1
                at += 1
        assert len(set(by.values())) == len(by)
