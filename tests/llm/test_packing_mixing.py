import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from vibespark.llm.mix import mix_sources, mixed_documents, permuted, shard_counts
from vibespark.llm.pack import TextCoder, default_tokenizer, pack, pack_documents, plan_bins, sequences, tokenize

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def level(sizes, cap=3.0):
    order = sorted((s for s in sizes if s is not None), key=lambda x: x.encode()) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    left, free, out = sum(sizes.values()), set(order), {}
    while True:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > cap * sizes[s] + 1e-9]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.discard(s)


def test_mix(docs):
    rows = docs.select("doc_id", "text", "source").collect()
    found, blocks = mix_sources(docs, block=8)
    got = found.collect()
    assert len(got) == len(rows)
    size = Counter()
    for r in rows:
        size[r.source] += len(WORD.findall(r.text or ""))
    want = level(size)
    assert Counter((r.id, r.source, r["size"]) for r in got) == Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in rows)
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 4 * 8 + 1
    again, _ = mix_sources(docs, block=8)
    assert sorted((r.id, r.taken) for r in again.collect()) == sorted((r.id, r.taken) for r in got)
    b = blocks.collect()
    at = defaultdict(list)
    for r in b:
        at[r.shard].append(r.position)
    assert all(len(set(p)) == len(p) and max(p) < len(p) + 4 for p in at.values())
    assert max(Counter((r.place, r.index) for r in b).values()) <= 3


def test_mixed_documents_carry_the_words_taken(docs):
    found, _ = mix_sources(docs, block=8)
    taken = Counter()
    for r in found.collect():
        taken[r.id] += r.taken
    out = mixed_documents(docs, block=8)
    assert out.columns == docs.columns
    words, text = Counter(), {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in out.collect():
        w = WORD.findall(r.text)
        words[r.doc_id] += len(w)
        assert not Counter(w) - Counter(WORD.findall(text[r.doc_id])) and r.n_chars == len(r.text)
    assert words == +taken


def test_mixed_documents_keep_null_ids(spark):
    rows = [(None if k % 3 == 0 else k, " ".join(f"w{k}_{j}" for j in range(30)), "s%d" % (k % 2)) for k in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found, _ = mix_sources(d, block=8)
    want = Counter()
    for r in found.collect():
        want[r.source] += r.taken
    got, ids = Counter(), defaultdict(set)
    for r in mixed_documents(d, block=8).collect():
        got[r.source] += len(r.text.split())
        ids[r.doc_id] |= {w.split("_")[0] for w in r.text.split()}
    assert len(ids[None]) > 1 and {w for w in ids[None]} <= {f"w{k}" for k in range(0, 60, 3)}
    targets = {r.source: r.target for r in found.select("source", "target").distinct().collect()}
    for s, t in targets.items():
        assert abs(got[s] - t) <= 4 * 8 + 1 and abs(want[s] - t) <= 4 * 8 + 1


def test_mixed_documents_tell_rows_of_one_id_apart(spark):
    rows = [(k // 2, " ".join(f"w{k}_{j}" for j in range(80 if k % 2 else 3)), "s%d" % (k // 2 % 2)) for k in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {(r.id, r["size"]): r.taken for r in mix_sources(d, block=8)[0].collect()}
    assert 0 in taken.values() and any(taken[k, 80] and not taken[k, 3] for k in range(30))
    words = Counter()
    for r in mixed_documents(d, block=8).collect():
        for w in r.text.split():
            words[w.split("_")[0]] += 1
    assert {k: words[f"w{k}"] for k in range(60)} == {k: taken[k // 2, 80 if k % 2 else 3] for k in range(60)}


def test_shard_counts_are_drawn(spark):
    wanted = [700.3, 150.9, 90.0, 0.4]
    d = spark.createDataFrame(list(enumerate(wanted)), "place long, wanted double")
    seen = []
    for seed in range(3):
        counts, shards = shard_counts(spark, d, 10, seed)
        assert shards == 94
        rows = counts.collect()
        per = defaultdict(Counter)
        for r in rows:
            per[r.shard][r.place] += r["count"]
            assert r["count"] >= wanted[r.place] // shards
        assert set(per) == set(range(shards)) and all(9 <= sum(c.values()) <= 11 for c in per.values())
        total = Counter()
        for c in per.values():
            total.update(c)
        # five deviations of the drawn remainder
        assert all(abs(total[k] - w) <= 5 * (shards * 0.25) ** 0.5 + 1 for k, w in enumerate(wanted))
        assert abs(sum(total.values()) - sum(wanted)) <= 2
        seen.append(sorted(map(tuple, rows)))
    assert len({str(x) for x in seen}) == 3
    again, _ = shard_counts(spark, d, 10, 2)
    assert sorted(map(tuple, again.collect())) == seen[2]


def test_mix_follows_the_drawn_counts(spark):
    rows = [(k, " ".join(f"w{k}_{j}" for j in range(40)), "s%d" % (k % 3)) for k in range(90)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found, blocks = mix_sources(d, block=8, shard_blocks=32)
    b = blocks.collect()
    drawn = Counter((r.shard, r.place) for r in b)
    assert len({r.shard for r in b}) > 10 and len(set(drawn.values())) > 3
    taken = Counter()
    for r in found.collect():
        taken[r.place] += r.taken
    of = Counter()
    for (_, place), n in drawn.items():
        of[place] += 8 * n
    assert taken == of  # 40 words are whole blocks
    order = {r.doc_id: k for k, r in enumerate(mixed_documents(d, block=8, shard_blocks=32).coalesce(1).collect())}
    assert list(order) != sorted(order)


def test_mix_without_words(no_docs, spark):
    assert mix_sources(no_docs)[0].count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mix_sources(blank)[0].collect()] == [(0, 0.0)] * 2


@pytest.mark.parametrize("n", [1, 2, 3, 17, 100])
def test_permutation(spark, n):
    from pyspark.sql import functions as F

    got = spark.range(n).select(permuted(F.col("id"), F.lit(n), F.lit(3)).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(n))


def test_pack_round_trip(docs):
    plain = Tokenizer.from_file(default_tokenizer())
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [0]
        texts[r.doc_id].append(ids)
    packed = pack(tokenize(docs, default_tokenizer(), max_tokens=256), 256)
    whole = {r.sequence_id: (np.frombuffer(r.ids, "<u4"), r.lengths) for r in sequences(packed).collect()}
    pieces = defaultdict(list)
    for r in packed.collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= 256 and (whole[r.sequence_id][0][r.offset : r.offset + r.length] == ids).all()
        assert r.piece == 0 or r.length == 256
        pieces[r.id].append((r.piece, r.start, ids.tolist()))
    for k, docs_of in texts.items():
        if len(docs_of) == 1:
            parts = sorted(pieces[k])
            assert sum((p[2] for p in parts), []) == docs_of[0]
            assert [p[1] for p in parts] == np.cumsum([0, *[len(p[2]) for p in parts[:-1]]]).tolist()
    total = sum(len(x) for x, _ in whole.values())
    assert all(len(x) == sum(n) <= 256 for x, n in whole.values()) and total == sum(len(i) for v in texts.values() for i in v)
    assert len(whole) <= -(-total // 256) * 1.05 + 1


def test_checksums(docs):
    got = sorted((r.doc_id, r.piece, r.ids_crc32) for r in pack_documents(docs).collect())
    plain, want = Tokenizer.from_file(default_tokenizer()), []
    for r in docs.select("doc_id", "text").collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        for k, lo in enumerate([0, *range(first, len(ids), 2048)]):
            want.append((r.doc_id, k, zlib.crc32(np.array(ids[lo : first if not k else lo + 2048], "<u4").tobytes())))
    assert got == sorted(want)


def test_pack_with_null_ids(spark):
    d = spark.createDataFrame([(None, "a b c"), (None, None), (1, "a b c"), (1, "a b c")], "doc_id long, text string")
    got = pack_documents(d).collect()
    assert sorted((str(r.doc_id), r.piece, r.start) for r in got) == [("1", 0, 0)] * 2 + [("None", 0, 0)] * 2
    assert len({(r.sequence_id, r.offset) for r in got}) == 4


def test_coder_equals_the_tokenizer():
    coder, plain = TextCoder(default_tokenizer()), Tokenizer.from_file(default_tokenizer())
    odd = ["", " ", "a  b", "\n\n x", "don't\u00a0stop", "\u3000\u3000a b", "<|endoftext|> x", "x\u0085 y", "1²³ ½", "日本語 テキスト", "a\x0b b", "tab\t\tx  ", "é" * 50, "🙂 ok", "\x00 \x1c a"]
    odd += ["a <|endoftext|> b <|endoftext|>", "x<|endoftext|>", "<|endoftext", "<|endoftext|><|endoftext|>"]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(["plain", *odd])] == [plain.encode(t, add_special_tokens=False).ids for t in ["plain", *odd]]
    assert plain.token_to_id("<|endoftext|>") in np.frombuffer(coder.encode(odd)[6], "<u4")
    assert coder.fast is not None


def check_plan(rows, counts, tokens, items, attention):
    bins = defaultdict(list)
    ranks = defaultdict(list)
    for length, lo, hi, seq, each, at in rows:
        ranks[length].append((lo, hi))
        for k in range(hi - lo):
            bins[seq + k // each].append((at + k % each * length, length))
    for length, n in counts.items():
        end = 0
        for lo, hi in sorted(ranks[length]):
            assert lo == end
            end = hi
        assert end == n
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= tokens and len(b) <= items and sum(n * n for _, n in b) <= attention
    return len(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("caps", [(100, 100, 10_000), (100, 3, 10_000), (100, 100, 2_600)])
def test_plan_keeps_every_capacity(rule, caps):
    rng = np.random.default_rng(4)
    for _ in range(20):
        counts = {int(k): int(n) for k, n in zip(rng.integers(1, 51, 20), rng.integers(1, 60, 20), strict=True)}
        n = check_plan(plan_bins(counts, *caps, rule=rule), counts, *caps)
        assert n >= -(-sum(k * v for k, v in counts.items()) // caps[0])


@pytest.mark.parametrize("limits", [(3, None), (None, 300.0)])
def test_pack_with_limits_that_bind(spark, limits):
    d = spark.createDataFrame([(k, 10) for k in range(40)], "id long, length long")
    bins = Counter(r.sequence_id for r in pack(d, 100, *limits).collect())
    assert sum(bins.values()) == 40 and max(bins.values()) == 3 and len(bins) == 14


def test_plan_refuses_what_cannot_fit():
    with pytest.raises(ValueError):
        plan_bins({101: 1}, 100, 10, 1e9)
    assert plan_bins({}, 100, 10, 1e9) == []


def test_pack_without_rows(no_docs):
    assert pack_documents(no_docs).count() == 0
