import random

import pytest

from vibespark.llm import anchors, phrases, suffix


@pytest.fixture(autouse=True)
def small_batches(monkeypatch):
    """Several batches and shards even for small tables."""
    monkeypatch.setattr(anchors, "BATCH_BYTES", 20_000)
    monkeypatch.setattr(anchors, "HOT_BATCHES", 3)
    monkeypatch.setattr(anchors, "BATCHES_PER_ASKED", 2)
    monkeypatch.setattr(phrases, "AUTOMATON_BYTES", 4_000)
    monkeypatch.setattr(suffix, "BATCH_BYTES", 20_000)
    monkeypatch.setattr(suffix, "ARRAY_BYTES", 10_000)


CLASHING = "id long, row string, bucket int, content string, n int, size int, batch int, digest string, keep int, member int, _row int, key double"


def make_docs(spark, seed=5, n=120, extra=True):
    """Documents with nulls, empty and blank texts, very long ones, exact and near copies, repeated rows and clashing columns."""
    r = random.Random(seed)
    vocab = ["w%d" % k for k in range(400)] + ["größe", "été", "a", "THE", "\u3000x", "b\u00a0c"]
    passage = [r.choice(vocab) for _ in range(70)]
    rows = []
    for k in range(n):
        words = [r.choice(vocab) for _ in range(r.choice([0, 1, 3, 19, 20, 21, 60, 150]))]
        if r.random() < 0.35:
            at = r.randrange(len(words) + 1)
            words[at:at] = passage[r.randrange(8) : 70 - r.randrange(8)]
        rows.append((k, " ".join(words)))
    base = rows[3][1] + " " + " ".join(r.choice(vocab) for _ in range(200))
    for k in range(n, n + 12):  # a family of near copies, some of them equal
        words = base.split()
        for _ in range(r.choice([0, 0, 1, 3])):
            words[r.randrange(len(words))] = r.choice(vocab)
        rows.append((k, " ".join(words)))
    rows += [(n + 20, None), (n + 21, ""), (n + 22, " \t\n"), (n + 23, "a  b\tc\n"), (n + 24, "a b c "), (n + 25, "x " * 3000), (n + 26, "x " * 2500), (n + 27, "ab" * 5000), (n + 28, rows[5][1])]
    rows += [rows[7], (n + 29, "A B C D e f"), (n + 30, "a b c d e f")]
    sources = ["s%d" % k for k in range(7)]
    full = [(k, t, r.choice(["en", "de"]), "hot" if r.random() < 0.33 else r.choice([*sources, None]), None if t is None else len(t)) for k, t in rows]
    d = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        d = d.selectExpr("*", *[f"cast(1 as {x.split()[1]}) as `{x.split()[0]}`" for x in CLASHING.split(", ")])
    return d


@pytest.fixture(scope="session")
def docs(spark):
    d = make_docs(spark).persist()
    d.count()
    return d


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def texts(docs):
    return sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
