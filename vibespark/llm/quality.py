"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, arrow_slices, flat_bytes, mix64, spill, words

#: Bytes of a gram and buckets they are hashed to; pairs of neighbours in a repeat gram.
GRAM, BUCKETS, REPEATS = 4, 1 << 18, 3
#: Counts of one slice of the tables when they are added up.
SLICE = 1 << 14


@dataclass(frozen=True)
class QualityOptions:
    """labelled: labelled rows used at most, half to fit the target and half to choose the cut; smoothing: added to each
    count; neutral: log ratios nearer 0 than this count as 0, so that shares of languages do not matter; prior: grams of average text that a short text is mixed with; scale: grams
    of the text whose importance weight is given, few enough that the Gumbel noise decides near the cut; temperature: of the Gumbel noise; clean_cost: what losing a share of clean labelled rows costs
    against keeping the same share of the others; seed."""

    labelled: int = 20_000
    smoothing: float = 1.0
    neutral: float = 0.3
    prior: float = 100.0
    scale: float = 100.0
    temperature: float = 1.0
    clean_cost: float = 10.0
    seed: int = 17


def grams_of(texts) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Buckets and text numbers of the byte grams (A-Z lower-cased), and of the repeat grams: whether each of some
    consecutive words equals the word before it."""
    raw, at = flat_bytes(texts)
    low = _LOWER.astype(np.uint8)[raw]
    h = np.zeros(max(len(low) - GRAM + 1, 0), np.uint64)
    for k in range(GRAM):
        h = (h << np.uint64(8)) | low[k : k + len(h)]
    text = np.repeat(np.arange(len(texts)), np.diff(at))
    whole = text[: len(h)] == text[len(text) - len(h) :]
    letters = (mix64(h[whole]) % np.uint64(BUCKETS)).astype(np.int64), text[: len(h)][whole]
    w, _, _, first = words(raw, at, True)
    of = np.repeat(np.arange(len(texts)), np.diff(first))
    same = np.zeros(len(w), np.int64)
    same[1:] = (w[1:] == w[:-1]) & (of[1:] == of[:-1])
    n = max(len(w) - REPEATS, 0)
    marks = np.zeros(n, np.int64)
    for k in range(1, REPEATS + 1):
        marks = 2 * marks + same[k : k + n]
    inside = of[:n] == of[len(w) - n :]
    return letters, (marks[inside], of[:n][inside])


def count_grams(docs: DataFrame, clean_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts over all rows (id, text), and over the rows whose id is in the sorted clean_ids, of both kinds of grams.

    A task adds up its own tables; the slices of the tables, whose number is fixed, are added up in parallel.
    """
    size = BUCKETS + (1 << REPEATS)
    wanted = docs.sparkSession.sparkContext.broadcast(clean_ids)

    def local(batches) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        table = np.zeros((2, size), np.int64)
        for batch in arrow_slices(batches, "text"):
            ids = pc.fill_null(batch.column("id"), 0).to_numpy(zero_copy_only=False)
            mine = np.isin(ids, wanted.value) & pc.is_valid(batch.column("id")).to_numpy(zero_copy_only=False)
            for (g, of), base in zip(grams_of(pc.fill_null(batch.column("text"), "")), (0, BUCKETS), strict=True):
                top = BUCKETS if base == 0 else 1 << REPEATS
                table[0, base : base + top] += np.bincount(g, minlength=top)
                table[1, base : base + top] += np.bincount(g[mine[of]], minlength=top)
        parts = [(k, np.ascontiguousarray(table[:, k * SLICE : (k + 1) * SLICE]).tobytes()) for k in range(-(-size // SLICE))]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], ["slice", "counts"])

    def added(table):
        import pyarrow as pa

        total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table([pa.array([table.column("slice")[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "counts"])

    parts = docs.mapInArrow(local, "slice int, counts binary").groupBy("slice").applyInArrow(added, "slice int, counts binary").collect()
    rows = [np.frombuffer(r["counts"], np.int64).reshape(2, -1) for r in sorted(parts, key=lambda r: r["slice"])]
    whole = np.concatenate(rows, axis=1) if rows else np.zeros((2, size), np.int64)
    return whole[0], whole[1]


def log_ratios(raw: np.ndarray, target: np.ndarray, smoothing: float, neutral: float = 0.0) -> np.ndarray:
    """log of target over raw probability of each gram, less its mean over target text, for both kinds of grams."""
    out = []
    for part in (slice(0, BUCKETS), slice(BUCKETS, None)):
        r, t = raw[part] + smoothing, target[part] + smoothing
        ratio = np.log(t / t.sum()) - np.log(r / r.sum())
        out.append(ratio - (ratio * target[part]).sum() / max(target[part].sum(), 1))
    every = np.concatenate(out)
    return np.where(np.abs(every) < neutral, 0.0, every)


def weights(column, texts, ratios: np.ndarray, o: QualityOptions) -> tuple[np.ndarray, np.ndarray]:
    """Log importance weight of each text, and its Gumbel key; the noise is the id's, of a null id the text's."""
    import pyarrow as pa
    import pyarrow.compute as pc

    n = len(column)
    ids = pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False).view(np.uint64)
    if column.null_count:
        own = np.array([zlib.crc32(t.as_buffer() or b"") | 1 << 63 for t in texts.cast(pa.binary())], np.uint64)
        ids = np.where(pc.is_null(column).to_numpy(zero_copy_only=False), own, ids)
    weight = np.zeros(n)
    for (g, of), base in zip(grams_of(texts), (0, BUCKETS), strict=True):
        prior = o.prior if base == 0 else o.prior / 10
        weight += np.bincount(of, weights=ratios[base + g], minlength=n) / (np.bincount(of, minlength=n) + prior)
    weight = np.round(o.scale * weight, 6)
    u = (mix64(ids ^ mix64(np.array([o.seed], np.uint64))) >> np.uint64(11)).astype(np.float64)
    gumbel = -np.log(-np.log((u + 0.5) / 2.0**53))
    return weight, weight + o.temperature * gumbel


class QualityModel:
    """Fitted log ratios and the key of the last row that is kept."""

    def __init__(self, ratios: np.ndarray, options: QualityOptions):
        self.ratios, self.options, self.cut = ratios, options, -np.inf

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, weight, key) of every row."""
        shared, o = docs.sparkSession.sparkContext.broadcast(self.ratios), self.options

        def run(batches) -> Iterator:
            import pyarrow as pa
            import pyarrow.compute as pc

            for batch in arrow_slices(batches, "text"):
                w, key = weights(batch.column("id"), pc.fill_null(batch.column("text"), ""), shared.value, o)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(w), pa.array(key)], ["id", "weight", "key"])

        return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, weight double, key double")

    def keep(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The rows of docs, with all their columns, whose key reaches the cut."""
        shared, o, cut = docs.sparkSession.sparkContext.broadcast(self.ratios), self.options, self.cut

        def run(batches) -> Iterator:
            import pyarrow as pa
            import pyarrow.compute as pc

            for batch in arrow_slices(batches, text_col):
                _, key = weights(batch.column(id_col), pc.fill_null(batch.column(text_col), ""), shared.value, o)
                yield batch.filter(pa.array(key >= cut))

        return docs.mapInArrow(run, docs.schema)


def _kth_largest(keys: DataFrame, k: int, least: float, most: float) -> float:
    """The k-th largest of column key, by histograms of a fixed number of bins, each over the bin before that holds it.

    What reaches the driver is a histogram, or in the end the rows of a small bin, or the counts of the few numbers that
    lie in a bin too narrow to divide.
    """
    bins, few, lo, hi = 4096, 10_000, least, most
    while True:
        here = keys.filter((F.col("key") >= lo) & (F.col("key") <= hi))
        step = (hi - lo) / bins
        narrow = lo + step == lo or hi - step == hi
        if not narrow and here.limit(few + 1).count() <= few:
            return sorted((r["key"] for r in here.collect()), reverse=True)[k - 1]
        at = F.col("key") if narrow else F.least(F.floor((F.col("key") - lo) / step), F.lit(bins - 1))
        counts = here.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        for r in sorted(counts, key=lambda r: r["bin"], reverse=True):
            if k <= r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]
        if narrow or lo == hi:
            return lo


def fit_quality(docs: DataFrame, labels: DataFrame, options: QualityOptions | None = None, id_col: str = "doc_id", text_col: str = "text", k: int | None = None) -> tuple[QualityModel, DataFrame]:
    """Fits target and raw models, scores all rows and finds the cut of the Gumbel top-k: (model, scores).

    Target text is that of rows labelled quality 1 and not toxic; raw text is every row. A text's log importance weight
    is the mean log ratio of its grams, less the mean of target text, times options.scale. Each row's key is its weight
    and its own Gumbel noise, and the k rows of the largest keys are drawn, a sample without replacement in proportion
    to the weights' powers. k, if not given, is the number of rows whose weight reaches the cut that best parts the
    labelled rows not used for fitting (shares of clean rows kept count clean_cost times; of equal cuts the lowest). Rows tied with
    the k-th key are all drawn. Without labelled rows of both kinds everything is kept.

    scores: id, weight, key, kept for each row of docs. Null texts count as empty, which weighs as average target text;
    null ids have no label and the noise of their text; a null quality is no label, a null toxic is 0; an id with several labels is clean only if
    all are. No rows give no rows; other columns are ignored.
    """
    o = options or QualityOptions()
    good = F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0))
    known = labels.filter("quality IS NOT NULL").groupBy(F.col(id_col).cast("long").alias("id")).agg(good.alias("clean"))
    chosen = known.orderBy(F.xxhash64("id", F.lit(o.seed)), "id").limit(o.labelled).collect()
    half = [int(mix64(np.array([r["id"]], np.int64).view(np.uint64))[0] & np.uint64(1)) for r in chosen]
    fit = np.array(sorted(r["id"] for r, s in zip(chosen, half, strict=True) if s == 0 and r["clean"]), np.int64)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    raw, target = count_grams(rows, fit)
    model = QualityModel(log_ratios(raw, target, o.smoothing, o.neutral), o)
    scores = spill(model.score(docs, id_col, text_col))
    held = docs.sparkSession.createDataFrame([(r["id"], bool(r["clean"])) for r, s in zip(chosen, half, strict=True) if s == 1], "id long, clean boolean")
    seen = scores.join(F.broadcast(held), "id").select("key", "clean").limit(2 * o.labelled).collect() if len(chosen) else []
    good, bad = (np.sort([r["key"] for r in seen if r["clean"] == c]) for c in (True, False))
    if len(fit) and len(good) and len(bad) or k is not None:
        if k is None:
            cuts = np.unique(np.concatenate([good, bad]))
            gain = o.clean_cost * (len(good) - np.searchsorted(good, cuts)) / len(good) - (len(bad) - np.searchsorted(bad, cuts)) / len(bad)
            best = int(gain.argmax())
            cut = (cuts[best] + cuts[best - 1]) / 2 if best else cuts[0]  # midway to the next labelled row below
            k = scores.filter(F.col("key") >= float(cut)).count()
        edge = scores.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n")).first()
        model.cut = np.inf if k < 1 else -np.inf if k >= edge["n"] else _kth_largest(scores.select("key"), k, edge["lo"], edge["hi"])
    return model, scores.withColumn("kept", F.col("key") >= F.lit(float(model.cut)))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """The rows of documents that the resampling draws."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    _, scores = fit_quality(docs, labels)
    return scores.filter("kept").select(F.col("id").alias("doc_id"), "weight", "key", "kept")
