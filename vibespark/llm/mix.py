"""Mixing sources to target weights (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_spilled, spill, text_of, word_count

#: Rounds of the index permutations.
ROUNDS = 12
#: Rows of one bucket of the running sums, about.
BUCKET_ROWS = 2_000
#: Shards whose counts are summed up together.
CHUNK = 4_096


def permuted(index: Column, size: Column, *key: Column) -> Column:
    """index moved by a keyed pseudorandom permutation of 0..size-1: swap-or-not rounds, exact for every size."""

    def turn(x: Column, r: Column) -> Column:
        other = F.pmod(F.xxhash64(*key, r) - x, size)
        return F.when(F.xxhash64(*key, r, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, turn)


def source_targets(sized: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Target size of each source: (source, source_size, target, place).

    Sources by code point, null last, take the weights in turn and share the sum of all sizes. A target stops at cap
    times its source's size; the excess is shared again by weight. That sharing ends where every source below its cap
    has the same target per weight, so the level is found directly: sources by cap per weight, running sums of caps.
    The windows run over one row per source.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    all_rows = Window.partitionBy()
    given = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("place", (F.row_number().over(everything) - 1).cast("long"))
    s = s.withColumn("weight", F.element_at(given, (F.pmod("place", F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("total", F.sum("source_size").over(all_rows).cast("double")).withColumn("most", F.lit(cap) * F.col("source_size"))
    before = Window.orderBy(F.col("most") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(F.col("most") / F.col("weight"), "place").rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    s = s.withColumns({"level": level, "rank": F.row_number().over(Window.orderBy(F.col("most") / F.col("weight"), "place"))})
    # the first source in that order whose cap is not below the level sets it
    fits = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct("rank", "level"))
    s = s.withColumn("held", F.min(fits).over(all_rows)["level"])
    target = F.least(F.col("most"), F.coalesce(F.col("held") * F.col("weight"), F.col("most")))
    return s.select("source", "source_size", target.alias("target"), "place")


def _running(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """sized with place (of its source), source totals and start (words of the source before this document).

    A source's stream runs by hashed bucket, then id: buckets are summed apart, so that one source with any share of
    all rows is spread over all buckets. Null ids are spread by their row.
    """
    buckets = max(1, -(-sized.count() // BUCKET_ROWS))
    d = sized.join(targets, sized.source.eqNullSafe(targets.source)).drop(targets.source)
    d = d.withColumn("bucket", F.pmod(F.when(F.col("id").isNull(), F.xxhash64("row")).otherwise(F.xxhash64("id")), F.lit(buckets)))
    sums = d.groupBy("place", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("place", "bucket", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("bucket_start"))
    inside = Window.partitionBy("place", "bucket").orderBy("id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return d.join(sums, ["place", "bucket"]).withColumn("start", F.col("start") + F.col("bucket_start")).drop("bucket_start", "bucket")


def shard_counts(spark, sources: DataFrame, shard_blocks: int, seed: int) -> tuple[DataFrame, int]:
    """How many blocks of each source an output shard takes: (shard, place, count), and the number of shards.

    sources: (place, wanted), the blocks that each source should give in all. A shard's counts are a multinomial draw
    with the sources' shares, drawn by residual resampling: the whole part of a source's expected count is its own, and
    the rest of the shard is drawn from the sources in proportion to their fractions, each draw by its own hash. So
    every shard is drawn by itself, has its expected make-up to within a block of each source and a few draws, and the
    deviation of the sums grows as the root of the number of shards. A draw finds its source through a guide table: the
    sources' intervals cut into as many cells as there are sources, joined by cell.
    """
    wanted = sources.agg(F.sum("wanted").alias("w"), F.count(F.lit(1)).alias("n")).first()
    if not wanted["n"]:
        return spark.createDataFrame([], "shard long, place long, count long"), 0
    shards, cells = max(1, round(wanted["w"] / shard_blocks)), wanted["n"]
    s = sources.withColumn("expected", F.col("wanted") / shards).withColumn("whole", F.floor("expected"))
    s = s.withColumn("hi", F.sum(F.col("expected") - F.col("whole")).over(Window.orderBy("place")))
    s = s.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("place")), F.lit(0.0)))
    rest = s.agg(F.max("hi")).first()[0]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = spark.range(-(-shards // CHUNK)).withColumnRenamed("id", "chunk").repartition(parts, "chunk")
    every = chunks.select(F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.lit(shards)) - 1)).alias("shard"))
    some = s.filter("whole > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-shards // CHUNK) - 1).cast("long"))))
    # a number of its own: the planner would otherwise join these few rows into one task before they grow
    some = some.repartition(parts, "place", "chunk")
    own = some.select(F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.lit(shards)) - 1)).alias("shard"), "place", F.col("whole").alias("count"))
    if rest > 1e-9:
        # the draws of a shard: fractions add up over the shards
        draws = F.floor((F.col("shard") + 1) * rest + 1e-9) - F.floor(F.col("shard") * rest + 1e-9)
        drawn = every.withColumn("draws", draws).filter("draws > 0").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("draws") - 1)).alias("draw"))
        unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("source"), "shard", "draw"), 12) / F.lit(float(1 << 52))
        cell = lambda x: F.floor(x / F.lit(rest) * cells)
        drawn = drawn.withColumn("u", unit * F.lit(rest)).withColumn("cell", cell(F.col("u")))
        guide = s.filter("hi > lo").select("place", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
        drawn = drawn.join(guide, "cell").filter("lo <= u AND u < hi").select("shard", "place", F.lit(1).cast("long").alias("count"))
        own = own.unionByName(drawn)
    return own.groupBy("shard", "place").agg(F.sum("count").alias("count")), shards


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3),
    cap: float = 3.0, block: int = 64, shard_blocks: int = 1_024, seed: int = 1, row_col: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Mixes sources to target weights. Returns (documents, blocks).

    The words of a source form one stream, packed into blocks of ``block`` words (the last may be shorter). Each output
    shard of about ``shard_blocks`` blocks draws multinomial counts of the sources (see shard_counts). The slots that a
    source got, numbered from shard to shard, go in epochs of its number of blocks through the source's own
    pseudorandom permutation of block indexes, and blocks meet documents by block index. A slot beyond cap times the
    source's blocks stays empty. Within its shard, a slot's position is pseudorandom too.

    documents: row (one per input row; row_col, if named, holds a whole number of its own for each), id, source, size,
    source_size, target, taken, and start, place (of the source).
    blocks: shard, position (in the mixed output), place, epoch, index (block of the source's stream).
    A block is taken at most ceil(cap) times, so no document exceeds cap times its size (cap a whole number). Equal
    input and seed give equal results. Null or blank texts have size 0 and are taken 0 times; null sources form one
    source, the last; null and repeated ids and repeated rows are separate documents; among rows alike in id and size
    any order may hold; an empty table gives empty results. Sources are few: windows over one row per source run in one task.
    """
    spark = docs.sparkSession
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    sized = spill(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_of(text_col)).alias("size"), row.alias("row"))
    )
    targets = spill(source_targets(sized, weights, cap))
    length = F.lit(block)
    n_blocks = F.ceil(F.col("source_size") / length).cast("long")
    sources = targets.filter("source_size > 0").select("place", n_blocks.alias("n"), (F.col("target") / F.col("source_size") * n_blocks).alias("wanted"))
    counts, _ = shard_counts(spark, sources, shard_blocks, seed)
    counts = spill(counts.withColumn("chunk", F.floor(F.col("shard") / CHUNK)))
    sums = counts.groupBy("place", "chunk").agg(F.sum("count").alias("n_chunk"))
    ahead = lambda *by: Window.partitionBy(*by)
    before = Window.unboundedPreceding, -1
    sums = sums.select("place", "chunk", F.coalesce(F.sum("n_chunk").over(ahead("place").orderBy("chunk").rowsBetween(*before)), F.lit(0)).alias("first"))
    made = counts.withColumns({
        "first_here": F.coalesce(F.sum("count").over(ahead("place", "chunk").orderBy("shard").rowsBetween(*before)), F.lit(0)),
    }).join(sums, ["place", "chunk"])
    made = made.withColumns({
        "lead": F.coalesce(F.sum("count").over(ahead("shard").orderBy("place").rowsBetween(*before)), F.lit(0)),
        "filled": F.sum("count").over(ahead("shard")),
    }).join(F.broadcast(sources), "place")
    slots = made.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
    slots = slots.withColumn("slot", F.col("first") + F.col("first_here") + F.col("k")).filter(F.col("slot") < F.floor(F.lit(cap) * F.col("n")))
    epoch = F.floor(F.col("slot") / F.col("n"))
    blocks = slots.select(
        "shard", permuted(F.col("lead") + F.col("k"), F.col("filled"), F.lit(seed), F.lit("position"), F.col("shard")).alias("position"), "place", epoch.alias("epoch"),
        permuted(F.pmod("slot", F.col("n")), F.col("n"), F.lit(seed), F.col("place"), epoch).alias("index"),
    )
    at = spill(_running(sized, targets))
    drop_spilled(sized)
    last = F.floor((F.col("start") + F.col("size") - 1) / length)
    parts = at.filter("size > 0").select("row", "place", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / length), last)).alias("index"))
    inside = F.least(F.col("start") + F.col("size"), (F.col("index") + 1) * length) - F.greatest("start", F.col("index") * length)
    times = blocks.groupBy("place", "index").agg(F.count(F.lit(1)).alias("times"))
    # both sides grow with the data, though their estimates, made from the sources table, look small
    taken = parts.join(times.hint("merge"), ["place", "index"]).groupBy("row").agg(F.sum(inside * F.col("times")).alias("taken"))
    documents = at.join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return documents, blocks


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of docs: each epoch that takes words of a document gives a row of it with the words taken.

    A document whose words are all taken in an epoch keeps its text unchanged; of others, the taken words stay, in
    order, joined by one space. n_chars, where docs has it as a column, follows the text. A row stands in the output
    shard and at the place of the first of its blocks there: a partition holds whole shards, one after the other. A
    document that no epoch takes gives no row. Rows are documents of their own, whether their id is null or repeats.
    No rows give no rows; other columns stay as they are.
    """
    block = options.get("block", 64)
    text_col = options.get("text_col", "text")
    # stored once with the text, as row numbers of another scan need not agree, and ids may be null or repeated
    kept = spill(docs.withColumn("_mix_row", F.monotonically_increasing_id()))
    found, blocks = mix_sources(kept, **options, row_col="_mix_row")
    length = F.lit(block)
    d = found.filter("size > 0")
    last = F.floor((F.col("start") + F.col("size") - 1) / length)
    parts = d.select("row", "place", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / length), last)).alias("index"))
    lo = F.greatest(F.col("start"), F.col("index") * length) - F.col("start")
    hi = F.least(F.col("start") + F.col("size"), (F.col("index") + 1) * length) - F.col("start")
    runs = parts.withColumns({"lo": lo, "hi": hi}).join(blocks.hint("merge"), ["place", "index"])
    runs = runs.groupBy("row", "size", "epoch").agg(
        F.min(F.struct("shard", "position")).alias("first"), F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"), F.sum(F.col("hi") - F.col("lo")).alias("words")
    )
    # at most ceil(cap) epochs of a document
    runs = runs.groupBy(F.col("row").alias("_mix_row")).agg(F.collect_list(F.struct("first", "spans", (F.col("words") == F.col("size")).alias("whole"))).alias("_mix_runs"))
    out = kept.join(runs, "_mix_row")
    split = F.split(F.regexp_replace(text_of(text_col), r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    # the words are looked up only where a text is cut, once for all of its epochs
    out = out.withColumn("_mix_words", F.when(F.exists("_mix_runs", lambda r: ~r["whole"]), split)).withColumn("_mix_run", F.explode("_mix_runs"))
    cut = F.array_join(F.flatten(F.transform(F.col("_mix_run.spans"), lambda s: F.slice("_mix_words", (s["lo"] + 1).cast("int"), (s["hi"] - s["lo"]).cast("int")))), " ")
    out = out.withColumn(text_col, F.when(F.col("_mix_run.whole"), F.col(text_col)).otherwise(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    out = out.select(*docs.columns, F.col("_mix_run.first.shard").alias("_mix_shard"), F.col("_mix_run.first.position").alias("_mix_position"))
    return out.repartition("_mix_shard").sortWithinPartitions("_mix_shard", "_mix_position").select(*docs.columns)


def op6_mix(spark, sf_dir: str) -> DataFrame:
    found, _ = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source")
