"""Approximate nearest neighbours over balanced posting lists, whose centroids are searched through an in-memory graph."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spill

#: Entries of a matrix of distances to centroids held at once; bytes of vectors in a record batch that is made, about.
ENTRIES, BATCH_BYTES = 1 << 22, 4 << 20


@dataclass(frozen=True)
class IndexOptions:
    """rows_per_list: rows to a centroid, about; max_lists: bound of centroids, hence of what is broadcast (max_lists times
    dimension times 4 bytes, and degree times 4 bytes of graph); sample_rows: rows, about, that centroids are fitted on,
    and four to a list at least; replicas, closure: a vector lies in its nearest list and in others, up to replicas in
    all, whose centroid is at most 1 + closure times as far; probe_ratio: a query reads the lists whose centroid is at
    most probe_ratio times as far as the nearest, or as the list at which k others are sure; None: the ratio at which
    trial_queries rows of the sample find the share ``recall`` of their neighbours, so that data with
    clusters are pruned far more than data without; split_rows, split_queries: longer lists, and those that more
    queries read, are split; bins: lists are compared in about so many groups at most, as far as split_rows rows of each
    list fit group_bytes; degree, beam: neighbours in the graph, candidates kept at least."""

    rows_per_list: int = 100
    max_lists: int = 16_384
    sample_rows: int = 20_000
    replicas: int = 2
    closure: float = 0.005
    probe_ratio: float | None = None
    recall: float = 0.93
    trial_queries: int = 300
    split_rows: int = 2_000
    split_queries: int = 2_000
    bins: int = 256
    group_bytes: int = 32 << 20
    degree: int = 24
    beam: int = 32
    rounds: int = 8
    balance: float = 0.02


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0))


def fit_centroids(sample: np.ndarray, lists: int, rounds: int, balance: float) -> np.ndarray:
    """k-means whose distances grow with the share a list has already taken, so that lists stay balanced."""
    rng = np.random.Generator(np.random.PCG64(7))
    sample = np.unique(sample, axis=0)
    rng.shuffle(sample)
    c = sample[:lists].copy()
    load = np.ones(len(c))
    for _ in range(rounds):
        near = np.concatenate([(_distances(x, c) * (1 + balance * load)).argmin(1) for x in np.array_split(sample, max(1, len(sample) // 4096, len(sample) * len(c) // ENTRIES))])
        load = np.minimum(np.bincount(near, minlength=len(c)) / max(len(sample) / len(c), 1), 4)
        total = np.zeros_like(c, dtype=np.float64)
        np.add.at(total, near, sample)
        some = np.bincount(near, minlength=len(c))
        c = np.where(some[:, None] > 0, total / np.maximum(some, 1)[:, None], c).astype(np.float32)
    return np.unique(c, axis=0)


def centroid_graph(c: np.ndarray, degree: int) -> np.ndarray:
    """Neighbours of each centroid: the nearest, and a few drawn ones that keep the graph connected."""
    k = len(c)
    near = min(degree * 3 // 4, k - 1)
    graph = np.random.Generator(np.random.PCG64(11)).integers(0, k, (k, degree))
    step = max(1, min(1024, ENTRIES // k))
    for lo in range(0, k, step):
        if near:
            d = _distances(c[lo : lo + step], c)
            d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
            graph[lo : lo + step, :near] = np.argpartition(d, near - 1, axis=1)[:, :near] if near < k else np.argsort(d, axis=1)[:, :near]
    graph[:, -1] = (np.arange(k) + 1) % k
    return graph


def search_graph(x: np.ndarray, c: np.ndarray, graph: np.ndarray, beam: int, ratio: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each vector, centroids found and their distances, nearest first.

    Best-first search from fixed entries: the nearest centroid not yet expanded is expanded while it is among the
    ``beam`` nearest found or within ``ratio`` of the nearest, so that a query finds every list its pruning allows.
    """
    entries = np.unique(np.linspace(0, len(c) - 1, num=min(16, len(c))).astype(np.int64))
    x = x.astype(np.float32)
    d = np.full((len(x), len(c)), np.inf, np.float32) if len(c) <= 4096 else None
    out = []
    norm = (c * c).sum(1)
    for i, one in enumerate(x):
        seen = np.zeros(len(c), bool)
        done = np.zeros(len(c), bool)
        dist = d[i] if d is not None else np.full(len(c), np.inf, np.float32)
        new = entries
        size = float(one @ one)
        while len(new):
            seen[new] = True
            dist[new] = np.sqrt(np.maximum(norm[new] - 2 * (c[new] @ one) + size, 0))
            found = np.flatnonzero(seen)
            reach = dist[found]
            limit = max(np.partition(reach, beam - 1)[beam - 1] if len(found) > beam else np.inf, reach.min() * ratio)
            turn = found[(reach <= limit) & ~done[found]]
            done[turn] = True
            new = np.unique(graph[turn])
            new = new[~seen[new]]
        found = np.flatnonzero(seen)
        order = found[np.argsort(dist[found], kind="stable")]
        out.append((order, dist[order]))
    return out


def fitted_ratio(sample: np.ndarray, c: np.ndarray, k: int, o: IndexOptions, share: float = 1.0) -> float:
    """The probe ratio at which trial queries from the sample reach o.recall of their nearest rows of the sample.

    share: of all rows, what the sample is. Of the k nearest of all rows, about k * share are in the sample, as its
    nearest; at least one is tried, so that of a small sample the ratio errs to the side of reading more.
    """
    k = max(1, round(k * min(share, 1.0)))
    rng = np.random.Generator(np.random.PCG64(13))
    asked = rng.permutation(len(sample))[: o.trial_queries]
    k = min(k, len(sample) - 1)
    if k < 1 or len(c) < 2:
        return 1.0
    own = _distances(sample[asked], c)
    needed = []
    for lo in range(0, len(asked), 64):
        d = _distances(sample[asked[lo : lo + 64]], sample)
        d[np.arange(len(d)), asked[lo : lo + 64]] = np.inf
        for i, near in enumerate(np.argpartition(d, k - 1, axis=1)[:, :k]):
            from_c = _distances(sample[near], c)
            lists = np.argsort(from_c, axis=1)[:, : o.replicas]
            reach = np.take_along_axis(from_c, lists, axis=1)
            mine = own[lo + i]
            far = np.where(reach <= (1 + o.closure) * reach[:, :1] + 1e-6, mine[lists], np.inf).min(axis=1)
            needed.append(far / max(mine.min(), 1e-6))
    return float(np.quantile(np.concatenate(needed), o.recall)) + 1e-6


def enough_lists(one: np.ndarray, c: np.ndarray, held: np.ndarray, least: int, ratio: float) -> np.ndarray:
    """The lists by centroid distance until they hold ``least`` ids, with those at most ratio times as far as the last; all if none suffice."""
    c = c.astype(np.float64)
    d = np.sqrt(((c - one) ** 2).sum(1))
    order = np.argsort(d, kind="stable")
    sure = np.flatnonzero(np.cumsum(held[order]) >= least)
    return np.flatnonzero(d <= ratio * d[order[sure[0]]] + 1e-6) if len(sure) else order


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of rows with a vector that is not null, not zero and has finite components only."""
    v = F.col("vec")
    kind = "array<float>" if vectors.select(vec_col).dtypes[0][1] == "array<float>" else "array<double>"
    d = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("vec"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return d.filter(F.col("id").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0))


def listed(part, found: list[np.ndarray], counts: np.ndarray, split_rows: int, a_bin: int, dims: int) -> Iterator:
    """Record batches of bounded size of (bin, id, vec, lists, parts): a row for each row of part and bin of lists with some it
    found, and into how many parts the longest of these is split. However many lists are found, the vectors of a
    batch stay near BATCH_BYTES."""
    import pyarrow as pa

    at = np.repeat(np.arange(len(found)), [len(m) for m in found])
    lst = np.concatenate(found) if found else np.zeros(0, np.int64)
    some = counts[lst] > 0
    at, lst = at[some], lst[some]
    order = np.lexsort((lst, at))
    at, lst = at[order], lst[order]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (lst[1:] // a_bin != lst[:-1] // a_bin)
    first = np.flatnonzero(fresh)
    edge = np.append(first, len(at))
    step = max(1, BATCH_BYTES // (8 * dims))
    for lo in range(0, len(first), step):
        mine = first[lo : lo + step]
        ends = edge[lo : lo + step + 1]
        inside = lst[ends[0] : ends[-1]]
        rows = part.take(pa.array(at[mine]))
        parts = np.maximum.reduceat(-(-counts[inside] // split_rows), mine - mine[0])
        lists = pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), pa.array(inside.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array((lst[mine] // a_bin).astype(np.int32)), rows.column("id"), rows.column("vec"), lists, pa.array(parts.astype(np.int32))], ["bin", "id", "vec", "lists", "parts"])


def compared(x: np.ndarray, ids: np.ndarray, lists: np.ndarray, q: np.ndarray, q_ids: np.ndarray, pair_list: np.ndarray, pair_query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest other ids of each query among the rows of the lists it reads: query ids, ids and distances.

    (pair_list, pair_query) say which query reads which list. A query holds k ids at any time. Products of matrices only
    rule rows out, with a margin above their rounding; distances are those of the original vectors.
    """
    best_d, best_id, held = np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64), np.zeros(len(q), np.int64)
    order = np.argsort(lists, kind="stable")
    starts = np.unique(lists[order], return_index=True)
    stops = np.append(starts[1][1:], len(order))
    of_pair = np.lexsort((pair_query, pair_list))
    pair_list, pair_query = pair_list[of_pair], pair_query[of_pair]
    slice_of = max(1, (1 << 20) // x.shape[1])
    for one, start, stop in zip(*starts, stops, strict=True):
        asking = pair_query[np.searchsorted(pair_list, one) : np.searchsorted(pair_list, one, "right")]
        for at in range(start, stop if len(asking) else start, 2048):
            own = order[at : min(at + 2048, stop)]
            xs = x[own].astype(np.float64)
            xn = (xs * xs).sum(1)
            distinct = len(np.unique(ids[own])) == len(own) > k
            for lo in range(0, len(asking), 256):
                mine = asking[lo : lo + 256]
                qs = q[mine].astype(np.float64)
                qn = (qs * qs).sum(1)
                with np.errstate(all="ignore"):
                    d = qn[:, None] + xn - 2 * (qs @ xs.T)
                    slack = 8 * (x.shape[1] + 8) * np.finfo(np.float64).eps * (qn + xn.max())
                    limit = np.where(held[mine] == k, best_d[mine, -1] ** 2 * (1 + 1e-12) + slack, np.inf)
                    may = ~(d > limit[:, None])
                    if distinct and may.sum() > 4 * k * len(mine):  # k others, and perhaps the query itself
                        limit = np.fmin(limit, np.partition(d, k, axis=1)[:, k] + 2 * slack)
                        may = ~(d > limit[:, None])
                i, j = np.nonzero(may)
                other = ids[own[j]] != q_ids[mine[i]]
                i, j = i[other], j[other]
                if not len(i):
                    continue
                exact = np.concatenate([np.sqrt(((qs[i[p : p + slice_of]] - xs[j[p : p + slice_of]]) ** 2).sum(-1)) for p in range(0, len(i), slice_of)])
                # with those held so far; an id counts once, with its nearest vector
                row, col = np.nonzero(np.arange(k) < held[mine][:, None])
                who, vid, dist = np.concatenate([i, row]), np.concatenate([ids[own[j]], best_id[mine[row], col]]), np.concatenate([exact, best_d[mine[row], col]])
                by_id = np.lexsort((dist, vid, who))
                fresh = np.ones(len(by_id), bool)
                fresh[1:] = (who[by_id][1:] != who[by_id][:-1]) | (vid[by_id][1:] != vid[by_id][:-1])
                by_id = by_id[fresh]
                near = by_id[np.lexsort((vid[by_id], dist[by_id], who[by_id]))]
                rank = np.arange(len(near)) - np.searchsorted(who[near], who[near])
                near, rank = near[rank < k], rank[rank < k]
                best_d[mine[who[near]], rank], best_id[mine[who[near]], rank] = dist[near], vid[near]
                held[mine] = np.bincount(who[near], minlength=len(mine))
    row, col = np.nonzero(np.arange(k) < held[:, None])
    return q_ids[row], best_id[row, col], best_d[row, col]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", options: IndexOptions | None = None) -> DataFrame:
    """The k nearest vectors found for each query by Euclidean distance: (query_id, rank, vec_id, score).

    Centroids are fitted on a bounded sample; every vector is put into posting lists, boundary vectors into several.
    Lists longer than split_rows are split by hashed id, so they stay balanced however many vectors coincide, and so are
    the queries of a bin of lists. A query goes to a bin once, with the lists it reads there, and what a task holds is
    bounded by group_bytes however many lists there are and however many of them a query reads. A query reads the lists that the distance ratio selects; where these may hold fewer than k
    other ids, it goes on to farther ones until k are sure, so that only tables of fewer candidates give fewer than k
    rows. The rows of its lists are compared in double precision on the original vectors. Ties go to the smaller id; a query's own id is no candidate. Vectors that are null, zero, or hold null or
    non-finite components take no part, nor do those of a length other than the most frequent. Rows that repeat an id
    count once, with their nearest vector. No vectors or queries give no rows.
    """
    o = options or IndexOptions()
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    lengths = rows.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    dims, total = lengths[0]["n"], lengths[0]["rows"]
    rows = rows.filter(F.size("vec") == dims)
    asked = usable(queries, id_col, vec_col).filter(F.size("vec") == dims)
    lists = max(1, min(o.max_lists, total // o.rows_per_list))
    wanted = max(o.sample_rows, 4 * lists)
    every = max(1, total // wanted)
    taken = rows.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(every)) == 0).select("vec").limit(2 * wanted).toArrow()
    sample = taken.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dims)
    if not len(sample):
        sample = np.zeros((1, dims), np.float32)
    c = fit_centroids(sample, lists, o.rounds, o.balance)
    probe_ratio = fitted_ratio(sample, c, k, o, len(sample) / total) if o.probe_ratio is None else o.probe_ratio
    shared = spark.sparkContext.broadcast((c, centroid_graph(c, o.degree)))
    # lists of neighbouring numbers are read together, so that a query leaves k rows for each bin and not for each list
    vec = dict(rows.dtypes)["vec"]
    row_bytes = (4 if vec == "array<float>" else 8) * dims
    a_bin = max(1, min(max(o.split_rows // o.rows_per_list, -(-len(c) // o.bins)), o.group_bytes // (row_bytes * o.split_rows)))
    asked_at_once = max(1, min(o.split_queries * a_bin, o.group_bytes // row_bytes, o.group_bytes // (8 * a_bin)))  # 8 bytes for a query and one of its lists

    def within(limit: int | None, ratio: float, made):
        """made(part, the lists of each of its rows) for slices whose distances to centroids stay within ENTRIES."""

        def run(batches) -> Iterator:
            cents, graph = shared.value
            step = max(1, min(1024, ENTRIES // len(cents)))
            for batch in batches:
                for lo in range(0, batch.num_rows, step):
                    part = batch.slice(lo, step)
                    flat = part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                    found = search_graph(flat, cents, graph, o.beam, ratio)
                    yield from made(part, flat, cents, [(lst[ok][:limit]) for lst, dist in found for ok in [dist <= ratio * dist[0] + 1e-6]])

        return run

    def post(part, _, __, mine):
        import pyarrow as pa

        sizes = [len(m) for m in mine]
        out = part.take(pa.array(np.repeat(np.arange(len(mine)), sizes)))
        home = np.concatenate([np.arange(n) == 0 for n in sizes])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(mine).astype(np.int32)), out.column("id"), out.column("vec"), pa.array(home)], ["list", "id", "vec", "home"])

    posted = spill(rows.mapInArrow(within(o.replicas, 1 + o.closure, post), f"list int, id long, vec {vec}, home boolean"))
    # each id counts in one list that has it, so the sum over any lists is at most the number of ids in them
    homes = posted.filter("home").groupBy("id").agg(F.min("list").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    sizes = posted.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    held, counts = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
    for into, of in ((held, homes), (counts, sizes)):
        for r in of.collect():  # a row per centroid
            into[r["list"]] = r["n"]

    def probe(part, flat, cents, mine):
        # k others, and perhaps the query itself
        mine = [m if held[m].sum() > k else np.union1d(m, enough_lists(flat[i], cents, held, k + 1, probe_ratio)) for i, m in enumerate(mine)]
        yield from listed(part, mine, counts, o.split_rows, a_bin, dims)

    probes = spill(asked.mapInArrow(within(None, probe_ratio, probe), f"bin int, id long, vec {vec}, lists array<int>, parts int"))
    reads = F.broadcast(probes.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / asked_at_once).alias("reads")))
    splits = F.broadcast(spark.createDataFrame([(i, -(-int(n) // o.split_rows)) for i, n in enumerate(counts) if n], "list int, splits long"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    posted = posted.join(splits, "list").withColumn("bin", F.floor(F.col("list") / a_bin).cast("int")).join(reads, "bin").withColumn("part", F.pmod(F.xxhash64("id"), F.col("splits"))).select("bin", "part", upto("reads").alias("turn"), "list", "id", "vec")
    probes = probes.join(reads, "bin").withColumn("turn", F.pmod(F.xxhash64("id"), F.col("reads"))).select("bin", upto("parts").alias("part"), "turn", "lists", "id", "vec")

    def columns(table):
        return np.array(table.column("id"), np.int64), table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)

    def compare(left, right):
        import pyarrow as pa

        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if left.num_rows and right.num_rows:
            (ids, x), (q_ids, q) = columns(left), columns(right)
            read = right.column("lists").combine_chunks()
            pair_query = np.repeat(np.arange(len(q)), read.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int32)
            out = compared(x, ids, np.array(left.column("list"), np.int32), q, q_ids, read.flatten().to_numpy(zero_copy_only=False), pair_query, k)
        return pa.table([pa.array(col) for col in out], names=["query_id", "vec_id", "score"])

    found = posted.groupBy("bin", "part", "turn").cogroup(probes.groupBy("bin", "part", "turn")).applyInArrow(compare, "query_id long, vec_id long, score double")
    found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def op1_ann(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
