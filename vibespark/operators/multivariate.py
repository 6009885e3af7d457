"""Many attributes at once: principal components, distances, affinities, embedding, correlation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def numeric_columns(df: DataFrame, skip: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in skip]


def useful_columns(df: DataFrame, skip: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns without nulls that are not constant, found in one pass."""
    cols = numeric_columns(df, skip)
    if not cols:
        return []
    r = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.struct(F.count(c).alias("n"), F.min(c).alias("a"), F.max(c).alias("b")).alias(c) for c in cols]).first()
    return [c for c in cols if r[c]["n"] == r["_rows"] and r[c]["a"] != r[c]["b"]]


def non_null_columns(df: DataFrame) -> list[str]:
    """Columns with some value."""
    r = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if r[c]]


def pca(df: DataFrame, components: int = 2, skip: tuple[str, ...] = ()) -> DataFrame:
    """df with pc1, pc2, ... of its useful columns, each standardised with its sample deviation.

    Moments are one aggregate over the rows; only the covariance of the columns reaches the driver. A component's sign
    makes its largest loading positive.
    """
    cols = useful_columns(df, skip)
    if not cols:
        raise ValueError("no column varies")
    m = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in cols], *[F.corr(a, b).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j]).first()
    n = len(cols)
    r = np.eye(n)
    for i in range(n):
        for j in range(i + 1, n):
            r[i, j] = r[j, i] = m[f"{i}_{j}"]
    value, vector = np.linalg.eigh(r)
    out = []
    for k in range(min(components, n)):
        v = vector[:, np.argsort(-value)[k]]
        v = v * np.sign(v[np.abs(v).argmax()])
        terms = [(F.col(c) - m[c]["m"]) / m[c]["s"] * float(x) for c, x in zip(cols, v, strict=True)]
        out.append(sum(terms[1:], terms[0]).alias(f"pc{k + 1}"))
    return df.select("*", *out)


def correlations(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, corr) of each two numeric columns, from one aggregate."""
    cols = numeric_columns(df, skip)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    made = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr")) for a, b in pairs]).alias("x"))
    return made.select(F.explode("x").alias("x")).select("x.*")


def negative_squared_distances(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(a, b, d): minus the squared distance of each row to each, for tables small enough that all pairs are the result."""
    a, b = df.select(F.col(id_col).alias("a"), F.col(vec).alias("_x")), df.select(F.col(id_col).alias("b"), F.col(vec).alias("_y"))
    d = F.aggregate(F.zip_with("_x", "_y", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return a.crossJoin(b).select("a", "b", (-d).alias("d"))


# ---- t-SNE: exact, quadratic in its rows by definition; for tables of results ------------------------------------


def softmax(x: np.ndarray, diagonal: bool = True) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    if diagonal:
        np.fill_diagonal(e, 0)
    e = e + 1e-8
    return e / e.sum(axis=1, keepdims=True)


def affinities(d: np.ndarray, sigmas: np.ndarray | None = None) -> np.ndarray:
    """Gaussian affinities of negative squared distances."""
    return softmax(d if sigmas is None else d / (2 * sigmas[:, None] ** 2))


def find_sigmas(d: np.ndarray, perplexity: float, rounds: int = 200) -> np.ndarray:
    """Widths that give each row the perplexity, by bisection of all rows at once."""
    lo, hi = np.full(len(d), 1e-20), np.full(len(d), 1e4)
    for _ in range(rounds):
        mid = (lo + hi) / 2
        p = affinities(d, mid)
        perp = 2 ** -(p * np.log2(p)).sum(axis=1)
        hi, lo = np.where(perp > perplexity, mid, hi), np.where(perp > perplexity, lo, mid)
    return (lo + hi) / 2


def tsne(df: DataFrame, skip: tuple[str, ...] = (), perplexity: float = 20, seed: int = 0, iterations: int = 1000, rate: float = 500, momentum: float = 0.0, max_rows: int = 5_000) -> DataFrame:
    """df with x and y of its embedding. All pairs of rows are needed at once, so more than max_rows rows are refused."""
    cols = useful_columns(df, skip)
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows")

    def run(table):
        import pyarrow as pa

        x = np.column_stack([np.array(table.column(c), float) for c in cols])
        x = (x - x.mean()) / (x.std() or 1.0)
        s = (x * x).sum(1)
        d = -(s[:, None] + s - 2 * x @ x.T)
        p = affinities(d, find_sigmas(d, min(perplexity, max(len(x) - 1, 1))))
        p = (p + p.T) / (2 * len(x))
        y = np.random.Generator(np.random.PCG64(seed)).normal(0, 1e-4, (len(x), 2))
        v = np.zeros_like(y)
        for _ in range(iterations):
            gap = y[:, None] - y[None]
            q = 1 / (1 + (gap * gap).sum(-1))
            np.fill_diagonal(q, 0)
            w = (p - q / q.sum()) * q
            v = momentum * v - rate * 4 * (w[:, :, None] * gap).sum(1)
            y = y + v
        return table.drop_columns(["_g"]).append_column("x", pa.array(y[:, 0])).append_column("y", pa.array(y[:, 1]))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.withColumn("_g", F.lit(0)).groupBy("_g").applyInArrow(run, f"{schema}, x double, y double")
