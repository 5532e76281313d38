"""Whitening of embeddings: the singular values of the centred rows, by MLlib's `computeSVD`.

Entries become integers, x = floor(1024 * c) + 100000, so that their sums S over the n fitted rows are exact. A row is
centred before anything is multiplied, as (n * x - S) / n with an exact numerator, and the matrix of centred rows stays
distributed. Its singular values s give the eigenvalues of the covariance, e = s ** 2 / n; its right singular vectors are
the components. The total variance doesn't come from them but from the exact deviations, the sum of (n * x - S) ** 2.

MLlib reads the components from a Gram matrix, where directions far weaker than the strongest drown in rounding. Those of
under `WEAK` of the strongest singular value are therefore taken from a further decomposition of the rows without their
part along the components already found.

Vectors take no part if they are null or empty, hold null or non-finite entries or ones beyond `LARGEST`, or are not of
the most frequent length (of several, the longest). A null vec_id takes part and is kept; repeated rows count as often as
they occur. Components without variance are not returned, so that one row, or equal rows alone, give an empty result, as
an empty table does. A component's largest entry (of equal ones, the first) is positive. A deviation that is no long is
null. Other columns are ignored."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumweave.llm.common import materialise, table

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Entries of which the integer is exact in a double, with room for the offset.
LARGEST = float(1 << 40)
#: Singular values below this part of the largest are taken again without the components before them.
WEAK = 1e-4
#: Below this part of the very largest, what is left is rounding.
NONE = 1e-11
#: Vectors up to this length are decomposed in full from their Gram matrix, longer ones by Lanczos steps.
FULL = 4096


def integers(vectors: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> tuple[DataFrame, int, int]:
    """((vec_id, x) of the rows that take part, their number, their length)."""
    entry = F.col("embedding")
    good = entry.isNotNull() & (F.size(entry) > 0) & ~F.exists(entry, lambda c: F.coalesce(F.isnan(c) | (F.abs(c) > LARGEST), F.lit(True)))
    rows = vectors.select("vec_id", "embedding").where(good)
    lengths = rows.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims"))
    first = lengths.first()
    n, dims = (first.n, first.dims) if first else (0, 0)
    x = F.transform(entry, lambda c: F.floor(scale * c.cast("double")).cast("long") + F.lit(offset))
    return rows.where(F.size("embedding") == dims).select("vec_id", x.alias("x")), n, dims


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def sums(rows: DataFrame, dims: int) -> list[int]:
    """The exact sum of each entry: a task gives a row for each entry and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            whole = x.sum(0) if np.abs(x).max(initial=0) * len(x) < 1 << 62 else x.astype(object).sum(0)
            yield pa.record_batch([pa.array(np.arange(dims, dtype=np.int32)), pa.array([Decimal(int(v)) for v in whole], pa.decimal128(38, 0))], names=["at", "part"])

    summed = rows.select("x").mapInArrow(run, "at int, part decimal(38,0)").groupBy("at").agg(F.sum("part").alias("s"))
    found = {r.at: int(r.s) for r in summed.collect()}  # a number for each entry of a vector
    return [found[i] for i in range(dims)]


def deviations(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * x - S, exact: as longs where their squares' sum fits, else as Python's integers."""
    high = max(n * int(np.abs(x).max(initial=0)), max(map(abs, s)))
    if x.shape[1] * (2 * high) ** 2 < 1 << 63:
        return n * x - np.array(s, np.int64)
    if 2 * high < 1 << 62:
        d = n * x - np.array(s, np.int64)
        if x.shape[1] * int(np.abs(d).max(initial=0)) ** 2 < 1 << 63:
            return d
        return d.astype(object)
    return n * x.astype(object) - np.array(s, object)


def _centred(dims: int, n: int, s: list[int], without: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = (deviations(_matrix(batch.column(0), dims), n, s) / n).astype(np.float64)
            for _ in range(2 if without.shape[1] else 0):  # the second time takes what rounding left
                c = c - (c @ without) @ without.T
            yield pa.record_batch([pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * dims), pa.array(c.ravel()))], names=["c"])

    return run


def components(rows: DataFrame, n: int, dims: int, s: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit eigenvectors of the covariance as columns, eigenvalues), by falling eigenvalue: k at most."""
    found, values = np.empty((dims, 0)), np.empty(0)
    while len(values) < min(k, dims):
        centred = rows.select("x").mapInArrow(_centred(dims, n, s, found), "c array<double>")
        vectors = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector("c").alias("c")), "c")
        svd = RowMatrix(vectors, n, dims).computeSVD(dims if dims <= FULL else min(k, dims))
        sigma, right = svd.s.toArray(), svd.V.toArray()
        least = max(WEAK * sigma.max(initial=0), NONE * np.sqrt(n * values.max(initial=0)))
        strong = np.flatnonzero(sigma > least)[: k - len(values)]
        if not len(strong):
            break
        right = right[:, strong] - found @ (found.T @ right[:, strong])
        found = np.concatenate([found, right / np.linalg.norm(right, axis=0)], 1)
        values = np.concatenate([values, sigma[strong] ** 2 / n])
    order = np.argsort(-values, kind="stable")
    found, values = found[:, order], values[order]
    top = np.abs(found).argmax(0)
    return found * np.sign(found[top, np.arange(found.shape[1])]), values


def projected(rows: DataFrame, n: int, dims: int, s: list[int], found: np.ndarray, values: np.ndarray) -> DataFrame:
    """(vec_id, deviation, whitened) of each row: the exact deviation, a number for each component."""
    scaled = found / np.sqrt(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = deviations(_matrix(batch.column(1), dims), n, s)
            whole = pa.array([Decimal(int(v)) for v in (d * d).sum(1)], pa.decimal128(38, 0))
            w = (d / n).astype(np.float64) @ scaled
            at = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            yield pa.record_batch([batch.column(0), whole, pa.ListArray.from_arrays(at, pa.array(w.ravel()))], names=["vec_id", "deviation", "whitened"])

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation decimal(38,0), whitened array<double>")


def identity_error(white: DataFrame, k: int) -> float:
    """The largest absolute entry of the covariance of `whitened` less the identity, centred before multiplying."""
    w = [F.col("whitened")[i] for i in range(k)]
    mean = white.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(w))).first()
    both = [(i, j) for i in range(k) for j in range(i, k)]
    cov = white.agg(*(F.avg((w[i] - F.lit(mean[i])) * (w[j] - F.lit(mean[j]))).alias(f"c{i}_{j}") for i, j in both)).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(cov, both, strict=True))


def whitened(vectors: DataFrame, k: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of a table (vec_id, embedding)."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows, n, dims = integers(vectors, scale, offset)
    if not n:
        return empty
    s = sums(rows, dims)
    found, values = components(rows, n, dims, s, k)
    if not len(values):
        return empty
    white = materialise(projected(rows, n, dims, s, found, values), "whitened")
    total = white.agg(F.sum(F.col("deviation").cast("double"))).first()[0] / n**3
    explained = F.array(*(F.lit(float(e / total)) for e in values))
    out = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        F.expr("try_cast(deviation AS long)").alias("deviation"),
        "whitened",
        explained[F.col("at")].alias("explained"),
        F.lit(identity_error(white, len(values))).alias("identity_error"),
    )


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
