"""Exact top-k search by inner product as a Voronoi join.

Vectors become integers, floor(256 * x). Pivots are about the square root of the rows in number, drawn by hash from a
bounded sample; data and queries are grouped by their nearest pivot, and groups cut into blocks of bounded size, so that
a hot group is many tasks. A group is summarised by its pivot p, the least and greatest distance to it, and the largest
norm. For a query q and a group:
  q . x <= q . p + |q| * greatest distance,   q . x <= (|q|^2 + largest norm^2 - d^2) / 2
with d the largest lower bound of |q - x|: from the distances, by the triangle inequality, and from the plane between
q's pivot and p. A query first searches its own group; its k-th score there, or what the summaries promise if that is
more, bounds it from below. It is then sent to the groups alone whose upper bound reaches that, and only scores that
reach it come back.

Data blocks are written once and never move again: blocks of queries lie as array files in the shared folder, and a
block of data reads those that are sent to its group. Where no bound holds (vectors that are spread evenly over many
dimensions) every query visits every group.

Vectors that are null, or hold null or non-finite components, take no part. All vectors must have one length. Equal
scores go to the smaller vec_id; a query's own row, by vec_id, is no candidate. Repeated rows are candidates as often as
they occur; a repeated query gives one answer. Other columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from albumweave.llm.common import get, materialise, new_folder, put, table

SCALE = 256
#: Pivots: the square root of the rows, at most PIVOTS, out of a sample of SAMPLE rows.
PIVOTS, SAMPLE = 1024, 4096
#: Vectors of a block, and blocks of queries that one reading of a data block meets.
DATA_BLOCK, QUERY_BLOCK, MEET = 2048, 512, 64
OUT = "query_id long, rank int, vec_id long, score long"
FOUND = "query_id long, vec_id long, score long"


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equal-length lists of longs as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floating point where all sums stay below 2 ** 53."""
    high = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if high < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, equal ones by id."""
    if len(score) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= cut)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def packed(ids: np.ndarray, v: np.ndarray, *more: np.ndarray) -> bytes:
    """Ids, further numbers for each row, and vectors, in the fewest bytes that hold them."""
    kind = next(t for t in ("<i2", "<i4", "<i8") if np.abs(v).max(initial=0) < np.iinfo(t).max)
    head = np.array([len(ids), v.shape[1], int(kind[2]), len(more)], "<i8").tobytes()
    return head + ids.astype("<i8").tobytes() + b"".join(m.astype("<f8").tobytes() for m in more) + v.astype(kind).tobytes()


def unpacked(data: bytes) -> tuple:
    """(ids, vectors, further numbers...)"""
    n, dims, width, more = np.frombuffer(data, "<i8", 4).tolist()
    at = 32 + 8 * n
    extra = [np.frombuffer(data, "<f8", n, at + 8 * n * i) for i in range(more)]
    v = np.frombuffer(data, f"<i{width}", n * dims, at + 8 * n * more).reshape(n, dims)
    return np.frombuffer(data, "<i8", n, 32), v.astype(np.int64), *extra


class Groups:
    """Pivots and the summaries of their groups; a few numbers for each pivot."""

    def __init__(self, pivots: np.ndarray, rows: list) -> None:
        m = len(pivots)
        self.p = pivots.astype(np.float64)
        self.near, self.far, self.norm, self.size = np.full(m, np.inf), np.full(m, -1.0), np.zeros(m), np.zeros(m, np.int64)
        for r in rows:
            self.near[r.cell], self.far[r.cell], self.norm[r.cell], self.size[r.cell] = r.near, r.far, r.norm, r.n - r.own
        self.full = self.far >= 0

    def bounds(self, q: np.ndarray, home: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(upper bound of the scores in each group, lower bound of the k-th score) for queries of one group."""
        q = q.astype(np.float64)
        dot, size = q @ self.p.T, (q * q).sum(1)[:, None]
        far, near = np.maximum(self.far, 0), np.where(self.full, self.near, 0)
        apart = np.sqrt(np.maximum(size - 2 * dot + (self.p * self.p).sum(1), 0))
        between = np.sqrt(np.maximum(((self.p - self.p[home]) ** 2).sum(1), 1e-12))
        plane = (apart**2 - apart[:, [home]] ** 2) / (2 * between)
        d = np.maximum(np.maximum(apart - far, near - apart), np.maximum(plane, 0))
        high = np.minimum(dot + np.sqrt(size) * far, (size + self.norm**2 - np.maximum(d, 0) ** 2) / 2)
        low = np.where(self.full, dot - np.sqrt(size) * far, -np.inf)
        order = np.argsort(-low, 1)
        held = np.cumsum(self.size[order], 1) >= k
        at = np.where(held.any(1), held.argmax(1), len(self.p) - 1)
        least = np.where(held.any(1), np.take_along_axis(low, np.take_along_axis(order, at[:, None], 1), 1)[:, 0], -np.inf)
        slack = 1e-6 * (1 + np.abs(dot) + size)
        return np.where(self.full, high + slack, -np.inf), least - slack.max(1)


def _read(names: list[str], held: dict) -> Iterator[tuple]:
    for name in names:
        if name not in held:
            if len(held) >= 2 * MEET:
                held.clear()
            held[name] = unpacked(get(name))
        yield held[name]


def _scan(k: int):
    """Tasks over (data, names): the scores of each block's vectors that reach the queries' bounds, k at most for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for data, names in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                ids, v = unpacked(data.as_py())
                for qi, q, least in _read(names, held):
                    s = products(q, v)
                    part = []
                    for row in np.flatnonzero(s.max(1) >= least).tolist():
                        at = np.flatnonzero((s[row] >= least[row]) & (ids != qi[row]))
                        at = at[best(s[row, at], ids[at], k)]
                        part.append((np.full(len(at), qi[row]), ids[at], s[row, at]))
                    if part:
                        yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*part, strict=True)], names=["query_id", "vec_id", "score"])

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query, k: int = 5, scale: int = SCALE, pivots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, rank, vec_id, score) of a table (vec_id, embedding), and the visits (name of a block of queries, cell)
    beyond the queries' own groups."""
    spark = vectors.sparkSession
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    usable = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(usable).select("vec_id", whole.alias("v"), is_query.alias("asks"))
    drawn = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()  # SAMPLE vectors at most
    none = spark.createDataFrame([], OUT)
    if not drawn:
        return none, spark.createDataFrame([], "name string, cell int")
    p = np.unique(np.array([r.v for r in drawn], np.int64), axis=0)
    many = pivots or min(PIVOTS, math.isqrt(rows.count()) + 1)
    p = p[np.random.Generator(np.random.PCG64(5)).permutation(len(p))[:many]]
    sc = spark.sparkContext
    centre = sc.broadcast(p)  # PIVOTS vectors at most

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = centre.value.astype(np.float64)
        for batch in batches:
            v = _matrix(batch.column(1)).astype(np.float64)
            far = np.maximum((v * v).sum(1)[:, None] - 2 * v @ p.T + (p * p).sum(1), 0)
            cell = far.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt(far[np.arange(len(v)), cell])), pa.array(np.sqrt((v * v).sum(1)))], names=["vec_id", "v", "asks", "cell", "far", "norm"])

    placed = materialise(rows.mapInArrow(near, "vec_id long, v array<long>, asks boolean, cell int, far double, norm double"), "placed")
    # One row for each pivot. No query counts its own rows: the most that one query id has in a group are left out.
    own = placed.where("asks").groupBy("cell", "vec_id").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max("n").alias("own"))
    sums = placed.groupBy("cell").agg(F.min(F.col("far") * (1 - 1e-9) - 1e-6).alias("near"), F.max(F.col("far") * (1 + 1e-9) + 1e-6).alias("far"), F.max(F.col("norm") + 1e-6).alias("norm"), F.count("*").alias("n"), F.count_if("asks").alias("queries"))
    summaries = sums.join(own, "cell", "left").fillna(0, ["own"]).collect()
    groups = sc.broadcast(Groups(p, summaries))
    count = spark.createDataFrame([(r.cell, max(1, -(-r.n // DATA_BLOCK)), max(1, -(-r.queries // QUERY_BLOCK))) for r in summaries], "cell int, data_blocks int, query_blocks int")
    folder = new_folder(spark, "queries")

    def in_blocks(df: DataFrame, blocks: str, run, schema: str) -> DataFrame:
        dealt = df.join(F.broadcast(count), "cell")  # PIVOTS rows
        block = F.pmod(F.xxhash64("vec_id", "v"), F.col(blocks)).cast("int").alias("block")
        return dealt.select("cell", block, *df.columns[1:]).groupBy("cell", "block").applyInArrow(run, schema)

    def pack(rows: pa.Table) -> pa.Table:
        return pa.table({"cell": rows.column("cell")[:1], "data": pa.array([packed(rows.column("vec_id").to_numpy(), _matrix(rows.column("v")))], pa.binary())})

    def file(rows: pa.Table, least: np.ndarray, turn: int) -> str:
        cell, block = rows.column("cell")[0].as_py(), rows.column("block")[0].as_py()
        return put(folder, f"{turn}-{cell}-{block}", packed(rows.column("vec_id").to_numpy(), _matrix(rows.column("v")), least))

    def ask_home(rows: pa.Table) -> pa.Table:
        _, least = groups.value.bounds(_matrix(rows.column("v")), rows.column("cell")[0].as_py(), k)
        return pa.table({"cell": rows.column("cell")[:1], "name": pa.array([file(rows, least, 1)])})

    def ask_others(rows: pa.Table) -> pa.Table:
        home = rows.column("cell")[0].as_py()
        high, least = groups.value.bounds(_matrix(rows.column("v")), home, k)
        least = np.maximum(least, rows.column("kth").fill_null(-(1 << 62)).to_numpy().astype(np.float64))
        cells = np.flatnonzero((high >= least[:, None]).any(0))
        cells = cells[cells != home].astype(np.int32)
        return pa.table({"cell": pa.array(cells), "name": pa.array([file(rows, least, 2)] * len(cells), pa.string())})

    def visited(asked: DataFrame) -> DataFrame:
        """Data blocks with the names of the query blocks that visit them, `MEET` at a time."""
        turn = F.floor((F.row_number().over(Window.partitionBy("cell").orderBy("name")) - 1) / MEET)
        lists = asked.withColumn("turn", turn).groupBy("cell", "turn").agg(F.collect_list("name").alias("names"))
        return blocks.join(lists, "cell").select("data", "names").mapInArrow(_scan(k), FOUND)

    blocks = materialise(in_blocks(placed.select("cell", "vec_id", "v"), "data_blocks", pack, "cell int, data binary"), "blocks")
    asks = placed.where("asks").select("cell", "vec_id", "v").dropDuplicates(["vec_id"])
    asks = materialise(asks, "asks")
    at_home = materialise(in_blocks(asks, "query_blocks", ask_home, "cell int, name string"), "home")
    first = materialise(visited(at_home), "first")
    kth = _top(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    visits = materialise(in_blocks(asks.join(kth, "vec_id", "left").select("cell", "vec_id", "v", "kth"), "query_blocks", ask_others, "cell int, name string"), "visits")
    found = first.union(visited(visits))
    return _top(found, k).select("query_id", "rank", "vec_id", "score"), visits.select("name", "cell")


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = SCALE, pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of a table (vec_id, embedding)."""
    return search(vectors, is_query, k, scale, pivots)[0]


def op6_topk_search(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
