"""Graphs of faces: components, canonical pairs, greedy one-to-one matching."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from albumweave.operators.pairs import blocks_of, stars

PASSES = 50


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session without one gets a local folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return where.rstrip("/")


#: Working tables made since each open `working` began, the outermost first.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


@contextmanager
def working(spark: SparkSession) -> Iterator[None]:
    """Working tables settled inside go at its end, but for those that outlive it: they go with the one around it, if
    there is one, or else with the driver."""
    made: list[str] = []
    token = _OPEN.set((*_OPEN.get(), made))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for uri in made:
            _path_of(spark, uri)[1].delete(_path_of(spark, uri)[0], True)


def _path_of(spark: SparkSession, uri: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, what: str, outlive: bool = False) -> str:
    """A fresh path in the shared folder. It goes when the driver ends, or with the `working` that it was made in; one
    that outlives that goes with the next around it."""
    uri = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    path, fs = _path_of(spark, uri)
    scopes = _OPEN.get()[: -1 if outlive else None]
    if scopes:
        scopes[-1].append(uri)
    fs.deleteOnExit(path)
    return uri


def settled(df: DataFrame, outlive: bool = False) -> DataFrame:
    """The table, written to the shared folder and read back, which cuts its lineage. Sizes are known then, and none of
    the plan behind it is kept. It goes as its folder does (`new_folder`)."""
    uri = new_folder(df.sparkSession, "settled", outlive)
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def components(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ("event_id",), node: str = "row_ix") -> DataFrame:
    """(keys, node, root): the smallest node reached over undirected edges (keys, a, b). Each pass takes the least
    root of the neighbours and then the root of that root, so that long chains halve."""
    k = list(keys)
    both = edges.select(*k, "a", "b").union(edges.select(*k, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = settled(both)
    now = settled(nodes.select(*k, node, F.col(node).alias("root")).distinct())
    for _ in range(PASSES):
        near = both.join(now.select(*k, F.col(node).alias("b"), "root"), [*k, "b"]).groupBy(*k, "a").agg(F.min("root").alias("near"))
        step = now.join(near.withColumnRenamed("a", node), [*k, node], "left").select(*k, node, F.least("root", "near").alias("next"), F.col("root").alias("was"))
        up = step.select(*k, F.col(node).alias("next"), F.col("next").alias("up"))
        step = settled(step.join(up, [*k, "next"], "left").select(*k, node, F.coalesce("up", "next").alias("root"), "was"))
        now = step.drop("was")
        if step.where("root <> was").isEmpty():
            return now
    raise RuntimeError("components did not settle")


def similar_components(faces: DataFrame, least: float) -> DataFrame:
    """(event_id, row_ix, root): components of an event's faces over pairs of cosine >= least. The stars of an event
    of one block are its components already; others are joined over their cells."""
    found = settled(stars(faces, least))
    nodes = faces.select("event_id", "row_ix").distinct()
    large = blocks_of(faces.select("event_id", "row_ix")).where("blocks > 1").select("event_id").distinct()
    if large.isEmpty():
        rows = nodes.join(found.withColumnRenamed("a", "row_ix"), ["event_id", "row_ix"], "left")
        return rows.select("event_id", "row_ix", F.coalesce("b", "row_ix").alias("root"))
    return components(nodes, found)


def canonical_pairs(pairs: DataFrame, keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Undirected pairs (a <= b), each once, with the first seq at which it occurred; self pairs are dropped."""
    return pairs.where("a <> b").groupBy(*keys, "kind", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("seq").alias("seq"))


def greedy_matching(pairs: DataFrame, order: list, keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """One-to-one matching of (keys, left, right) in the given total order: the pairs that a walk down the order would
    take. A pair that is first for both its sides is taken by that walk whatever happens elsewhere, so each round takes
    all such pairs of all keys at once and drops what they block."""
    k = list(keys)
    left = settled(pairs.withColumn("pos", F.row_number().over(Window.partitionBy(*k).orderBy(*order))))
    taken = None
    while not left.isEmpty():
        first = left.withColumn("l1", F.min("pos").over(Window.partitionBy(*k, "left"))).withColumn("r1", F.min("pos").over(Window.partitionBy(*k, "right")))
        now = settled(first.where("pos = l1 AND pos = r1").drop("l1", "r1"))
        taken = now if taken is None else taken.unionByName(now)
        left = settled(left.join(now.select(*k, "left"), [*k, "left"], "left_anti").join(now.select(*k, "right"), [*k, "right"], "left_anti"))
    return (pairs.withColumn("pos", F.lit(0)).limit(0) if taken is None else taken).drop("pos")
