"""Aggregates of clusters and the set-based steps of a clustering pass. Tables hold event_id, row_ix, face_id, v and a
cluster column. Sums of vectors take one position each; their number is read from the rows unless it is given."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from albumweave.functions.vectors import dot, mean_vector, normalised, sum_vector
from albumweave.operators.config import Thresholds
from albumweave.operators.graph import settled
from albumweave.operators.pairs import Cell, blocks_of, in_cells, matrix

T = Thresholds()


def vector_size(faces: DataFrame, dims: int | None = None) -> int:
    """The one length of the vectors, 0 for an empty table; vectors of several lengths are an error."""
    if dims is not None:
        return dims
    low, high = faces.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if low != high:
        raise ValueError(f"vectors of {low} to {high} components")
    return low or 0


def centroids(faces: DataFrame, cluster: str = "cluster", dims: int | None = None) -> DataFrame:
    """The normalised mean of each cluster, or its first member where the mean is zero."""
    dims = vector_size(faces, dims)
    first = F.min_by("v", "row_ix")
    out = faces.groupBy("event_id", F.col(cluster).alias("cluster")).agg(mean_vector("v", dims).alias("mean"), first.alias("first"), F.count("*").alias("n"), F.min("row_ix").alias("first_ix"))
    return out.select("event_id", "cluster", "n", "first_ix", F.coalesce(normalised("mean"), "first").alias("centroid"))


def leave_one_out(faces: DataFrame, cluster: str = "cluster", dims: int | None = None) -> DataFrame:
    """Each face's cosine with the sum of the other members: 1 for a single member or a zero sum. Sums are made before
    the shuffle and joined back, so that a large cluster is no single task."""
    dims = vector_size(faces, dims)
    sums = faces.groupBy("event_id", F.col(cluster).alias("cluster")).agg(sum_vector("v", dims).alias("total"), F.count("*").alias("n"))
    rows = faces.withColumn("cluster", F.col(cluster)).join(sums, ["event_id", "cluster"])
    rest = F.zip_with("total", "v", lambda s, x: s - x)
    size = F.sqrt(dot(rest, rest))
    value = F.when((F.col("n") > 1) & (size > 1e-12), dot(rest, "v") / F.nullif(size, F.lit(0.0))).otherwise(F.lit(1.0))
    return rows.withColumn("loo", value).drop("total")


def fragment_means(faces: DataFrame, cluster: str = "cluster", floor: float = T.merge_pair_mean, centroid_floor: float = T.merge_centroid, dims: int | None = None) -> DataFrame:
    """Pairs of clusters near enough to merge: centroids, and the mean over all cross pairs of faces. The mean of the
    dot products is the dot product of the mean vectors, so no pair of faces is made."""
    means = faces.groupBy("event_id", F.col(cluster).alias("cluster")).agg(mean_vector("v", vector_size(faces, dims)).alias("mean"), F.min("row_ix").alias("first_ix"))
    means = means.withColumn("centroid", normalised("mean"))
    a, b = (means.select("event_id", *(F.col(c).alias(f"{p}_{c}") for c in ("cluster", "mean", "centroid", "first_ix"))) for p in "ab")
    pairs = a.join(b, "event_id").where("a_first_ix < b_first_ix").select("event_id", "a_cluster", "b_cluster", dot("a_centroid", "b_centroid").alias("centroid_similarity"), dot("a_mean", "b_mean").alias("pair_mean"))
    return pairs.where((F.col("centroid_similarity") >= centroid_floor) & (F.col("pair_mean") >= floor))


def to_centroids(faces: DataFrame, cents: DataFrame, least: float = -2.0) -> DataFrame:
    """Every face with every cluster of its event that it is at least so similar to. A block of an event's faces meets
    all its clusters in one matrix product; clusters are far fewer than faces."""
    rows = blocks_of(faces)
    blocks = rows.select("event_id", "blocks", "block").distinct()
    own = cents.select("event_id", F.col("cluster").alias("to"), "centroid").join(blocks.select("event_id", "block"), "event_id")
    own = own.select(F.col("event_id").alias("in_event"), F.col("block").alias("in_block"), "to", "centroid")
    keep = list(faces.columns)
    schema = T_.StructType([*faces.schema.fields, T_.StructField("to", cents.schema["cluster"].dataType), T_.StructField("similarity", T_.DoubleType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        s = matrix(left.column("v")) @ matrix(right.column("centroid")).T if left.num_rows and right.num_rows else np.empty((left.num_rows, right.num_rows))
        p, q = np.nonzero(s >= least)
        made = left.select(keep).take(pa.array(p))
        return made.append_column("to", right.column("to").take(pa.array(q))).append_column("similarity", pa.array(s[p, q], pa.float64()))

    return rows.groupBy("event_id", "block").cogroup(own.groupBy("in_event", "in_block")).applyInArrow(run, schema)


def rescue_candidates(noise: DataFrame, cents: DataFrame, least: float = T.rescue) -> DataFrame:
    return to_centroids(noise, cents, least).select("event_id", "face_id", F.col("to").alias("cluster"), "similarity")


def margin_candidates(noise: DataFrame, cents: DataFrame, floor: float = T.margin_floor, ratio: float = T.margin_ratio) -> DataFrame:
    """The best cluster where it clearly leads the second; events of one cluster give nothing."""
    rank = Window.partitionBy("event_id", "face_id").orderBy(F.desc("similarity"), "to")
    ranked = to_centroids(noise, cents).withColumn("rank", F.row_number().over(rank)).withColumn("second", F.lead("similarity").over(rank))
    lead = F.col("similarity") >= ratio * F.greatest("second", F.lit(0.0))
    return ranked.where((F.col("rank") == 1) & F.col("second").isNotNull() & (F.col("similarity") >= floor) & lead).select("event_id", "face_id", F.col("to").alias("cluster"), "similarity", "second")


def evictions(faces: DataFrame, cluster: str = "cluster", t: Thresholds = T, protected: DataFrame | None = None, linked: DataFrame | None = None, dims: int | None = None) -> DataFrame:
    """member, noise or ambiguous for each face of a cluster, from one snapshot. Pairs are made only for members in the
    grey zone. Faces that a person named (`protected`: event_id, face_id) stay members; clusters that a person keeps
    apart (`linked`: event_id, cluster, other, both ways) are no rivals of each other."""
    dims = vector_size(faces, dims)
    loo = leave_one_out(faces, cluster, dims)
    others = to_centroids(loo, centroids(faces, cluster, dims)).where("to <> cluster").select("event_id", "face_id", "cluster", "to", "similarity")
    if linked is not None:
        others = others.join(linked.select("event_id", "cluster", F.col("other").alias("to")), ["event_id", "cluster", "to"], "left_anti")
    others = others.groupBy("event_id", "face_id").agg(F.max("similarity").alias("other"))
    low = (F.col("n") > 1) & (F.col("loo") >= t.membership) & (F.col("loo") < t.grey_ceiling) & F.lit(t.grey_pair > 0)
    grey = loo.where(low).select("event_id", "cluster", "face_id", F.col("v").alias("own_v"))
    mates = faces.select("event_id", F.col(cluster).alias("cluster"), F.col("face_id").alias("mate"), "v")
    best = grey.join(mates, ["event_id", "cluster"]).where("mate <> face_id").groupBy("event_id", "face_id").agg(F.max(dot("own_v", "v")).alias("best_pair"))
    rows = loo.join(others, ["event_id", "face_id"], "left").join(best, ["event_id", "face_id"], "left")
    safe = F.lit(False)
    if protected is not None:
        rows = rows.join(protected.select("event_id", "face_id", F.lit(True).alias("safe")).distinct(), ["event_id", "face_id"], "left")
        safe = F.coalesce("safe", F.lit(False))
    status = (
        F.when((F.col("n") == 1) | safe, "member")
        .when(F.col("loo") < t.membership, "noise")
        .when((F.col("loo") < t.grey_ceiling) & (F.col("best_pair") < t.grey_pair), "noise")
        .when(F.col("loo") - F.col("other") < t.membership_margin, "ambiguous")
        .otherwise("member")
    )
    return rows.select("event_id", "face_id", "cluster", "loo", status.alias("status"))


def core_distances(faces: DataFrame, k: int = T.min_samples) -> DataFrame:
    """The k-th smallest cosine distance of each face in its event, its own 0 included; null in a smaller event. A cell
    hands on the k - 1 least of each row."""
    if k == 1:
        return faces.select("event_id", "face_id", F.lit(0.0).alias("core"))

    def run(cell: Cell) -> pa.Table:
        d, parts = cell.distance(), []
        for side, rows in ((cell.left, d), (cell.right, d.T))[: 1 if cell.same else 2]:
            if k == 2:
                near = pa.array(rows.min(1, initial=np.inf))
            else:
                near = np.partition(rows, min(k - 2, rows.shape[1] - 1), 1)[:, : k - 1] if rows.size else rows[:, :0]
                near = pa.array(list(near), pa.list_(pa.float64()))
            parts.append(pa.table({"event_id": cell.rows.column("event_id").take(pa.array(side)), "face_id": cell.rows.column("face_id").take(pa.array(side)), "near": near}))
        return pa.concat_tables(parts)

    one = T_.DoubleType()
    schema = T_.StructType([faces.schema["event_id"], faces.schema["face_id"], T_.StructField("near", one if k == 2 else T_.ArrayType(one))])
    # The least distances of all cells of a face: one alone is merged before the shuffle, a list would be moved for each cell.
    least = F.min("near") if k == 2 else F.get(F.array_sort(F.flatten(F.collect_list("near"))), F.lit(k - 2))
    kth = in_cells(faces, run, schema).groupBy("event_id", "face_id").agg(least.alias("core"))
    return kth.select("event_id", "face_id", F.when(F.col("core") <= 2, F.col("core")).alias("core"))


def with_core(faces: DataFrame, k: int = T.min_samples) -> DataFrame:
    """Faces with their core distances, which are made once however often the table is read."""
    return faces.select("event_id", "row_ix", "face_id", "v").join(settled(core_distances(faces, k)), ["event_id", "face_id"])


def reach_of(cell: Cell) -> np.ndarray:
    """Mutual reachability of a cell's pairs: the greatest of the distance and both core distances."""
    core = cell.rows.column("core").to_pandas().to_numpy(np.float64, na_value=np.inf)
    return np.maximum(cell.distance(), np.maximum(core[cell.left][:, None], core[cell.right]))


def mutual_reachability(faces: DataFrame, k: int = T.min_samples) -> DataFrame:
    """For each face the least of max(core, core of the other, distance), over the other faces of its event."""

    def run(cell: Cell) -> pa.Table:
        r, parts = reach_of(cell), []
        for side, rows in ((cell.left, r), (cell.right, r.T))[: 1 if cell.same else 2]:
            parts.append(pa.table({"event_id": cell.rows.column("event_id").take(pa.array(side)), "face_id": cell.rows.column("face_id").take(pa.array(side)), "reach": pa.array(rows.min(1, initial=np.inf))}))
        return pa.concat_tables(parts)

    schema = T_.StructType([faces.schema["event_id"], faces.schema["face_id"], T_.StructField("reach", T_.DoubleType())])
    return in_cells(with_core(faces, k), run, schema, ("core",)).groupBy("event_id", "face_id").agg(F.min("reach").alias("reach")).where(F.col("reach") <= 2)


def overlaps(now: DataFrame, before: DataFrame) -> DataFrame:
    """Jaccard similarity of new and old clusters, tables (event_id, face_id, cluster), that share a face."""
    shared = now.select("event_id", "face_id", F.col("cluster").alias("left")).join(before.select("event_id", "face_id", F.col("cluster").alias("right")), ["event_id", "face_id"])
    both = shared.groupBy("event_id", "left", "right").agg(F.count("*").alias("shared"))
    size = lambda df, c: df.groupBy("event_id", F.col("cluster").alias(c)).agg(F.count("*").alias(f"{c}_n"))
    both = both.join(size(now, "left"), ["event_id", "left"]).join(size(before, "right"), ["event_id", "right"])
    union: Column = F.col("left_n") + F.col("right_n") - F.col("shared")
    return both.select("event_id", "left", "right", "shared", (F.col("shared") / union).alias("jaccard"))
