"""Corrections by people as pairs of faces, and the upkeep of an event's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_chain(members: DataFrame, merged: DataFrame) -> DataFrame:
    """Must-links for merges (event_id, cluster, target): neighbours, by row, of all faces that become one cluster."""
    rows = members.join(merged, ["event_id", "cluster"])
    after = F.lead("face_id").over(Window.partitionBy("event_id", "target").orderBy("row_ix", "face_id"))
    return rows.withColumn("b", after).where("b IS NOT NULL").select("event_id", F.lit("must").alias("kind"), F.col("face_id").alias("a"), "b")


def split_links(groups: DataFrame) -> DataFrame:
    """For splits (event_id, cluster, grp, row_ix, face_id): a must chain in each group, cannot-links between the
    groups' first faces."""
    w = Window.partitionBy("event_id", "cluster", "grp").orderBy("row_ix", "face_id")
    must = groups.withColumn("b", F.lead("face_id").over(w)).where("b IS NOT NULL").select("event_id", F.lit("must").alias("kind"), F.col("face_id").alias("a"), "b")
    return must.union(distinct_links(groups.withColumn("one", F.row_number().over(w)).where("one = 1").select("event_id", F.col("cluster").alias("within"), "row_ix", "face_id")))


def distinct_links(firsts: DataFrame) -> DataFrame:
    """Cannot-links between all faces (event_id, within, row_ix, face_id) of one statement that they are different."""
    a, b = (firsts.select("event_id", "within", F.col("row_ix").alias(f"{p}_ix"), F.col("face_id").alias(p)) for p in "ab")
    return a.join(b, ["event_id", "within"]).where("a_ix < b_ix").select("event_id", F.lit("cannot").alias("kind"), "a", "b")


def reassign_links(members: DataFrame, moves: DataFrame) -> DataFrame:
    """For moves (event_id, photo_id, cluster, target): the photo's face is tied to the target's first face and kept
    from the source's first remaining one."""
    first = members.withColumn("one", F.row_number().over(Window.partitionBy("event_id", "cluster").orderBy("row_ix")))
    face = members.join(moves, ["event_id", "photo_id", "cluster"]).select("event_id", "cluster", "target", F.col("face_id").alias("a"), F.col("photo_id").alias("moved"))
    to = first.where("one = 1").select("event_id", F.col("cluster").alias("target"), F.col("face_id").alias("b"))
    must = face.join(to, ["event_id", "target"]).select("event_id", F.lit("must").alias("kind"), "a", "b")
    # The first face on another photo is the cluster's first, or else the first that is not on that one's photo.
    known, least = members.where("photo_id IS NOT NULL"), F.min(F.struct("row_ix", "face_id", "photo_id"))
    one = known.groupBy("event_id", "cluster").agg(least.alias("one"))
    two = known.join(one, ["event_id", "cluster"]).where("photo_id <> one.photo_id").groupBy("event_id", "cluster").agg(least.alias("two"))
    rest = face.select("event_id", "cluster", "moved", "a").distinct().join(one, ["event_id", "cluster"]).join(two, ["event_id", "cluster"], "left")
    b = F.when(F.col("one.photo_id") != F.col("moved"), F.col("one.face_id")).otherwise(F.col("two.face_id"))
    cannot = rest.withColumn("b", b).where("b IS NOT NULL").select("event_id", F.lit("cannot").alias("kind"), "a", "b")
    return must.union(cannot).where("a <> b")


def without_photos(faces: DataFrame, gone: DataFrame) -> DataFrame:
    return faces.join(gone.select("event_id", "photo_id").distinct(), ["event_id", "photo_id"], "left_anti")


def living_pairs(pairs: DataFrame, faces: DataFrame) -> DataFrame:
    """Pairs both of whose faces are still there."""
    live = faces.select("event_id", "face_id").distinct()
    out = pairs.join(live.withColumnRenamed("face_id", "a"), ["event_id", "a"], "left_semi")
    return out.join(live.withColumnRenamed("face_id", "b"), ["event_id", "b"], "left_semi")


def appended(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rows and those of photos not stored yet, numbered after each event's last row."""
    order = [c for c in ("row_ix", "face_id") if c in new.columns]
    fresh = new.join(stored.select("event_id", "photo_id").distinct(), ["event_id", "photo_id"], "left_anti")
    last = stored.groupBy("event_id").agg(F.max("row_ix").alias("last"))
    fresh = fresh.join(last, "event_id", "left").withColumn("row_ix", F.coalesce(F.col("last") + 1, F.lit(0)) + F.row_number().over(Window.partitionBy("event_id").orderBy(*order)) - 1)
    return stored.unionByName(fresh.drop("last"), allowMissingColumns=True)


def violations(faces: DataFrame, pairs: DataFrame) -> DataFrame:
    """(event_id, rule, item) of every broken rule on rows and pairs: none for a sound event."""
    n = F.sqrt(F.aggregate("v", F.lit(0.0), lambda m, x: m + x * x))
    bad = lambda df, rule, item, where: df.where(where).select("event_id", F.lit(rule).alias("rule"), F.col(item).cast("string").alias("item"))
    rows = bad(faces, "empty_face_id", "row_ix", (F.coalesce("face_id", F.lit("")) == ""))
    rows = rows.union(bad(faces, "empty_photo_id", "row_ix", F.coalesce("photo_id", F.lit("")) == ""))
    rows = rows.union(bad(faces, "not_unit", "face_id", F.coalesce(F.abs(n - 1) > 1e-3, F.lit(True))))
    rows = rows.union(bad(faces, "bad_width", "face_id", F.coalesce((F.col("face_width") < 0) | F.isnan("face_width"), F.lit(True))))
    rows = rows.union(bad(faces.groupBy("event_id", "face_id").agg(F.count("*").alias("n")), "repeated_face_id", "face_id", F.col("n") > 1))
    named = pairs.withColumn("item", F.concat_ws("|", "a", "b"))
    rows = rows.union(bad(named, "self_pair", "item", F.col("a") == F.col("b")))
    lost = named.join(living_pairs(named, faces).select("event_id", "a", "b").distinct(), ["event_id", "a", "b"], "left_anti")
    return rows.union(bad(lost, "unknown_face", "item", F.lit(True)))
