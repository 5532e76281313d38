"""Inbound messages: one schema for all kinds, checks as predicates, poison kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MESSAGE = """type string, job_id string, group_id string, event_id string, action string,
    images array<struct<image_id:string, s3_key:string>>, options struct<exclude_eyes_closed:boolean, exclude_blurry:boolean>,
    merge struct<target_cluster_id:string, source_cluster_ids:array<string>>, split struct<cluster_id:string, groups:array<array<string>>>,
    reassign struct<image_id:string, from_cluster_id:string, to_cluster_id:string>, confirm_distinct struct<cluster_ids:array<string>>,
    image_ids array<string>"""
TYPES = ("classify_request", "cluster_feedback", "delete_request")


def problem(m):
    """The first broken rule of a parsed message, or null."""
    text = lambda c: F.coalesce(F.length(c), F.lit(0)) > 0
    ids = F.transform(m["images"], lambda x: x["image_id"])
    repeated = lambda a: F.size(F.array_distinct(a)) < F.size(a)
    # An id in two groups of a split; repeats inside one group are harmless.
    spread = F.flatten(F.transform(m["split"]["groups"], lambda g: F.array_distinct(g)))
    return (
        F.when(m.isNull(), "not_json")
        .when(~F.coalesce(m["type"].isin(*TYPES), F.lit(False)), "unknown_type")
        .when(~text(m["job_id"]), "no_job_id")
        .when(~text(m["event_id"]), "no_event_id")
        .when((m["type"] == "classify_request") & F.coalesce(F.size(m["images"]) < 1, F.lit(True)), "no_images")
        .when((m["type"] == "classify_request") & F.exists(ids, lambda x: ~text(x)), "no_image_id")
        .when((m["type"] == "classify_request") & repeated(ids), "repeated_image")
        .when((m["type"] == "delete_request") & F.coalesce(F.size(m["image_ids"]) < 1, F.lit(True)), "no_images")
        .when((m["type"] == "cluster_feedback") & ~F.coalesce(m["action"].isin("merge", "split", "reassign", "confirm_distinct"), F.lit(False)), "unknown_action")
        .when((m["action"] == "merge") & F.coalesce(F.size(m["merge"]["source_cluster_ids"]) < 1, F.lit(True)), "no_sources")
        .when((m["action"] == "merge") & F.array_contains(m["merge"]["source_cluster_ids"], m["merge"]["target_cluster_id"]), "merge_into_itself")
        .when((m["action"] == "split") & F.coalesce(F.size(m["split"]["groups"]) < 2, F.lit(True)), "no_groups")
        .when((m["action"] == "split") & repeated(spread), "overlapping_groups")
        .when((m["action"] == "reassign") & F.coalesce(m["reassign"]["from_cluster_id"] == m["reassign"]["to_cluster_id"], F.lit(True)), "no_move")
        .when((m["action"] == "confirm_distinct") & F.coalesce(F.size(m["confirm_distinct"]["cluster_ids"]) < 2, F.lit(True)), "too_few_clusters")
        .when((m["action"] == "confirm_distinct") & repeated(m["confirm_distinct"]["cluster_ids"]), "repeated_cluster")
    )


def parsed(raw: DataFrame, column: str = "raw") -> DataFrame:
    """`raw` with `message` (null if poison), `problem`, and `job_id` as far as it can be told."""
    m = F.from_json(F.col(column), MESSAGE)
    rows = raw.withColumn("_m", m)
    rows = rows.withColumn("_m", F.when(F.coalesce(F.get_json_object(column, "$"), F.lit("")).startswith("{"), F.col("_m")))
    rows = rows.withColumn("problem", problem(F.col("_m")))
    quoted = F.col(column).rlike(r'"job_id"\s*:\s*"[^"]')
    return rows.select(*raw.columns, F.when(F.col("problem").isNull(), F.col("_m")).alias("message"), "problem", F.when(quoted, F.get_json_object(column, "$.job_id")).alias("job_id"))
