"""The tables of events: one folder per event_id, whole events overwritten, older files read with defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOX = T.StructType([T.StructField(k, T.DoubleType()) for k in ("x", "y", "w", "h")])
FACES = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("row_ix", T.LongType()),
        T.StructField("face_id", T.StringType()),
        T.StructField("photo_id", T.StringType()),
        T.StructField("v", T.ArrayType(T.FloatType())),
        T.StructField("cluster_id", T.StringType()),
        T.StructField("face_width", T.DoubleType()),
        T.StructField("bbox", BOX),
        T.StructField("source_key", T.StringType()),
        T.StructField("image_long_side", T.DoubleType()),
    ]
)
CONSTRAINTS = T.StructType([T.StructField(n, t) for n, t in (("event_id", T.StringType()), ("kind", T.StringType()), ("seq", T.LongType()), ("a", T.StringType()), ("b", T.StringType()))])
SCORES = T.StructType([T.StructField(n, t) for n, t in (("event_id", T.StringType()), ("source_face_id", T.StringType()), ("rep_face_id", T.StringType()), ("similarity", T.DoubleType()))])
#: What a column holds in files that were written before it existed: unknown.
DEFAULTS = {"cluster_id": None, "face_width": 0.0, "bbox": None, "source_key": "", "image_long_side": 0.0}


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, schema: T.StructType = FACES, event_id: str | None = None) -> DataFrame:
    """The stored table, or one event of it (only its folder is read); an empty one if nothing is stored. Columns that
    older files lack take their defaults; files that can't be decoded fail the read and are left as they are."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return empty(spark, schema)
    df = spark.read.schema(schema).parquet(path)
    if event_id is not None:
        df = df.where(F.col("event_id") == event_id)
    return completed(df).select(*schema.fieldNames())


def completed(df: DataFrame) -> DataFrame:
    """Columns that older files lack, at their defaults."""
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items() if c in df.columns and v is not None})


def overwrite(df: DataFrame, path: str) -> None:
    """Replace the events that occur in `df`; other events stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_id").parquet(path)


def remove(spark: SparkSession, path: str, event_ids: list[str]) -> None:
    """Drop whole events: an overwrite with no rows leaves an event as it is."""
    for event_id in event_ids:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, f"event_id={event_id}")
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def encoded_scores(scores: DataFrame) -> DataFrame:
    """One JSON text per event, pairs in order, so that equal caches give equal bytes."""
    entry = F.struct("source_face_id", "rep_face_id", "similarity")
    return scores.groupBy("event_id").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("body"))


def decoded_scores(texts: DataFrame) -> DataFrame:
    """The pairs of (event_id, body); a broken body is an empty cache."""
    kind = "array<struct<source_face_id:string,rep_face_id:string,similarity:double>>"
    rows = texts.select("event_id", F.explode(F.from_json("body", kind)).alias("x"))
    return rows.select("event_id", "x.*").where("source_face_id IS NOT NULL AND rep_face_id IS NOT NULL AND similarity IS NOT NULL")


def encoded_verdicts(verdicts: DataFrame) -> DataFrame:
    labels = F.map_from_entries(F.array_sort(F.map_entries("labels")))
    entry = F.struct("face_id", "nonhuman", "rule", labels.alias("labels"), "n_faces")
    # Maps have no order to sort by: entries are ordered by a key beside them.
    keyed = F.sort_array(F.collect_list(F.struct(F.col("face_id").alias("k"), F.to_json(entry).alias("j"))))
    return verdicts.groupBy("event_id").agg(F.concat(F.lit("["), F.array_join(F.transform(keyed, lambda x: x["j"]), ","), F.lit("]")).alias("body"))


def decoded_verdicts(texts: DataFrame) -> DataFrame:
    kind = "array<struct<face_id:string,nonhuman:boolean,rule:string,labels:map<string,double>,n_faces:int>>"
    return texts.select("event_id", F.explode(F.from_json("body", kind)).alias("x")).select("event_id", "x.*").where("face_id IS NOT NULL AND nonhuman IS NOT NULL")


def thumbnail_key(prefix: str, event_id: str = "event_id", cluster_id: str = "cluster_id"):
    return F.concat(F.lit(prefix), F.col(event_id), F.lit("/"), F.col(cluster_id), F.lit(".jpg"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, error): files that can't be read are rows with an error, not a failed job."""
    df = spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").load(path)
    return df.select("path", "content", F.when(F.coalesce(F.length("content"), F.lit(0)) == 0, "empty").alias("error"))
