"""Tables of events that change together or not at all.

A change writes the events that it touches to a version of their own, root/<table>/version=<n>/event_id=<e>, and then the
manifest n, which says for each event the version that holds it. A manifest counts once its writer has marked it as
complete; the greatest such number is the state. A writer that dies before that leaves the state as it was, and its next
attempt writes over the remains. What neither the state nor the one before it needs is then swept away. There is one
writer at a time. A manifest holds an id and a number for each event; all else that a change writes or reads grows with
the events that it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "event_id string, version long"
#: How many states are kept.
KEPT = 2


def _folders(spark: SparkSession, path: str) -> tuple[object, list]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, [x.getPath() for x in fs.listStatus(where)] if fs.exists(where) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    """The complete manifests' numbers, in order."""
    fs, found = _folders(spark, f"{root}/manifest")
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName()) for p in found if p.getName().isdigit() and fs.exists(done(p, "_SUCCESS")))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(event_id, version) of the state, or of an earlier one that is still there."""
    if version is None:
        version = max(versions(spark, root), default=0)
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest/{version}") if version else spark.createDataFrame([], MANIFEST)


def read(spark: SparkSession, root: str, table: str, schema: T.StructType, touched: DataFrame | None = None) -> DataFrame:
    """A table of the state, or of the `touched` events (event_id) of it, whose versions alone are opened."""
    held = manifest(spark, root)
    if touched is None:
        paths = [f"{root}/{table}"] if not held.isEmpty() else []
    else:
        held = held.join(touched.select("event_id").distinct(), "event_id", "left_semi")
        paths = [f"{root}/{table}/version={r.version}" for r in held.select("version").distinct().collect()]  # a batch's events at most
    if not paths:
        return spark.createDataFrame([], schema)
    full = T.StructType([*schema.fields, T.StructField("version", T.LongType())])
    rows = spark.read.schema(full).option("basePath", f"{root}/{table}").parquet(*paths)
    return rows.join(held, ["event_id", "version"], "left_semi").select(*schema.fieldNames())


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], touched: DataFrame, alive: DataFrame | None = None) -> int:
    """Put what `tables` hold in place of the touched events' rows; those that are not `alive` (all, if not given) are
    gone. The new version's number."""
    before = versions(spark, root)
    n = max(before, default=0) + 1
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy("event_id").parquet(f"{root}/{name}/version={n}")
    touched = touched.select("event_id").distinct()
    now = touched if alive is None else touched.join(alive.select("event_id").distinct(), "event_id", "left_semi")
    held = manifest(spark, root).join(touched, "event_id", "left_anti").select("event_id", "version")
    held.union(now.select("event_id", F.lit(n).cast("long"))).write.mode("overwrite").parquet(f"{root}/manifest/{n}")
    sweep(spark, root, list(tables))
    return n


def sweep(spark: SparkSession, root: str, tables: list[str]) -> None:
    """Drop versions that the last states don't name."""
    kept = versions(spark, root)[-KEPT:]
    used = {r.version for n in kept for r in manifest(spark, root, n).select("version").distinct().collect()} | set(kept)
    for folder, number, stay in [("manifest", lambda x: x, set(kept)), *((t, lambda x: x.removeprefix("version="), used) for t in tables)]:
        fs, found = _folders(spark, f"{root}/{folder}")
        for path in found:
            name = number(path.getName())
            if name.isdigit() and int(name) not in stay:
                fs.delete(path, True)
