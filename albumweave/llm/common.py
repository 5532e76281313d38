"""Shared helpers: table access, the cluster's shared folder, and array files in it."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Code points that separate words: space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is configured."""
    conf = spark.sparkContext.getConf()
    where = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
        where = os.path.dirname(where) if where else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.sparkContext.setCheckpointDir(where)
    return where if "://" in where or where.startswith("file:") else "file://" + os.path.abspath(where)


#: Folders of working tables by whom they were made for; those of no owner stay until the driver's JVM ends.
_WORKING: dict[str, list[str]] = {}
_OWNER: ContextVar[str | None] = ContextVar("owner", default=None)


@contextmanager
def owned(owner: str) -> Iterator[None]:
    """Working tables made inside belong to `owner`, who may `release` them."""
    token = _OWNER.set(owner)
    try:
        yield
    finally:
        _OWNER.reset(token)


def new_folder(spark: SparkSession, what: str, working: bool = True) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends, or by its owner's `release` if it is a
    working one."""
    uri = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    if working and _OWNER.get() is not None:
        _WORKING.setdefault(_OWNER.get(), []).append(uri)
    return uri


def release(spark: SparkSession, owner: str) -> None:
    """Drop the working tables of an owner, and no others: only once the results that read them are written."""
    for uri in _WORKING.pop(owner, []):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, what: str = "table", working: bool = True) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage."""
    spark = df.sparkSession
    uri = new_folder(spark, what, working)
    df.write.mode("overwrite").parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def local_path(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[len("file:") :].lstrip("/")
    return uri if "://" not in uri else None


def put(uri: str, name: str, data) -> str:
    """Write one file of the shared folder from a task: a private name first, then a rename, so retries are safe."""
    folder, own = local_path(uri), f".{name}.{uuid.uuid4().hex}"
    if folder is not None:
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{own}", "wb") as f:
            f.write(data)
        os.replace(f"{folder}/{own}", f"{folder}/{name}")
        return f"{uri}/{name}"
    from pyarrow import fs as pfs

    fs, path = pfs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{own}") as f:
        f.write(data)
    fs.move(f"{path}/{own}", f"{path}/{name}")
    return f"{uri}/{name}"


def get(uri: str) -> bytes:
    path = local_path(uri)
    if path is not None:
        with open(path, "rb") as f:
            return f.read()
    from pyarrow import fs as pfs

    fs, path = pfs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def mapped(uri: str, dtype) -> np.ndarray:
    """An array file as a read-only memory map. A remote file is first copied to the worker's own disk; the copy has no
    name any more once it is mapped, so that nothing is left behind."""
    path = local_path(uri)
    if path is not None:
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
    data = get(uri)
    if not data:
        return np.empty(0, dtype)
    with tempfile.TemporaryFile() as f:
        f.write(data)
        f.flush()
        return np.memmap(f, dtype=dtype, mode="r")
