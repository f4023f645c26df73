"""Intermediate tables in the folder that the whole cluster shares, and objects sent to it by value."""

from __future__ import annotations

import pickle
import tempfile
import uuid
import weakref
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

#: The folder of each table that ``written`` made.
PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, one of our own for a local master; an error on a cluster, whose executors couldn't share it."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not (spark.conf.get("spark.master", "") or "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def written(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: the lineage ends there and every executor can read it."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (df if parts is None else df.coalesce(parts)).write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    PLACES[table] = path
    return table


def discarded(*tables: DataFrame) -> None:
    """Removes tables that ``written`` made and that nothing reads any more."""
    for table in tables:
        if path := PLACES.pop(table, None):
            place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def sent(spark: SparkSession, thing: Any) -> Callable[[], Any]:
    """A broadcast of ``thing`` by value, as a function for the executors: they need no copy of this package to read it."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    return lambda: pickle.loads(held.value)
