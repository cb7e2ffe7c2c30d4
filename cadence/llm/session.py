"""What the operators share of Spark: lineage cuts, broadcast values, joins with a checked broadcast."""

from __future__ import annotations

import atexit
import os
import pickle
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of ids that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, which every executor can read.

    Where the session names none, as in tests on one machine, it is a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or os.path.join(tempfile.gettempdir(), "cadence-checkpoints")


_written: dict[str, SparkSession] = {}


def _delete(path: str) -> None:
    context = _written.pop(path).sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def _clean() -> None:
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the session has ended: the folder is the cluster's to clean
            return


def cut(df: DataFrame) -> DataFrame:
    """df written as a table to the shared folder and read from there on; the table goes with drop(), or when Python ends."""
    spark = df.sparkSession
    if not _written:
        atexit.register(_clean)
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    _written[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes the tables of results of cut() that nothing reads any more."""
    for table in tables:
        if table.cut_path in _written:
            _delete(table.cut_path)


def share(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A function that gives the value on any executor. Classes of this package travel by value."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def with_ids(df: DataFrame, ids: DataFrame, column: str, how: str = "left_semi", most: int = BROADCAST_ROWS) -> DataFrame:
    """df joined on column with ids, a short table that has been cut; ids is broadcast if its rows are at most `most`."""
    return df.join(F.broadcast(ids) if ids.count() <= most else ids, column, how)
