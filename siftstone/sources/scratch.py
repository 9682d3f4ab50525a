"""Tables written in the folder that all executors share.

They cut a lineage as a checkpoint does, but are columns on disk: computed once, read by
column, and still there when executors are lost.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the checkpoint folder that the context already has.
    Only where neither is set and the master is local (tests, one machine) a temporary folder
    is made; on a cluster each executor would write to a folder of its own."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="siftstone-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(at)
    return at


_made: list[tuple[SparkSession, str]] = []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Spark's file system, whatever store it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session has ended before the interpreter
            return


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/siftstone/{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def cut(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table written in the shared folder."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("maxRecordsPerFile", 0).parquet(path)  # one file for each task, its rows in their order
    out = spark.read.schema(df.schema).parquet(path)
    out._siftstone_path = path
    return out


def placed(table: DataFrame) -> DataFrame:
    """A table of :func:`cut` with ``place`` (long): each row's place, from 0, in the order in
    which it was written, task by task.  Only one row for each task is summed up."""
    file = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    lain = table.select("*", file.alias("_part"), F.col("_metadata.row_index").alias("_row"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = lain.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return lain.join(parts, "_part").withColumn("place", F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def in_order(df: DataFrame, *by: str, tag: str) -> DataFrame:
    """``df`` written in the order of some columns, with ``place``: no task sorts more than its
    share, also where one value of the first column holds most rows."""
    return placed(cut(df.repartitionByRange(*by).sortWithinPartitions(*by), tag))


#: Rows of one group that a window sorts in a task; larger groups are ranked by their places in a written order.
HOT_GROUP = 1 << 20


def numbered(df: DataFrame, group: str, by: str, tag: str, hot_group: int = HOT_GROUP) -> DataFrame:
    """``df`` with ``k``: each row's number, from 1, within its group in the order of ``by``.

    Groups are counted first.  Those that one task can sort are ranked by a window; only the rows of
    larger ones are written in order, where ranks are places less the group's first.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_group).select(group)
    hot = cut(sizes, f"{tag}-hot")
    turn = F.row_number().over(Window.partitionBy(group).orderBy(by)).cast("long")
    if hot.isEmpty():
        return df.withColumn("k", turn)
    few = df.join(hot, group, "left_anti").withColumn("k", turn)
    lain = in_order(df.join(hot, group, "left_semi"), group, by, tag=tag)
    first = lain.groupBy(group).agg(F.min("place").alias("_first"))
    return few.unionByName(lain.join(first, group).withColumn("k", F.col("place") - F.col("_first") + 1).drop("place", "_first"))


def drop(df: DataFrame) -> None:
    """Delete the table that :func:`cut` wrote, once nothing reads it any more."""
    path = getattr(df, "_siftstone_path", None)
    if path:
        remove(df.sparkSession, path)
