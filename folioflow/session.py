"""Session helpers shared by every operator: lineage cuts, table access, page de-duplication."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; Catalyst prunes its columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where it is unset, a session within one machine (tests) gets a temporary folder; a cluster's is an error, for a folder of the
    driver's machine is none of the executors'.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="folioflow-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a written table in the shared folder.

    It is computed once (a checkpoint computes its rows twice), is columnar, has a size the planner knows, and survives the
    loss of executors. It is deleted when the session's driver ends, for the frame may be read until then.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, scan: bool = True) -> DataFrame:
    """Give CPU-heavy Arrow functions enough tasks where there would be fewer than three a core.

    A compressed split, or a shuffle partition that the adaptive planner has merged, holds far more work for a Python function than for
    a scan. A scan that has tasks enough (any large table) is left alone, so no shuffle is added there. With ``scan`` false the
    frame holds a shuffle: its partitions cannot be counted without running it, so it is spread anyway.
    """
    spark = df.sparkSession
    wanted = spark.sparkContext.defaultParallelism * 3
    if scan and df._jdf.queryExecution().toRdd().getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted if scan else max(wanted, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of one key together, over as many tasks as the session asks for: the adaptive planner merges partitions by their bytes, but here a byte is much work for Python."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism * 3, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def first_delivery(pages: DataFrame, *columns: str, texts: bool = True) -> DataFrame:
    """One row per page_id, whatever number of times it was delivered; the smallest row_id wins.

    Narrow columns (``texts`` false) are one aggregate with map-side combine. With texts only ids are grouped: the later deliveries are found on two narrow columns and written, so the planner knows their
    size, and are then taken out. Texts are not shuffled to drop a few copies unless the copies are many. Rows
    without a page_id are one page. Rows that repeat a row_id too are told apart by nothing, so one of them is kept.
    """
    first = [F.min_by(c, F.coalesce("row_id", F.lit(2**63 - 1))).alias(c) for c in columns]
    if not texts:
        return pages.groupBy("page_id").agg(*first)
    ids = pages.select("page_id", "row_id")
    several = ids.groupBy(F.col("page_id").alias("p")).agg(F.min("row_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = cut(ids.join(several, F.col("page_id").eqNullSafe(F.col("p"))).select("page_id", "row_id", "first"))
    untold = later.groupBy("page_id").agg(F.count_if(F.col("row_id").isNull()).alias("bare"), F.count_if(F.col("row_id") == F.col("first")).alias("same")).where("bare > 0 or same > 1")
    if untold.isEmpty():
        return pages.join(later.where("row_id <> first").select("row_id"), "row_id", "left_anti").select("page_id", *columns)
    return pages.groupBy("page_id").agg(*first)
