"""Tables that a plan writes once and reads again, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows up to which a counted table of narrow rows is broadcast.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set")
    folder = "file://" + tempfile.mkdtemp(prefix="laxity-work-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialised(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/laxity-table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
