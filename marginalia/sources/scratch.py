"""Tables written to the cluster's shared folder and read back."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a session in one process (as in tests) gets a folder of its own; a cluster, whose executors would not see that, is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="marginalia-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written and read back: lineage is cut, and Spark plans joins by the true size."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def appended(df: DataFrame, path: str, number: int) -> DataFrame:
    """``df`` written as part ``number`` of the table in ``path``, in place of such a part if there is one; what comes back is all parts."""
    df.write.mode("overwrite").parquet(f"{path}/part={number}")
    return parts(df.sparkSession, path, df.schema, number + 1)


def parts(spark: SparkSession, path: str, schema: StructType | str, count: int) -> DataFrame:
    """The first ``count`` parts of a table that ``appended`` wrote; no part is an empty table."""
    paths = [f"{path}/part={i}" for i in range(count)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
