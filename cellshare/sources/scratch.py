"""Tables between the steps of iterative operators, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset and everything runs on one machine, a folder that goes with Python."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base and sc._jsc.sc().getCheckpointDir().isDefined():
        base = sc._jsc.sc().getCheckpointDir().get()
    if not base:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(sc, "_cellshare_local", None)
        if base is None:
            base = sc._cellshare_local = tempfile.mkdtemp(prefix="cellshare_")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base}/steps_{sc.applicationId}"


def settle(df: DataFrame) -> DataFrame:
    """``df`` as a written table: the lineage ends, and a lost executor costs nothing that was done before."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
