"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder: spark.checkpoint.dir; where that is unset, one in the warehouse, or in local mode, where
    driver and executors are one process, a temporary one."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isEmpty():
        return sc.getConf().get("spark.checkpoint.dir") or current.get()
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        local = sc.master.startswith("local")
        folder = tempfile.mkdtemp(prefix="aerotrace-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/aerotrace-checkpoints"
    sc.setCheckpointDir(folder)
    return folder
