"""Folders for streams and logs that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir; where the session names none, beside the warehouse, or in local mode a temporary one."""
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not top:
        top = tempfile.mkdtemp(prefix="spark-") if re.match(r"local(\[|$)", sc.master) else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
