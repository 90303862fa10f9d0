"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from granary.model import GranaryError

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; in local mode, where one machine does it all, a temporary one if none is named."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise GranaryError("set spark.checkpoint.dir to a folder that all executors share")
        where = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="granary-")
        _LOCAL[spark.sparkContext.applicationId] = where
    return where.rstrip("/")
