"""Where jobs keep their checkpoints and intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_LOCAL_ROOTS: dict[str, str] = {}


def work_root(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only in local mode."""
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster has other processes
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="fleetlens-")
    return _LOCAL_ROOTS[app]


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path under the work root that no earlier run has used."""
    return f"{work_root(spark)}/{label}-{uuid.uuid4().hex}"
