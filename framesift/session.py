"""A session with the settings that the engine's plans expect."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Ranking plans keep a bounded number of rows a group before the shuffle only up to this rank; the
#: largest top-k in use is 3000.
RANK_LIMIT = "10000"


def tune(spark: SparkSession) -> SparkSession:
    """Settings that only change how plans run, plus UTC."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.optimizer.windowGroupLimitThreshold": RANK_LIMIT,
    }.items():
        spark.conf.set(key, value)
    return spark


def session(name: str = "framesift", master: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    return tune((builder.master(master) if master else builder).getOrCreate())


def scratch(spark: SparkSession, name: str) -> str:
    """A path for a table of our own in the folder that the cluster shares (spark.checkpoint.dir); in a temporary folder
    only where that is unset and everything runs in one process."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="framesift-scratch-")
    return f"{shared.rstrip('/')}/framesift-{name}-{uuid.uuid4().hex}"
