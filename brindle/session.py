"""The session settings the library relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "brindle", **settings: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC times; ``settings`` override or add."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.cbo.enabled": "true",
        "spark.sql.cbo.joinReorder.enabled": "true",
    } | settings
    return SparkSession.builder.appName(app).config(map=conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: what the cluster names in ``spark.checkpoint.dir``. Only where that is unset and
    Spark runs on this machine alone, as in tests, a new temporary folder is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")
