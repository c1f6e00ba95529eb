"""Session settings that the engine's results depend on."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def session(app: str = "sparkloom", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; what is set already stays."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster it is shipped with ``--py-files`` or an archive; this does no harm then.
    """
    root = str(Path(__file__).resolve().parents[1])
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(":")
    if root not in known:
        environment["PYTHONPATH"] = ":".join([root, *filter(None, known)])
