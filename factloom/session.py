"""A session with the settings that the engine's semantics need."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "factloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, AQE with skew handling, Arrow. Everything else is the cluster's to set."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config(map={
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()})
    return b.getOrCreate()
