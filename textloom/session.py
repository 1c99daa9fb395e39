"""SparkSession factory with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "textloom", **conf: str) -> SparkSession:
    """An active or new session: UTC, adaptive execution, Arrow transfer.

    Cluster sizes (executors, memory, shuffle partitions) are left to the submitter.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
