"""Sessions with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` wins over these settings.

    Partition counts and memory are left to the cluster's own configuration.
    """
    b = SparkSession.builder.appName("tessera")
    if master:
        b = b.master(master)
    for k, v in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }.items():
        b = b.config(k, v)
    return b.getOrCreate()
