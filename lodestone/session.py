"""Spark sessions with the settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app_name: str = "lodestone", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf: further settings, with _ for the dots of their names."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.sources.partitionOverwriteMode": "dynamic"}
    for k, v in {**settings, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()
