"""A session with the settings the library assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "tessera", **settings: str) -> SparkSession:
    """UTC, ANSI and adaptive execution on. On a cluster also set spark.checkpoint.dir to a shared folder."""
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return SparkSession.builder.appName(name).config(map=fixed | settings).getOrCreate()
