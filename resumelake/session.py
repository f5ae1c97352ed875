"""A session with the settings that plans of this package count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "resumelake", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins, partitions of moderate size; conf (dots as __) comes on top."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.files.maxPartitionBytes", "128m")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
