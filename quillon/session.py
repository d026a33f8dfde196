"""Session settings that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # a checkpoint's files go with the last frame that reads them
}


def get_session(master: str | None = None, app: str = "quillon", **settings: str) -> SparkSession:
    """The running session, or a new one; ``settings`` use underscores for dots."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | {k.replace("_", "."): v for k, v in settings.items()})
    return (builder.master(master) if master else builder).getOrCreate()
