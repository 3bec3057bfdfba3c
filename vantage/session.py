"""A Spark session with the settings that the library's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Case decides between columns, moments have no zone, and days are counted in UTC.
SETTINGS = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(name: str = "vantage", master: str | None = None, shuffle_partitions: int | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """A session under SETTINGS; master and the number of shuffle partitions are the cluster's unless given."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.config(map=extra or {}).getOrCreate()
