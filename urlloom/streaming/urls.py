"""URLs in Structured Streaming. All URL functions are stateless, so they are used as in batch; what is here adds windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import url_part, url_without_hash
from ..kernel.pattern import URLPattern
from ..operators.router import route


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A stream with a column `url`: the lines of files as they come."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path).withColumnRenamed("value", "url")


def host_windows(stream: DataFrame, url: str, time: str, length: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts of each hostname in windows of event time; rows later than `late` are dropped by the watermark, and state goes with it."""
    rows = stream.withWatermark(time, late).select(F.col(time), url_part(url, "hostname").alias("hostname")).where("hostname IS NOT NULL")
    return rows.groupBy(F.window(time, length, slide) if slide else F.window(time, length), "hostname").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "hostname", "n")


def host_sessions(stream: DataFrame, url: str, time: str, user: str, gap: str, late: str) -> DataFrame:
    """Visits of each user to each hostname: times that follow within `gap` are one session."""
    rows = stream.withWatermark(time, late).select(F.col(time), F.col(user), url_part(url, "hostname").alias("hostname")).where("hostname IS NOT NULL")
    return rows.groupBy(F.session_window(time, gap), user, "hostname").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), user, "hostname", "n")


def first_seen(stream: DataFrame, url: str, time: str, late: str) -> DataFrame:
    """Each URL without fragment once, within the watermark's memory."""
    return stream.withColumn("canonical", url_without_hash(url)).where("canonical IS NOT NULL").withWatermark(time, late).dropDuplicatesWithinWatermark(["canonical"])


def routed(stream: DataFrame, url: str, patterns: Sequence[tuple[str, URLPattern]]) -> DataFrame:
    """The stream's rows, once for each pattern that they match."""
    return route(stream, url, patterns)
