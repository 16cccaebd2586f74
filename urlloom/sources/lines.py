"""Lines of text as URLs, and the sinks that go with them; each works on one line at a time, so on any number of them."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import PARTS
from ..functions.urls import url_can_parse, url_parse, url_part


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A column `url` with one row for each line."""
    return spark.read.text(path).withColumnRenamed("value", "url")


def from_values(spark: SparkSession, urls: list[str]) -> DataFrame:
    return spark.createDataFrame([(u,) for u in urls], "url string")


def part_lines(lines: DataFrame, part: str, url: str = "url") -> DataFrame:
    """A column `value`: one part of each URL, or `Invalid URL: ` and the line."""
    if part not in PARTS:
        raise ValueError(f"{part!r} not found; there are {', '.join(PARTS)}")
    return lines.select(F.coalesce(url_part(url, part), F.concat(F.lit("Invalid URL: "), F.col(url))).alias("value"))


def invalid_lines(lines: DataFrame, url: str = "url") -> DataFrame:
    """A column `value` with the lines that are no URLs, marked as such."""
    return lines.where(~F.coalesce(url_can_parse(url), F.lit(False))).select(F.concat(F.lit("Invalid URL: "), F.col(url)).alias("value"))


def dump_lines(lines: DataFrame, url: str = "url") -> DataFrame:
    """A column `value` with each URL's struct as JSON."""
    return lines.select(F.coalesce(F.to_json(url_parse(url)), F.concat(F.lit("Invalid URL: "), F.col(url))).alias("value"))


def write_lines(values: DataFrame, path: str) -> None:
    values.select("value").write.text(path)


@dataclass(frozen=True)
class Throughput:
    bytes: int
    lines: int
    invalid: int
    seconds: float

    def __str__(self) -> str:
        rate = self.bytes / max(self.seconds, 1e-9) / 1e9
        return f"read {self.bytes} bytes in {self.seconds:.3f} s using {self.lines} lines, {self.invalid} invalid, {rate:.4f} GB/s"


def throughput(lines: DataFrame, url: str = "url") -> Throughput:
    """Validates all lines and tells how fast that was."""
    began = time.perf_counter()
    row = lines.agg(F.coalesce(F.sum(F.octet_length(url)), F.lit(0)).alias("b"), F.count("*").alias("n"), F.coalesce(F.sum((~F.coalesce(url_can_parse(url), F.lit(False))).cast("long")), F.lit(0)).alias("bad")).first()
    return Throughput(row.b, row.n, row.bad, time.perf_counter() - began)
