"""Relational queries over URLs: canonical forms, de-duplication, host statistics, links, lists of hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.params import params_parse, params_text
from ..functions.urls import _col, url_can_parse, url_part, url_resolve, url_with, url_without_hash

#: Parameters that only track visitors.
TRACKING = ("ref", "fbclid", "gclid", "msclkid")
TRACKING_PREFIXES = ("utm_",)


def valid_rows(df: DataFrame, url: str) -> DataFrame:
    return df.where(url_can_parse(url))


def invalid_rows(df: DataFrame, url: str) -> DataFrame:
    """Rows whose URL is not valid; null is not a URL."""
    return df.where(~F.coalesce(url_can_parse(url), F.lit(False)))


def without_tracking(url: Column | str, names: Sequence[str] = TRACKING, prefixes: Sequence[str] = TRACKING_PREFIXES) -> Column:
    """The href without tracking parameters. URLs that have none keep their query as it is written."""
    search = url_part(url, "search")
    params = params_parse(search)
    tracks = lambda p: p["key"].isin(*names) | F.lit(False) if not prefixes else p["key"].isin(*names) | _any_prefix(p["key"], prefixes)
    left = params_text(F.filter(params, lambda p: ~tracks(p)))
    return F.when(~F.exists(params, tracks), url_part(url, "href")).otherwise(url_with(F.when(F.exists(params, tracks), _col(url)), "search", left))


def _any_prefix(key: Column, prefixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | key.startswith(p)
    return out


def canonical_dedup(df: DataFrame, url: str, order: Sequence[Column | str], name: str = "canonical") -> DataFrame:
    """One row for each URL without fragment: the first in the order given. Invalid URLs are left out.

    The first row is found by an aggregate with map-side combining, not by a window, so that a URL that a third of all rows
    have does not fill one task.
    """
    keyed = df.withColumn(name, url_without_hash(url, once=True)).where(F.col(name).isNotNull())
    rank = F.struct(*[_col(o) for o in order])
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = keyed.groupBy(name).agg(F.min_by(row, rank).alias("__row"), F.count("*").alias("n_copies"))
    return best.select(F.col(name), "n_copies", "__row.*")


def ranked_by_host(df: DataFrame, url: str, order: Sequence[Column | str], limit: int) -> DataFrame:
    """The first rows of each host, with their rank."""
    window = Window.partitionBy("hostname").orderBy(*[_col(o) for o in order])
    return df.withColumn("hostname", url_part(url, "hostname", once=True)).where("hostname IS NOT NULL").withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit)


def host_counts(df: DataFrame, url: str) -> DataFrame:
    """Rows of each hostname; invalid URLs are left out."""
    return df.select(url_part(url, "hostname", once=True).alias("hostname")).where("hostname IS NOT NULL").groupBy("hostname").agg(F.count("*").alias("n"))


def host_rollup(df: DataFrame, url: str) -> DataFrame:
    """Counts by protocol and hostname, by protocol, and in all."""
    parts = df.select(url_part(url, "protocol").alias("protocol"), url_part(url, "hostname").alias("hostname")).where("protocol IS NOT NULL")
    return parts.rollup("protocol", "hostname").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def links(df: DataFrame, url: str, html: str) -> DataFrame:
    """One row for each href attribute of a page: the columns of df but the page, position, the link as written, and resolved (null where invalid)."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != html]
    found = df.select(*kept, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"""(?i)\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))).alias("position", "link"))
    return found.withColumn("href", url_resolve("link", url).getField("href"))


def only_hosts(df: DataFrame, url: str, hosts: DataFrame, hostname: str = "hostname") -> DataFrame:
    """Rows whose hostname is in a list."""
    return df.withColumn("__host", url_part(url, "hostname")).join(hosts.select(F.col(hostname).alias("__host")).distinct(), "__host", "left_semi").drop("__host")


def without_hosts(df: DataFrame, url: str, hosts: DataFrame, hostname: str = "hostname") -> DataFrame:
    """Rows whose hostname is not in a list; rows with invalid URLs stay."""
    return df.withColumn("__host", url_part(url, "hostname")).join(hosts.select(F.col(hostname).alias("__host")).distinct(), "__host", "left_anti").drop("__host")
