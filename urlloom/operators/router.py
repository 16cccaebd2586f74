"""Routing: which of many patterns each URL matches.

Every URL is parsed once. Patterns with a fixed hostname are joined with URLs by that hostname, an equi-join that
gives each URL the list of its own host's patterns; the others are one constant list. Lists are filtered by built-in regular expressions, so
no URL meets every pattern through a cross join, and the pattern side is broadcast only if Spark finds it small enough.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import url_parse
from ..kernel.pattern import COMPONENTS, Component, URLPattern
from ..shipping import ship
from .patterns import component_values, exact_hostname, url_struct_test

#: Up to so many patterns without a fixed host are compiled into one expression; more are a list that is filtered.
UNROLLED = 64
_RULE = "struct<i: int, " + ", ".join(f"{c}: string" for c in COMPONENTS) + ">"


def _java(component: Component) -> str | None:
    """The component as a regular expression for Java; None for one that everything matches."""
    if component.kind == "any":
        return None
    if component.kind in ("empty", "exact"):
        return "\\A\\Q" + component.exact.replace("\\E", "\\E\\\\E\\Q") + "\\E\\z"
    return rf"{'(?i)' if component.ignore_case else ''}\A(?:{component.regex})\z"


def _rule(i: int, pattern: URLPattern) -> dict[str, int | str | None]:
    return {"i": i} | {name: _java(pattern.components[name]) for name in COMPONENTS}


def _matching(rules: Column, values: dict[str, Column]) -> Column:
    """Numbers of the rules that the values match."""

    def test(rule: Column) -> Column:
        out = F.lit(True)
        for name in ("port", "pathname", "search", "hash", "protocol", "hostname", "username", "password"):
            out = out & (rule[name].isNull() | F.regexp_like(values[name], rule[name]))
        return out

    return F.transform(F.filter(rules, test), lambda rule: rule["i"])


def route(df: DataFrame, url: str, patterns: Sequence[tuple[str, URLPattern]], name: str = "pattern_id") -> DataFrame:
    """The rows of df, once for each pattern that the URL matches, with the pattern's id; other rows are left out."""
    spark = df.sparkSession
    ship(spark)
    if any(c.startswith("__") for c in df.columns):
        raise ValueError("column names that begin with two underscores are reserved")
    hosts: dict[str, list[dict]] = {}
    others: list[int] = []
    own: list[int] = []  # patterns with an engine of their own
    for i, (_, p) in enumerate(patterns):
        host = exact_hostname(p)
        if any(c.engine for c in p.components.values()):
            own.append(i)
        elif host is None:
            others.append(i)
        else:
            hosts.setdefault(host, []).append(_rule(i, p) | {"hostname": None})
    rows = df.withColumn("__u", url_parse(url, once=True)).where(F.col("__u").isNotNull())
    keep = [F.col(f"`{c}`") for c in df.columns]
    values = component_values(F.col("__u").getField)
    none = F.array().cast("array<int>")
    one_by_one = [*own, *others] if len(others) <= UNROLLED else own
    hits = F.filter(F.array(*[F.when(url_struct_test(patterns[i][1], F.col("__u")), F.lit(i)) for i in one_by_one]).cast("array<int>"), lambda x: x.isNotNull()) if one_by_one else none
    if len(others) > UNROLLED:
        rules = F.from_json(F.lit(json.dumps([_rule(i, patterns[i][1]) for i in others])), f"array<{_RULE}>")
        hits = F.concat(hits, _matching(rules, values))
    if hosts:
        table = spark.createDataFrame([(h, [tuple(r[k] for k in ("i", *COMPONENTS)) for r in rules]) for h, rules in hosts.items()], f"__host string, __rules array<{_RULE}>")
        rows = rows.join(table, values["hostname"] == F.col("__host"), "left")
        hits = F.concat(hits, F.coalesce(_matching(F.col("__rules"), values), none))
    ids = F.array(*[F.lit(p) for p, _ in patterns]) if patterns else F.array(F.lit(None).cast("string"))
    return rows.select(*keep, F.explode(hits).alias("__i")).select(*keep, F.element_at(ids, F.col("__i") + 1).alias(name))
