"""Query strings as array<struct<key, value>>: order and duplicates are kept. All of it is built-in expressions.

Stray percent signs are escaped first, so that the built-in decoder takes every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .types import PARAMS
from .urls import _col


def _text(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def _pair(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def params_parse(query: Column | str) -> Column:
    """The pairs of a query string; one leading question mark is dropped, empty pieces are skipped."""
    query = _col(query)
    whole = F.regexp_replace(query, r"%(?![0-9A-Fa-f]{2})", "%25")
    pieces = F.filter(F.split(F.regexp_replace(whole, r"\A\?", ""), "&"), lambda p: p != "")
    cut = lambda p: F.when(p.contains("="), F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p))).otherwise("")
    return F.transform(pieces, lambda p: _pair(F.url_decode(F.substring_index(p, "=", 1)), F.url_decode(cut(p)))).cast(PARAMS)


def params_text(params: Column) -> Column:
    return F.array_join(F.transform(params, lambda p: F.concat(F.url_encode(p["key"]), F.lit("="), F.url_encode(p["value"]))), "&")


def params_size(params: Column) -> Column:
    return F.when(params.isNotNull(), F.size(params))


def params_get(params: Column, key: Column | str) -> Column:
    """The first value of a key, or null."""
    key = _text(key)
    return F.try_element_at(F.filter(params, lambda p: p["key"] == key), F.lit(1))["value"]


def params_get_all(params: Column, key: Column | str) -> Column:
    key = _text(key)
    return F.transform(F.filter(params, lambda p: p["key"] == key), lambda p: p["value"])


def params_has(params: Column, key: Column | str, value: Column | str | None = None) -> Column:
    key = _text(key)
    if value is None:
        return F.exists(params, lambda p: p["key"] == key)
    value = _text(value)
    return F.exists(params, lambda p: (p["key"] == key) & (p["value"] == value))


def params_append(params: Column, key: Column | str, value: Column | str) -> Column:
    return F.concat(params, F.array(_pair(_text(key), _text(value)))).cast(PARAMS)


def params_set(params: Column, key: Column | str, value: Column | str) -> Column:
    """The key's first pair gets the value and its others go; without any, a pair is added at the end."""
    key, value = _text(key), _text(value)
    first = F.array_position(F.transform(params, lambda p: p["key"]), key)
    numbered = F.transform(params, lambda p, i: F.struct(p.alias("p"), (i + 1).cast("long").alias("i")))
    left = F.filter(numbered, lambda x: (x["p"]["key"] != key) | (x["i"] == first))
    changed = F.transform(left, lambda x: F.when(x["p"]["key"] == key, _pair(x["p"]["key"], value)).otherwise(x["p"]))
    return F.when(first > 0, changed.cast(PARAMS)).otherwise(params_append(params, key, value))


def params_remove(params: Column, key: Column | str, value: Column | str | None = None) -> Column:
    key = _text(key)
    if value is None:
        return F.filter(params, lambda p: p["key"] != key)
    value = _text(value)
    return F.filter(params, lambda p: (p["key"] != key) | (p["value"] != value))


def params_sort(params: Column) -> Column:
    """Stable order by the UTF-16 code units of keys."""
    marked = F.transform(params, lambda p, i: F.struct(F.encode(p["key"], "UTF-16BE").alias("k"), i.alias("i"), p.alias("p")))
    return F.transform(F.array_sort(marked), lambda x: x["p"])


def params_keys(params: Column) -> Column:
    return F.transform(params, lambda p: p["key"])


def params_values(params: Column) -> Column:
    return F.transform(params, lambda p: p["value"])


def params_explode(df: DataFrame, query: Column | str, position: str = "position", outer: bool = False) -> DataFrame:
    """One row for each pair: the columns of df, then position, key and value."""
    explode = F.posexplode_outer if outer else F.posexplode
    rows = df.select("*", explode(params_parse(query)).alias(position, "__pair"))
    return rows.select("*", F.col("__pair.key").alias("key"), F.col("__pair.value").alias("value")).drop("__pair")
