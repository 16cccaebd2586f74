"""Spark types of URLs, query parameters and pattern results."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..kernel.pattern import COMPONENTS
from ..kernel.url import Url

#: The getters, in the order of the struct.
PARTS = ("href", "protocol", "username", "password", "host", "hostname", "port", "pathname", "search", "hash", "origin")
OFFSETS = ("protocol_end", "username_end", "host_start", "host_end", "port", "pathname_start", "search_start", "hash_start")

_text = T.StringType()
OFFSETS_TYPE = T.StructType([T.StructField(n, T.LongType()) for n in OFFSETS])
#: raw_host, raw_query and raw_fragment are null where the part is missing; getters give '' for missing and for empty parts.
URL = T.StructType(
    [T.StructField(n, _text) for n in PARTS]
    + [T.StructField("scheme_type", T.IntegerType()), T.StructField("host_type", T.IntegerType()), T.StructField("has_opaque_path", T.BooleanType())]
    + [T.StructField(n, _text) for n in ("raw_host", "raw_query", "raw_fragment")]
    + [T.StructField("components", OFFSETS_TYPE)]
)
EDITED = T.StructType([T.StructField("url", URL), T.StructField("ok", T.BooleanType())])
PARAM = T.StructType([T.StructField("key", _text), T.StructField("value", _text)])
PARAMS = T.ArrayType(PARAM)
PATTERN_INIT = T.StructType([T.StructField(n, _text) for n in (*COMPONENTS, "base_url")])
COMPONENT_RESULT = T.StructType([T.StructField("input", _text), T.StructField("groups", T.MapType(_text, _text, True))])
PATTERN_RESULT = T.StructType([T.StructField("inputs", T.ArrayType(_text)), *(T.StructField(n, COMPONENT_RESULT) for n in COMPONENTS)])


def arrow(kind: T.DataType) -> pa.DataType:
    return to_arrow_type(kind)


def getters(url: Url) -> dict[str, str]:
    return {
        "href": url.href,
        "protocol": url.protocol,
        "username": url.username,
        "password": url.password,
        "host": url.host_and_port,
        "hostname": url.hostname,
        "port": url.port_text,
        "pathname": url.path,
        "search": url.search,
        "hash": url.hash,
        "origin": url.origin,
    }


def record(url: Url | None) -> dict | None:
    """A URL as the struct; None stays None, which is how failure is told."""
    if url is None:
        return None
    return getters(url) | {"scheme_type": url.scheme_type, "host_type": url.host_type, "has_opaque_path": url.opaque, "raw_host": url.host, "raw_query": url.query, "raw_fragment": url.fragment, "components": url.offsets()}
