"""Arrow functions around the kernel. Rows that the JVM has settled arrive as nulls and cost nothing here.

Equal values of a batch are computed once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .types import EDITED, PATTERN_RESULT, URL, arrow, record


def batched(kind: T.DataType, of: Callable) -> Callable[..., Column]:
    """An Arrow function of one or more columns from a function of single values; None in the first is None out."""
    out = arrow(kind)

    def run(*columns: pa.Array) -> pa.Array:
        if columns[0].null_count == len(columns[0]):
            return pa.nulls(len(columns[0]), out)
        rows = list(zip(*(c.to_pylist() for c in columns), strict=True))
        known: dict = {}
        values = []
        for row in rows:
            if row[0] is None:
                values.append(None)
                continue
            try:
                if row not in known:
                    known[row] = of(*row)
                values.append(known[row])
            except TypeError:  # values that cannot be keys
                values.append(of(*row))
        return pa.array(values, out)

    def one(a: pa.Array) -> pa.Array:
        return run(a)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return run(a, b)

    def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return run(a, b, c)

    made = [F.arrow_udf(f, kind) for f in (one, two, three)]

    def call(*columns: Column, once: bool = False) -> Column:
        """once: the optimizer must not copy the call, neither into a filter that it moves nor into each use of a column."""
        ship()
        f = made[len(columns) - 1]
        return (f.asNondeterministic() if once else f)(*columns)

    call.functions = made
    return call


@cache
def parse_udf(max_length: int | None) -> Callable[..., Column]:
    def of(text, base=None):
        from urlloom.kernel.url import MAX_LENGTH, parse

        return record(parse(text, base, max_length or MAX_LENGTH))

    return batched(URL, of)


@cache
def resolve_udf(max_length: int | None) -> Callable[..., Column]:
    def of(text, base):
        from urlloom.kernel.url import MAX_LENGTH, parse

        return None if base is None else record(parse(text, base, max_length or MAX_LENGTH))

    return batched(URL, of)


@cache
def can_parse_udf(max_length: int | None) -> Callable[..., Column]:
    def of(text, base=""):
        from urlloom.kernel.url import MAX_LENGTH, can_parse

        return None if base is None else can_parse(text, base or None, max_length or MAX_LENGTH)

    return batched(T.BooleanType(), of)


@cache
def edit_udf(part: str, max_length: int | None) -> Callable[..., Column]:
    def of(text, value):
        from urlloom.kernel.url import MAX_LENGTH, edited, parse

        url = parse(text)
        if url is None or value is None:
            return None
        new, ok = edited(url, part, value, max_length or MAX_LENGTH)
        return {"url": record(new), "ok": ok}

    return batched(EDITED, of)


@cache
def clear_udf(part: str) -> Callable[..., Column]:
    def of(text):
        from urlloom.kernel.url import cleared, parse

        url = parse(text)
        return record(cleared(url, part)) if url else None

    return batched(URL, of)


@cache
def codec_udf(name: str, argument: str | None = None) -> Callable[..., Column]:
    """A function of the kernel from text to text."""

    def of(text):
        from urlloom.kernel import codec, host, idna, show, url

        if name == "percent_encode":
            return codec.percent_encode(text, argument)
        if name == "domain_to_ascii":
            return host.domain_to_ascii(text)
        if name == "diagram":
            return show.diagram(url.parse(text))
        if name == "from_file_path":
            return url.from_file_path(text)
        if name == "host":
            found = host.parse_host(text, argument == "special")
            return found and found[0]
        return getattr(codec, name)(text) if hasattr(codec, name) else getattr(idna, name)(text)

    return batched(T.StringType(), of)


def pattern_exec_udf(pattern) -> Callable[..., Column]:
    def of(text, base=None):
        found = pattern.exec(text, base)
        return found and {k: v if k == "inputs" else {"input": v["input"], "groups": list(v["groups"].items())} for k, v in found.items()}

    return batched(PATTERN_RESULT, of)


def pattern_exec_init_udf(pattern) -> Callable[..., Column]:
    """As above for structured inputs, which the result shows as JSON."""

    def of(init):
        import json

        given = {k: v for k, v in init.items() if v is not None}
        found = pattern.exec(given)
        return found and {k: [json.dumps(given, ensure_ascii=False, sort_keys=True)] if k == "inputs" else {"input": v["input"], "groups": list(v["groups"].items())} for k, v in found.items()}

    return batched(PATTERN_RESULT, of)


def pattern_test_init_udf(pattern) -> Callable[..., Column]:
    def of(init):
        return pattern.test({k: v for k, v in init.items() if v is not None})

    return batched(T.BooleanType(), of)


def component_udf(component) -> Callable[..., Column]:
    """Whether a component of a pattern matches, by its own engine."""

    def of(text):
        return component.match(text) is not None

    return batched(T.BooleanType(), of)
