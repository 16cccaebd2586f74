"""URL patterns over columns: test compiles to built-in predicates, exec is an Arrow function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import native, udfs
from ..functions.urls import _col, url_resolve, url_unless_plain
from ..kernel.pattern import COMPONENTS, Component, Engine, URLPattern

#: Cheap and selective components first: conjunctions stop at the first that fails.
ORDER = ("protocol", "port", "hostname", "pathname", "search", "hash", "username", "password")


def url_pattern(pattern: str | dict, base_url: str | None = None, ignore_case: bool = False, engine: Engine | None = None) -> URLPattern:
    """Compiles a pattern on the driver. With another regular expression engine, its components are tested in Arrow functions."""
    return URLPattern(pattern, base_url, ignore_case, engine)


def component_test(component: Component, value: Column) -> Column:
    """One component's predicate; components that match anything fold away."""
    if component.kind == "any":
        return F.lit(True)
    if component.kind in ("empty", "exact"):
        return value == F.lit(component.exact)
    if component.engine is not None:
        return udfs.component_udf(component)(value)
    return value.rlike(rf"{'(?i)' if component.ignore_case else ''}\A(?:{component.regex})\z")


def component_values(part: Callable[[str], Column]) -> dict[str, Column]:
    """The texts that components are matched with, from a URL's parts."""
    cut = {"protocol": lambda c: F.rtrim(c, F.lit(":")), "search": lambda c: F.substring(c, 2, 2**31 - 1), "hash": lambda c: F.substring(c, 2, 2**31 - 1)}
    return {name: cut.get(name, lambda c: c)(part(name)) for name in COMPONENTS}


def test_components(pattern: URLPattern, values: dict[str, Column]) -> Column:
    """The conjunction of the components' predicates over eight columns."""
    out = None
    for name in ORDER:
        component = pattern.components[name]
        if component.kind != "any":
            test = component_test(component, values[name])
            out = test if out is None else out & test
    return F.lit(True) if out is None else out


def url_pattern_test(pattern: URLPattern, url: Column | str, base: Column | str | None = None) -> Column:
    """Whether URLs match: false for invalid URLs, null for null."""
    url = _col(url)
    if base is not None:
        return F.when(url.isNotNull(), url_struct_test(pattern, url_resolve(url, base)))
    # one question whether a URL is plain, not one for each component
    plain = test_components(pattern, component_values(native.plain_parts(url).__getitem__))
    return F.when(native.is_plain(url), plain).when(url.isNotNull(), url_struct_test(pattern, url_unless_plain(url)))


def url_struct_test(pattern: URLPattern, u: Column) -> Column:
    """As url_pattern_test, over a URL struct."""
    return F.coalesce(test_components(pattern, component_values(u.getField)) & u.isNotNull(), F.lit(False))


def url_pattern_exec(pattern: URLPattern, url: Column | str, base: Column | str | None = None) -> Column:
    """The match result struct, or null. Groups that took no part have null values."""
    exec_ = udfs.pattern_exec_udf(pattern)
    if base is not None:
        return exec_(_col(url), _col(base))
    # rows that do not match never reach Python
    return exec_(F.when(url_pattern_test(pattern, url), _col(url)))


def url_pattern_exec_init(pattern: URLPattern, init: Column) -> Column:
    """The match result of structured inputs (PATTERN_INIT)."""
    return udfs.pattern_exec_init_udf(pattern)(init)


def url_pattern_test_init(pattern: URLPattern, init: Column) -> Column:
    """Whether structured inputs (PATTERN_INIT) match; null for null."""
    return udfs.pattern_test_init_udf(pattern)(init)


def exact_hostname(pattern: URLPattern) -> str | None:
    component = pattern.components["hostname"]
    return component.exact if component.kind == "exact" else None


__all__ = ["URLPattern", "component_test", "exact_hostname", "test_components", "url_pattern", "url_pattern_exec", "url_pattern_exec_init", "url_pattern_test", "url_pattern_test_init", "url_struct_test"]
