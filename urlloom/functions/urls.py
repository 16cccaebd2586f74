"""URL columns: parse, validate, resolve, read parts, edit. Null in gives null out; an invalid URL gives null.

Every function has a part that Catalyst compiles, for plain URLs and IPv4 hosts, and an Arrow function for the rest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernel.show import OFFSETS
from . import native, udfs
from .types import OFFSETS_TYPE, PARTS, URL

#: The struct's fields that getters do not cover.
FIELDS = ("scheme_type", "host_type", "has_opaque_path", "raw_host", "raw_query", "raw_fragment", "components")
SPECIAL_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _limited(plain: Column, url: Column, href: Column | None, max_length: int | None) -> Column:
    if max_length is None:
        return plain
    ok = F.octet_length(url) <= max_length
    return plain & (ok if href is None else ok & (F.octet_length(href) <= max_length))


def _plain(url: Column, max_length: int | None) -> Column:
    return native.is_plain(url) if max_length is None else native.is_plain(url) & (F.octet_length(url) < max_length)


def _numeric(url: Column, max_length: int | None) -> Column:
    """With a limit these are not settled in the JVM, as an address may become longer."""
    return native.is_numeric(url) if max_length is None else F.lit(False)


def url_unless_plain(url: Column, max_length: int | None = None, once: bool = False, numeric: bool = True) -> Column:
    """The struct of URLs that are not plain; null for those that are, and unless numeric also for those with a host of numbers."""
    other = ~_plain(url, max_length) & ~native.surely_invalid(url)
    return udfs.parse_udf(max_length)(F.when(other if numeric else other & ~native.is_numeric(url), url), once=once)


def url_parse(url: Column | str, max_length: int | None = None, once: bool = False) -> Column:
    """The URL struct. For a few parts, url_part costs less, as only those are computed.

    once: Python parses a URL once, however often the column is used; filters on other columns then stay above it.
    """
    url = _col(url)
    parts = native.plain_parts(url)
    struct = F.struct(*[parts[f.name].cast(OFFSETS_TYPE if f.name == "components" else f.dataType).alias(f.name) for f in URL.fields])
    # both are made, as an expression that several fields share is only computed once outside of conditions
    return F.element_at(F.array(struct, url_unless_plain(url, max_length, once)), F.when(_plain(url, max_length), 1).otherwise(2))


def url_part(url: Column | str, part: str, once: bool = False) -> Column:
    """One getter or field of a URL text; once as in url_parse."""
    if part not in PARTS and part not in FIELDS:
        raise ValueError(f"{part!r} not found; there are {', '.join((*PARTS, *FIELDS))}")
    url = _col(url)
    if part in ("hostname", "raw_host"):
        numeric = native.numeric_host(native.plain_parts(url)["hostname"])
    else:
        numeric = native.of_numeric(url, lambda parts: parts[part])
    return F.when(native.is_plain(url), native.plain_parts(url)[part]).when(native.is_numeric(url), numeric).otherwise(url_unless_plain(url, None, once, numeric=False).getField(part))


def url_can_parse(url: Column | str, base: Column | str | None = None, max_length: int | None = None) -> Column:
    """Whether a text is a valid URL, relative to a base if there is one; a null base gives null."""
    url = _col(url)
    if base is not None:
        return udfs.can_parse_udf(max_length)(url, _col(base))
    plain, wrong, numeric = _plain(url, max_length), native.surely_invalid(url), _numeric(url, max_length)
    fits = native.numeric_value(native.plain_parts(url)["hostname"]).isNotNull()
    return F.when(plain, True).when(wrong, F.when(url.isNotNull(), False)).when(numeric, fits).otherwise(udfs.can_parse_udf(max_length)(F.when(~plain & ~wrong & ~numeric, url)))


def url_resolve(url: Column | str, base: Column | str, max_length: int | None = None) -> Column:
    """The URL struct of a reference relative to a base."""
    return udfs.resolve_udf(max_length)(_col(url), _col(base))


def url_set(url: Column | str, part: str, value: Column | str, max_length: int | None = None) -> Column:
    """struct<url, ok>: the URL with a part set; a refused value leaves the URL and makes ok false. value: a column, or a text as it is."""
    value = F.lit(value) if isinstance(value, str) else value
    return udfs.edit_udf(part, max_length)(_col(url), value)


def url_with(url: Column | str, part: str, value: Column | str, max_length: int | None = None) -> Column:
    """The href after url_set."""
    return url_set(url, part, value, max_length).getField("url").getField("href")


def url_clear(url: Column | str, part: str) -> Column:
    """The URL struct without its port, search or hash."""
    if part not in ("port", "search", "hash"):
        raise ValueError(part)
    return udfs.clear_udf(part)(_col(url))


def url_without_hash(url: Column | str, once: bool = False) -> Column:
    """The href without its fragment; compiled for plain URLs. once as in url_parse."""
    url = _col(url)
    plain, numeric = native.is_plain(url), native.is_numeric(url)
    cut = lambda parts: F.substring_index(parts["href"], "#", 1)
    return F.when(plain, cut(native.plain_parts(url))).when(numeric, native.of_numeric(url, cut)).otherwise(udfs.clear_udf("hash")(F.when(~plain & ~numeric, url), once=once).getField("href"))


# -- predicates over the struct ----------------------------------------------------------------------


def has_credentials(u: Column) -> Column:
    return (u.getField("username") != "") | (u.getField("password") != "")


def has_non_empty_username(u: Column) -> Column:
    return u.getField("username") != ""


def has_non_empty_password(u: Column) -> Column:
    return u.getField("password") != ""


has_password = has_non_empty_password


def has_hostname(u: Column) -> Column:
    return F.when(u.isNotNull(), u.getField("raw_host").isNotNull())


def has_empty_hostname(u: Column) -> Column:
    return F.when(u.isNotNull(), F.coalesce(u.getField("raw_host") == "", F.lit(False)))


def has_port(u: Column) -> Column:
    return u.getField("port") != ""


def has_search(u: Column) -> Column:
    return F.when(u.isNotNull(), u.getField("raw_query").isNotNull())


def has_hash(u: Column) -> Column:
    return F.when(u.isNotNull(), u.getField("raw_fragment").isNotNull())


def is_special(u: Column) -> Column:
    return u.getField("scheme_type") != 1


def default_port(protocol: Column | str) -> Column:
    """The default port of a special scheme, 0 without any."""
    scheme = F.rtrim(_col(protocol), F.lit(":"))
    table = F.create_map(*[F.lit(x) for pair in SPECIAL_PORTS.items() for x in pair])
    return F.when(scheme.isNotNull(), F.coalesce(F.try_element_at(table, scheme), F.lit(0)))


def href_size(u: Column) -> Column:
    return F.octet_length(u.getField("href"))


def pathname_length(u: Column) -> Column:
    return F.octet_length(u.getField("pathname"))


def dns_length_ok(hostname: Column | str) -> Column:
    """Whether a domain has 253 characters at most, a last dot aside, and labels of 1 to 63."""
    host = F.regexp_replace(_col(hostname), r"\.\z", "")
    return (F.length(host) <= 253) & F.forall(F.split(host, r"\."), lambda x: F.length(x).between(1, 63))


def offsets_consistent(u: Column) -> Column:
    """Whether the offsets cut href into its parts."""
    c = u.getField("components")
    href, size = u.getField("href"), F.length(u.getField("href")).cast("long")
    cut = lambda a, b: F.substring(href, (a + 1).cast("int"), (b - a).cast("int"))
    search, end = c.getField("search_start"), c.getField("hash_start")
    path_end = F.coalesce(search, end, size)
    ordered = (c.getField("protocol_end") <= c.getField("username_end")) & (c.getField("username_end") <= c.getField("host_start")) & (c.getField("host_start") <= c.getField("host_end")) & (c.getField("host_end") <= c.getField("pathname_start"))
    return ordered & (cut(F.lit(0).cast("long"), c.getField("protocol_end")) == u.getField("protocol")) & (cut(c.getField("pathname_start"), path_end) == u.getField("pathname"))


def url_dump(u: Column) -> Column:
    """All parts and offsets as JSON; credentials, query and fragment only where there are any."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    row = lambda name, value: F.concat(F.lit(f'\t"{name}":'), value)
    part = lambda name, field: row(name, quoted(u.getField(field)))
    offset = lambda name: row(name, F.coalesce(u.getField("components").getField(name).cast("string"), F.lit("null")))
    rows = [
        part("buffer", "href"),
        part("protocol", "protocol"),
        F.when(has_credentials(u), part("username", "username")),
        F.when(has_credentials(u), part("password", "password")),
        part("host", "host"),
        part("path", "pathname"),
        row("opaque path", u.getField("has_opaque_path").cast("string")),
        F.when(has_search(u), part("query", "search")),
        F.when(has_hash(u), part("fragment", "hash")),
        *map(offset, OFFSETS),
    ]
    return F.when(u.isNotNull(), F.concat(F.lit("{\n"), F.concat_ws(",\n", *rows), F.lit("\n}")))


def url_diagram(u: Column) -> Column:
    """The href, a bar under each offset, and for each offset a line that leads to its name."""
    return udfs.codec_udf("diagram")(u.getField("href"))
