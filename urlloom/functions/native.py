"""Built-in expressions for plain absolute URLs, and the guards that say which URLs are plain.

A guard is one regular expression; where it holds, every part is a substring (lower-cased for the host) and nothing needs
encoding or resolving. A second guard admits hosts that are IPv4 addresses in any spelling, which are written anew.
These rows never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that need no encoding in each part.
_PATH = r"[!$%&'()*+,\-./0-9:;=@A-Z\[\]_a-z|~]"
_QUERY = r"[!$%&()*+,\-./0-9:;=?@A-Z\[\\\]^_`a-z{|}~]"
_FRAGMENT = r"[!#$%&'()*+,\-./0-9:;=?@A-Z\[\\\]^_a-z{|}~]"
#: Empty labels are not plain; the last label starts with a letter, so the host is no address.
_DOMAIN = r"(?!\.)(?![^/?#]*\.\.)(?:[a-z0-9_\-.]*\.)?[a-z][a-z0-9_\-]*"
_BYTE = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: An address as it is serialized.
_QUAD = rf"{_BYTE}(?:\.{_BYTE}){{3}}"
#: A number of an address in any base, of at most 60 bits; longer ones take the other way.
_NUMBER = r"(?:0[xX][0-9a-fA-F]{0,15}|0[0-7]{0,19}|[1-9][0-9]{0,17})"
_NUMBERS = rf"{_NUMBER}(?:\.{_NUMBER}){{0,3}}\.?"
#: Ports that are some scheme's default take the other way, as they may have to go.
_PORT = r"(?::(?!(?:80|443|21)(?:[/?#]|\z))[1-9][0-9]{0,3})?"
#: Dot segments, also percent-encoded ones.
_NO_DOTS = r"(?![^?#]*/(?:\.|%2[eE]){1,2}(?:[/?#]|\z))"
#: No credentials. Only single characters are repeated, never groups: Java's engine goes one call deeper for each
#: turn of a group, and a long URL would end the thread's stack.
_START = rf"\A(?:https?|wss?|ftp)://{_NO_DOTS}"
_REST = rf"{_PORT}(?:/{_PATH}*)?(?:\?{_QUERY}*)?(?:#{_FRAGMENT}*)?\z"
PLAIN = rf"{_START}(?:{_DOMAIN}|{_QUAD}){_REST}"
#: As plain, but for a host of numbers, which may be too large.
NUMERIC = rf"{_START}{_NUMBERS}{_REST}"
#: Hosts of numbers by themselves.
NUMERIC_HOST = rf"\A{_NUMBERS}\z"
#: The longest URL that is judged by the guard: a bound for the regular expression's work on each row.
PLAIN_BYTES = 8192
_SCHEMES = (("http", 0), ("https", 2), ("ws", 3), ("ftp", 4), ("wss", 5))


def is_plain(url: Column) -> Column:
    return (F.octet_length(url) <= PLAIN_BYTES) & url.rlike(PLAIN)


def is_numeric(url: Column) -> Column:
    return (F.octet_length(url) <= PLAIN_BYTES) & url.rlike(NUMERIC)


def surely_invalid(url: Column) -> Column:
    """Without a letter and a colon, nothing is an absolute URL."""
    return ~url.rlike(r"[A-Za-z]") | ~url.contains(":")


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def dotted(value: Column) -> Column:
    return F.concat_ws(".", *[F.pmod(F.shiftright(value, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])


def numeric_value(host: Column) -> Column:
    """The 32-bit value of a host of numbers; null where one is too large. The last number fills what is left.

    Other texts may not fail, as the optimizer takes expressions out of conditions.
    """

    def number(text: Column) -> Column:
        hexadecimal = F.conv(F.concat(F.lit("0"), F.substring(text, 3, 15)), 16, 10)
        octal = F.conv(F.substring(text, 1, 20), 8, 10)
        return F.when(text.rlike(r"\A0[xX]"), hexadecimal).when(text.startswith("0"), octal).otherwise(text).try_cast("long")

    def value(numbers: Column) -> Column:
        lead, last = F.slice(numbers, F.lit(1), F.size(numbers) - 1), F.element_at(numbers, -1)
        bits = (5 - F.size(numbers)) * 8
        fits = (bits >= 8) & F.forall(lead, lambda n: n.between(0, 255)) & (F.call_function("shiftrightunsigned", last, bits) == 0)
        first = F.aggregate(lead, F.lit(0).cast("long"), lambda sum_, n: sum_ * 256 + n)
        return F.when(fits, F.call_function("shiftleft", first, bits) + last)

    return _bound(F.transform(F.split(F.rtrim(host, F.lit(".")), r"\."), number), value)


def numeric_host(host: Column) -> Column:
    """The serialized form of a host of numbers; null where one is too large."""
    return _bound(numeric_value(host), lambda v: F.when(v.isNotNull(), dotted(v)))


def of_numeric(url: Column, of: Callable[[dict[str, Column]], Column]) -> Column:
    """An expression of the parts of a URL with a host of numbers; null where that is invalid."""
    both = F.struct(url.alias("url"), numeric_host(plain_parts(url)["hostname"]).alias("host"))
    return _bound(both, lambda b: F.when(b["host"].isNotNull(), of(plain_parts(b["url"], b["host"]))))


def plain_parts(url: Column, shown: Column | None = None) -> dict[str, Column]:
    """All getters and fields of a plain URL, each by itself a short expression, so that unused ones cost nothing.

    shown: what stands for the hostname, where that is an address in another spelling.
    Parts are cut at the first of each delimiter, from the end: such searches go over bytes and cost far less than a
    regular expression. A plain URL is ASCII, so its length in bytes is that in characters.
    """
    size = F.octet_length
    after = lambda text, n: F.substr(text, n + 1, size(text))
    colon = F.instr(url, ":")
    scheme = F.substring_index(url, ":", 1)
    until_hash = F.substring_index(url, "#", 1)
    until_query = F.substring_index(until_hash, "?", 1)
    rest = after(until_query, colon + 2)
    host = F.substring_index(rest, "/", 1)
    hostname = F.substring_index(host, ":", 1)
    has_port = host.contains(":")
    port = F.when(has_port, after(host, size(hostname) + 1)).otherwise("")
    path = after(rest, size(host))
    has_fragment, has_query = url.contains("#"), until_hash.contains("?")
    query, fragment = after(until_hash, size(until_query) + 1), after(url, size(until_hash) + 1)
    # the only thing that a plain URL may lack is the slash of an empty path
    bare = ~rest.contains("/")
    more = F.when(bare, 1).otherwise(0)
    if shown is None:
        href = F.when(bare, F.concat(until_query, F.lit("/"), after(url, size(until_query)))).otherwise(url)
        # labels of addresses start with digits, which come before the colon; the last ones of domains do not
        host_type = F.when(F.substring_index(hostname, ".", -1) < ":", 1).otherwise(0)
    else:
        more = more + size(shown) - size(hostname)
        href = F.concat(scheme, F.lit("://"), shown, after(host, size(hostname)), F.when(bare, "/").otherwise(path), after(url, size(until_query)))
        host, hostname, host_type = F.concat(shown, after(host, size(hostname))), shown, F.lit(1)
    number = F.lit(None).cast("int")
    for name, code in _SCHEMES:
        number = F.when(scheme == name, code).otherwise(number)
    long = lambda c: c.try_cast("long")
    offsets = F.struct(
        long(colon).alias("protocol_end"),
        long(colon + 2).alias("username_end"),
        long(colon + 2).alias("host_start"),
        long(colon + 2 + size(hostname)).alias("host_end"),
        F.when(has_port, long(port)).alias("port"),
        long(colon + 2 + size(host)).alias("pathname_start"),
        F.when(has_query, long(size(until_query) + more)).alias("search_start"),
        F.when(has_fragment, long(size(until_hash) + more)).alias("hash_start"),
    )
    return {
        "href": href,
        "protocol": F.concat(scheme, F.lit(":")),
        "username": F.lit(""),
        "password": F.lit(""),
        "host": host,
        "hostname": hostname,
        "port": port,
        "pathname": F.when(bare, F.lit("/")).otherwise(path),
        "search": F.when(size(until_hash) > size(until_query) + 1, after(until_hash, size(until_query))).otherwise(""),
        "hash": F.when(size(url) > size(until_hash) + 1, after(url, size(until_hash))).otherwise(""),
        "origin": F.concat(scheme, F.lit("://"), host),
        "scheme_type": number,
        "host_type": host_type,
        "has_opaque_path": F.lit(False),
        "raw_host": hostname,
        "raw_query": F.when(has_query, query),
        "raw_fragment": F.when(has_fragment, fragment),
        "components": offsets,
    }
