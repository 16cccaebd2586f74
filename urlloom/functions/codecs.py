"""Text codecs as columns: percent and form encoding, domains, addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernel.charsets import EXTRA, SETS
from . import native, udfs
from .urls import _col


def _class(name: str) -> str:
    """A Java pattern of the characters that a set encodes."""
    if name == "www_form":
        return r"[^*\-._ 0-9A-Za-z]"
    return r"[\x00-\x1f\x7f-\x{10ffff}" + "".join(f"\\x{ord(c):02x}" for c in EXTRA[name]) + "]"


def percent_encode(text: Column | str, charset: str) -> Column:
    """Encodes a text's characters that are in a set: c0_control, fragment, query, special_query, path, userinfo or www_form."""
    if charset not in SETS:
        raise ValueError(charset)
    text = _col(text)
    needed = text.rlike(_class(charset))
    return F.when(~needed, text).otherwise(udfs.codec_udf("percent_encode", charset)(F.when(needed, text)))


def percent_decode(text: Column | str) -> Column:
    """Decodes %HH; other percent signs stay. Bytes that are not UTF-8 become U+FFFD."""
    text = _col(text)
    needed = text.contains("%")
    return F.when(~needed, text).otherwise(udfs.codec_udf("percent_decode")(F.when(needed, text)))


def form_encode(text: Column | str) -> Column:
    return F.url_encode(_col(text))


def form_decode(text: Column | str) -> Column:
    """As percent_decode, with blanks for plus signs; compiled where every percent sign begins an escape."""
    text = _col(text)
    odd = text.rlike(r"%(?![0-9A-Fa-f]{2})")
    return F.when(~odd, F.url_decode(F.when(~odd, text))).otherwise(udfs.codec_udf("form_decode")(F.when(odd, text)))


def domain_to_ascii(domain: Column | str) -> Column:
    """The ASCII form of a domain; null where it has none. ASCII domains are only put in lower case."""
    domain = _col(domain)
    plain = domain.rlike(r"\A[0-9A-Za-z._\-]+\z")
    return F.when(plain, F.lower(domain)).otherwise(udfs.codec_udf("domain_to_ascii")(F.when(~plain, domain)))


def domain_to_unicode(domain: Column | str) -> Column:
    """The readable form; labels that cannot be decoded stay."""
    domain = _col(domain)
    plain = ~domain.rlike(r"(?i)xn--|[^\x00-\x7f]")
    return F.when(plain, F.lower(domain)).otherwise(udfs.codec_udf("to_unicode")(F.when(~plain, domain)))


def parse_host(host: Column | str, special: bool = True) -> Column:
    """The serialized host, as parsing a URL with that host gives it; null where it is invalid."""
    host = _col(host)
    if not special:
        return udfs.codec_udf("host", "other")(host)
    numeric = host.rlike(native.NUMERIC_HOST)
    return F.when(numeric, native.numeric_host(host)).otherwise(udfs.codec_udf("host", "special")(F.when(~numeric, host)))


def ipv4_text(value: Column | str) -> Column:
    """A 32-bit number in dotted form."""
    v = _col(value).cast("long")
    return F.when(v.between(0, 2**32 - 1), native.dotted(v))


def ipv4_value(host: Column | str) -> Column:
    """The 32-bit value of an IPv4 host in any of its spellings; null where it is none."""
    host = _col(host)
    numeric = host.rlike(native.NUMERIC_HOST)
    other = udfs.codec_udf("host", "special")(F.when(~numeric, host))
    return F.when(numeric, native.numeric_value(host)).when(other.rlike(native.NUMERIC_HOST), native.numeric_value(other))


def url_from_file(path: Column | str) -> Column:
    """The file URL of a path."""
    path = _col(path)
    plain = path.rlike(r"\A/(?!.*/[/.\-])(?![/.\-])[A-Za-z0-9_.~\-/]*[A-Za-z0-9_.~\-]\z")
    return F.when(plain, F.concat(F.lit("file://"), path)).otherwise(udfs.codec_udf("from_file_path")(F.when(~plain, path)))
