"""Tests of texts that parsing is made of, as built-in expressions. Null in gives null out."""

from __future__ import annotations

from pyspark.sql import Column

from ..kernel.charsets import FORBIDDEN_DOMAIN, FORBIDDEN_HOST
from .urls import _col


def _class(signs: str) -> str:
    return "[" + "".join(f"\\x{ord(c):02x}" for c in signs) + "]"


def has_tab_or_newline(text: Column | str) -> Column:
    return _col(text).rlike(r"[\t\n\r]")


def is_ascii(text: Column | str) -> Column:
    return _col(text).rlike(r"\A[\x00-\x7f]*\z")


def has_forbidden_host_sign(text: Column | str) -> Column:
    return _col(text).rlike(_class(FORBIDDEN_HOST))


def has_forbidden_domain_sign(text: Column | str) -> Column:
    """Also true for every character beyond ASCII, which has to be mapped first."""
    return _col(text).rlike(_class(FORBIDDEN_DOMAIN) + r"|[^\x00-\x7f]")


def is_scheme(text: Column | str) -> Column:
    return _col(text).rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*\z")


def is_digits(text: Column | str) -> Column:
    return _col(text).rlike(r"\A[0-9]+\z")


def is_hex(text: Column | str) -> Column:
    return _col(text).rlike(r"\A[0-9A-Fa-f]+\z")


def ends_in_number(host: Column | str) -> Column:
    """Whether a lower-case host has to be an IPv4 address."""
    return _col(host).rlike(r"(?:\A|\.)(?:[0-9]+|0x[0-9a-f]*)\.?\z")


def is_dotted_quad(host: Column | str) -> Column:
    """Four decimal numbers up to 255 without leading zeros."""
    byte = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return _col(host).rlike(rf"\A{byte}(?:\.{byte}){{3}}\z")


def is_dot_segment(segment: Column | str) -> Column:
    """One or two dots, as they are or percent-encoded."""
    return _col(segment).rlike(r"\A(?i:\.|%2e){1,2}\z")


def is_drive_letter(segment: Column | str, normalized: bool = False) -> Column:
    return _col(segment).rlike(r"\A[A-Za-z]:\z" if normalized else r"\A[A-Za-z][:|]\z")


PREDICATES = {f.__name__: f for f in (has_tab_or_newline, is_ascii, has_forbidden_host_sign, has_forbidden_domain_sign, is_scheme, is_digits, is_hex, ends_in_number, is_dotted_quad, is_dot_segment, is_drive_letter)}
