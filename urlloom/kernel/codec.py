"""Percent and form codecs over strings; bytes that are not UTF-8 after decoding become U+FFFD."""

from __future__ import annotations

import re

from .charsets import NEEDED, TABLES

_ESCAPES = re.compile(rb"%([0-9A-Fa-f]{2})")


def utf8(text: str) -> bytes:
    """UTF-8 bytes; lone surrogates count as U+FFFD."""
    try:
        return text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace").encode()


def percent_encode(text: str, charset: str) -> str:
    if not NEEDED[charset].search(text):
        return text
    table = TABLES[charset]
    return "".join([table[b] for b in utf8(text)])


def percent_decode_bytes(text: str) -> bytes:
    raw = utf8(text)
    return _ESCAPES.sub(lambda m: bytes([int(m[1], 16)]), raw) if b"%" in raw else raw


def percent_decode(text: str) -> str:
    return percent_decode_bytes(text).decode("utf-8", "replace") if "%" in text else text


def form_decode(text: str) -> str:
    return percent_decode(text.replace("+", " "))


def form_encode(text: str) -> str:
    return percent_encode(text, "www_form").replace(" ", "+")
