"""Hosts: IPv4 and IPv6 addresses, domains and opaque hosts."""

from __future__ import annotations

import re

from .charsets import FORBIDDEN_DOMAIN, FORBIDDEN_HOST
from .codec import percent_decode, percent_decode_bytes, percent_encode
from .idna import to_ascii

DEFAULT, IPV4, IPV6 = 0, 1, 2
_PLAIN = re.compile(r"[a-z][a-z0-9_.~!$&'()*+,;=\"`{}-]*", re.A)
_NUMERIC_END = re.compile(r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\.?$")
_NUMBER = re.compile(r"(?:0[xX](?P<hex>[0-9a-fA-F]*)|0(?P<octal>[0-7]*)|(?P<decimal>[1-9][0-9]*))$")
_QUAD = re.compile(r"(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})")
_PIECE = re.compile(r"[0-9a-fA-F]{1,4}")
_DOMAIN_BAD = re.compile("[" + re.escape(FORBIDDEN_DOMAIN) + "]")
_HOST_BAD = re.compile("[" + re.escape(FORBIDDEN_HOST) + "]")


def ipv4_number(text: str) -> int | None:
    m = _NUMBER.match(text)
    if not m:
        return None
    if m["decimal"] is not None:
        return int(m["decimal"])
    return int(m["hex"] or "0", 16) if m["hex"] is not None else int(m["octal"] or "0", 8)


def ipv4_parse(text: str) -> int | None:
    """The 32-bit value of a dotted address of one to four numbers; the last one fills what is left."""
    parts = text.split(".")
    if len(parts) > 1 and not parts[-1]:
        parts.pop()
    if len(parts) > 4 or any(len(p) > 4096 for p in parts):
        return None
    numbers = [ipv4_number(p) for p in parts]
    if any(n is None for n in numbers):
        return None
    *lead, last = numbers
    if any(n > 255 for n in lead) or last >= 256 ** (4 - len(lead)):
        return None
    return sum(n << 8 * (3 - i) for i, n in enumerate(lead)) + last


def ipv4_text(value: int) -> str:
    return ".".join(str(b) for b in value.to_bytes(4, "big"))


def ipv6_parse(text: str) -> list[int] | None:
    """The eight pieces of an address without brackets."""
    if len(text) > 45:
        return None
    head, _, tail = text.rpartition(":")
    if "." in tail:
        quad = _QUAD.fullmatch(tail)
        if not quad or any(int(b) > 255 for b in quad.groups()):
            return None
        a, b, c, d = map(int, quad.groups())
        text = f"{head}:{a << 8 | b:x}:{c << 8 | d:x}"
    left, gap, right = text.partition("::")
    sides = [side.split(":") if side else [] for side in (left, right)]
    if not all(_PIECE.fullmatch(p) for side in sides for p in side):
        return None
    pieces = [[int(p, 16) for p in side] for side in sides]
    missing = 8 - len(pieces[0]) - len(pieces[1])
    if missing < (1 if gap else 0) or (missing and not gap):
        return None
    return pieces[0] + [0] * missing + pieces[1]


def ipv6_text(pieces: list[int]) -> str:
    """Lower-case hexadecimal with the first longest run of two or more zeros left out."""
    best, at = 1, -1
    i = 0
    while i < 8:
        j = i
        while j < 8 and pieces[j] == 0:
            j += 1
        if j - i > best:
            best, at = j - i, i
        i = max(j, i + 1)
    shown = [f"{p:x}" for p in pieces]
    if at < 0:
        return ":".join(shown)
    return ":".join(shown[:at]) + "::" + ":".join(shown[at + best :])


def domain_to_ascii(text: str) -> str | None:
    """A percent-encoded domain in ASCII; None where it has no valid form."""
    if "%" in text:
        try:
            text = percent_decode_bytes(text).decode()
        except UnicodeDecodeError:
            return None
    out = to_ascii(text)
    return None if not out or _DOMAIN_BAD.search(out) else out


def parse_host(text: str, special: bool) -> tuple[str, int] | None:
    """(serialized host, host type); None where the host is invalid."""
    if special and _PLAIN.fullmatch(text) and "xn--" not in text and not _NUMERIC_END.search(text):
        return text, DEFAULT
    if text.startswith("["):
        pieces = ipv6_parse(text[1:-1]) if text.endswith("]") else None
        return None if pieces is None else (f"[{ipv6_text(pieces)}]", IPV6)
    if not special:
        return None if _HOST_BAD.search(text) else (percent_encode(text, "c0_control"), DEFAULT)
    domain = domain_to_ascii(text)
    if domain is None:
        return None
    if _NUMERIC_END.search(domain):
        value = ipv4_parse(domain)
        return None if value is None else (ipv4_text(value), IPV4)
    return domain, DEFAULT


def dns_length_ok(hostname: str) -> bool:
    """Whether a domain obeys the length limits of DNS: 253 characters, a trailing dot aside, and labels of 1 to 63."""
    labels = hostname.removesuffix(".").split(".")
    return len(hostname.removesuffix(".")) <= 253 and all(1 <= len(x) <= 63 for x in labels)


__all__ = ["DEFAULT", "IPV4", "IPV6", "dns_length_ok", "domain_to_ascii", "ipv4_parse", "ipv4_text", "ipv6_parse", "ipv6_text", "parse_host", "percent_decode"]
