"""Domain names: UTS #46 mapping (non-transitional), label validity, Punycode.

Mappings are derived from Python's Unicode data by the published construction: compatibility decomposition and case
folding, with default-ignorable characters removed and the four deviation characters kept. Code points newer than that
data count as unassigned, so as disallowed.
"""

from __future__ import annotations

import re
import unicodedata as ud
from functools import lru_cache

MAX_BYTES = 16384
ZWNJ, ZWJ = "‌", "‍"
_DEVIATIONS = frozenset("ßς" + ZWNJ + ZWJ)
#: Characters that the mapping drops.
_IGNORED = frozenset([0xAD, 0x34F, 0x180B, 0x180C, 0x180D, 0x180F, 0x180E, 0x200B, 0x2060, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFEFF, 0xFFA0, *range(0x1D173, 0x1D17B), *range(0x2061, 0x2065), *range(0x206A, 0x2070), *range(0xFE00, 0xFE10), *range(0x1BCA0, 0x1BCA4), *range(0xE0100, 0xE01F0)])
#: Dots that count as a full stop, and characters whose mapping is not their folding.
_SPECIAL = {"。": ".", "．": ".", "｡": ".", "ẞ": "ß", "≠": "≠", "≮": "≮", "≯": "≯"}
#: Assigned characters that are disallowed although folding keeps them.
_DISALLOWED = frozenset([0xFE12, 0xFFFC, 0xFFFD, *range(0x2028, 0x202F), *range(0x2065, 0x206A), *range(0x2FF0, 0x3000), 0x31EF])


@lru_cache(maxsize=65536)
def mapped(c: str) -> str | None:
    """What a character maps to; None where it is disallowed."""
    if c < "\x80":
        return c.lower()
    if c in _DEVIATIONS:
        return c
    if c in _SPECIAL:
        return _SPECIAL[c]
    code = ord(c)
    if code in _IGNORED:
        return ""
    if code in _DISALLOWED:
        return None
    kind = ud.category(c)
    if kind in ("Cn", "Co", "Cs", "Cc", "Cf", "Zl", "Zp"):
        return None
    out = ud.normalize("NFKC", ud.normalize("NFKC", c).casefold())
    out = ud.normalize("NFKC", out.casefold()) if kind != "Ll" or out != c else out
    for x in out:
        if x == "." or ord(x) in _DISALLOWED or x >= "\x80" and ud.category(x) in ("Cn", "Co", "Cs", "Cc", "Zl", "Zp", "Zs"):
            return None
    return "".join(x for x in out if ord(x) not in _IGNORED)


def map_text(text: str) -> str | None:
    out = []
    for c in text:
        m = mapped(c)
        if m is None:
            return None
        out.append(m)
    return ud.normalize("NFC", "".join(out))


# -- Punycode (RFC 3492) ---------------------------------------------------------------------------


def punycode_decode(text: str) -> str | None:
    """The label that follows xn--; None where it is malformed or not in its shortest form."""
    try:
        out = text.encode("ascii").decode("punycode")
    except (UnicodeError, ValueError, OverflowError, IndexError):
        return None
    if any(0xD800 <= ord(c) < 0xE000 for c in out) or punycode_encode(out) != text.lower():
        return None
    return out


def punycode_encode(label: str) -> str:
    return label.encode("punycode").decode("ascii")


# -- labels ------------------------------------------------------------------------------------------

_JOINING_LEFT = re.compile("[ؠئبت-خس-ؿف-هىيٮٯٸ-ڇښ-ڿہۂیێېۑۺ-ۼۿܒ-ܔܚ-ܝܟ-ܧܩܫܭܮݎ-ݘݜ-ݪݭ-ݰݲݵ-ݷݺ-ݿߊ-ߪࡁ-ࡅࡈࡊ-ࡓࡕࡠࡢ-ࡥࡨࢆࢉ-ࢍࢠ-ࢩࢯࢰࢳ-ࢸࢺ-ࣈ᠇ᠠ-ᡸᢇ-ᢨᢪꡀ-ꡲ]")
_JOINING_RIGHT = re.compile("[ؠآ-ؿف-يٮٯٱ-ٳٵ-ۓەۮۯۺ-ۼۿܐܒ-ܯݍ-ݿߊ-ߪࡀ-ࡘࡠࡢ-ࡥࡧ-ࡪࡰ-ࢂࢆࢉ-ࢎࢠ-ࢬࢮ-ࣈ᠇ᠠ-ᡸᢇ-ᢨᢪꡀ-ꡱ]")


def _joiners_ok(label: str) -> bool | None:
    """The context rule of the first joiner in a label; None where there is none."""
    at = next((i for i, c in enumerate(label) if c in (ZWNJ, ZWJ)), -1)
    if at < 0:
        return None
    if at and ud.combining(label[at - 1]) == 9:
        return True
    if label[at] == ZWJ:
        return False
    return bool(_JOINING_LEFT.search(label[:at])) and bool(_JOINING_RIGHT.search(label[at + 1 :]))


def _bidi_ok(label: str) -> bool:
    """The Bidi rule of a label by itself; labels without right-to-left characters pass."""
    kinds = [ud.bidirectional(c) for c in label]
    if not {"R", "AL", "AN"} & set(kinds):
        return True
    body = kinds[:]
    while body and body[-1] == "NSM":
        body.pop()
    if kinds[0] in ("R", "AL"):
        allowed = {"R", "AL", "AN", "EN", "ES", "CS", "ET", "ON", "BN", "NSM"}
        return set(kinds) <= allowed and bool(body) and body[-1] in ("R", "AL", "EN", "AN") and not {"EN", "AN"} <= set(kinds)
    if kinds[0] == "L":
        return set(kinds) <= {"L", "EN", "ES", "CS", "ET", "ON", "BN", "NSM"} and bool(body) and body[-1] in ("L", "EN")
    return False


def label_valid(label: str) -> bool:
    if not label or ud.category(label[0])[0] == "M":
        return False
    if any(mapped(c) != c for c in label if c not in _DEVIATIONS):
        return False
    joined = _joiners_ok(label)
    return joined if joined is not None else _bidi_ok(label)


def to_ascii(domain: str) -> str | None:
    """The ASCII form of a domain; None where it has none. ASCII input is only put in lower case."""
    if len(domain.encode("utf-8", "replace")) > MAX_BYTES:
        return None
    if domain.isascii():
        return domain.lower()
    text = map_text(domain)
    if text is None:
        return None
    labels = []
    for label in text.split("."):
        if label.startswith("xn--"):
            if not label.isascii():
                return None
            plain = punycode_decode(label[4:])
            if plain is None or not plain or plain.isascii() or map_text(plain) != plain or not label_valid(plain):
                return None
            labels.append(label)
        elif label.isascii():
            labels.append(label)
        elif label_valid(label):
            labels.append("xn--" + punycode_encode(label))
        else:
            return None
    return ".".join(labels)


def to_unicode(domain: str) -> str:
    """The readable form: labels that do not decode stay as they are."""
    if len(domain.encode("utf-8", "replace")) > MAX_BYTES:
        return domain
    out = []
    for label in domain.split("."):
        if label[:4].lower() == "xn--" and label.isascii():
            plain = punycode_decode(label[4:].lower())
            out.append(plain if plain and label_valid(plain) else label)
        else:
            out.append(label.lower() if label.isascii() else label)
    return ".".join(out)


_START = ("Lu", "Ll", "Lt", "Lm", "Lo", "Nl")


def name_code_point(c: str, first: bool) -> bool:
    """Whether a character may be in a pattern's name, as in identifiers."""
    if first:
        return c in "$_" or c.isidentifier()
    return c in "$" + ZWNJ + ZWJ or ("a" + c).isidentifier()
