"""Fixed values of the URL standard: percent-encode sets, forbidden code points, schemes."""

from __future__ import annotations

import re

#: ASCII characters that each set encodes, besides control characters and all bytes from 7F on.
EXTRA = {
    "c0_control": "",
    "fragment": ' "<>`',
    "query": ' "#<>',
    "special_query": " \"#<>'",
    "path": ' "#<>?^`{}',
    "userinfo": ' "#<>?^`{}/:;=@[\\]|',
}
#: The form set is given by what it leaves alone; blanks become plus signs later.
FORM_SAFE = "*-._ 0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

FORBIDDEN_HOST = "\x00\t\n\r #/:<>?@[\\]^|"
FORBIDDEN_DOMAIN = FORBIDDEN_HOST + "".join(map(chr, range(0x20))) + "%\x7f"

#: Special schemes with their default ports, and the numbers of scheme types.
DEFAULT_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
SCHEME_TYPES = {"http": 0, "https": 2, "ws": 3, "ftp": 4, "wss": 5, "file": 6}
NOT_SPECIAL = 1


def _encodes(name: str, byte: int) -> bool:
    if name == "www_form":
        return chr(byte) not in FORM_SAFE or byte > 0x7E
    return byte < 0x20 or byte > 0x7E or chr(byte) in EXTRA[name]


SETS = (*EXTRA, "www_form")
#: For each set what each byte becomes, and a pattern of the characters that need work.
TABLES = {name: [f"%{b:02X}" if _encodes(name, b) else chr(b) for b in range(256)] for name in SETS}
NEEDED = {name: re.compile("[" + "".join(f"\\x{b:02x}" for b in range(0x80) if _encodes(name, b)) + "\x80-\U0010ffff]") for name in SETS}
