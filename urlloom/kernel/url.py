"""URL records: parsing, resolving, serializing, and editing.

Texts are cut top-down: fragment, scheme, then by the kind of scheme authority, path and query. Paths are lists of
segments until they are serialized. A record is a value: setters return a new one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from .charsets import DEFAULT_PORTS, NOT_SPECIAL, SCHEME_TYPES
from .codec import percent_encode
from .host import DEFAULT, parse_host

MAX_LENGTH = 2**32 - 1
_EDGES = "".join(map(chr, range(0x21)))
_BREAKS = str.maketrans("", "", "\t\n\r")
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):")
_DRIVE = re.compile(r"[A-Za-z][:|]")
_DRIVE_START = re.compile(r"[A-Za-z][:|](?:[/\\?#]|$)")
_DOTS = re.compile(r"(\.|%2[eE]){1,2}")
_ENDS = {True: re.compile(r"[/\\?]"), False: re.compile(r"[/?]")}
_SLASHES = {True: re.compile(r"[/\\]"), False: re.compile(r"/")}


class Invalid(ValueError):
    """A text is no URL."""


@dataclass(frozen=True, slots=True)
class Url:
    scheme: str
    username: str = ""
    password: str = ""
    host: str | None = None
    host_type: int = DEFAULT
    port: int | None = None
    path: str = ""
    opaque: bool = False
    query: str | None = None
    fragment: str | None = None

    @property
    def special(self) -> bool:
        return self.scheme in DEFAULT_PORTS

    @property
    def scheme_type(self) -> int:
        return SCHEME_TYPES.get(self.scheme, NOT_SPECIAL)

    @property
    def protocol(self) -> str:
        return self.scheme + ":"

    @property
    def has_credentials(self) -> bool:
        return bool(self.username or self.password)

    @property
    def credentials(self) -> str:
        secret = f":{self.password}" if self.password else ""
        return f"{self.username}{secret}@" if self.has_credentials else ""

    @property
    def hostname(self) -> str:
        return self.host or ""

    @property
    def port_text(self) -> str:
        return "" if self.port is None else str(self.port)

    @property
    def host_and_port(self) -> str:
        return self.hostname if self.port is None else f"{self.hostname}:{self.port}"

    @property
    def search(self) -> str:
        return f"?{self.query}" if self.query else ""

    @property
    def hash(self) -> str:
        return f"#{self.fragment}" if self.fragment else ""

    @property
    def before_path(self) -> str:
        if self.host is not None:
            return f"{self.scheme}://{self.credentials}{self.host_and_port}"
        return f"{self.scheme}:" + ("/." if not self.opaque and self.path.startswith("//") else "")

    @property
    def href(self) -> str:
        out = self.before_path + self.path
        if self.query is not None:
            out += "?" + self.query
        return out if self.fragment is None else f"{out}#{self.fragment}"

    @property
    def origin(self) -> str:
        if self.special:
            return "null" if self.scheme == "file" else f"{self.scheme}://{self.host_and_port}"
        if self.scheme == "blob" and self.path:
            inner = parse(self.path)
            if inner and inner.scheme in ("http", "https"):
                return inner.origin
        return "null"

    @property
    def segments(self) -> list[str]:
        return self.path.split("/")[1:]

    def offsets(self) -> dict[str, int | None]:
        """Where the parts of href begin and end. With credentials the host starts at the at sign."""
        protocol_end = len(self.scheme) + 1
        before = len(self.before_path)
        if self.host is None:
            username_end = host_start = host_end = protocol_end
        else:
            username_end = host_start = protocol_end + 2
            if self.has_credentials:
                username_end += len(self.username)
                host_start += len(self.credentials) - 1
            host_end = before - (0 if self.port is None else 1 + len(str(self.port)))
        after_path = before + len(self.path)
        after_query = after_path + (0 if self.query is None else 1 + len(self.query))
        return {
            "protocol_end": protocol_end,
            "username_end": username_end,
            "host_start": host_start,
            "host_end": host_end,
            "port": self.port,
            "pathname_start": before,
            "search_start": None if self.query is None else after_path,
            "hash_start": None if self.fragment is None else after_query,
        }


# -- paths -------------------------------------------------------------------------------------------


def shorten(path: list[str], scheme: str) -> list[str]:
    """Takes the last segment off the list, which is given back; a drive letter that is the only one stays."""
    if path and not (scheme == "file" and len(path) == 1 and _DRIVE.fullmatch(path[0]) and path[0][1] == ":"):
        path.pop()
    return path


def walked(path: list[str], text: str, scheme: str) -> list[str]:
    """The segments of `path` followed by those of `text`, dot segments resolved."""
    pieces, path = _SLASHES[scheme in DEFAULT_PORTS].split(text), list(path)
    last = len(pieces) - 1
    for i, piece in enumerate(pieces):
        piece = percent_encode(piece, "path")
        if _DOTS.fullmatch(piece):
            if len(piece) in (2, 4, 6) and piece.lower() not in (".", "%2e"):
                shorten(path, scheme)
            if i == last:
                path.append("")
            continue
        if scheme == "file" and not path and _DRIVE.fullmatch(piece):
            piece = piece[0] + ":"
        path.append(piece)
    return path


def joined(path: list[str]) -> str:
    return "".join(f"/{p}" for p in path)


def absolute_path(text: str, scheme: str) -> str:
    """The path of a text that begins after the authority; one slash at its start is no segment."""
    special = scheme in DEFAULT_PORTS
    if not special and not text:
        return ""
    if text[:1] == "/" or special and text[:1] == "\\":
        text = text[1:]
    return joined(walked([], text, scheme))


# -- parsing -----------------------------------------------------------------------------------------


def _cut_query(text: str, scheme: str) -> tuple[str, str | None]:
    head, mark, query = text.partition("?")
    return head, percent_encode(query, "special_query" if scheme in DEFAULT_PORTS else "query") if mark else None


def _port(text: str, scheme: str) -> int | None:
    if not text:
        return None
    if not (text.isascii() and text.isdigit()) or int(text) > 0xFFFF:
        raise Invalid(text)
    return None if int(text) == DEFAULT_PORTS.get(scheme) else int(text)


def _colon(text: str) -> int:
    """Where the first colon outside of brackets is, or -1."""
    inside = False
    for i, c in enumerate(text):
        if c == ":" and not inside:
            return i
        inside = c == "[" or inside and c != "]"
    return -1


def _host(text: str, scheme: str) -> tuple[str, int]:
    found = parse_host(text, scheme in DEFAULT_PORTS)
    if found is None:
        raise Invalid(text)
    return found


def _authority(scheme: str, text: str) -> Url:
    special = scheme in DEFAULT_PORTS
    end = _ENDS[special].search(text)
    authority, rest = (text[: end.start()], text[end.start() :]) if end else (text, "")
    login, at, server = authority.rpartition("@")
    if at and not server:
        raise Invalid(text)
    username, _, password = login.partition(":")
    colon = _colon(server)
    name, port = (server, None) if colon < 0 else (server[:colon], server[colon + 1 :])
    if not name and (special or colon >= 0):
        raise Invalid(text)
    host, kind = _host(name, scheme) if name else ("", DEFAULT)
    path, query = _cut_query(rest, scheme)
    return Url(scheme, percent_encode(username, "userinfo"), percent_encode(password, "userinfo"), host, kind, _port(port, scheme) if port else None, absolute_path(path, scheme), False, query)


def _opaque(scheme: str, text: str, more: bool) -> Url:
    path, query = _cut_query(text, scheme)
    path = percent_encode(path, "c0_control")
    if path.endswith(" ") and (query is not None or more):
        path = path[:-1] + "%20"
    return Url(scheme, path=path, opaque=True, query=query)


def _file(text: str, base: Url | None) -> Url:
    if text[:1] in ("/", "\\") and text:
        if text[1:2] in ("/", "\\") and len(text) > 1:
            return _file_host(text[2:])
        path, query = _cut_query(text[1:], "file")
        host, kind, start = "", DEFAULT, []
        if base:
            host, kind = base.host, base.host_type
            first = base.segments[:1]
            if not _DRIVE_START.match(text[1:]) and first and _DRIVE.fullmatch(first[0]) and first[0][1] == ":":
                start = first
        return Url("file", host=host, host_type=kind, path=joined(walked(start, path, "file")), query=query)
    if base:
        if not text:
            return replace(base, fragment=None)
        path, query = _cut_query(text, "file")
        if text[0] == "?":
            return replace(base, query=query, fragment=None)
        start = [] if _DRIVE_START.match(text) else shorten(base.segments, "file")
        return replace(base, path=joined(walked(start, path, "file")), query=query, fragment=None)
    path, query = _cut_query(text, "file")
    return Url("file", host="", path=joined(walked([], path, "file")), query=query)


def _file_host(text: str) -> Url:
    end = re.search(r"[/\\?]", text)
    name, rest = (text[: end.start()], text[end.start() :]) if end else (text, "")
    if _DRIVE.fullmatch(name):
        path, query = _cut_query(text, "file")
        return Url("file", host="", path=joined(walked([], path, "file")), query=query)
    host, kind = _host(name, "file") if name else ("", DEFAULT)
    path, query = _cut_query(rest, "file")
    return Url("file", host="" if host == "localhost" else host, host_type=kind, path=absolute_path(path, "file"), query=query)


def _relative(text: str, base: Url) -> Url:
    slash = "/\\" if base.special else "/"
    if text and text[0] in slash:
        if len(text) > 1 and text[1] in slash:
            return _authority(base.scheme, text.lstrip("/\\") if base.special else text[2:])
        path, query = _cut_query(text, base.scheme)
        return replace(base, path=joined(walked([], path[1:], base.scheme)), query=query, fragment=None)
    if not text:
        return replace(base, fragment=None)
    path, query = _cut_query(text, base.scheme)
    if text[0] == "?":
        return replace(base, query=query, fragment=None)
    return replace(base, path=joined(walked(shorten(base.segments, base.scheme), path, base.scheme)), query=query, fragment=None)


def _parsed(text: str, base: Url | None) -> Url:
    text = text.strip(_EDGES).translate(_BREAKS)
    text, mark, fragment = text.partition("#")
    m = _SCHEME.match(text)
    if m:
        scheme, rest = m[1].lower(), text[m.end() :]
        if scheme == "file":
            out = _file(rest, base if base and base.scheme == "file" else None)
        elif scheme in DEFAULT_PORTS:
            if base and base.scheme == scheme and not rest.startswith("//"):
                out = _relative(rest, base)
            else:
                out = _authority(scheme, rest.lstrip("/\\"))
        elif rest.startswith("//"):
            out = _authority(scheme, rest[2:])
        elif rest.startswith("/"):
            path, query = _cut_query(rest, scheme)
            out = Url(scheme, path=absolute_path(path, scheme), query=query)
        else:
            out = _opaque(scheme, rest, bool(mark))
    elif base is None or base.opaque and (text or not mark):
        raise Invalid(text)
    elif base.opaque:
        out = replace(base, fragment=None)
    else:
        out = _file(text, base) if base.scheme == "file" else _relative(text, base)
    return replace(out, fragment=percent_encode(fragment, "fragment")) if mark else out


def parse(text: str, base: Url | str | None = None, max_length: int = MAX_LENGTH) -> Url | None:
    """The URL of a text, relative to a base if there is one; None where either is invalid or longer than allowed."""
    if isinstance(base, str):
        base = parse(base, None, max_length)
        if base is None:
            return None
    limited = max_length < MAX_LENGTH
    if limited and len(text.encode("utf-8", "replace")) > max_length:
        return None
    try:
        out = _parsed(text, base)
    except Invalid:
        return None
    return None if limited and len(out.href) > max_length else out


def can_parse(text: str, base: str | None = None, max_length: int = MAX_LENGTH) -> bool:
    return parse(text, base, max_length) is not None


def from_file_path(path: str) -> str:
    """The file URL of a path."""
    return "file://" + absolute_path(path.translate(_BREAKS), "file")


# -- editing -----------------------------------------------------------------------------------------


def _locked(url: Url) -> bool:
    return not url.host or url.scheme == "file"


def _set_href(url: Url, value: str) -> Url | None:
    return parse(value)


def _set_protocol(url: Url, value: str) -> Url | None:
    value = value.translate(_BREAKS)
    if not value:
        return url
    m = _SCHEME.match(value + ":")
    if not m:
        return None
    scheme = m[1].lower()
    if (scheme in DEFAULT_PORTS) != url.special or scheme == "file" and (url.has_credentials or url.port is not None) or url.scheme == "file" and url.host == "":
        return None
    return replace(url, scheme=scheme, port=None if url.port == DEFAULT_PORTS.get(scheme) else url.port)


def _set_username(url: Url, value: str) -> Url | None:
    return None if _locked(url) else replace(url, username=percent_encode(value, "userinfo"))


def _set_password(url: Url, value: str) -> Url | None:
    return None if _locked(url) else replace(url, password=percent_encode(value, "userinfo"))


def _set_port(url: Url, value: str) -> Url | None:
    if _locked(url):
        return None
    if not value:
        return replace(url, port=None)
    value = value.translate(_BREAKS)
    digits = re.match(r"[0-9]*", value)[0]
    if not value:
        return url
    if not digits:
        return None
    try:
        return replace(url, port=_port(digits, url.scheme))
    except Invalid:
        return None


def _set_pathname(url: Url, value: str) -> Url | None:
    if url.opaque:
        return None
    value = value.translate(_BREAKS)
    if not value and not url.special and url.host is None:
        return replace(url, path="")
    return replace(url, path=absolute_path(value, url.scheme))


def _trimmed(url: Url) -> Url:
    if url.opaque and url.query is None and url.fragment is None:
        return replace(url, path=url.path.rstrip(" "))
    return url


def _set_search(url: Url, value: str) -> Url | None:
    if not value:
        return _trimmed(replace(url, query=None))
    return replace(url, query=percent_encode(value.removeprefix("?").translate(_BREAKS), "special_query" if url.special else "query"))


def _set_hash(url: Url, value: str) -> Url | None:
    if not value:
        return _trimmed(replace(url, fragment=None))
    return replace(url, fragment=percent_encode(value.removeprefix("#").translate(_BREAKS), "fragment"))


def _set_host(url: Url, value: str, port_too: bool = True) -> Url | None:
    if url.opaque:
        return None
    value = value.partition("#")[0].translate(_BREAKS)
    if url.scheme == "file":
        value = re.split(r"[/\\?]", value, maxsplit=1)[0]
        found = parse_host(value, True) if value else ("", DEFAULT)
        if found is None:
            return None
        host, kind = found
        return replace(url, host="" if host == "localhost" else host, host_type=kind)
    end = _ENDS[url.special].search(value)
    value = value[: end.start()] if end else value
    colon = _colon(value)
    if colon >= 0:
        found = parse_host(value[:colon], url.special) if colon and port_too else None
        if found is None:
            return None
        out = replace(url, host=found[0], host_type=found[1])
        port = value[colon + 1 :]
        return (_set_port(out, port) or out) if port else out
    if not value:
        if url.special or url.has_credentials or url.port is not None:
            return None
        return replace(url, host="", host_type=DEFAULT)
    found = parse_host(value, url.special)
    return None if found is None else replace(url, host=found[0], host_type=found[1])


SETTERS = {
    "href": _set_href,
    "protocol": _set_protocol,
    "username": _set_username,
    "password": _set_password,
    "host": _set_host,
    "hostname": lambda url, value: _set_host(url, value, port_too=False),
    "port": _set_port,
    "pathname": _set_pathname,
    "search": _set_search,
    "hash": _set_hash,
}


def edited(url: Url, part: str, value: str, max_length: int = MAX_LENGTH) -> tuple[Url, bool]:
    """The URL with a part set, and whether that was accepted; a refused value changes nothing."""
    out = SETTERS[part](url, value)
    if out is None or max_length < MAX_LENGTH and len(out.href) > max_length:
        return url, False
    return out, True


def cleared(url: Url, part: str) -> Url:
    """The URL without its port, search or hash."""
    return replace(url, port=None) if part == "port" else _trimmed(replace(url, **{"search": {"query": None}, "hash": {"fragment": None}}[part]))
