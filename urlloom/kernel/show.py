"""How URLs are shown to people: a dump of all parts as JSON, and a diagram of where they are in the href."""

from __future__ import annotations

from .url import Url

#: Offsets from the last part to the first, as the diagram lists them.
MARKS = ("hash_start", "search_start", "pathname_start", "host_end", "host_start", "username_end", "protocol_end")
#: Offsets in the order of the dump.
OFFSETS = ("protocol_end", "username_end", "host_start", "host_end", "port", "pathname_start", "search_start", "hash_start")


def quoted(text: str) -> str:
    """A normalized URL has no control characters, so only two signs need escapes."""
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def dump(url: Url) -> str:
    """All parts and offsets as JSON; credentials, query and fragment only where there are any."""
    rows = {"buffer": url.href, "protocol": url.protocol}
    if url.has_credentials:
        rows |= {"username": url.username, "password": url.password}
    rows |= {"host": url.host_and_port, "path": url.path}
    shown = [f'\t"{name}":{quoted(value)}' for name, value in rows.items()]
    shown.append(f'\t"opaque path":{"true" if url.opaque else "false"}')
    if url.query is not None:
        shown.append(f'\t"query":{quoted(url.search)}')
    if url.fragment is not None:
        shown.append(f'\t"fragment":{quoted(url.hash)}')
    at = url.offsets()
    shown += [f'\t"{name}":{"null" if at[name] is None else at[name]}' for name in OFFSETS]
    return "{\n" + ",\n".join(shown) + "\n}"


def diagram(url: Url) -> str:
    """The href, a bar under each offset, and for each offset a line that leads to its name."""
    at, size = url.offsets(), len(url.href)
    marks = [(at[name], name) for name in MARKS if at[name] is not None and at[name] != size]
    lines = [f"{url.href} [{size} bytes]", bars({p for p, _ in marks}, size)]
    for k, (place, name) in enumerate(marks):
        left = {p for p, _ in marks} - {p for p, _ in marks[:k]}
        number = "" if name == "hash_start" else f" {place}"
        lines.append(bars(left, place) + "`" + "-" * (size - place - 1) + f" {name}{number}")
    lines += [f"note: {name} omitted" for name in ("hash", "search") if at[f"{name}_start"] is None]
    return "".join(f"{x}\n" for x in lines)


def bars(places: set[int], upto: int) -> str:
    return "".join("|" if i in places else " " for i in range(upto))
