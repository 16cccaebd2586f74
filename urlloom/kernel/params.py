"""Query strings as ordered lists of (key, value); duplicates are kept."""

from __future__ import annotations

from .codec import form_decode, form_encode

Pairs = list[tuple[str, str]]


def parse_params(text: str) -> Pairs:
    pairs = [piece.partition("=") for piece in text.removeprefix("?").split("&") if piece]
    return [(form_decode(k), form_decode(v)) for k, _, v in pairs]


def params_text(pairs: Pairs) -> str:
    return "&".join(f"{form_encode(k)}={form_encode(v)}" for k, v in pairs)


def set_param(pairs: Pairs, key: str, value: str) -> Pairs:
    """The first pair of the key gets the value, later ones go; without any, one is added at the end."""
    at = next((i for i, (k, _) in enumerate(pairs) if k == key), None)
    if at is None:
        return [*pairs, (key, value)]
    return [*pairs[:at], (key, value), *((k, v) for k, v in pairs[at + 1 :] if k != key)]


def sorted_params(pairs: Pairs) -> Pairs:
    """Stable order by the UTF-16 code units of keys."""
    return sorted(pairs, key=lambda p: p[0].encode("utf-16-be", "surrogatepass"))
