"""Vectorized word and shingle kernels over the concatenated bytes of a batch of texts.

All functions take `data` (uint8 bytes of all texts, one after another) and `at` (offsets, one more
than there are texts). Words never cross texts. Cost is a few nanoseconds per byte.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
#: Whitespace of the word rule: space and the control characters 09 to 0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Characters of alphanumeric words: digits, letters and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection on 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def words(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, which are runs of bytes that `inside` holds true, and each text's first word's number."""
    mask = inside[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    edge = np.empty(len(data) + 1, bool)
    edge[1:-1] = mask[1:] != mask[:-1]
    edge[0] = edge[-1] = True
    edge[at] = True
    cuts = np.flatnonzero(edge)
    run = mask[cuts[:-1]]
    starts, ends = cuts[:-1][run], cuts[1:][run]
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time; equal bytes give equal hashes in every batch."""
    size = ends - starts
    h = mix(size.astype(U) + U(0x9E3779B97F4A7C15))
    if not len(starts):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    live, done = np.flatnonzero(size <= _LONG), 0
    while len(live):
        left = size[live] - done
        piece = eight[starts[live] + done]
        short = left < 8
        if short.any():
            keep = (U(1) << (U(8) * np.minimum(left, 7).astype(U))) - U(1)
            piece = np.where(short, piece & keep, piece)
        h[live] = mix(h[live] ^ mix(piece + U(0xD6E8FEB86659FD93)))
        done += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > _LONG):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


#: Odd multipliers, one for each place in a shingle.
_PLACES = mix(np.arange(1, 65, dtype=U)) | U(1)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether all k are in the word's own text."""
    n = len(h)
    out = np.zeros(n, U)
    if n >= k:
        for j in range(k):
            out[: n - k + 1] += h[j : n - k + 1 + j] * _PLACES[j]
    last = np.repeat(first[1:], np.diff(first))
    return mix(out), np.arange(n) + k <= last


def text_of(first: np.ndarray) -> np.ndarray:
    """Number of the text that each word is in."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]
