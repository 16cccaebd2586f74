"""Small tables with every odd case, and brute-force versions of what operators compute."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import zstandard
from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, bucket long, block string, score string, component_id string, __n long"
WORDS = re.compile("[^\x20\x09-\x0d]+")
ITEM_WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def vocabulary(seed: int, n: int = 3000) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnoéß") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def prose(rng: random.Random, words: list[str], n: int) -> str:
    out = [rng.choice(words) for _ in range(n)]
    for i in range(0, n, 11):
        out[i] = out[i].capitalize()
        if i:
            out[i - 1] += "."
    return " ".join(out)


def changed(rng: random.Random, words: list[str], text: str, share: float) -> str:
    return " ".join(rng.choice(words) if rng.random() < share else w for w in text.split(" "))


def texts(seed: int = 1, n: int = 60) -> list[str | None]:
    """Prose with copies, near copies, shared passages, junk, empty and very long texts."""
    rng, words = random.Random(seed), vocabulary(seed)
    passage = prose(rng, words, 70)
    out: list[str | None] = []
    for i in range(n):
        kind = i % 10
        if kind == 3 and out:
            out.append(out[0])
        elif kind == 4:
            out.append(changed(rng, words, out[1], 0.01 * rng.randint(0, 8)))
        elif kind == 5:
            out.append(prose(rng, words, 40) + "\n" + passage + "\n" + prose(rng, words, 30))
        elif kind == 6:
            out.append(("spam spam\n" + prose(rng, words, 3) + "\n") * rng.randint(1, 30))
        else:
            out.append(prose(rng, words, rng.choice([4, 9, 60, 200])))
    return [*out, None, "", " \t\n\x0b ", "one", "One two three  four", "x" * 20_000, " ".join(["same"] * 3000), "é" * 60, "a\x1fb c", "#*$ %&|<> x"]


def docs(spark: SparkSession, rows: list[str | None] | None = None) -> DataFrame:
    """Documents with null ids, repeated rows, and columns that clash with names that operators use."""
    rows = texts() if rows is None else rows
    table = [(i, t, [None, "en", "de"][i % 3], [None, "a", "b"][i % 3], None if i % 5 == 0 else len(t or ""), "clash", None, None, "x", None, "c", 1) for i, t in enumerate(rows)]
    table += [table[2], table[2], (None, rows[1], None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(table, DOCS).repartition(5)


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def brute_counts(text: str | None) -> tuple:
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if many[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def brute_verdict(text: str | None) -> str:
    """The compression bands, computed anew: limits are lines in log2 of the length that meet at 256 bytes."""
    raw = (text or "").encode()
    if not raw:
        return "empty"

    def ratio(x):
        return len(x) / len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(x))

    def low(n):
        return 1.05 + 0.2 * math.log2(n / 256) if n <= 256 else min(1.5, 1.05 + 0.12 * math.log2(n / 256))

    def high(n):
        return max(1, 2.6 + 0.42 * math.log2(n / 256))

    if ratio(raw) > high(len(raw)):
        return "repetitive"
    if ratio(raw) < low(len(raw)):
        return "incompressible"
    chunks = [raw[i : i + 2048] for i in range(0, len(raw), 2048)]
    bad = sum(len(c) for c in chunks if ratio(c) > high(len(c)) + 0.35 or ratio(c) < low(len(c)) - 0.1)
    return "chunks" if bad > 0.34 * len(raw) else "ok"


def brute_shingles(text: str | None) -> frozenset:
    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_components(rows: list[tuple[int | None, str | None]]) -> dict[int, int]:
    """Smallest id reachable over links of similarity 0.75 or more."""
    sets = [(i, brute_shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            common = len(s & t)
            if s and t and 100 * common >= 75 * (len(s) + len(t) - common):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def brute_removed(rows: list[tuple[int | None, str | None]], window: int = 50) -> list[tuple]:
    least: dict[bytes, int] = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        if i is not None:
            for p in range(len(b) - window + 1):
                s = b[p : p + window]
                least[s] = min(least.get(s, i), i)
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - window + 1):
                if least[b[p : p + window]] < i:
                    gone[p : p + window] = b"\x01" * window
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return out


def brute_hits(text: str | None, items: list[tuple[str, str | None]], window: int = 10) -> tuple:
    words = ITEM_WORDS.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items:
        w = ITEM_WORDS.findall((t or "").translate(LOWER))
        k = min(window, len(w))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            for p in range(len(words) - k + 1):
                if words[p : p + k] == w[i : i + k]:
                    hit.update(range(p, p + k))
                    found.add(str(item))
    return len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def ordered(rows) -> list:
    return sorted((tuple(r) for r in rows), key=repr)
