"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A pre-token's symbols sit at fixed places; the leaf at place i holds `rank * size + i` for the pair that starts
there, so the root of a minimum tree is the leftmost pair of the lowest rank. A merge changes three
leaves, and each change is carried up in a logarithmic number of steps, until the root holds no
mergeable pair. Many pre-tokens go through their trees in lockstep as rows of one array; a very long
one has a tree of its own.

Normalizer and pre-tokenizer are those of the tokenizer file. Where pre-tokens cannot cross a blank, the texts'
blank-separated pieces are encoded once and kept in a bounded two-generation cache.

Defined cases: a null text counts as empty and has no tokens; special tokens' strings inside texts become
their ids, as the tokenizers library has it; repeated rows are encoded each by itself; a very long text is a batch of its own, and
a very long pre-token has a tree of its own; of equal ranks the leftmost pair is merged; an empty table
gives an empty result. Only the id and the columns in `keep` are carried.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import prepare, with_text

#: Entries that each of the cache's two generations may hold, and the longest piece kept.
CACHED = 150_000
CACHED_CHARS = 64
#: Pre-tokens of more symbols have a tree of their own.
LOCKSTEP = 128
NONE = np.iinfo(np.int32).max


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: Latin-1's visible ones stand for themselves, the rest take code points from 256 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [], 0x100
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def _blanks(step: dict) -> bool:
    """Whether a normalizer's step makes one blank of white space."""
    return step["type"] == "Replace" and step["pattern"] == {"Regex": r"\s+"} and step["content"] == " "


class BPE:
    """A byte-level BPE of a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are supported")
        self.library = Tokenizer.from_file(path)
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        chars = byte_alphabet()
        self.inner = np.array([vocab.get(c, -1) for c in chars], np.int32)
        self.final = np.array([vocab.get(c + suffix, -1) for c in chars], np.int32)
        self.byte_of = {c: i for i, c in enumerate(chars)}
        pairs = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            pairs[vocab[a] << 20 | vocab[b]] = (rank, vocab[a + b])
        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.append(keys, np.int64(1) << 62)
        self.rank = np.append(np.array([pairs[k][0] for k in keys.tolist()], np.int32), NONE)
        self.product = np.append(np.array([pairs[k][1] for k in keys.tolist()], np.int32), -1)
        self.pairs = pairs
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: list[str] = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.known = {*vocab.values(), *self.special.values()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.normalizer, self.splitter = self.library.normalizer, self.library.pre_tokenizer
        self.decoder = (spec.get("decoder") or {}).get("type")
        if self.decoder not in (None, "ByteLevel"):
            raise ValueError("unknown decoder")
        normalizer = spec.get("normalizer") or {}
        steps = normalizer["normalizers"] if normalizer.get("type") == "Sequence" else [normalizer] if normalizer else []
        self.blank = self._blank_splits(spec, steps)
        #: Whether all that the normalizer does to ASCII is to put it in lower case and to make blanks of white space.
        self.simple = all(s["type"] in ("NFC", "Lowercase") or _blanks(s) for s in steps)
        self.lowers = any(s["type"] == "Lowercase" for s in steps)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _blank_splits(spec: dict, normalizers: list[dict]) -> bool:
        """Whether pre-tokens are matches of a pattern that excludes blanks, so that texts can be cut at blanks."""
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        if [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[0]["behavior"] != "Removed" or not steps[0]["invert"] or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
            return False
        pattern = steps[0]["pattern"].get("Regex", "")
        return not regex.search(r"\\s(?!\\p\{L\}\\p\{N\}\])| |\\S|\(\?|\^(?!\\s)", pattern) and any(map(_blanks, normalizers))

    # -- merging -------------------------------------------------------------------------------

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1)

    def merge_many(self, pieces: Sequence[bytes]) -> list[np.ndarray]:
        """Token ids of each pre-token (given as bytes)."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        width = 2
        while width <= LOCKSTEP:
            rows = np.flatnonzero((size <= width) & (size > (0 if width == 2 else width // 2)))
            for i in range(0, len(rows), step := max(1, (1 << 20) // width)):
                part = rows[i : i + step]
                flat, counts = self._lockstep([pieces[r] for r in part.tolist()], size[part], width)
                ends = np.cumsum(counts)
                for r, s, e in zip(part.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                    out[r] = flat[s:e]
            width *= 2
        for r in np.flatnonzero(size > LOCKSTEP).tolist():
            out[r] = self._alone(pieces[r])
        return out

    def _lockstep(self, pieces: list[bytes], size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(pieces)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        inside = np.arange(width) < size[:, None]
        sym = np.full((n, width), -1, np.int32)
        sym[inside] = self.inner[flat]
        every = np.arange(n)
        sym[every, size - 1] = self.final[flat[np.cumsum(size) - 1]]
        follow = np.tile(np.arange(1, width + 1, dtype=np.int16), (n, 1))
        before = np.tile(np.arange(-1, width - 1, dtype=np.int16), (n, 1))
        tree = np.full((n, 2 * width), NONE, np.int32)
        pair = np.zeros((n, width), np.int32)
        rows, places = np.nonzero(inside[:, 1:])
        found = self._lookup(sym[rows, places], sym[rows, places + 1])
        pair[rows, places] = found
        some = self.rank[found] != NONE
        tree[rows[some], width + places[some]] = self.rank[found[some]] * width + places[some]
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half

        def update(rows, places, value):
            node = places + width
            tree[rows, node] = value
            node = node >> 1
            while node[0] >= 1:
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                node = node >> 1

        def repair(rows, places):
            """Recomputes the pair that starts at each place."""
            if not len(rows):
                return
            right = follow[rows, places].astype(np.int64)
            has = right < size[rows]
            found = np.full(len(rows), len(self.keys) - 1)
            found[has] = self._lookup(sym[rows[has], places[has]], sym[rows[has], right[has]])
            pair[rows, places] = found
            rank = self.rank[found]
            update(rows, places, np.where(rank == NONE, NONE, rank * np.int32(width) + places).astype(np.int32))

        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live):
            place = (tree[live, 1] % width).astype(np.int64)
            gone = follow[live, place].astype(np.int64)
            sym[live, place] = self.product[pair[live, place]]
            sym[live, gone] = -1
            nxt = follow[live, gone]
            follow[live, place] = nxt
            there = nxt < size[live]
            before[live[there], nxt[there]] = place[there]
            update(live, gone, NONE)
            repair(live, place)
            left = before[live, place].astype(np.int64)
            has = left >= 0
            repair(live[has], left[has])
            live = live[tree[live, 1] != NONE]
        kept = sym >= 0
        return sym[kept], kept.sum(1)

    def _alone(self, piece: bytes) -> np.ndarray:
        """One long pre-token: the same tree in plain lists."""
        n = len(piece)
        sym = self.inner[np.frombuffer(piece, np.uint8)].tolist()
        sym[-1] = int(self.final[piece[-1]])
        width = 1 << (n - 1).bit_length()
        none = 1 << 60
        pairs = self.pairs
        tree = [none] * (2 * width)

        def leaf(i, j):
            got = pairs.get(sym[i] << 20 | sym[j])
            return got[0] * width + i if got else none

        for i in range(n - 1):
            tree[width + i] = leaf(i, i + 1)
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        follow, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def update(i, value):
            i += width
            tree[i] = value
            i >>= 1
            while i:
                new = tree[2 * i] if tree[2 * i] < tree[2 * i + 1] else tree[2 * i + 1]
                if new == tree[i]:
                    break
                tree[i] = new
                i >>= 1

        while tree[1] < none:
            i = tree[1] % width
            j = follow[i]
            sym[i] = pairs[sym[i] << 20 | sym[j]][1]
            sym[j] = -1
            k = follow[i] = follow[j]
            if k < n:
                before[k] = i
            update(j, none)
            update(i, leaf(i, k) if k < n else none)
            if before[i] >= 0:
                update(before[i], leaf(before[i], i))
        return np.array([s for s in sym if s >= 0], np.int32)

    # -- texts ---------------------------------------------------------------------------------

    def normalized(self, text: str) -> str:
        if self.normalizer is None:
            return text
        if self.blank and self.simple and text.isascii():  # NFC changes nothing; blanks become cuts anyway
            text = text.translate(ASCII_BLANKS)
            return text.lower() if self.lowers else text
        return self.normalizer.normalize_str(text)

    def pre_tokens(self, piece: str) -> list[bytes]:
        if self.splitter is None:
            return [piece.encode()]
        if self.blank and piece.isascii() and piece.isalpha():
            return [piece.encode()]
        of = self.byte_of
        return [bytes([of[c] for c in t]) for t, _ in self.splitter.pre_tokenize_str(piece)]

    def pieces_of(self, text: str) -> list[str]:
        """Special tokens' strings, and between them the pieces that can be encoded each by itself."""
        out: list[str] = []
        for i, part in enumerate(self.cut.split(text) if self.cut and "<|" in text else [text]):
            if i % 2:
                out.append(part)
            elif self.blank:
                out += [p for p in self.normalized(part).split(" ") if p]
            elif part:
                out.append(self.normalized(part))
        return out

    def encode_many(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        cut = [self.pieces_of(t) for t in texts]
        young, old, here = self.young, self.old, {}
        missing: dict[str, list[bytes]] = {}
        for pieces in cut:
            for p in pieces:
                if p in young or p in here or p in missing:
                    continue
                if p in old:
                    young[p] = old[p]
                elif p in self.special:
                    here[p] = int(self.special[p]).to_bytes(4, "little")
                else:
                    missing[p] = self.pre_tokens(p)
        distinct = {t: i for i, t in enumerate(dict.fromkeys(t for ts in missing.values() for t in ts))}
        ids = [x.astype("<u4").tobytes() for x in self.merge_many(list(distinct))]
        for p, ts in missing.items():
            got = ids[distinct[ts[0]]] if len(ts) == 1 else b"".join([ids[distinct[t]] for t in ts])
            (young if len(p) <= CACHED_CHARS else here)[p] = got
        out = []
        for pieces in cut:
            try:
                out.append(b"".join([young[p] for p in pieces]))
            except KeyError:
                out.append(b"".join([young[p] if p in young else here[p] for p in pieces]))
        if len(young) > CACHED:
            self.old, self.young = young, {}
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], "<u4").tolist()

    def decode(self, ids: Sequence[int]) -> str:
        tokens = self.tokens
        got = [tokens[i] for i in ids if i < len(tokens)]
        if self.decoder is None:
            return " ".join(got)
        of, out = self.byte_of, bytearray()
        for t in got:
            if all(c in of for c in t):
                out += bytes([of[c] for c in t])
            else:
                out += t.encode()
        return out.decode("utf-8", "replace")


ASCII_BLANKS = {i: " " for i in (9, 10, 11, 12, 13)}


@lru_cache(maxsize=2)
def loaded(path: str) -> BPE:
    """One BPE for each Python worker and file."""
    return BPE(path)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), outputs: Sequence[str] = ("n_tokens", "ids_sha256", "decoded_sha256")) -> DataFrame:
    """One row for each row of docs: its id, the columns in keep, and of n_tokens, ids, decoded, ids_sha256, decoded_sha256 those in outputs."""
    prepare(docs.sparkSession)
    kinds = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    carried = [c for c in dict.fromkeys([id_col, *keep]) if c not in outputs]
    picked, source = with_text(docs, carried, text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields if f.name in carried), *(f"{o} {kinds[o]}" for o in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            ids = bpe.encode_many([t or "" for t in batch.column(batch.schema.get_field_index(source)).to_pylist()])
            made = {}
            if {"decoded", "decoded_sha256"} & {*outputs}:
                decoded = [bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
                made["decoded"] = pa.array(decoded, pa.string()) if "decoded" in outputs else None
                made["decoded_sha256"] = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string())
            if "ids" in outputs:
                made["ids"] = pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32()))
            made["n_tokens"] = pa.array([len(x) // 4 for x in ids], pa.int64())
            made["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], *(made[o] for o in outputs)], names=[*carried, *outputs])

    return picked.mapInArrow(run, schema)


def op4_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document."""
    import public_tokenizers

    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
