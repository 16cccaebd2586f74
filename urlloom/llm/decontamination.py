"""Benchmark decontamination: a prefix-filtered set join of item windows with document shingles.

An item is cut into windows of `window` consecutive words (a shorter item is one window), and a window into
the shingles of up to five words that it is a set of. A document holds a window only if it holds all of its
shingles, so with the shingles ordered by how often the corpus has them, the prefix that must match
has length |x| - |x| + 1 = 1: the rarest shingle. Documents are joined with those prefix tokens alone;
a match at one place fixes where the window would start, which must lie inside the document
(length and position bounds); what is left is verified word by word.

Corpus frequencies are counted over all documents in one pass, summed inside each task before they
are shuffled. Items are handled in blocks of at most `block_bytes` of text (or one item); their windows, which take some 30 times
that, are what is broadcast. Every block is matched against all documents, so no benchmark is too large. Documents are
never shuffled.

Defined cases: null texts have no words; an item without words has no window; a null item id counts
as an empty string; repeated document rows are judged each by itself; items of the same id add up; of shingles that are
equally rare the one with the smaller hash is the prefix; a very long text is a batch of its own and is read whole; ids may be of any type.
Only the id and the columns in `keep` are carried, so clashing names cannot arise.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import columns_of, prepare, with_text

K = 5
BLOCK_BYTES = 2 << 20
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def item_words(text: str | None) -> list[bytes]:
    data = tk.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = tk.words(data, np.array([0, len(data)]), tk.ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts, ends, strict=True)]


def hashes_of(words: Sequence[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return tk.word_hashes(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)


class Windows:
    """The distinct windows of a block of items, with their shingles."""

    def __init__(self, items: Sequence[tuple[str, str | None]], window: int):
        by_words: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            words = item_words(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                by_words[tuple(words[i : i + window])].add(item or "")
        self.words = list(by_words)
        self.joined = [b" ".join(w) for w in self.words]
        self.items = [sorted(x) for x in by_words.values()]
        self.size = np.array([len(w) for w in self.words], np.int64)
        #: Of every window: the shingles at each offset. Windows of fewer than K words have one of their own length.
        self.shingles: list[np.ndarray] = []
        for w in self.words:
            k = min(K, len(w))
            h, ok = tk.shingles(hashes_of(w), np.array([0, len(w)]), k)
            self.shingles.append(h[ok])
        self.lengths = sorted({min(K, len(w)) for w in self.words})

    def tokens(self) -> np.ndarray:
        return np.unique(np.concatenate(self.shingles)) if self.shingles else np.zeros(0, np.uint64)

    def prefixes(self, often: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rarest shingle of each window, where it is in it, and the window; ordered by shingle."""
        where = np.array([min(range(len(s)), key=lambda i, s=s: (often.get(int(s[i]), 0), int(s[i]))) for s in self.shingles], np.int64)
        token = np.array([s[i] for s, i in zip(self.shingles, where, strict=True)], np.uint64)
        order = np.argsort(token, kind="stable")
        return token[order], where[order], order


class Member:
    """Which of many hashes are in a sorted set, by a bit table before a binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(12, int(np.ceil(np.log2(max(1, len(keys)) * 32))))
        self.table = np.zeros(1 << self.bits, bool)
        self.table[(keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.table[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
        if not len(maybe):
            return maybe
        found = h[maybe]
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        return maybe[self.keys[at] == found]


def read_words(batch: pa.RecordBatch, source: str = "__loom_text") -> tuple:
    data, at = columns_of(batch, source)
    data = tk.LOWER[data]
    starts, ends, first = tk.words(data, at, tk.ALNUM)
    return data, starts, ends, first, tk.word_hashes(data, starts, ends)


def corpus_counts(docs: DataFrame, windows: Windows) -> dict[int, int]:
    """How often all documents have each shingle of the windows; at most as many rows as the block has shingles."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((windows.tokens(), windows.lengths))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, lengths = shared.value
        member, total = Member(tokens), np.zeros(len(tokens), np.int64)
        for batch in batches:
            _, _, _, first, h = read_words(batch)
            for k in lengths:
                sh, whole = tk.shingles(h, first, k)
                hit = member(sh)
                np.add.at(total, np.searchsorted(tokens, sh[hit[whole[hit]]]), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(tokens[some].view(np.int64)), pa.array(total[some])], names=["token", "n"])

    rows = docs.select("__loom_text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(np.asarray(rows["token"].to_numpy()).view(np.uint64).tolist(), rows["n"].to_pylist(), strict=True))


def match(docs: DataFrame, windows: Windows, prefixes: tuple, source: str, last_block: bool) -> DataFrame:
    """Adds what the windows hit to __loom_hits (words' numbers, as 32-bit integers) and __loom_items; after the last block texts go."""
    names = [c for c in docs.columns if c != "__loom_text" or not last_block]
    shared = docs.sparkSession.sparkContext.broadcast((prefixes, windows.joined, windows.items, windows.size, windows.lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (token, where, order), joined, items, size, lengths = shared.value
        member = Member(np.unique(token))
        for batch in batches:
            data, starts, ends, first, h = read_words(batch, source)
            last = np.repeat(first[1:], np.diff(first))
            begin = np.repeat(first[:-1], np.diff(first))
            hit_in, found = np.zeros(len(h) + 1, np.int32), defaultdict(set)
            owner = tk.text_of(first)
            for k in lengths:
                sh, whole = tk.shingles(h, first, k)
                at = member(sh)
                at = at[whole[at]]
                low, high = np.searchsorted(token, sh[at]), np.searchsorted(token, sh[at], side="right")
                reps = high - low
                entry = np.repeat(low, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                place = np.repeat(at, reps)
                which, start = order[entry], place - where[entry]
                fits = (start >= begin[place]) & (start + size[which] <= last[place]) & (np.minimum(size[which], K) == k)
                for w, s in zip(which[fits].tolist(), start[fits].tolist(), strict=True):
                    e = s + int(size[w])
                    if b" ".join([data[a:b].tobytes() for a, b in zip(starts[s:e].tolist(), ends[s:e].tolist(), strict=True)]) == joined[w]:
                        hit_in[s] += 1
                        hit_in[e] -= 1
                        found[int(owner[s])].update(items[w])
            hit = np.cumsum(hit_in[:-1]) > 0
            old_hits, old_items = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            hits = []
            for i in range(batch.num_rows):
                new = np.flatnonzero(hit[first[i] : first[i + 1]]).astype("<u4")
                hits.append(np.union1d(np.frombuffer(old_hits[i], "<u4"), new).astype("<u4").tobytes() if old_hits[i] else new.tobytes())
            named = [sorted({*old_items[i], *found.get(i, ())}) for i in range(batch.num_rows)]
            counts = pa.array(np.diff(first), pa.int64())
            before = [batch.column(batch.schema.get_field_index(c)) for c in names[:-3]]
            yield pa.RecordBatch.from_arrays([*before, counts, pa.array(hits, pa.binary()), pa.array(named, pa.list_(pa.string()))], names=names)

    return docs.mapInArrow(run, docs.select(*[F.col(f"`{c}`") for c in names]).schema)


def block_count(texts: DataFrame, block_bytes: int) -> int:
    """How many blocks items are dealt to by hash, so that none has more bytes than that, or it has one item."""
    size = F.octet_length("t") + F.octet_length("id")
    blocks = max(1, -(-(texts.agg(F.sum(size)).first()[0] or 0) // block_bytes))
    while blocks > 1:
        dealt = texts.groupBy(F.pmod(F.xxhash64("id", "t"), F.lit(blocks))).agg(F.sum(size).alias("bytes"), F.countDistinct("id", "t").alias("n"))
        if (dealt.where("n > 1").agg(F.max("bytes")).first()[0] or 0) <= block_bytes:
            break
        blocks *= 2
    return blocks


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, keep: Sequence[str] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: id, the columns in keep, how many words are inside item windows, and which items."""
    spark = docs.sparkSession
    prepare(spark)
    new = RESULT.replace(",", "").split()[::2]
    carried = [c for c in dict.fromkeys([id_col, *keep]) if c not in new]
    now, source = with_text(docs, carried, text_col)
    now = now.select("*", F.lit(0).cast("long").alias("__loom_n"), F.lit(None).cast("binary").alias("__loom_hits"), F.array().cast("array<string>").alias("__loom_items"))
    texts = items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(f"`{item_text}`").cast("string"), F.lit("")).alias("t"))
    blocks = block_count(texts, block_bytes)
    for i in range(blocks):
        part = texts if blocks == 1 else texts.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == i)
        windows = Windows([(r.id, r.t) for r in part.toLocalIterator()], window)
        often = corpus_counts(docs.select(F.col(f"`{text_col}`").cast("string").alias("__loom_text")), windows)
        now = match(now, windows, windows.prefixes(often), source, i == blocks - 1)
    ids = F.array_sort("__loom_items")
    return now.select(
        *[F.col(f"`{c}`") for c in carried],
        F.col("__loom_n").alias("n_words"),
        (F.octet_length("__loom_hits") / 4).cast("long").alias("n_hit"),
        F.size("__loom_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.octet_length("__loom_hits") > 0).alias("contaminated"),
    )


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
