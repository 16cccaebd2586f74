"""Exact substring removal with bucket-pointer refinement of suffixes.

Every byte covered by a `window`-byte string that also starts in a document of a smaller id is removed. Strings
are those of the input, and never cross documents.

Sorting every suffix of a corpus would move a record for each byte. Instead, windows are dealt by an anchor, the
smallest hash among their `GRAM`-byte substrings: equal windows have equal anchors, and neighbouring windows share theirs,
so a document is a list of runs of windows.

1. Documents are packed into blocks of a few MB, compressed, and written; all later steps read those.
2. Every block sends its distinct anchors, packed by bucket; those of a single document are out, and go no further.
3. Runs with a repeated anchor are sent with their text, once for each distinct run of a block, with the smallest id.
   The suffixes of these texts are put into buckets of equal `GRAM_BYTES`-byte strings. Each bucket is refined: sorted on the
   bucket pointers of the suffixes `GRAM_BYTES` later, then its parts on those twice as far, and so on; a pointer that was
   refined serves all later sorts at once, and a bucket of one suffix is left alone. Equal windows are then neighbours.
   Each class of windows has its smallest id, which goes back to blocks with a larger one.
4. Blocks mark windows whose smallest id is below their document's, and cut.

Messages are pre-aggregated in each block. An anchor of very many blocks, or of many texts in one block, is hot: the texts around
it differ, and would meet in one place. Its windows are dealt each by itself, by their own hash, so those that differ
go to different places and those that are equal are one message for each block, and no order is needed to find them. No text is compared pair by pair.
Places are counted by the bytes of the texts, and one place refines a bounded number of bytes at a time.

Defined cases: a null text is empty; a document without id loses nothing and takes nothing from others; rows of the same
id take nothing from each other; an empty table gives an empty result; a text of any length is handled whole, in a
block of its own if it is longer than one, and in segments of `SEGMENT` bytes while anchors are sought. Ids that are
not whole numbers count as missing. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import columns_of, dealt, prepare, saved

U = np.uint64
WINDOW = 50
GRAM = 20
BLOCK = 2 << 20
SEGMENT = 1 << 20
#: Bytes of the first buckets' strings, and how much later the next pointer is looked up.
GRAM_BYTES = 7
#: Suffixes whose buckets are refined together.
TOGETHER = 1 << 18
#: Bytes of documents for each place where texts are refined, and for each group of places, which get their texts together.
PLACE, GROUP = 768 << 10, 8 << 20
#: An anchor of more blocks, or of more different texts in one block, is hot.
HOT_BLOCKS, HOT_TEXTS = 1024, 48
TOP = np.iinfo(np.int64).max
_A, _B, _C = (U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def anchor_runs(data: np.ndarray, at: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of each run; runs also end where a segment does."""
    n, span = len(data), window - GRAM + 1
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if n < window:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.zeros(n + 1, np.int8)
    ends = np.maximum(at[1:] - window + 1, at[:-1])
    np.add.at(inside, at[:-1], 1)
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside, dtype=np.int8) > 0
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((n + 1,), "<u8", padded.data, strides=(1,))
    for s in range(0, n - window + 1, SEGMENT):
        e = min(s + SEGMENT, n - window + 1)
        near = eight[s : e + span - 1 + 12].copy()
        many = e - s + span - 1
        m = tk.mix(near[:many] * _A + near[8 : 8 + many] * _B + near[12 : 12 + many] * _C)
        size = 1
        while 2 * size <= span:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if size < span:
            m = np.minimum(m[: len(m) - (span - size)], m[span - size :])
        ok = inside[s:e]
        change = np.ones(e - s, bool)
        change[1:] = (m[1:] != m[:-1]) | (ok[1:] != ok[:-1])
        first = np.flatnonzero(change)
        length = np.diff(np.append(first, e - s))
        sel = ok[first]
        out.append((m[first[sel]], first[sel] + s, length[sel]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def stretches(cut: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The ranges that begin at `cut` and together reach to n."""
    return list(zip(cut.tolist(), [*cut[1:].tolist(), n], strict=False))


class Block:
    """The documents of one packed block and what its anchors are."""

    def __init__(self, packed: bytes, ids: bytes, sizes: bytes, buckets: int, window: int):
        raw = zstandard.decompress(packed)
        self.raw, self.window = raw, window
        self.ids = np.frombuffer(ids, "<i8")
        self.at = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<i8"))]).astype(np.int64)
        anchor, self.start, self.length = anchor_runs(np.frombuffer(raw, np.uint8), self.at, window)
        self.doc = np.searchsorted(self.at, self.start, side="right") - 1
        distinct, which = np.unique(anchor, return_inverse=True)
        z = tk.mix(distinct)
        bucket = (z % U(buckets)).astype(np.int64)
        order = np.lexsort((z, bucket))
        self.z, self.bucket = z[order], bucket[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.which = rank[which]
        low, high = np.full(len(z), TOP), np.full(len(z), -TOP)
        np.minimum.at(low, self.which, self.ids[self.doc])
        np.maximum.at(high, self.which, self.ids[self.doc])
        self.shared = low < high
        #: Anchors of many different runs.
        self.many = np.bincount(self.which, minlength=len(z)) > HOT_TEXTS
        runs = np.flatnonzero(self.many[self.which])
        texts = {(a, raw[s : s + n + window - 1]) for a, s, n in zip(self.which[runs].tolist(), self.start[runs].tolist(), self.length[runs].tolist(), strict=True)}
        self.many = np.bincount(np.array([a for a, _ in texts], np.int64), minlength=len(z)) > HOT_TEXTS

    def bounds(self) -> list[tuple[int, int, int]]:
        """(bucket, first, end) of the distinct anchors of each bucket."""
        cut = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        return [(int(self.bucket[a]), a, b) for a, b in stretches(cut, len(self.bucket))]

    def marked(self, notes: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Which distinct anchors other documents have, and which are hot."""
        mask, hot = self.shared.copy(), np.zeros(len(self.shared), bool)
        for bucket, a, b in self.bounds():
            bits = notes.get(bucket)
            if bits is not None:
                both = np.unpackbits(np.frombuffer(bits, np.uint8), count=2 * (b - a)).astype(bool)
                mask[a:b] |= both[: b - a]
                hot[a:b] = both[b - a :]
        return mask, hot

    def candidates(self, notes: dict[int, bytes], groups: int, inner: int) -> Candidates:
        """What may repeat: runs of repeated anchors; those of hot anchors are cut into their windows.

        A group has `inner` places for texts and as many for windows of hot anchors.
        """
        mask, hot = self.marked(notes)
        runs = np.flatnonzero(mask[self.which])
        reps = np.where(hot[self.which[runs]], self.length[runs], 1)
        run = np.repeat(runs, reps)
        ahead = np.arange(len(run)) - np.repeat(np.cumsum(reps) - reps, reps)
        single = np.repeat(hot[self.which[runs]], reps)
        start, length = self.start[run] + ahead, np.where(single, 1, self.length[run])
        raw, more = self.raw, self.window - 1
        seen: dict[bytes, int] = {}
        of = np.array([seen.setdefault(raw[s:e], len(seen)) for s, e in zip(start.tolist(), (start + length + more).tolist(), strict=True)], np.int64)
        least, place = np.full(len(seen), TOP), np.zeros(len(seen), np.int64)
        np.minimum.at(least, of, self.ids[self.doc[run]])
        texts = list(seen)
        place[of] = ((self.z[self.which[run]] >> U(20)) % U(groups * inner)).astype(np.int64)
        alone = np.unique(of[single])
        place[alone] = [zlib.crc32(texts[t]) % (groups * inner) for t in alone.tolist()]
        part = place // inner * 2 * inner + place % inner
        part[alone] += inner
        return Candidates(start, length, self.doc[run], of, texts, least, part)


@dataclass
class Candidates:
    """First window, windows, document and distinct text of each candidate run; the texts, their smallest ids and places."""

    start: np.ndarray
    length: np.ndarray
    doc: np.ndarray
    of: np.ndarray
    texts: list[bytes]
    least: np.ndarray
    part: np.ndarray

    def by_part(self) -> np.ndarray:
        """The order in which texts are sent."""
        return np.argsort(self.part, kind="stable")


def suffix_order(text: np.ndarray, at: np.ndarray, window: int = WINDOW, together: int = TOGETHER) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of the texts, in order of their first `window` bytes at least, and the bytes that each place has to its text's end.

    An end of text is below every byte. A pointer is the first slot of a suffix's bucket, so pointers are ordered as
    the suffixes are as far as these were told apart. About 30 bytes of memory for each byte of the texts.
    """
    n = len(text)
    left = (np.repeat(at[1:], np.diff(at)) - np.arange(n)).astype(np.int32)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.ndarray((n,), ">u8", padded.data, strides=(1,)).astype(U)
    key &= ~U(0xFF)
    short = np.flatnonzero(left < GRAM_BYTES)
    key[short] &= ~((U(1) << (U(8) * (U(8) - left[short].astype(U)))) - U(1))
    key |= np.minimum(left, GRAM_BYTES).astype(U)
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = key[1:] != key[:-1]
    del key
    pointer = np.empty(n, np.int32)
    pointer[order] = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=np.int32), 0))
    # buckets of one suffix, or of suffixes that are at their end, are done
    live = np.flatnonzero(~(fresh & np.append(fresh[1:], True)) & (left[order] >= GRAM_BYTES)).astype(np.int32)
    heads = np.flatnonzero(fresh[live])
    while len(live):
        head = np.searchsorted(heads, together, side="right") - 1
        upto = len(live) if len(live) <= together else int(heads[head]) if head > 0 else int(heads[1]) if len(heads) > 1 else len(live)
        refine(live[:upto], order, pointer, left, window)
        live = live[upto:]
        heads = heads[np.searchsorted(heads, upto) :] - upto
    return order, left


def refine(slots: np.ndarray, order: np.ndarray, pointer: np.ndarray, left: np.ndarray, window: int) -> None:
    """Sorts buckets, which take the slots given, by pointers further and further on until each has one suffix or equal windows."""
    for ahead in range(GRAM_BYTES, window, GRAM_BYTES):
        if not len(slots):
            return
        place = order[slots]
        later = np.zeros(len(place), np.int64)
        more = left[place] > ahead
        later[more] = pointer[place[more] + ahead] + 1
        key = pointer[place].astype(np.int64) << 32 | later
        sort = np.argsort(key, kind="stable")
        key, place = key[sort], place[sort]
        order[slots] = place
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        pointer[place] = np.maximum.accumulate(np.where(fresh, slots, 0))
        slots = slots[~(fresh & np.append(fresh[1:], True)) & (key & 0xFFFFFFFF > 0)]


def window_classes(text: np.ndarray, at: np.ndarray, window: int = WINDOW, together: int = TOGETHER) -> tuple[np.ndarray, np.ndarray]:
    """Window starts with equal windows next to each other, and which of them begin a class of equal windows."""
    order, left = suffix_order(text, at, window, together)
    place = order[left[order] >= window]
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(text) + 1,), "<u8", padded.data, strides=(1,))
    first = np.ones(len(place), bool)
    for i in range(1, len(place), together):
        a, b = place[i - 1 : i + together - 1], place[i : i + together]
        a = a[: len(b)]
        other = np.zeros(len(b), bool)
        for j in (*range(0, window - 8, 8), window - 8):
            other |= eight[a + j] != eight[b + j]
        first[i : i + len(b)] = other
    return place, first


def smallest_ids(texts: list[bytes], ids: np.ndarray, window: int = WINDOW, together: int = TOGETHER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same smallest id: (first run of each text and one more, first window, windows, id)."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    place, first = window_classes(data, at, window, together)
    owner = np.searchsorted(at, place, side="right") - 1
    begin = np.flatnonzero(first)
    least = np.minimum.reduceat(ids[owner], begin) if len(begin) else np.zeros(0, np.int64)
    value = np.full(len(data), -TOP)
    value[place] = least[np.cumsum(first) - 1]
    place = np.sort(place)
    value = value[place]
    owner = np.searchsorted(at, place, side="right") - 1
    change = np.ones(len(place), bool)
    change[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    cut = np.flatnonzero(change)
    return np.searchsorted(owner[cut], np.arange(len(texts) + 1)), place[cut] - at[owner[cut]], np.diff(np.append(cut, len(place))), value[cut]


#: Made once: for a small message a new one takes longer than its bytes.
_COMPRESS, _DECOMPRESS = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray | bytes) -> bytes:
    raw = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    head = np.array([len(raw), *map(len, raw)], "<i8").tobytes()
    return _COMPRESS.compress(head + b"".join(raw))


def unpack(packed: bytes) -> list[bytes]:
    raw = _DECOMPRESS.decompress(packed)
    count = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", count, 8).tolist()
    out, at = [], 8 * (count + 1)
    for n in sizes:
        out.append(raw[at : at + n])
        at += n
    return out


def packed_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK, keep: Sequence[str] = ()) -> DataFrame:
    """Blocks of documents: compressed text, ids, sizes, and the columns in keep as an Arrow stream."""
    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"), *[F.col(f"`{c}`") for c in keep])

    def extra(batch: pa.RecordBatch) -> bytes | None:
        if not keep:
            return None
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        return zstandard.compress(sink.getvalue().to_pybytes(), 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = columns_of(batch, "t")
            raw = data.tobytes()
            # documents without id are below all others for themselves, which `cut` sees to
            ids = np.asarray(batch.column(0).fill_null(TOP).to_numpy(zero_copy_only=False), "<i8")
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(at, at[i] + block_bytes, side="right")) - 1)
                sizes = np.diff(at[i : j + 1]).astype("<i8")
                cells = (zstandard.compress(raw[at[i] : at[j]], 3), ids[i:j].tobytes(), sizes.tobytes(), extra(batch.select(list(keep)).slice(i, j - i)))
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in cells), pa.array([at[j] - at[i]], pa.int64())], names=["packed", "ids", "sizes", "extra", "bytes"])
                i = j

    return picked.mapInArrow(run, "packed binary, ids binary, sizes binary, extra binary, bytes long").withColumn("block", F.monotonically_increasing_id())


def group_answers(notes: list[bytes], inner: int, window: int = WINDOW) -> list[bytes | None]:
    """For each message of a group, its runs of windows whose smallest id is below the message's: (text, first window, windows, id).

    The work for a place is in its texts, and none is in how many messages there are: a corpus of n blocks has n messages for each group.
    """
    counts, sizes, least, raws = zip(*map(unpack, notes), strict=True)
    part = np.repeat(np.tile(np.arange(2 * inner), len(counts)), np.frombuffer(b"".join(counts), "<i4"))
    many = np.array([len(x) // 4 for x in sizes], np.int64)
    size, ids, raw = np.frombuffer(b"".join(sizes), "<i4").astype(np.int64), np.frombuffer(b"".join(least), "<i8"), b"".join(raws)
    del counts, sizes, least, raws
    source, begin, ends = np.repeat(np.arange(len(many)), many), np.cumsum(many) - many, np.cumsum(size)
    by_place = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[by_place], np.arange(2 * inner + 1)).tolist()
    found: list[np.ndarray] = []
    for number in range(2 * inner):
        own = by_place[bounds[number] : bounds[number + 1]]
        if not len(own):
            continue
        seen: dict[bytes, int] = {}
        of = np.array([seen.setdefault(raw[e - n : e], len(seen)) for n, e in zip(size[own].tolist(), ends[own].tolist(), strict=True)], np.int64)
        lowest = np.full(len(seen), TOP)
        np.minimum.at(lowest, of, ids[own])
        if number < inner:
            first, start, length, value = smallest_ids(list(seen), lowest, window)
        else:  # single windows, which are their own classes
            first, start, length, value = np.arange(len(seen) + 1), np.zeros(len(seen), np.int64), np.ones(len(seen), np.int64), lowest
        reps = first[of + 1] - first[of]
        j = np.repeat(np.arange(len(of)), reps)
        run = np.repeat(first[of], reps) + np.arange(len(j)) - np.repeat(np.cumsum(reps) - reps, reps)
        lower = value[run] < ids[own[j]]
        j, run = own[j[lower]], run[lower]
        found.append(np.stack([source[j], j - begin[source[j]], start[run], length[run], value[run]]))
    answers = np.concatenate(found, 1) if found else np.zeros((5, 0), np.int64)
    answers = answers[:, np.argsort(answers[0], kind="stable")]
    upto = np.searchsorted(answers[0], np.arange(len(many) + 1)).tolist()
    return [pack(*(x.astype(t) for x, t in zip(answers[1:, a:b], ("<i4", "<i4", "<i4", "<i8"), strict=True))) if a < b else None for a, b in zip(upto, upto[1:], strict=False)]


def notes_of(table: pa.Table, kind: int) -> dict[int, bytes]:
    return {b: x for k, b, x in zip(table["kind"].to_pylist(), table["bucket"].to_pylist(), table["note"].to_pylist(), strict=True) if k == kind}


def substrings_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_kept: bool = False, block_bytes: int = BLOCK, place_bytes: int = PLACE, group_bytes: int = GROUP, most_groups: int = 1 << 20, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """One row for each row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, and with_kept the bytes left."""
    spark = docs.sparkSession
    prepare(spark)
    if window < GRAM + 4:
        raise ValueError(f"windows have {GRAM + 4} bytes at least")
    blocks = saved(packed_blocks(docs, id_col, text_col, block_bytes), "blocks")
    size = blocks.agg(F.sum("bytes")).first()[0] or 0
    buckets = dealt(spark, size)
    groups = min(dealt(spark, size, group_bytes), most_groups)
    inner = max(1, -(-size // (groups * place_bytes)))

    def open_block(table) -> Block:
        return Block(*(table[c][0].as_py() for c in ("packed", "ids", "sizes")), buckets, window)

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = Block(*(batch.column(c)[i].as_py() for c in ("packed", "ids", "sizes")), buckets, window)
                rows = b.bounds()
                if rows:
                    # 47 bits of the anchor, and whether the block has many texts around it
                    short = b.z >> U(17) << U(1) | b.many.astype(U)
                    notes = [(short[x:y] & U(0xFFFFFFFF)).astype("<u4").tobytes() + (short[x:y] >> U(32)).astype("<u2").tobytes() for _, x, y in rows]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([batch.column("block")[i].as_py()] * len(rows), pa.int64()), pa.array(notes, pa.binary())], names=["bucket", "block", "note"])

    def repeated(table: pa.Table) -> pa.Table:
        notes = table["note"].to_pylist()
        counts = [len(x) // 6 for x in notes]
        values = np.concatenate([np.frombuffer(x, "<u4", n).astype(U) | np.frombuffer(x, "<u2", n, 4 * n).astype(U) << U(32) for x, n in zip(notes, counts, strict=True)])
        distinct, which, count = np.unique(values >> U(1), return_inverse=True, return_counts=True)
        full = np.zeros(len(distinct), bool)
        full[which[(values & U(1)) > 0]] = True
        many, hot = (count > 1)[which], ((count > hot_blocks) | (count > 1) & full)[which]
        ends = np.cumsum(counts).tolist()
        bits = [np.packbits(np.concatenate([many[e - n : e], hot[e - n : e]])).tobytes() if many[e - n : e].any() else None for n, e in zip(counts, ends, strict=True)]
        keep = [x is not None for x in bits]
        out = pa.table({"block": table["block"], "kind": pa.array([1] * len(bits), pa.int32()), "bucket": table["bucket"], "note": pa.array(bits, pa.binary())})
        return out.filter(pa.array(keep))

    schema = "block long, kind int, bucket long, note binary"
    marks = saved(blocks.mapInArrow(send_anchors, "bucket long, block long, note binary").groupBy("bucket").applyInArrow(repeated, schema), "marks")

    def send_runs(block: pa.Table, notes: pa.Table) -> pa.Table:
        rows: dict[str, list] = {"part": [], "block": [], "note": []}
        for i in range(block.num_rows):
            c = open_block(block.slice(i, 1)).candidates(notes_of(notes, 1), groups, inner)
            order = c.by_part()
            group = c.part[order] // (2 * inner)
            cut = np.flatnonzero(np.diff(group, prepend=-1))
            for x, y in stretches(cut, len(order)):
                own = order[x:y]
                mine = [c.texts[o] for o in own.tolist()]
                rows["part"].append(int(group[x]))
                rows["block"].append(block["block"][i].as_py())
                rows["note"].append(pack(np.bincount(c.part[own] % (2 * inner), minlength=2 * inner).astype("<i4"), np.array([len(t) for t in mine], "<i4"), c.least[own].astype("<i8"), b"".join(mine)))
        return pa.table({"part": pa.array(rows["part"], pa.int64()), "block": pa.array(rows["block"], pa.int64()), "note": pa.array(rows["note"], pa.binary())})

    def smallest(table: pa.Table) -> pa.Table:
        packed = group_answers(table["note"].to_pylist(), inner, window)
        keep = [x is not None for x in packed]
        out = pa.table({"block": table["block"], "kind": pa.array([2] * len(packed), pa.int32()), "bucket": table["part"], "note": pa.array(packed, pa.binary())})
        return out.filter(pa.array(keep))

    by_block = blocks.groupBy("block")
    sent = by_block.cogroup(marks.groupBy("block")).applyInArrow(send_runs, "part long, block long, note binary")
    replies = saved(sent.groupBy("part").applyInArrow(smallest, schema), "replies")

    key = docs.schema[id_col].dataType.simpleString()
    result = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{', kept binary' if with_kept else ''}"

    def cut(block: pa.Table, notes: pa.Table) -> pa.Table:
        marks_, replies_ = notes_of(notes, 1), notes_of(notes, 2)
        rows = []
        for i in range(block.num_rows):
            b = open_block(block.slice(i, 1))
            c = b.candidates(marks_, groups, inner)
            covered = np.zeros(len(b.raw) + 1, np.int32)

            def remove(start, length, covered=covered):
                np.add.at(covered, start, 1)
                np.add.at(covered, start + length + window - 1, -1)

            own = b.ids[c.doc]
            local = (c.least[c.of] < own) & (own != TOP)
            remove(c.start[local], c.length[local])
            # texts were sent group by group, in this order
            order = c.by_part()
            group = c.part[order] // (2 * inner)
            by_text = np.argsort(c.of, kind="stable")
            from_text = np.searchsorted(c.of[by_text], np.arange(len(c.least) + 1))
            if replies_:
                parts = list(zip(*map(unpack, replies_.values()), strict=True))
                j, start, length, value = (np.frombuffer(b"".join(x), t) for x, t in zip(parts, ("<i4", "<i4", "<i4", "<i8"), strict=True))
                base = np.searchsorted(group, np.fromiter(replies_, np.int64, len(replies_)))
                text = order[np.repeat(base, [len(x) // 4 for x in parts[0]]) + j]
                reps = from_text[text + 1] - from_text[text]
                k = np.repeat(np.arange(len(j)), reps)
                at = by_text[np.repeat(from_text[text], reps) + np.arange(len(k)) - np.repeat(np.cumsum(reps) - reps, reps)]
                lower = (value[k] < own[at]) & (own[at] != TOP)
                k, at = k[lower], at[lower]
                remove(c.start[at] + start[k], length[k].astype(np.int64))
            gone = np.cumsum(covered[:-1]) > 0
            data = np.frombuffer(b.raw, np.uint8)
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            heads = b.at[:-1][b.at[:-1] < len(gone)]
            begins[heads] = gone[heads]
            n_removed, n_spans = tk.per_text(gone, b.at), tk.per_text(begins, b.at)
            for d, (x, y) in enumerate(zip(b.at[:-1].tolist(), b.at[1:].tolist(), strict=True)):
                left = b.raw[x:y] if not n_removed[d] else data[x:y][~gone[x:y]].tobytes()
                rows.append((None if b.ids[d] == TOP else int(b.ids[d]), y - x, int(n_removed[d]), int(n_spans[d]), hashlib.sha256(left).hexdigest(), *([left] if with_kept else [])))
        names = [x.split()[0] for x in result.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        cols = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, cols, types, strict=False)})

    out = by_block.cogroup(marks.unionByName(replies).groupBy("block")).applyInArrow(cut, result)
    return out if id_col == "doc_id" and key == "bigint" else out.withColumn("doc_id", F.col("doc_id").cast(key)).withColumnRenamed("doc_id", id_col)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document."""
    return substrings_removed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
