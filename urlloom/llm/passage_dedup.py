"""Fuzzy passages that repeat across documents, by collinear chaining of shared seeds.

1. Documents are packed into blocks. Of every `SPREAD` neighbouring five-word shingles the one with the smallest hash is a
   seed, so equal stretches of words have equal seeds. Where a few words repeat again and again, seeds are numbered.
   Of every `LONG_SPREAD` neighbouring shingles of `LONG` words, one is a long seed. Five words may have an unrelated older
   holder; a long seed's first holder has at least `LONG` words of the passage. Every equal stretch of `min_words` words
   has a long seed, two long seeds that follow each other in it leave one word between them at most, and `FLANK`
   reaches from the first and the last of them to its ends.
2. Seeds are joined: each block sends its distinct seeds, with their place in the smallest id that has them; each
   bucket finds the smallest id of all and answers the blocks that have a larger one.
   The first holder may share nothing but the seed. Seeds of more than two places are therefore sent again, each place with the words
   around it; sorted by these, each place gets two partners more: of all places of smaller ids the one that goes on equal for the
   most words, and the one that was equal before for the most. So every place has three partners at most, whatever
   the number of holders, and these are equal to it as far on each side as any is: a run of `min_words` words that any earlier document
   has is equal to one partner of its long seed from the seed to its end, and to another from its begin to the seed.
3. A document's matches with one earlier document, of a long seed its first and last K words, are chained: matches in the order of their places here, a Fenwick tree
   over places there for the best chain to append to, and a cost for the gaps on both sides.
4. Chains go to the block of the earlier document with `FLANK` words on each side, and are aligned: between matches,
   and beyond the ends as far as the score does not drop within those words. An equal stretch never reaches further from its
   last long seed; a changed one may, where for `FLANK` words no ten that follow each other are equal. Gaps of more than
   `BRIDGE` words divide an alignment into stretches, which are judged each by itself.
5. Aligned stretches that follow each other closely in a document are one passage, even where different earlier
   documents have its parts. Its parts of `min_words` words with `identity` or more equal words are cut from the
   document, an equal run of `min_words` always; their first occurrence stays.

Defined cases: words are runs of letters, digits and characters beyond ASCII, with A-Z in lower case. Null texts have none; a
document without id takes and loses nothing; rows of the same id do not match each other; an empty table gives an
empty result; a very long text is a block by itself and is handled whole; of equal seeds in one document the first counts.
Ids that are not whole numbers count as missing. Only the id and the columns in `keep` are carried.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import dealt, dropped, plan_bytes, prepare, saved
from .suffix_dedup import BLOCK, TOP, pack, packed_blocks, stretches, unpack

U = np.uint64
K = 5
SPREAD = 6
#: Words of a long seed, and shingles of which one is taken: together one word more than a passage's least length.
LONG = 25
LONG_SPREAD = 26
#: Seeds of one document that repeat within so many words are told apart by number; less than a passage's least length.
NEAR = 40
#: Words of context that are sent with a chain, on each side: as far as an end of an equal stretch can be from a long seed.
FLANK = 26
#: Words around a long and around another seed, on each side, by which partners are compared. A passage's least length has
#: no more beside its long seed.
AROUND_LONG, AROUND = LONG_SPREAD - 1, 8
#: Words that an alignment bridges at most.
BRIDGE = 48


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    identity: float = 0.75
    #: Words between aligned stretches of one passage.
    join_gap: int = 12
    #: What a chain loses for each word of a gap, when a match counts for K words.
    gap_cost: float = 0.06
    #: Chains of fewer words or matches are not aligned.
    least_words: int = 12
    least_seeds: int = 2
    #: How far the score may drop where an alignment is extended; equal words count 1, others -1.
    drop: int = 8


class Block:
    """The words and seeds of a packed block."""

    def __init__(self, packed: bytes, ids: bytes, sizes: bytes):
        self.raw = zstandard.decompress(packed)
        self.ids = np.frombuffer(ids, "<i8")
        self.at = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<i8"))]).astype(np.int64)
        low = tk.LOWER[np.frombuffer(self.raw, np.uint8)]
        self.starts, self.ends, self.first = tk.words(low, self.at, tk.ALNUM)
        self.hash = tk.word_hashes(low, self.starts, self.ends)
        self.words = (self.hash >> U(32)).astype(np.uint32)

    def seeds(self, buckets: int) -> None:
        sh, whole = tk.shingles(self.hash, self.first, K)
        # documents of fewer shingles than a window: all of theirs
        few = np.repeat(np.diff(self.first) < SPREAD - 1 + K, np.diff(self.first))
        short = np.flatnonzero((self.smallest(sh, K, SPREAD) | few) & whole)
        long_sh = np.zeros(len(sh), U)
        n = max(0, len(sh) - LONG + 1)
        for j in range(0, LONG, K):
            long_sh[:n] = tk.mix(long_sh[:n] * U(0x9E3779B97F4A7C15) + sh[j : n + j])
        long_ = np.flatnonzero(self.smallest(long_sh, LONG, LONG_SPREAD))
        place = np.concatenate([short, long_])
        z = np.concatenate([tk.mix(sh[short] + U(77)), tk.mix(long_sh[long_] + U(78))])
        order = np.argsort(place, kind="stable")
        self.place, self.long = place[order], order >= len(short)
        self.owner = np.searchsorted(self.first, self.place, side="right") - 1
        z = self.numbered(z[order])
        own = self.ids[self.owner]
        order = np.lexsort((self.place, own, z))
        new = np.ones(len(order), bool)
        new[1:] = z[order][1:] != z[order][:-1]
        lead = order[new]
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        bucket = (z[lead] % U(buckets)).astype(np.int64)
        sort = np.lexsort((z[lead], bucket))
        rank = np.empty(len(sort), np.int64)
        rank[sort] = np.arange(len(sort))
        self.which = rank[self.which]
        #: The place of each distinct seed in the block's smallest id that has it.
        self.lead, self.z, self.bucket = lead[sort], z[lead][sort], bucket[sort]

    def smallest(self, sh: np.ndarray, k: int, spread: int) -> np.ndarray:
        """Which shingles of k words have the smallest hash of `spread` neighbours inside one document."""
        taken = np.zeros(len(sh), bool)
        n = len(sh) - spread + 1
        if n <= 0:
            return taken
        m = sh.copy()
        size = 1
        while 2 * size <= spread:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        m = np.minimum(m[: len(m) - (spread - size)], m[spread - size :]) if size < spread else m
        # windows must be inside one document: the last shingle of each is a whole one, as are those before it
        last = np.repeat(self.first[1:], np.diff(self.first))
        windows = np.flatnonzero(np.arange(n) + spread - 1 + k <= last[:n])
        for j in range(spread):
            taken[windows[sh[windows + j] == m[windows]] + j] = True
        return taken

    def numbered(self, z: np.ndarray) -> np.ndarray:
        """Seeds that repeat within NEAR words are numbered, so that the places of a periodic stretch differ.

        A copy of a passage is further away, so the seeds of a second copy equal those of the first.
        """
        order = np.lexsort((self.place, self.owner, z))
        near = np.zeros(len(order), bool)
        a, b = order[:-1], order[1:]
        near[1:] = (z[a] == z[b]) & (self.owner[a] == self.owner[b]) & (self.place[b] - self.place[a] <= NEAR)
        if not near.any():
            return z
        at = np.arange(len(order))
        rank = np.empty(len(order), np.int64)
        rank[order] = at - np.maximum.accumulate(np.where(near, 0, at))
        return np.where(rank > 0, tk.mix(z + rank.astype(U) * U(0x9E3779B97F4A7C15)), z)

    def bounds(self) -> list[tuple[int, int, int]]:
        cut = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        return [(int(self.bucket[a]), a, b) for a, b in stretches(cut, len(self.bucket))]

    def open_places(self, notes: list[bytes]) -> list[tuple[int, np.ndarray]]:
        """(bucket, seeds by number) of the places whose seeds other notes call open, always in the same order."""
        mask, begin = np.zeros(len(self.lead), bool), {bucket: (s, e) for bucket, s, e in self.bounds()}
        for note in notes:
            bucket, bits = unpack(note)
            s, e = begin[int(np.frombuffer(bucket, "<i8")[0])]
            mask[s:e] = np.unpackbits(np.frombuffer(bits, np.uint8), count=e - s)
        at = np.flatnonzero(mask[self.which] & (self.ids[self.owner] != TOP))
        at = at[np.argsort(self.which[at], kind="stable")]
        bucket = self.bucket[self.which[at]]
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        return [(int(bucket[s]), at[s:e]) for s, e in stretches(cut, len(at))]

    def around(self, at: np.ndarray, size: int, n: int) -> np.ndarray:
        """The n words after and the n words before seeds of `size` words, the nearest first; zero beyond the text."""
        place, owner, step = self.place[at][:, None], self.owner[at], np.arange(n)
        after, before = place + size + step, place - 1 - step
        inside = np.concatenate([after < self.first[owner + 1][:, None], before >= self.first[owner][:, None]], 1)
        where = np.clip(np.concatenate([after, before], 1), 0, max(0, len(self.words) - 1))
        return np.where(inside, self.words[where], 0).astype("<u4")


def nearest(z: np.ndarray, around: np.ndarray, ids: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each place, the place of the same seed and a smaller id that has most of the words around in common, or -1.

    Of equally good ones it is the one of the least rank, which orders by id first; -1 too if that is the first of
    all places of the seed. Sorted by their words, those that have j words in common are neighbours, so one
    sort and a minimum for each j will do.
    """
    n, words = around.shape
    order = np.lexsort((*around.T[::-1], z))
    equal = np.zeros((max(0, n - 1), words + 1), bool)
    np.equal(around[order[1:]], around[order[:-1]], out=equal[:, :words])
    common = np.where(z[order[1:]] == z[order[:-1]], equal.argmin(1), -1)
    by_rank, own = np.empty(n, np.int64), ids[order]
    dense = np.empty(n, np.int64)
    by_rank[:] = np.argsort(rank, kind="stable")
    dense[by_rank] = np.arange(n)
    dense = dense[order]
    best = np.full(n, -1)
    for j in range(words, -1, -1):
        starts = np.concatenate([[0], np.flatnonzero(common < j) + 1])
        low = by_rank[np.repeat(np.minimum.reduceat(dense, starts), np.diff(np.append(starts, n)))]
        if j:
            better = (best < 0) & (ids[low] < own)
            best[better] = low[better]
        else:
            best[best == low] = -1
    out = np.empty(n, np.int64)
    out[order] = best
    return out


def planes(a: np.ndarray) -> bytes:
    """Bytes of equal significance together, which compresses numbers of similar size."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unplanes(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def chains(x: np.ndarray, y: np.ndarray, rules: Rules) -> list[np.ndarray]:
    """Collinear chains of matches (x here, y there), best first; each match is in one chain at most.

    f(i) = K + max(0, max over j before i in both of f(j) - cost * (x_i - x_j + y_i - y_j)). The cost is separable, so a
    Fenwick tree over the ranks of y holds the largest f(j) + cost * (x_j + y_j) of every prefix.
    """
    order = np.lexsort((-y, x))
    xs, ys = x[order].tolist(), y[order].tolist()
    n, cost = len(xs), rules.gap_cost
    rank = np.searchsorted(np.unique(y), y[order]).tolist()
    width = max(rank) + 1
    best, who = [-1e18] * (width + 1), [-1] * (width + 1)
    score, back = [0.0] * n, [-1] * n
    i = 0
    while i < n:
        # matches of the same x see only those before it
        j = i
        while j < n and xs[j] == xs[i]:
            at, g, b = rank[j], -1e18, -1
            while at > 0:
                if best[at] > g:
                    g, b = best[at], who[at]
                at &= at - 1
            gain = g - cost * (xs[j] + ys[j])
            score[j], back[j] = (K + gain, b) if gain > 0 else (float(K), -1)
            j += 1
        for t in range(i, j):
            at, g = rank[t] + 1, score[t] + cost * (xs[t] + ys[t])
            while at <= width:
                if g > best[at]:
                    best[at], who[at] = g, t
                at += at & -at
        i = j
    used = [False] * n
    out = []
    for t in sorted(range(n), key=score.__getitem__, reverse=True):
        chain = []
        while t >= 0 and not used[t]:
            used[t] = True
            chain.append(t)
            t = back[t]
        if len(chain) >= rules.least_seeds and xs[chain[0]] + K - xs[chain[-1]] >= rules.least_words:
            out.append(order[np.array(chain[::-1])])
    return out


def gap_matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which words of a an alignment of two stretches can make equal: a longest common subsequence.

    It is the longest chain of pairs of equal words that increases on both sides, found by bisection over the
    least last word of chains of each length: n log n for the n pairs, whatever the sizes.
    """
    taken = np.zeros(len(a), bool)
    if not len(a) or not len(b):
        return taken
    if np.array_equal(a, b):
        return ~taken
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a), np.searchsorted(b[order], a, side="right")
    ends: list[int] = []
    last: list[int] = []
    links: list[tuple[int, int]] = []
    for i in np.flatnonzero(high > low).tolist():
        # of one word here the later words there come first, so that it is in a chain once
        for j in order[low[i] : high[i]][::-1].tolist():
            at = bisect_left(ends, j)
            links.append((i, last[at - 1] if at else -1))
            if at == len(ends):
                ends.append(j)
                last.append(len(links) - 1)
            else:
                ends[at], last[at] = j, len(links) - 1
    k = last[-1] if last else -1
    while k >= 0:
        i, k = links[k]
        taken[i] = True
    return taken


def extended(a: np.ndarray, b: np.ndarray, drop: int) -> np.ndarray:
    """Which words are equal as far as two stretches go on together from their start."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    if not n:
        return same
    score = np.cumsum(np.where(same, 1, -1))
    fallen = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score > drop)
    upto = fallen[0] if len(fallen) else n
    if not upto:
        return same[:0]
    at = int(score[:upto].argmax())
    return same[: at + 1] if score[at] > 0 else same[:0]


def align(here: np.ndarray, there: np.ndarray, x: np.ndarray, y: np.ndarray, rules: Rules) -> list[tuple[int, int, np.ndarray]]:
    """Stretches (first word, end, which words are equal) of `here` that match `there` along a chain of seeds (x, y).

    Neighbouring seeds on one diagonal are compared word by word; between diagonals the gap is aligned, and the
    chain is cut where less than half of a gap and what follows it is equal. Gaps on one diagonal need no cut, as
    passages() takes the parts of a stretch that are equal enough.
    """
    runs: list[list[int]] = []
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        if runs and a - runs[-1][0] == b - runs[-1][1] and a - runs[-1][2] <= BRIDGE:
            runs[-1][2] = a + K
        else:
            if runs and (a < runs[-1][2] or b < runs[-1][1] + runs[-1][2] - runs[-1][0]):
                over = max(runs[-1][2] - a, runs[-1][1] + runs[-1][2] - runs[-1][0] - b)
                if over >= K:
                    continue
                a, b = a + over, b + over
                runs.append([a, b, a + K - over])
                continue
            runs.append([a, b, a + K])
    out: list[list] = []
    for a, b, e in runs:
        equal = here[a:e] == there[b : b + e - a]
        if out:
            gap = (a - out[-1][1], b - out[-1][4])
            inside = gap_matches(here[out[-1][1] : a], there[out[-1][4] : b]) if max(gap) <= BRIDGE else None
            if inside is not None and (max(gap) <= 3 or 2 * inside.sum() + (e - a) >= max(gap)):
                out[-1][2] += [inside, equal]
                out[-1][1], out[-1][4] = e, b + e - a
                continue
        out.append([a, e, [equal], b, b + e - a])
    done: list[tuple[int, int, np.ndarray]] = []
    for k, (a, e, equal, b, end) in enumerate(out):
        stop, stop_there = (out[k + 1][0], out[k + 1][3]) if k + 1 < len(out) else (len(here), len(there))
        begin, begin_there = (done[-1][1], out[k - 1][4]) if done else (0, 0)
        before = extended(here[begin:a][::-1], there[begin_there:b][::-1], rules.drop)
        after = extended(here[e:stop], there[end:stop_there], rules.drop)
        done.append((a - len(before), e + len(after), np.concatenate([before[::-1], *equal, after])))
    return done


def qualifying(equal: np.ndarray, rules: Rules) -> list[tuple[int, int]]:
    """Parts [a, e) of min_words words with identity or more equal ones that begin and end with an equal word.

    The longest is taken first, then what lies before and after it. A run of min_words equal words is always
    taken: a part that overlapped it would be longer with it.
    """
    out, todo = [], [(0, len(equal))]
    while todo:
        s, t = todo.pop()
        if t - s < rules.min_words:
            continue
        at = s + np.flatnonzero(equal[s:t])
        if len(at) < rules.identity * rules.min_words:
            continue
        # equal words up to and with the i-th of them, less what identity asks for
        upto = np.arange(1, len(at) + 1) - rules.identity * (at + 1)
        ahead = np.arange(len(at)) - rules.identity * at
        best = np.maximum.accumulate(upto[::-1])[::-1]
        # for each begin, the last end that is good enough: best falls, so it is found by bisection
        last = len(at) - 1 - np.searchsorted(best[::-1], ahead - 1e-9)
        size = np.where(last >= np.arange(len(at)), at[np.maximum(last, 0)] + 1 - at, 0)
        k = int(size.argmax())
        if size[k] < rules.min_words:
            continue
        a, e = int(at[k]), int(at[last[k]]) + 1
        out.append((a, e))
        todo += [(s, a), (e, t)]
    return sorted(out)


def passages(stretches: list[tuple[int, int, np.ndarray, int]], rules: Rules) -> list[tuple[int, int, list[int]]]:
    """(first word, end, earlier ids) of a document's passages, from stretches (first word, end, which words are equal, earlier id).

    A word counts as equal if it is in any stretch, and is the smallest such id's. Of stretches that follow each other the parts that
    are equal enough are cut; a stretch that is a passage by itself is always cut, whatever lies around it.
    """
    stretches = sorted(stretches, key=lambda v: (v[0], v[1], v[3]))
    out: list[tuple[int, int, list[int]]] = []
    s = 0
    while s < len(stretches):
        begin, end, t = stretches[s][0], stretches[s][1], s + 1
        while t < len(stretches) and stretches[t][0] <= end + rules.join_gap:
            end = max(end, stretches[t][1])
            t += 1
        near, s = stretches[s:t], t
        if end - begin < rules.min_words:
            continue
        union, holder = np.zeros(end - begin, bool), np.zeros(end - begin, np.int64)
        parts: list[tuple[int, int]] = []
        for a, e, equal, ref in sorted(near, key=lambda v: v[3]):
            a, e = a - begin, e - begin
            holder[a:e][equal & ~union[a:e]] = ref
            union[a:e] |= equal
            if e - a >= rules.min_words and equal.sum() >= rules.identity * (e - a):
                parts.append((a, e))
        joined: list[list[int]] = []
        for a, e in sorted([*parts, *qualifying(union, rules)]):
            if joined and a < joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], e)
            else:
                joined.append([a, e])
        out += [(begin + a, begin + e, np.unique(holder[a:e][union[a:e]]).tolist()) for a, e in joined]
    return out


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules | None = None, with_kept: bool = False, keep: Sequence[str] = (), block_bytes: int = BLOCK) -> DataFrame:
    """One row for each row of docs: doc_id, the columns in keep, n_words, n_passages, n_removed_words, source_ids (where they occur first), kept_sha256, and with_kept the text left."""
    spark, rules = docs.sparkSession, rules or Rules()
    prepare(spark)
    buckets = dealt(spark, plan_bytes(docs), 8 << 20)
    keep = [c for c in keep if c != text_col]
    blocks = saved(packed_blocks(docs, id_col, text_col, block_bytes, keep), "blocks")
    schema = "block long, kind int, note binary"

    def rows_of(rows: list[tuple]) -> pa.Table:
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.table({"block": pa.array(cols[0], pa.int64()), "kind": pa.array(cols[1], pa.int32()), "note": pa.array(cols[2], pa.binary())})

    def opened(row) -> Block:
        return Block(*(row[c][0].as_py() for c in ("packed", "ids", "sizes")))

    def send_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                b = opened(row)
                b.seeds(buckets)
                out = []
                times = np.minimum(np.bincount(b.which, minlength=len(b.lead)), 255).astype(np.uint8)
                for bucket, s, e in b.bounds():
                    lead = b.lead[s:e]
                    z = b.z[s:e] >> U(16)
                    owner = b.owner[lead]
                    short = (z & U(0xFFFFFFFF)).astype("<u4").tobytes() + (z >> U(32)).astype("<u2").tobytes()
                    note = pack(short, planes(b.ids[owner].astype("<i8")), planes(owner.astype("<u4")), planes((b.place[lead] - b.first[owner]).astype("<u4")), times[s:e])
                    out.append((bucket, row["block"][0].as_py(), note))
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["bucket", "block", "note"])

    def first_places(table: pa.Table) -> pa.Table:
        blocks_ = table["block"].to_pylist()
        z, ids, owner, place, times, sizes = [], [], [], [], [], []
        for note in table["note"].to_pylist():
            short, i, o, p, t = unpack(note)
            n = len(short) // 6
            z.append(np.frombuffer(short, "<u4", n).astype(U) | np.frombuffer(short, "<u2", n, 4 * n).astype(U) << U(32))
            ids.append(unplanes(i, "<i8"))
            owner.append(unplanes(o, "<u4"))
            place.append(unplanes(p, "<u4"))
            times.append(np.frombuffer(t, np.uint8))
            sizes.append(n)
        z, ids, owner, place, times = (np.concatenate(v) for v in (z, ids, owner, place, times))
        source = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((np.array(blocks_, np.int64)[source], ids, z))
        new = np.ones(len(order), bool)
        new[1:] = z[order][1:] != z[order][:-1]
        lead, more = np.empty(len(order), np.int64), np.empty(len(order), bool)
        lead[order] = order[new][np.cumsum(new) - 1]
        # seeds of two places have one partner, so the others are open
        more[order] = (np.add.reduceat(times[order].astype(np.int64), np.flatnonzero(new)) > 2)[np.cumsum(new) - 1]
        answer = ids[lead] < ids
        out, begin = [], 0
        for k, n in enumerate(sizes):
            sel = np.flatnonzero(answer[begin : begin + n])
            ref = lead[begin + sel]
            if more[begin : begin + n].any():
                out.append((blocks_[k], 5, pack(np.array([table["bucket"][0].as_py()], "<i8"), np.packbits(more[begin : begin + n]))))
            begin += n
            if len(sel):
                where = np.array(blocks_, np.int64)[source[ref]]
                out.append((blocks_[k], 1, pack(np.array([table["bucket"][0].as_py()], "<i8"), planes(sel.astype("<u4")), planes(ids[ref].astype("<i8")), planes(where.astype("<i8")), planes(owner[ref]), planes(place[ref]))))
        return rows_of(out)

    answers = saved(blocks.mapInArrow(send_seeds, "bucket long, block long, note binary").groupBy("bucket").applyInArrow(first_places, schema), "answers")

    def of_kind(notes: pa.Table, kind: int) -> list[bytes]:
        return notes.filter(pc.equal(notes["kind"], kind))["note"].to_pylist()

    def send_places(block: pa.Table, notes: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for r in range(block.num_rows):
            row = block.slice(r, 1)
            b = opened(row)
            b.seeds(buckets)
            for bucket, at in b.open_places(of_kind(notes, 5)):
                owner, z = b.owner[at], b.z[b.which[at]]
                long_, other = b.around(at[b.long[at]], LONG, AROUND_LONG), b.around(at[~b.long[at]], K, AROUND) >> np.uint32(16)
                note = pack(b.long[at], z, planes(b.ids[owner].astype("<i8")), planes(owner.astype("<u4")), planes((b.place[at] - b.first[owner]).astype("<u4")), long_, other.astype("<u2"))
                out.append((bucket, row["block"][0].as_py(), note))
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({"bucket": pa.array(cols[0], pa.int64()), "block": pa.array(cols[1], pa.int64()), "note": pa.array(cols[2], pa.binary())})

    def partners(table: pa.Table) -> pa.Table:
        cells = list(zip(*map(unpack, table["note"].to_pylist()), strict=True))
        long_, z = np.frombuffer(b"".join(cells[0]), bool), np.frombuffer(b"".join(cells[1]), "<u8")
        sizes = np.array([len(x) for x in cells[0]], np.int64)
        ids, owner, place = (np.concatenate([unplanes(x, t) for x in c]) for c, t in zip(cells[2:5], ("<i8", "<u4", "<u4"), strict=True))
        source, begin = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
        blocks_ = np.array(table["block"].to_pylist(), np.int64)[source]
        rank = np.empty(len(z), np.int64)
        rank[np.lexsort((place, owner, blocks_, ids))] = np.arange(len(z))
        found_ = np.full((2, len(z)), -1)
        for which, words, kind, n in ((long_, cells[5], "<u4", AROUND_LONG), (~long_, cells[6], "<u2", AROUND)):
            at = np.flatnonzero(which)
            around = np.frombuffer(b"".join(words), kind).reshape(-1, 2 * n)
            for side in range(2 if len(at) else 0):
                best = nearest(z[at], around[:, side * n : (side + 1) * n], ids[at], rank[at])
                found_[side, at] = np.where(best < 0, -1, at[best])
        found_[1, found_[0] == found_[1]] = -1
        side, at = np.nonzero(found_ >= 0)
        ref = found_[side, at]
        order = np.argsort(at, kind="stable")
        at, ref = at[order], ref[order]
        out, upto = [], np.searchsorted(at, np.append(begin, len(z))).tolist()
        bucket = np.array([table["bucket"][0].as_py()], "<i8")
        for k, (s, e) in enumerate(zip(upto, upto[1:], strict=False)):
            if s < e:
                f = ref[s:e]
                out.append((int(blocks_[begin[k]]), 6, pack(bucket, planes((at[s:e] - begin[k]).astype("<u4")), planes(ids[f].astype("<i8")), planes(blocks_[f].astype("<i8")), planes(owner[f].astype("<u4")), planes(place[f].astype("<u4")))))
        return rows_of(out)

    by_block = blocks.groupBy("block")
    places = by_block.cogroup(answers.where("kind = 5").groupBy("block")).applyInArrow(send_places, "bucket long, block long, note binary")
    more = saved(places.groupBy("bucket").applyInArrow(partners, schema), "partners")

    def chain(block: pa.Table, notes: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for r in range(block.num_rows):
            row = block.slice(r, 1)
            own_block = row["block"][0].as_py()
            b = opened(row)
            b.seeds(buckets)
            lead_owner = b.owner[b.lead]
            ref_id, ref_block = b.ids[lead_owner].copy(), np.full(len(b.lead), own_block)
            ref_doc, ref_place = lead_owner.copy(), b.place[b.lead] - b.first[lead_owner]
            begin = {bucket: s for bucket, s, _ in b.bounds()}
            for note in of_kind(notes, 1):
                bucket, sel, i, w, o, p = unpack(note)
                at = begin[int(np.frombuffer(bucket, "<i8")[0])] + unplanes(sel, "<u4").astype(np.int64)
                ref_id[at], ref_block[at], ref_doc[at], ref_place[at] = unplanes(i, "<i8"), unplanes(w, "<i8"), unplanes(o, "<u4"), unplanes(p, "<u4")
            own = b.ids[b.owner]
            hit = np.flatnonzero((ref_id[b.which] < own) & (own != TOP))
            w = b.which[hit]
            matches = [(hit, ref_id[w], ref_block[w], ref_doc[w], ref_place[w])]
            places = dict(b.open_places(of_kind(notes, 5)))
            for note in of_kind(notes, 6):
                bucket, sel, i, w, o, p = unpack(note)
                at = places[int(np.frombuffer(bucket, "<i8")[0])][unplanes(sel, "<u4")]
                matches.append((at, unplanes(i, "<i8"), unplanes(w, "<i8"), unplanes(o, "<u4"), unplanes(p, "<u4")))
            hit, m_id, m_block, m_doc, m_place = (np.concatenate(v).astype(np.int64) for v in zip(*matches, strict=True))
            # a long seed matches with its first and with its last words
            ends = np.flatnonzero(b.long[hit])
            shift = np.concatenate([np.zeros(len(hit), np.int64), np.full(len(ends), LONG - K)])
            hit, m_id, m_block, m_doc, m_place = (np.concatenate([v, v[ends]]) for v in (hit, m_id, m_block, m_doc, m_place))
            here, there, owner = b.place[hit] + shift, m_place + shift, b.owner[hit]
            order = np.lexsort((there, here, m_doc, m_block, owner))
            owner, m_id, m_block, m_doc, here, there = (v[order] for v in (owner, m_id, m_block, m_doc, here, there))

            def changes(*columns: np.ndarray) -> np.ndarray:
                change = np.zeros(len(columns[0]), bool)
                change[:1] = True
                for v in columns:
                    change[1:] |= v[1:] != v[:-1]
                return change

            once = changes(here, there, m_doc, m_block, owner)
            owner, m_id, m_block, m_doc, here, there = (v[once] for v in (owner, m_id, m_block, m_doc, here, there))
            cut = np.flatnonzero(changes(owner, m_block, m_doc))
            asked: dict[int, dict[bytes, int]] = {}
            mine: list[tuple[int, int, int, int, int]] = []
            for s, e in stretches(cut, len(owner)):
                if e - s < rules.least_seeds:
                    continue
                doc = int(owner[s])
                x, y = here[s:e] - b.first[doc], there[s:e]
                if x[-1] + K - x[0] < rules.least_words:
                    continue
                target, other = int(m_block[s]), int(m_doc[s])
                total = int(b.first[doc + 1] - b.first[doc])
                for c in chains(x, y, rules):
                    low, high = max(0, int(x[c[0]]) - FLANK), min(total, int(x[c[-1]]) + K + FLANK)
                    words = b.words[b.first[doc] + low : b.first[doc] + high]
                    key = np.array([other, len(c), len(words)], "<i8").tobytes() + (x[c] - low).astype("<i4").tobytes() + y[c].astype("<i4").tobytes() + words.astype("<u4").tobytes()
                    to = asked.setdefault(target, {})
                    mine.append((target, to.setdefault(key, len(to)), doc, low, int(m_id[s])))
            for target, to in asked.items():
                out.append((target, 2, pack(np.array([own_block], "<i8"), np.array([len(k) for k in to], "<i8"), b"".join(to))))
            if mine:
                out.append((own_block, 3, pack(*(np.array(v, "<i8") for v in zip(*mine, strict=True)))))
        return rows_of(out)

    found = saved(by_block.cogroup(answers.unionByName(more).groupBy("block")).applyInArrow(chain, schema), "chains")

    def aligned(block: pa.Table, notes: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if not notes.num_rows:
            return rows_of(out)
        for r in range(block.num_rows):
            row = block.slice(r, 1)
            b = opened(row)
            for note in notes["note"].to_pylist():
                source, sizes, raw = unpack(note)
                at, result = 0, []
                for number, size in enumerate(np.frombuffer(sizes, "<i8").tolist()):
                    piece = raw[at : at + size]
                    at += size
                    doc, n, n_words = np.frombuffer(piece, "<i8", 3).tolist()
                    x, y = np.frombuffer(piece, "<i4", n, 24).astype(np.int64), np.frombuffer(piece, "<i4", n, 24 + 4 * n).astype(np.int64)
                    here = np.frombuffer(piece, "<u4", n_words, 24 + 8 * n)
                    low = max(0, int(y[0]) - FLANK)
                    there = b.words[b.first[doc] + low : min(b.first[doc + 1], b.first[doc] + int(y[-1]) + K + FLANK)]
                    result += [(number, *v) for v in align(here, there, x, y - low, rules)]
                if result:
                    *places, equal = zip(*result, strict=True)
                    out.append((int(np.frombuffer(source, "<i8")[0]), 4, pack(np.array([row["block"][0].as_py()], "<i8"), *(np.array(v, "<i8") for v in places), np.packbits(np.concatenate(equal)))))
        return rows_of(out)

    replies = saved(by_block.cogroup(found.where("kind = 2").groupBy("block")).applyInArrow(aligned, schema), "aligned")
    names = ["doc_id", "n_words", "n_passages", "n_removed_words", "source_ids", "kept_sha256", *(["kept"] if with_kept else [])]
    keep = [c for c in keep if c not in names]
    kinds_of = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    result = f"doc_id long, n_words long, n_passages long, n_removed_words long, source_ids array<long>, kept_sha256 string{', kept string' if with_kept else ''}" + "".join(f", `{c}` {kinds_of[c]}" for c in keep)

    def cut(block: pa.Table, notes: pa.Table) -> pa.Table:
        rows, carried = [], []
        kinds, raw_notes = notes["kind"].to_pylist(), notes["note"].to_pylist()
        for r in range(block.num_rows):
            b = opened(block.slice(r, 1))
            if keep:
                carried += pa.ipc.open_stream(zstandard.decompress(block["extra"][r].as_py())).read_all().to_batches()
            matched: dict[int, list] = {}
            got: dict[tuple[int, int], list] = {}
            for kind, note in zip(kinds, raw_notes, strict=True):
                if kind == 4:
                    *places, bits = unpack(note)
                    target, number, a, e = (np.frombuffer(v, "<i8").tolist() for v in places)
                    equal, at = np.unpackbits(np.frombuffer(bits, np.uint8)).view(bool), 0
                    for i, low, high in zip(number, a, e, strict=True):
                        got.setdefault((target[0], i), []).append((low, high, equal[at : at + high - low]))
                        at += high - low
            for kind, note in zip(kinds, raw_notes, strict=True):
                if kind == 3:
                    for target, number, doc, low, ref in zip(*(np.frombuffer(v, "<i8").tolist() for v in unpack(note)), strict=True):
                        for a, e, equal in got.get((target, number), ()):
                            matched.setdefault(doc, []).append((a + low, e + low, equal, ref))
            for d, (s, e) in enumerate(zip(b.at[:-1].tolist(), b.at[1:].tolist(), strict=True)):
                found_ = passages(matched.get(d, []), rules)
                first, parts, at, removed = int(b.first[d]), [], s, 0
                for a, z, _ in found_:
                    parts.append(b.raw[at : int(b.starts[first + a])])
                    at, removed = int(b.ends[first + z - 1]), removed + z - a
                parts.append(b.raw[at:e])
                left = b"".join(parts)
                refs = sorted({x for _, _, v in found_ for x in v})
                rows.append((None if b.ids[d] == TOP else int(b.ids[d]), int(b.first[d + 1]) - first, len(found_), removed, refs, hashlib.sha256(left).hexdigest(), *([left.decode("utf-8", "replace")] if with_kept else [])))
        types = [*[pa.int64()] * 4, pa.list_(pa.int64()), pa.string(), pa.string()]
        cols = list(zip(*rows, strict=True)) or [[]] * len(names)
        out = pa.table({n: pa.array(c, t) for n, c, t in zip(names, cols, types, strict=False)})
        for c in keep:
            out = out.append_column(c, pa.Table.from_batches(carried)[c])
        return out

    dropped(answers, more)
    return by_block.cogroup(found.where("kind = 3").unionByName(replies).groupBy("block")).applyInArrow(cut, result)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages cut from every document."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
