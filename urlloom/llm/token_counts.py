"""Edit-aware token counts: a segment tree over each document's pre-tokens.

Each leaf holds pre-tokens, their characters and their tokens; inner nodes hold sums, so the root is the
document's count and a position is found from the top in a logarithmic number of steps. An edit touches the leaves that
it overlaps, and `CONTEXT` characters before it, as far as a pre-token's match can look ahead. From the
leaf boundary there, text is cut into pre-tokens anew until a new boundary meets an old one behind the
edit: matches depend only on what follows them, so all later pre-tokens stay. Only the new pre-tokens are
encoded, the first touched leaf takes them, the others become empty, and the sums on their paths are updated.

`kept_trees` makes a table of trees, which keep their leaves' characters and tokens beside the text, and `edited_trees` applies a table of edits to it:
it joins the edits with their documents, reads no other text, and encodes only what the edits touch. Its rows replace
those of the same id, so that batches of edits follow each other. `counted` does both in one pass for a rule or a table.

Defined cases: a null text counts as empty and has no tokens; strings of special tokens inside texts
are ordinary text; a text of any length has one tree; edits are clipped to the text, and of overlapping edits the earlier one wins (of those with
equal ends the one that is first in order of its replacement); edits of equal places are all one; repeated
document rows each get all edits of their id; edits of unknown documents, or without an id, do nothing. Only the id and the
columns in `keep` are carried.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import BPE, CACHED, CACHED_CHARS, loaded
from .common import prepare

CONTEXT = 4
RESULT = "n_tokens long, n_edits long, n_tokens_after long, n_pretokens long, n_reencoded long"
TREE = ("text", "chars", "tokens", "n_tokens")
#: What takes a match's place, a sign that a text must have for one (null: none), and the pattern.
Rule = tuple[str, str | None, str]
#: What the registered query edits: e-mail addresses and telephone numbers become tags.
SCRUB = (("[EMAIL]", "@", r"[\w.+-]+@[\w-]+\.[\w.-]*\w"), ("[PHONE]", r"\d[\d ()-]{7}", r"(?:\+\d|\d)[\d ()-]{7,}\d"))

Edit = tuple[int, int, str]


class Counter:
    """Token counts of pre-tokens, in a bounded two-generation cache."""

    def __init__(self, bpe: BPE, pattern: str):
        self.bpe, self.pattern = bpe, regex.compile(pattern)
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def learn(self, tokens: Sequence[str]) -> dict[str, int]:
        """Counts of all the pre-tokens given; only unknown ones are encoded."""
        if len(self.young) > CACHED:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = []
        for t in set(tokens).difference(young):
            if t in old:
                young[t] = old[t]
            else:
                new.append(t)
        if not new:
            return young
        counts = [len(x) for x in self.bpe.merge_many([t.encode() for t in new])]
        young.update((t, c) for t, c in zip(new, counts, strict=True) if len(t) <= CACHED_CHARS)
        here = {t: c for t, c in zip(new, counts, strict=True) if len(t) > CACHED_CHARS}
        return young | here if here else young


class CountTree:
    """The segment tree of one document; chars and tokens are arrays in heap order."""

    def __init__(self, counter: Counter, leaves: list[str], counts: Sequence[int] | np.ndarray):
        self.counter, self.leaves = counter, leaves
        #: Pre-tokens and their counts of the leaves that edits have changed.
        self.changed: dict[int, tuple[list[str], list[int]]] = {}
        n = len(leaves)
        self.width = 1 << max(0, n - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * self.width, np.int64), np.zeros(2 * self.width, np.int64)
        self.chars[self.width : self.width + n] = [len(t) for t in leaves]
        self.tokens[self.width : self.width + n] = counts
        level = self.width
        while level > 1:
            half = level // 2
            for tree in (self.chars, self.tokens):
                np.add(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2], out=tree[half:level])
            level = half
        self.reencoded = 0

    @classmethod
    def of(cls, counter: Counter, text: str) -> CountTree:
        leaves = counter.pattern.findall(text)
        known = counter.learn(leaves)
        return cls(counter, leaves, [known[t] for t in leaves])

    @classmethod
    def kept(cls, counter: Counter, text: str, chars: bytes, tokens: bytes) -> CountTree:
        """The tree that `stored` gave; nothing is cut or encoded."""
        ends = np.cumsum(np.frombuffer(chars, "<u4"), dtype=np.int64).tolist()
        return cls(counter, [text[a:b] for a, b in zip([0, *ends], ends, strict=False)], np.frombuffer(tokens, "<u4"))

    def stored(self) -> tuple[str, bytes, bytes]:
        """Text, and characters and tokens of each pre-token."""
        pieces, counts = [], []
        leaf_tokens = self.tokens[self.width :].tolist()
        for i, t in enumerate(self.leaves):
            own, n = self.changed.get(i, ([t], [leaf_tokens[i]]))
            pieces += own
            counts += n
        return "".join(pieces), np.array([len(t) for t in pieces], "<u4").tobytes(), np.array(counts, "<u4").tobytes()

    def pieces(self, i: int) -> list[str]:
        return self.changed[i][0] if i in self.changed else [self.leaves[i]]

    @property
    def count(self) -> int:
        return int(self.tokens[1])

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that has the character at `place` (the last leaf at the end), and where that leaf starts."""
        node, start = 1, 0
        while node < self.width:
            left = int(self.chars[2 * node])
            if place - start < left:
                node = 2 * node
            else:
                start += left
                node = 2 * node + 1
        return node - self.width, start

    def _set(self, i: int, pieces: list[str], counts: list[int]) -> None:
        self.changed[i] = pieces, counts
        node = i + self.width
        self.chars[node], self.tokens[node] = sum(map(len, pieces)), sum(counts)
        node >>= 1
        while node:
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            node >>= 1

    def edit(self, begin: int, end: int, new: str) -> None:
        """Replaces the characters from begin to end, as the text is now."""
        total = int(self.chars[1])
        begin, end = min(max(begin, 0), total), min(max(end, begin, 0), total)
        if begin == end and not new:
            return
        if not self.leaves:
            self.leaves = [""]
        first, start = self.leaf_at(max(0, begin - CONTEXT)) if total else (0, 0)
        first = min(first, len(self.leaves) - 1)
        start = start if total else 0
        last, stop, reach = first, start, 16
        old = []
        while True:
            while last < len(self.leaves) and stop < end + reach:
                old += self.pieces(last)
                stop += int(self.chars[self.width + last])
                last += 1
            whole = last >= len(self.leaves)
            joined = "".join(old)
            text = joined[: begin - start] + new + joined[end - start :]
            moved = len(new) - (end - begin)
            # old boundaries behind the edit, where they are now
            at, bounds = start, {}
            for i in range(first, last):
                at += int(self.chars[self.width + i])
                if at >= end:
                    bounds.setdefault(at - start + moved, i + 1)
            fresh, met = [], None
            for m in self.counter.pattern.finditer(text):
                if not whole and m.end() > len(text) - CONTEXT:
                    break
                fresh.append(m.group())
                if m.end() >= begin - start + len(new) and m.end() in bounds:
                    met = bounds[m.end()]
                    break
            if met is None and whole:
                met = last
            if met is not None:
                break
            reach *= 4
        of = self.counter.learn(fresh)
        self._set(first, fresh, [of[t] for t in fresh])
        for i in range(first + 1, met):
            if self.pieces(i):
                self._set(i, [], [])
        self.reencoded += len(fresh)

    def text(self) -> str:
        return "".join(t for i in range(len(self.leaves)) for t in self.pieces(i))


def ordered(edits: Sequence[Edit]) -> list[Edit]:
    """Edits without overlaps, from the last to the first, so that earlier offsets stay valid."""
    out, reached = [], 0
    for b, e, new in sorted(set(edits)):
        if b >= reached and e >= b:
            out.append((b, e, new))
            reached = max(e, b)
    return out[::-1]


def scrubbing(rules: Sequence[Rule] = SCRUB) -> Callable[[str], list[Edit]]:
    """A rule that gives an edit for each match of a pattern; of overlapping matches the one that begins first, then the earlier rule's."""
    ready = [(put, re.compile(pattern), sign and re.compile(sign)) for put, sign, pattern in rules]

    def edits(text: str) -> list[Edit]:
        found = [(m.start(), m.end(), put, k) for k, (put, pattern, sign) in enumerate(ready) if sign is None or sign.search(text) for m in pattern.finditer(text)]
        if len(found) < 2:
            return [f[:3] for f in found]
        out, reached = [], 0
        for b, e, put, k in sorted(found, key=lambda f: (f[0], f[3])):
            if b < reached:  # what is left of a match that an earlier one overlaps
                m = ready[k][1].search(text, reached)
                if m is None or m.start() >= e:
                    continue
                b, e = m.span()
            out.append((b, e, put))
            reached = e
        return out

    return edits


def _listed(edits: DataFrame, id_col: str) -> DataFrame:
    """(__loom_id, __loom_edits): all edits of each document."""
    edit = F.struct(F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"), F.col("replacement").cast("string").alias("replacement"))
    return edits.select(F.col(f"`{id_col}`").alias("__loom_id"), edit.alias("e")).where("__loom_id IS NOT NULL").groupBy("__loom_id").agg(F.collect_set("e").alias("__loom_edits"))


def _given(edits: list[dict] | None) -> list[Edit]:
    return [(e["begin"] or 0, e["end"] or 0, e["replacement"] or "") for e in edits or ()]


def kept_trees(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The tree of every document: id, text, chars and tokens (of each pre-token, as little-endian 32-bit integers), n_tokens."""
    prepare(docs.sparkSession)
    picked = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(loaded(path), pattern)
        for batch in batches:
            cut = [counter.pattern.findall(t) for t in batch.column(1).to_pylist()]
            of = counter.learn(set().union(*cut))
            trees = [CountTree(counter, leaves, [of[t] for t in leaves]) for leaves in cut]
            kept = [t.stored()[1:] for t in trees]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.binary()) for c in ([k[0] for k in kept], [k[1] for k in kept])), pa.array([t.count for t in trees], pa.int64())], names=[id_col, *TREE])

    return picked.mapInArrow(run, f"`{id_col}` {picked.schema[0].dataType.simpleString()}, text string, chars binary, tokens binary, n_tokens long")


def edited_trees(trees: DataFrame, edits: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """The trees that edits (id, begin, end, replacement) change, after them, with n_reencoded; those of other documents stay as they are and are not read."""
    prepare(trees.sparkSession)
    touched = trees.select(F.col(f"`{id_col}`"), "text", "chars", "tokens").join(_listed(edits, id_col), F.col(f"`{id_col}`") == F.col("__loom_id")).drop("__loom_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(loaded(path), pattern)
        for batch in batches:
            rows = []
            for text, chars, tokens, given in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                tree = CountTree.kept(counter, text, chars, tokens)
                for b, e, put in ordered(_given(given)):
                    tree.edit(b, e, put)
                rows.append((*tree.stored(), tree.count, tree.reencoded))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[id_col, *TREE, "n_reencoded"])

    return touched.mapInArrow(run, f"`{id_col}` {touched.schema[0].dataType.simpleString()}, text string, chars binary, tokens binary, n_tokens long, n_reencoded long")


def counted(docs: DataFrame, path: str, pattern: str, rule: Callable[[str], list[Edit]] | None = None, edits: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """One row for each row of docs: its id, the columns in keep, and token counts before and after its edits.

    Edits come from `rule`, a function of the text, or from a table (id, begin, end, replacement) with offsets in the original text.
    """
    prepare(docs.sparkSession)
    new = RESULT.replace(",", "").split()[::2]
    carried = [c for c in dict.fromkeys([id_col, *keep]) if c not in new]
    picked = docs.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text_col}`").cast("string").alias("__loom_text"))
    if edits is not None:
        picked = picked.join(_listed(edits, id_col), F.col(f"`{id_col}`") == F.col("__loom_id"), "left").drop("__loom_id")
    else:
        picked = picked.withColumn("__loom_edits", F.lit(None).cast("array<struct<begin:bigint,end:bigint,replacement:string>>"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-2]), RESULT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(loaded(path), pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 2).to_pylist()]
            given = batch.column(batch.num_columns - 1).to_pylist()
            cut = [counter.pattern.findall(t) for t in texts]
            of = counter.learn(set().union(*cut))
            rows = []
            for text, leaves, own in zip(texts, cut, given, strict=True):
                tree = CountTree(counter, leaves, [of[t] for t in leaves])
                before = tree.count
                todo = ordered(_given(own) + (rule(text) if rule else []))
                for b, e, put in todo:
                    tree.edit(b, e, put)
                rows.append((before, len(todo), tree.count, len(leaves), tree.reencoded))
            cols = list(zip(*rows, strict=True)) or [[]] * len(new)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *(pa.array(c, pa.int64()) for c in cols)], names=[*carried, *new])

    return picked.mapInArrow(run, schema)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after personal data in it is replaced."""
    import public_tokenizers

    return counted(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, rule=scrubbing())
