"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features are densities of a fixed and of a learned lexicon, how near lexicon words are to second-person
words, capitals, punctuation, and obfuscation. The learned lexicon holds words and word beginnings that
labelled toxic texts have more often; for training texts it is learned on other folds, so that trees
see it as they will see new texts. Calibration uses scores of folds that the trees were not fit on.

The model is fit on at most `sample` labelled rows (of each label those with the smallest hash of their id); that bound does
not grow with the input. Their texts stay in executors: these count the lexicon's keys and compute features, and the driver gets at most
`LEXICON` keys with their counts and 24 numbers for each row. A rare label has all its rows or an eighth of the sample,
and calibration weighs the labels by how many rows they have in all. Every document is scored over its whole
text, in its own partition: no shuffle. Labels, language, source and id are never features.

Defined cases: a null or empty text has zero features and gets a score like any other; a very long text is one row of
a batch of its own; null labels and labels without document are not learned from; repeated rows are scored each by itself, and
an id that is repeated is learned from once, with its smallest text; ties of hashes are broken by the id; with
fewer than two rows of either label in the sample all scores are the share of label 1 (0 without any label).
Only the id and the columns in `keep` are carried.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import columns_of, dropped, prepare, saved

U = np.uint64
SAMPLE = 8000
#: Keys that a lexicon may hold, those of most toxic texts first.
LEXICON = 200_000
FOLDS = 4
#: Fixed word lists.
INSULTS = "asshole bastard bitch clown creep cretin crap cunt damn dick disgusting dumb dumbass fool freak fuck fucking garbage hate idiot idiotic imbecile jerk kill loser moron moronic nasty pathetic pig rat retard scum shit shut sick slut stupid suck trash ugly useless vermin whore worthless arschloch dumm dreck idiotin scheisse trottel abruti connard imbécile merde salaud stupide basura cabron estúpido idiota imbécil inútil mierda".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos ti tú tus usted ustedes vosotros".split()
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_LEET = tk.LOWER.copy()
for _a, _b in LEET.items():
    _LEET[ord(_a)] = ord(_b)
PREFIXES = (4, 5, 6, 7, 8)
TIERS = (1.0, 2.0, 3.0)
NEAR = 4
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_LOUD = np.zeros(256, bool)
_LOUD[[0x21, 0x3F]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
N_FEATURES = 24


def hashed(words: Sequence[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw], dtype=np.int64)
    return np.unique(tk.word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends))


def within(sorted_keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(sorted_keys) or not len(h):
        return np.zeros(len(h), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, h), len(sorted_keys) - 1)] == h


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, keys): each word itself, its beginnings, and its beginnings together with its length."""
    yield np.arange(len(h)), h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))[starts] if len(h) else h
    size = ends - starts
    for p in PREFIXES:
        long = np.flatnonzero(size > p)
        piece = eight[long] & (((U(1) << U(8 * p)) - U(1)) if p < 8 else ~U(0))
        key = tk.mix(piece ^ tk.mix(np.full(1, p + 1, U)))
        yield long, key
        yield long, tk.mix(key + size[long].astype(U))


@dataclass
class Lexicon:
    keys: np.ndarray
    weights: np.ndarray

    def __post_init__(self):
        self.bits = 22
        self.table = None

    def __getstate__(self):
        return {"keys": self.keys, "weights": self.weights, "bits": self.bits, "table": None}

    def word_weights(self, data, starts, ends, h) -> np.ndarray:
        """The largest weight among each word's keys; 0 for words without any."""
        if self.table is None:
            self.table = np.zeros(1 << self.bits, bool)
            self.table[(self.keys >> U(64 - self.bits)).astype(np.int64)] = True
        out = np.zeros(len(h))
        for which, keys in word_keys(data, starts, ends, h):
            maybe = np.flatnonzero(self.table[(keys >> U(64 - self.bits)).astype(np.int64)])
            hit = maybe[within(self.keys, keys[maybe])]
            if len(hit):
                words = which[hit]
                out[words] = np.maximum(out[words], self.weights[np.searchsorted(self.keys, keys[hit])])
        return out


def parsed(data: np.ndarray, at: np.ndarray) -> tuple:
    low = tk.LOWER[data]
    starts, ends, first = tk.words(low, at, tk.ALNUM)
    return low, starts, ends, first, tk.word_hashes(low, starts, ends)


def text_keys(data: np.ndarray, at: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of every key that a text has, each once; only those in `known` (ascending) if that is given."""
    low, starts, ends, first, h = parsed(data, at)
    owner = tk.text_of(first)
    texts, keys = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    for which, k in word_keys(low, starts, ends, h):
        if known is not None:
            hit = within(known, k)
            which, k = which[hit], k[hit]
        texts.append(owner[which])
        keys.append(k)
    text, key = np.concatenate(texts), np.concatenate(keys)
    _, once = np.unique(tk.mix(key ^ tk.mix(text.astype(U) + U(7))), return_index=True)
    return text[once], key[once]


def lexicon_of(keys: np.ndarray, a: np.ndarray, b: np.ndarray, n_pos: int, n_neg: int) -> Lexicon:
    """Keys (ascending) that are more frequent in toxic texts, by the log-odds of texts that have them: a of n_pos toxic ones and b of n_neg others."""
    odds = np.log((a + 0.5) / (n_pos + 1)) - np.log((b + 0.5) / (n_neg + 1))
    z = odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    good = (a >= 3) & (z > 2.6)
    return Lexicon(keys[good], (odds * a / (a + 2.0))[good])


def features(data: np.ndarray, at: np.ndarray, lexicon: Lexicon, fixed: np.ndarray, persons: np.ndarray) -> np.ndarray:
    """The dense features of every text of a batch."""
    n = len(at) - 1
    x = np.zeros((n, N_FEATURES))
    low, starts, ends, first, h = parsed(data, at)
    owner, words = tk.text_of(first), np.diff(first)
    per = np.maximum(words, 1) / 100.0
    count = lambda flags: tk.per_text(flags, first)
    insult = within(fixed, h)
    weight = lexicon.word_weights(low, starts, ends, h)
    x[:, 0] = np.log1p(words)
    x[:, 1], x[:, 2] = count(insult), count(insult) / per
    for j, t in enumerate(TIERS):
        c = count(weight > t)
        x[:, 3 + 2 * j], x[:, 4 + 2 * j] = c, c / per
    x[:, 9] = np.bincount(owner, weight, n)
    x[:, 10] = x[:, 9] / per
    hit = np.flatnonzero(weight > 0)
    order = hit[np.lexsort((-weight[hit], owner[hit]))]
    rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
    for j in range(4):
        top = order[rank == j]
        x[owner[top], 11 + j] = weight[top]
    flagged = insult | (weight > 2.0)
    second = within(persons, h)
    near = np.zeros(len(h), bool)
    for j in range(-NEAR, NEAR + 1):
        if j and len(h) > abs(j):
            a, b = (slice(j, None), slice(None, -j)) if j > 0 else (slice(None, j), slice(-j, None))
            near[b] |= second[a] & (owner[a] == owner[b])
    x[:, 15] = count(flagged & near)
    x[:, 16] = count(second) / per
    size = np.maximum(np.diff(at), 1)
    chars = lambda table: tk.per_text(table[data], at)
    letters = np.maximum(chars(_LETTER), 1)
    x[:, 17] = chars(_UPPER) / letters
    x[:, 18] = chars(_LOUD) / per
    x[:, 19] = chars(_PUNCT) / size
    # obfuscation: digits or signs for letters, letters set apart
    leet = _LEET[data]
    s2, e2, f2 = tk.words(leet, at, tk.ALNUM)
    h2 = tk.word_hashes(leet, s2, e2)
    x[:, 20] = np.maximum(tk.per_text(within(fixed, h2), f2) - x[:, 1], 0)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    letter = np.concatenate([[0], np.cumsum(_LETTER[data])])
    mixed = (digits[ends] > digits[starts]) & (letter[ends] > letter[starts])
    x[:, 21] = count(mixed) / per
    x[:, 22] = count(ends - starts == 1) / per
    shout = (ends - starts >= 3) & (np.concatenate([[0], np.cumsum(_UPPER[data])])[ends] - np.concatenate([[0], np.cumsum(_UPPER[data])])[starts] == ends - starts)
    x[:, 23] = count(shout) / per
    return x


# -- trees -----------------------------------------------------------------------------------------


class Boosted:
    """Boosted trees for log-loss, on features cut into at most 48 bins."""

    def __init__(self, trees: int = 120, depth: int = 3, rate: float = 0.1, leaf: int = 8, l2: float = 2.0):
        self.trees, self.depth, self.rate, self.leaf, self.l2 = trees, depth, rate, leaf, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        # a label that would hide in the last bin gives half of the cuts
        rare = y == (y.mean() <= 0.5) if len(y) else np.zeros(0, bool)
        sides = [x, x[rare]] if 0 < 48 * rare.sum() < len(y) else [x]
        leaf = max(1, min(self.leaf, int(rare.sum()) // 2))
        at = np.linspace(0, 1, 48 // len(sides))
        self.cuts = [np.unique(np.concatenate([np.quantile(v[:, f], at) for v in sides]))[1:] if len(x) else np.zeros(0) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(share / (1 - share)))
        raw, bins, d = np.full(len(y), self.start), 50, x.shape[1]
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            g, w = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.full(2**self.depth - 1, -1), np.zeros(2**self.depth - 1, np.int64)
            for level in range(self.depth):
                begin, many = 2**level - 1, 2**level
                base = node * bins
                best = np.full(many, 1e-6)
                for f in range(d):
                    key = base + binned[:, f]
                    sums = [np.bincount(key, v, many * bins).reshape(many, bins).cumsum(1) for v in (g, w)] + [np.bincount(key, minlength=many * bins).reshape(many, bins).cumsum(1)]
                    G, W, N = sums
                    right = [s[:, -1:] - s for s in sums]
                    gain = G**2 / (W + self.l2) + right[0] ** 2 / (right[1] + self.l2) - G[:, -1:] ** 2 / (W[:, -1:] + self.l2)
                    gain[(N < leaf) | (right[2] < leaf)] = -1
                    at = gain.argmax(1)
                    better = gain[np.arange(many), at] > best
                    best[better] = gain[np.arange(many), at][better]
                    feature[begin : begin + many][better], cut[begin : begin + many][better] = f, at[better]
                f = feature[begin + node]
                node = 2 * node + ((f >= 0) & (binned[np.arange(len(y)), np.maximum(f, 0)] > cut[begin + node]))
            G, W = np.bincount(node, g, 2**self.depth), np.bincount(node, w, 2**self.depth)
            value = self.rate * G / (W + self.l2)
            raw += value[node]
            self.model.append((feature, cut, value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.model:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                f = feature[2**level - 1 + node]
                node = 2 * node + ((f >= 0) & (binned[rows, np.maximum(f, 0)] > cut[2**level - 1 + node]))
            out += value[node]
        return out


class Isotonic:
    """A nondecreasing map from raw scores to probabilities: pool adjacent violators, linear between blocks.

    A small share of the logistic curve keeps the order of scores within a block.
    """

    def fit(self, raw: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> "Isotonic":
        order = np.argsort(raw, kind="stable")
        blocks: list[list[float]] = []
        weight = np.ones(len(y)) if weight is None else weight
        for r, t, w in zip(raw[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
            blocks.append([t * w, w, r * w])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                a = blocks.pop()
                blocks[-1] = [blocks[-1][0] + a[0], blocks[-1][1] + a[1], blocks[-1][2] + a[2]]
        self.x = np.array([b[2] / b[1] for b in blocks])
        self.p = np.array([b[0] / b[1] for b in blocks])
        return self

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(0.97 * np.interp(raw, self.x, self.p) + 0.03 / (1 + np.exp(-raw)), 0.0, 1.0)


@dataclass
class Model:
    lexicon: Lexicon | None
    trees: Boosted | None
    calibrated: Isotonic | None
    share: float

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(at) - 1, self.share)
        return self.calibrated(self.trees.raw(features(data, at, self.lexicon, hashed(INSULTS), hashed(SECOND_PERSON))))


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(4)) == 2


def key_counts(sample: DataFrame, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of three toxic texts or more, ascending, and how many texts of each label and fold have them."""

    def toxic_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = np.unique(text_keys(*columns_of(batch, "t"))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["key", "n"])

    first = sample.where("y = 1").select("t").mapInArrow(toxic_keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n >= 3").orderBy(F.col("n").desc(), "key").limit(LEXICON).select("key").toArrow()
    known = np.sort(np.asarray(first["key"].to_numpy()).view(U)) if first.num_rows else np.zeros(0, U)
    shared = sample.sparkSession.sparkContext.broadcast(known)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, key = text_keys(*columns_of(batch, "t"), shared.value)
            group = (np.asarray(batch.column("y")).astype(np.int64) * folds + np.asarray(batch.column("fold")).astype(np.int64))[text]
            cell, n = np.unique(np.searchsorted(shared.value, key) * 2 * folds + group, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(n, pa.int64())], names=["cell", "n"])

    out = np.zeros(len(known) * 2 * folds, np.int64)
    if len(known):
        rows = sample.select("y", "fold", "t").mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return known, out.reshape(len(known), 2, folds)


def sample_features(sample: DataFrame, lexicons: list[Lexicon]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, label and fold of every row, with the lexicon that its fold did not add to; in an order that does not depend on the table's."""
    shared = sample.sparkSession.sparkContext.broadcast(lexicons)
    names = [f"x{j}" for j in range(N_FEATURES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed, persons = hashed(INSULTS), hashed(SECOND_PERSON)
        for batch in batches:
            fold = np.asarray(batch.column("fold"))
            x = np.zeros((batch.num_rows, N_FEATURES))
            for k in np.unique(fold).tolist():
                own = np.flatnonzero(fold == k)
                x[own] = features(*columns_of(batch.take(pa.array(own)), "t"), shared.value[k], fixed, persons)
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("fold"), *(pa.array(v) for v in x.T)], names=["y", "fold", *names])

    rows = sample.select("y", "fold", "t").mapInArrow(run, "y int, fold int, " + ", ".join(f"{n} double" for n in names)).toArrow()
    y, fold = rows["y"].to_numpy().astype(np.int64), rows["fold"].to_numpy().astype(np.int64)
    x = np.stack([rows[n].to_numpy() for n in names], 1)
    order = np.lexsort((*x.T, fold, y))
    return x[order], y[order], fold[order]


def trained(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """A model of the labels of at most `sample` rows that are not held out."""
    prepare(docs.sparkSession)
    usable = labels.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{label}`").cast("int").alias("y")).where(F.col("i").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("i"))).distinct()
    # of each label the rows with the smallest hashes: at most `sample` rows of three numbers are broadcast
    there = [0, 0]
    for y, n in usable.groupBy("y").count().collect():
        there[y] = n
    rare = int(there[1] <= there[0])
    taken = [0, 0]
    taken[rare] = min(there[rare], max(sample // 8, round(sample * there[rare] / max(1, sum(there)))))
    taken[1 - rare] = min(there[1 - rare], sample - taken[rare])
    first = [usable.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(taken[y]) for y in (0, 1)]
    number = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("i"), "i")) - 1
    picked = first[0].unionByName(first[1]).withColumn("number", number)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    known = docs.select(F.col(f"`{id_col}`").alias("i"), text.alias("t")).join(F.broadcast(picked), "i").groupBy("i", "y", "number").agg(F.min("t").alias("t"))
    rows = saved(known, "labelled")
    found = [0, 0]
    for y, n in rows.groupBy("y").count().collect():
        found[y] = n
    weights = [n / max(1, k) for n, k in zip(there, found, strict=True)]
    total = sum(n * w for n, w in zip(found, weights, strict=True))
    share = found[1] * weights[1] / total if total else 0.0
    folds = min(FOLDS, *found)
    if folds < 2:
        dropped(rows)
        return Model(None, None, None, share)
    rows_ = rows.select("y", F.pmod("number", F.lit(folds)).cast("int").alias("fold"), "t")
    keys, counts = key_counts(rows_, folds)
    sizes = np.zeros((2, folds), np.int64)
    for y, k, n in rows_.groupBy("y", "fold").count().collect():
        sizes[y, k] = n
    parts = [[j for j in range(folds) if j != k] for k in range(folds)]
    lexicons = [lexicon_of(keys, counts[:, 1, p].sum(1), counts[:, 0, p].sum(1), int(sizes[1, p].sum()), int(sizes[0, p].sum())) for p in [*parts, list(range(folds))]]
    x, y, fold = sample_features(rows_, lexicons[:-1])
    dropped(rows)
    raw = np.zeros(len(y))
    for k in range(folds):
        if (fold == k).any() and (fold != k).any():
            raw[fold == k] = Boosted().fit(x[fold != k], y[fold != k]).raw(x[fold == k])
    return Model(lexicons[-1], Boosted().fit(x, y.astype(float)), Isotonic().fit(raw, y.astype(float), np.where(y == 1, weights[1], weights[0])), share)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), threshold: float = 0.3) -> DataFrame:
    """One row for each row of docs: its id, the columns in keep, held_out, score and predicted."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried = [c for c in dict.fromkeys([id_col, *keep]) if c not in ("held_out", "score", "predicted")]
    picked = docs.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text_col}`").cast("string").alias("__loom_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shared.value.score(*columns_of(batch, "__loom_text")), pa.float64())], names=[*carried, "score"])

    out = picked.mapInArrow(run, schema)
    return out.select(*[F.col(f"`{c}`") for c in carried], F.coalesce(held_out(F.col(f"`{id_col}`")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic"))
