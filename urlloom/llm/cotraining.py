"""Quality by co-training: a view of the text and a view of the page's metadata teach each other.

Each view has a logistic model over binned features, fit by Newton steps whose sums are taken over all rows
in Spark. After a first fit on labelled rows, every round lets each view pseudo-label the unlabelled rows
that it is surest of, in the classes' proportions, and the other view is fit again with them. How sure is sure enough
comes from histograms of both views over all unlabelled rows, and the share grows with the rounds. At the end each view is
calibrated on labelled rows that no fit has used, and the calibrated log-odds are added, less the prior once.

Texts are read once, in their own partitions; rounds read a narrow table of features. Only sums whose size does not
depend on the input (gradients, second derivatives, histograms) reach the driver.

Rows whose crc32(id) mod 4 is 2 are held out, those with 1 calibrate, the others are fit. Defined cases: null texts are empty; null metadata is a value of
its own; ids with contradicting labels count as unlabelled; labels other than 0 and 1 are ignored; repeated rows
are each used and scored; a very long text is a batch of its own; equal scores share a bucket of the histograms, so ties are pseudo-labelled
together or not at all; ids may be of any type; without both classes among the labels every score is the share of label 1 (0 without labels); an empty
table gives an empty result. Only the id and the columns in `keep` are carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import columns_of, prepare, saved
from .quality_rules import SYMBOLS, base_counts
from .toxicity import Isotonic

U = np.uint64
BINS = 8
#: Buckets of hashed languages and sources, and of the logarithm of the length.
METADATA = (16, 64, 24)
SCORE_BINS = 400
CONTENT = ("words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "punctuation", "digits", "beyond_ascii", "lines", "line_length", "distinct", "ratio", "pipes", "longest_word", "sentences")


@dataclass(frozen=True)
class Schedule:
    rounds: int = 3
    first_steps: int = 5
    steps: int = 2
    #: Share of the unlabelled rows that a view pseudo-labels in round 1; round r takes r times as many.
    share: float = 0.08
    pseudo_weight: float = 0.3
    l2: float = 1.0


def content_features(data: np.ndarray, at: np.ndarray, pack: zstandard.ZstdCompressor) -> np.ndarray:
    counts = base_counts(data, at)
    n, size = np.maximum(counts["n_words"], 1), np.maximum(np.diff(at), 1)
    low = tk.LOWER[data]
    starts, ends, first = tk.words(low, at, tk.ALNUM)
    h = tk.word_hashes(low, starts, ends)
    owner = tk.text_of(first)
    _, once = np.unique(tk.mix(h ^ tk.mix(owner.astype(U) + U(3))), return_index=True)
    longest = np.zeros(len(n))
    np.maximum.at(longest, owner, (ends - starts).astype(float))
    chars = lambda test: tk.per_text(test, at)
    lines = chars(data == 10) + 1
    raw = data.tobytes()
    ratio = [(b - a) / len(pack.compress(raw[a:b])) if b > a else 0.0 for a, b in zip(at[:-1], at[1:], strict=True)]
    upper, stops = (data >= 0x41) & (data <= 0x5A), (data == 0x2E) | (data == 0x21) | (data == 0x3F)
    signs = (data > 0x20) & ~tk.ALNUM[low]
    return np.stack(
        [np.log1p(counts["n_words"]), counts["word_chars"] / n, counts["n_symbols"] / n, counts["n_dup_lines"] / lines, counts["n_repeat_words"] / n, chars(upper) / size, chars(signs) / size,
         chars((data >= 0x30) & (data <= 0x39)) / size, chars(data >= 0x80) / size, np.log1p(lines), np.log1p(size / lines), np.bincount(owner[once], minlength=len(n)) / n, np.array(ratio, float),
         chars(SYMBOLS[data] & (data == 0x7C)) / n, longest, chars(stops) / n], 1)


class Views:
    """One-hot matrices of both views; each has a constant first column."""

    def __init__(self, cuts: list[list[float]]):
        self.cuts = [np.unique(np.array(c, float)) for c in cuts]
        self.widths = (1 + BINS * len(cuts), 1 + sum(METADATA))

    def __call__(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        n = batch.num_rows
        x = np.asarray(batch.column(batch.schema.get_field_index("__loom_c")).flatten()).reshape(n, -1)
        m = np.asarray(batch.column(batch.schema.get_field_index("__loom_m")).flatten()).reshape(n, -1)
        a, b, rows = np.zeros((n, self.widths[0])), np.zeros((n, self.widths[1])), np.arange(n)
        a[:, 0] = b[:, 0] = 1
        for j, cut in enumerate(self.cuts):
            a[rows, 1 + BINS * j + np.minimum(np.searchsorted(cut, x[:, j], side="right"), BINS - 1)] = 1
        at = 1
        for j, width in enumerate(METADATA):
            b[rows, at + m[:, j]] = 1
            at += width
        return a, b


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def binned(p: np.ndarray) -> np.ndarray:
    return np.minimum((p * SCORE_BINS).astype(np.int64), SCORE_BINS - 1)


def summed(table: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of vectors of `size` numbers: summed in each task, then by Spark for each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["i", "v"])

    rows = table.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[rows["i"].to_numpy()] = rows["v"].to_numpy()
    return out


@dataclass
class State:
    """Weights of both views, and from which scores on each pseudo-labels the other's rows."""

    weights: tuple[np.ndarray, np.ndarray]
    teachers: tuple[np.ndarray, np.ndarray] | None = None
    limits: tuple[tuple[float, float], tuple[float, float]] | None = None


def targets(x: tuple[np.ndarray, np.ndarray], y: np.ndarray, state: State, schedule: Schedule) -> list[tuple[np.ndarray, np.ndarray]]:
    """(target, weight) of every row for each view; y is 0 or 1, or -1 for unlabelled rows and -2 for rows that no fit may use."""
    out = []
    for view in (0, 1):
        target, weight = np.maximum(y, 0).astype(float), (y >= 0).astype(float)
        if state.teachers:
            p = sigmoid(x[1 - view] @ state.teachers[1 - view])
            low, high = state.limits[1 - view]
            free = y == -1
            target[free & (p >= high)] = 1
            weight[free & ((p >= high) | (p <= low))] = schedule.pseudo_weight
        out.append((target, weight))
    return out


def newton(table: DataFrame, views: Views, state: State, schedule: Schedule, steps: int) -> State:
    """Newton steps for both views at once."""
    for _ in range(steps):
        sizes = [d + d * d for d in views.widths]

        def sums(batch: pa.RecordBatch, state=state) -> np.ndarray:
            x, y = views(batch), np.asarray(batch.column(batch.schema.get_field_index("__loom_y")))
            parts = []
            for w, xs, (target, weight) in zip(state.weights, x, targets(x, y, state, schedule), strict=True):
                use = weight > 0
                xs, target, weight = xs[use], target[use], weight[use]
                p = sigmoid(xs @ w)
                parts += [xs.T @ (weight * (target - p)), (xs.T @ (xs * (weight * p * (1 - p))[:, None])).reshape(-1)]
            return np.concatenate(parts)

        total = summed(table, sums, sum(sizes))
        new, at = [], 0
        for w, d in zip(state.weights, views.widths, strict=True):
            ridge = np.full(d, schedule.l2)
            ridge[0] = 1e-6
            g, h = total[at : at + d], total[at + d : at + d + d * d].reshape(d, d)
            new.append(w + np.clip(np.linalg.solve(h + np.diag(ridge + 1e-9), g - ridge * w), -4, 4))
            at += d + d * d
        state = State(tuple(new), state.teachers, state.limits)
    return state


def limits_of(histogram: np.ndarray, positive: float, share: float) -> tuple[float, float]:
    """Scores at or under which, and from which on, a view's pseudo-labels count."""
    total = histogram.sum()
    if not total:
        return -1.0, 2.0
    up, down = np.cumsum(histogram), np.cumsum(histogram[::-1])
    low = int(np.searchsorted(up, total * share * (1 - positive), side="right"))
    high = SCORE_BINS - int(np.searchsorted(down, total * share * positive, side="right"))
    return min(low, SCORE_BINS // 2) / SCORE_BINS, max(high, SCORE_BINS // 2) / SCORE_BINS


def described(docs: DataFrame, id_col: str, text_col: str, metadata: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The columns carried, with features of the text (__loom_c) and buckets of the metadata (__loom_m)."""
    lang, source, length = metadata
    bucket = lambda c, n: F.pmod(F.xxhash64(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000"))), F.lit(n)).cast("int")
    size = F.least(F.floor(F.log2(F.greatest(F.coalesce(F.col(f"`{length}`").cast("double"), F.lit(0.0)), F.lit(0.0)) + 1)).cast("int"), F.lit(METADATA[2] - 1))
    carried = list(dict.fromkeys([id_col, *keep]))
    picked = docs.select(*[F.col(f"`{c}`") for c in carried], F.array(bucket(lang, METADATA[0]), bucket(source, METADATA[1]), size).alias("__loom_m"), F.col(f"`{text_col}`").cast("string").alias("__loom_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]), "__loom_c array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1, write_content_size=False)
        for batch in batches:
            x = content_features(*columns_of(batch, "__loom_text"), pack)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(CONTENT), pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "__loom_c"])

    return picked.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", metadata: Sequence[str] = ("lang", "source", "n_chars"), keep: Sequence[str] = (), schedule: Schedule | None = None, threshold: float = 0.5) -> DataFrame:
    """One row for each row of docs: id, the columns in keep, held_out, content_score, metadata_score, score and predicted."""
    spark, schedule = docs.sparkSession, schedule or Schedule()
    prepare(spark)
    new = ("held_out", "content_score", "metadata_score", "score", "predicted")
    keep = [c for c in dict.fromkeys(keep) if c not in (id_col, *new)]
    # what is kept is one column until the end, so that no name of it can clash
    bundle = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)] or [F.lit(0).alias("none")]).alias("__loom_keep")
    docs = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([id_col, text_col, *metadata])], bundle)
    known = labels.select(F.col(f"`{id_col}`").alias("__loom_id"), F.col(f"`{label}`").cast("int").alias("y")).where("y IN (0, 1)").groupBy("__loom_id").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).where("lo = hi").select("__loom_id", F.col("lo").alias("__loom_label"))
    fold = F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string")), F.lit(4)), F.lit(0))
    joined = described(docs, id_col, text_col, metadata, ["__loom_keep"]).join(known, F.col(f"`{id_col}`") == F.col("__loom_id"), "left").drop("__loom_id")
    # -1: unlabelled; -2: for calibration; -3: held out, which is only scored
    y = F.when(fold == 2, -3).when(F.col("__loom_label").isNull(), -1).when(fold == 1, -2).otherwise(F.col("__loom_label"))
    table = saved(joined.withColumn("__loom_y", y.cast("int")).withColumn("held_out", fold == 2).withColumn("__loom_label", F.coalesce("__loom_label", F.lit(-1))), "features")
    cuts = table.select(*[F.percentile_approx(F.col("__loom_c")[j], [i / BINS for i in range(1, BINS)], 2000).alias(f"q{j}") for j in range(len(CONTENT))]).first()
    views = Views([list(c or [0.0]) for c in cuts])
    lab = dict(table.where("__loom_y IN (0, 1)").groupBy("__loom_y").count().collect())
    zeros, ones = lab.get(0, 0), lab.get(1, 0)
    prior = ones / max(1, zeros + ones)
    narrow = table.select("__loom_c", "__loom_m", "__loom_y", "__loom_label")
    state, calibrated = None, None
    if zeros and ones:
        state = newton(narrow.where("__loom_y >= 0"), views, State(tuple(np.zeros(d) for d in views.widths)), schedule, schedule.first_steps)
        for r in range(1, schedule.rounds + 1):

            def histograms(batch: pa.RecordBatch, state=state) -> np.ndarray:
                free = np.asarray(batch.column(batch.schema.get_field_index("__loom_y"))) == -1
                return np.concatenate([np.bincount(binned(sigmoid(x[free] @ w)), minlength=SCORE_BINS) for x, w in zip(views(batch), state.weights, strict=True)]).astype(float)

            h = summed(narrow.where("__loom_y = -1"), histograms, 2 * SCORE_BINS)
            limits = tuple(limits_of(part, prior, schedule.share * r) for part in (h[:SCORE_BINS], h[SCORE_BINS:]))
            state = newton(narrow.where("__loom_y >= -1"), views, State(state.weights, state.weights, limits), schedule, schedule.steps)

        def calibration(batch: pa.RecordBatch, state=state) -> np.ndarray:
            label_ = np.asarray(batch.column(batch.schema.get_field_index("__loom_label")))
            return np.concatenate([np.bincount(binned(sigmoid(x[label_ == v] @ w)), minlength=SCORE_BINS) for x, w in zip(views(batch), state.weights, strict=True) for v in (0, 1)]).astype(float)

        h = summed(narrow.where("__loom_y = -2"), calibration, 4 * SCORE_BINS).reshape(2, 2, SCORE_BINS)
        calibrated = [curve(neg, pos, prior) for neg, pos in h]

    shared = spark.sparkContext.broadcast((views, state.weights if state else None, calibrated, prior))
    carried = [id_col, "__loom_keep", "held_out"]
    scoring = table.select(*[F.col(f"`{c}`") for c in carried], "__loom_c", "__loom_m")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in scoring.schema.fields[:-2]), "content_score double, metadata_score double, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, weights, calibrated, prior = shared.value
        odds = lambda p: np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4)))
        for batch in batches:
            if weights is None:
                both = [np.full(batch.num_rows, prior)] * 2
                score = both[0]
            else:
                both = [c(sigmoid(x @ w)) for x, w, c in zip(views(batch), weights, calibrated, strict=True)]
                score = sigmoid(odds(both[0]) + odds(both[1]) - odds(np.array(prior)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *(pa.array(v, pa.float64()) for v in (*both, score))], names=[*carried, "content_score", "metadata_score", "score"])

    made = [F.col(c) for c in new[:-1]]
    return scoring.mapInArrow(run, schema).select(F.col(f"`{id_col}`"), *[F.col("__loom_keep").getField(f"k{i}").alias(c) for i, c in enumerate(keep)], *made, (F.col("score") >= threshold).cast("int").alias("predicted"))


def curve(negative: np.ndarray, positive: np.ndarray, prior: float) -> Isotonic:
    """An isotonic curve from histograms; the prior counts as two rows spread over all scores, so that few rows calibrate softly."""
    at = np.arange(SCORE_BINS)
    x = (at + 0.5) / SCORE_BINS
    weight = negative + positive
    some = weight > 0
    if not some.any():
        out = Isotonic()
        out.x, out.p = np.array([0.0, 1.0]), np.array([prior, prior])
        return out
    blocks: list[list[float]] = []
    for xi, p, w in zip(x[some].tolist(), positive[some].tolist(), weight[some].tolist(), strict=True):
        blocks.append([p, w, xi * w])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            a = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], a, strict=True)]
    out = Isotonic()
    out.x = np.array([b[2] / b[1] for b in blocks])
    out.p = np.array([(b[0] + 2 * prior) / (b[1] + 2) for b in blocks])
    out.p = np.maximum.accumulate(out.p)
    return out


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document."""
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
