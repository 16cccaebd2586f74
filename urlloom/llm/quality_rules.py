"""Quality rules: word-level base rules, then bands of zstandard compression ratios.

`score_documents` reads every text once in its own partition: no shuffle, no state between texts,
so the cost is linear and a lost executor only repeats its own tasks. Ratios are of whole
documents and of fixed chunks; limits depend on length, as short inputs compress less. Every text and every chunk
is judged, of whatever length.

Defined cases: a null text has no words and is rejected; so is an empty one. A very long text is one row of its own
batch and is compressed whole and in chunks. Repeated rows are judged each by itself. An empty table gives an empty result. Columns of the input other than the id
and the text are kept only where `keep` names them; new columns replace columns of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from . import textkernel as tk
from .common import columns_of, prepare, with_text

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "ratio double, ratio_low double, ratio_high double, n_chunks long, n_bad_chunks long, verdict string"
)


@dataclass(frozen=True)
class Bands:
    """Limits of ratios, which are raw bytes divided by compressed bytes.

    With d = log2(n / unit), a text of n bytes may have a ratio from `low + low_slope * d` (`low_most` at most;
    `short_slope` counts below `unit`, where compression gains little and a text may even grow) to `base + slope * d`, 1 at least.
    Chunks are of `chunk` bytes, the last of what is left, and a shorter text is one chunk. Each has the limits of its own length,
    wider by `chunk_below` and `chunk_above`; a text is rejected if more than `bad_share` of its bytes are in chunks beyond them.
    """

    level: int = 3
    unit: int = 256
    low: float = 1.05
    low_slope: float = 0.12
    short_slope: float = 0.2
    low_most: float = 1.5
    base: float = 2.6
    slope: float = 0.42
    chunk: int = 2048
    chunk_below: float = 0.1
    chunk_above: float = 0.35
    bad_share: float = 0.34

    def limits(self, n: int) -> tuple[float, float]:
        d = math.log2(max(1, n) / self.unit)
        return min(self.low_most, self.low + (self.low_slope if d > 0 else self.short_slope) * d), max(1.0, self.base + self.slope * d)


def base_counts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The word and line counts of every text of a batch."""
    starts, ends, first = tk.words(data, at, ~tk.SPACE)
    hashes = tk.word_hashes(data, starts, ends)
    windows, whole = tk.shingles(hashes, first, 5)
    places = np.flatnonzero(whole)
    keys = tk.mix(windows[places] ^ tk.mix(tk.text_of(first)[places].astype(np.uint64) + np.uint64(1)))
    _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
    again = places[count[which] > 1]
    repeated = np.zeros(len(hashes), bool)
    for j in range(5):
        repeated[again + j] = True
    in_word = ~tk.SPACE[data]
    dup = np.zeros(len(at) - 1, np.int64)
    raw = data.tobytes()
    for i in np.flatnonzero(tk.per_text(data == 10, at) > 0):
        lines = [x for x in raw[at[i] : at[i + 1]].split(b"\n") if x.strip()]
        dup[i] = len(lines) - len(set(lines))
    return {
        "n_words": np.diff(first),
        "word_chars": tk.per_text(in_word & ((data & 0xC0) != 0x80), at),
        "n_symbols": tk.per_text(SYMBOLS[data], at),
        "n_dup_lines": dup,
        "n_repeat_words": tk.per_text(repeated, first),
    }


def bands_of(raw: bytes, pack: zstandard.ZstdCompressor, bands: Bands) -> tuple[float, float, float, int, int, str]:
    """Ratio and limits of the whole text, its chunks and those beyond limits, and the verdict."""
    n = len(raw)
    if not n:
        return 0.0, *bands.limits(0), 0, 0, "empty"
    ratio = n / len(pack.compress(raw))
    low, high = bands.limits(n)
    usual_low, usual_high = bands.limits(bands.chunk)
    chunks = bad = bad_bytes = 0
    for i in range(0, n, bands.chunk):
        piece = raw[i : i + bands.chunk]
        least, most = (usual_low, usual_high) if len(piece) == bands.chunk else bands.limits(len(piece))
        own = ratio if len(piece) == n else len(piece) / len(pack.compress(piece))
        chunks += 1
        if not least - bands.chunk_below <= own <= most + bands.chunk_above:
            bad += 1
            bad_bytes += len(piece)
    if ratio > high:
        verdict = "repetitive"
    elif ratio < low:
        verdict = "incompressible"
    else:
        verdict = "chunks" if bad_bytes > bands.bad_share * n else "ok"
    return ratio, low, high, chunks, bad, verdict


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), bands: Bands | None = None) -> DataFrame:
    """One row for each row of docs: its id, the columns in keep, counts, ratios and the verdict."""
    spark, bands = docs.sparkSession, bands or Bands()
    prepare(spark)
    names = RESULT.replace(",", "").split()[::2]
    carried = [c for c in dict.fromkeys([id_col, *keep]) if c not in names]
    picked, source = with_text(docs, carried, text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields if f.name in carried), RESULT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=bands.level, write_content_size=False)
        for batch in batches:
            data, at = columns_of(batch, source)
            out = base_counts(data, at)
            n, rep = out["n_words"], out["n_repeat_words"]
            failed = (n < 10) | (100 * rep > 20 * n)
            raw = data.tobytes()
            judged = [bands_of(raw[a:b], pack, bands) for a, b in zip(at[:-1], at[1:], strict=True)]
            cols = list(zip(*judged, strict=True)) or [[]] * 6
            kept = ~failed & np.array([v == "ok" for v in cols[5]], bool)
            arrays = [*batch.columns[: len(carried)], *(pa.array(out[c], pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))]
            arrays += [pa.array(failed), pa.array(kept), *(pa.array(cols[i], pa.float64()) for i in range(3)), *(pa.array(cols[i], pa.int64()) for i in (3, 4)), pa.array(cols[5], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*carried, *names])

    return picked.mapInArrow(run, schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
