"""Near-duplicates: SuperMinHash signatures, banding, verification on full shingle sets, union-find groups.

1. Every text becomes its set of distinct five-word shingles and a SuperMinHash signature: each element
   draws a random permutation of the signature's places step by step, and at step j offers the value j + r at its next place; a
   text is finished as soon as no place holds a value that a later step could lower.
2. Texts with equal sets form a class, which its smallest id stands for. Copies cost one row from then on.
3. `bands` keys of `rows` signature places each. In each bucket every member is paired with the bucket's smallest id
   only, so pairs grow with members. Pairs whose signatures agree in too few places go; the others are
   verified on full sets. Links make components. A pivot of many partners is dealt in several copies.
4. Buckets whose members are still in several components are compared in cells, across components alone, with the same
   two tests, and give out only links that join components. Buckets that share members make a cluster; a cluster that
   fits into a cell is one, and of a larger one each bucket is a cell, or each pair of its blocks if it is
   too large as well. A pair is verified in the first bucket that it shares. So every pair that shares a bucket is either in one
   component or was judged. Cells are bounded by the bytes of their members' sets.

With 32 bands of 4 a pair of similarity 0.75 shares no bucket with probability 5e-6, and has signatures that agree in
less than `estimate` of the places with 5e-8 (binomial; SuperMinHash has less variance than independent minima). There is no
cap on buckets, candidates or partners, and nothing of the corpus goes to the driver.

Defined cases: texts without words have an empty set and are linked with nothing; texts of fewer than five words
are one shingle; a very long text's signature is made `ELEMENTS` elements at a time, and it may be a block by itself; rows
without id, or with an id that is no whole number, are linked with nothing and kept; rows that repeat an id are one node, linked by any
of their texts; an empty table gives an empty result. Only the id and the columns in `keep` are carried.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import columns_of, components, dropped, prepare, saved

U = np.uint64
K = 5
#: Elements whose permutations are in memory at once.
ELEMENTS = 100_000
#: Bytes of the shingle sets of a cell.
CELL = 8 << 20
#: Partners of one pivot that meet in one place.
PARTNERS = 2000


@dataclass(frozen=True)
class Banding:
    bands: int = 32
    rows: int = 4
    similarity: int = 75
    estimate: float = 0.55

    @property
    def places(self) -> int:
        return self.bands * self.rows


def shingle_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text of a batch, ordered by text: (text, shingle)."""
    low = tk.LOWER[data]
    starts, ends, first = tk.words(low, at, ~tk.SPACE)
    h = tk.word_hashes(low, starts, ends)
    sh, whole = tk.shingles(h, first, K)
    owner = tk.text_of(first)
    sh, owner = sh[whole], owner[whole]
    n = np.diff(first)
    for k in range(1, K):
        short = np.flatnonzero(n == k)
        if len(short):
            own, ok = tk.shingles(h, first, k)
            sh = np.concatenate([sh, tk.mix(own[first[short]] + U(k))])
            owner = np.concatenate([owner, short])
    _, once = np.unique(tk.mix(sh ^ tk.mix(owner.astype(U) + U(1))), return_index=True)
    sh, owner = sh[once], owner[once]
    order = np.argsort(owner, kind="stable")
    return owner[order], sh[order]


def signatures(owner: np.ndarray, elements: np.ndarray, n: int, m: int) -> np.ndarray:
    """SuperMinHash of n sets; owner is ascending. Values are j * 2**48 + r; places of empty sets stay at the maximum."""
    sig = np.full((n, m), np.iinfo(np.uint64).max, U)
    bounds = np.searchsorted(owner, np.arange(n + 1))
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + ELEMENTS, side="right")) - 1)
        for low in range(bounds[i], bounds[j], ELEMENTS):  # one very large set may need several rounds
            part = slice(low, min(low + ELEMENTS, bounds[j]))
            _steps(owner[part], elements[part], sig, m)
        i = j
    return sig


def _steps(owner: np.ndarray, elements: np.ndarray, sig: np.ndarray, m: int) -> None:
    flat = sig.reshape(-1)
    live, perm = np.arange(len(elements)), None
    for j in range(m):
        e, o = elements[live], owner[live]
        r = tk.mix(e + U((2 * j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        k = j + ((tk.mix(r ^ U(0xD1B54A32D192ED03)) >> U(32)) * U(m - j) >> U(32)).astype(np.int64)
        value = (U(j) << U(48)) | (r >> U(16))
        if j == 0:
            place, first_k = k, k
        else:
            rows = np.arange(len(live))
            place = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[rows, j]
            perm[rows, j] = place
        np.minimum.at(flat, o * m + place, value)
        need = np.unique(o)
        need = need[sig[need].max(1) >= U(j + 1) << U(48)]
        if not len(need):
            return
        stay = np.isin(o, need) if len(need) < len(np.unique(o)) else np.ones(len(o), bool)
        if j == 0:
            kept = first_k[stay]
            perm = np.tile(np.arange(m, dtype=np.uint16), (len(kept), 1))
            perm[np.arange(len(kept)), kept] = 0
            perm[:, 0] = kept
        else:
            perm = perm[stay] if not stay.all() else perm
        live = live[stay]


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, rows)
    key = np.tile(tk.mix(np.arange(1, bands + 1, dtype=U)), (len(sig), 1))
    for j in range(rows):
        key = tk.mix(key ^ tk.mix(parts[:, :, j] + U(j + 1)))
    return key.view(np.int64)


def sketched(docs: DataFrame, id_col: str, text_col: str, keep: Sequence[str], b: Banding) -> DataFrame:
    """Set size, set fingerprint, band keys and one byte of each signature place, for each row."""
    carried = [c for c in dict.fromkeys([id_col, *keep])]
    picked = docs.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text_col}`").cast("string").alias("__loom_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]), "__loom_n long, __loom_f1 long, __loom_f2 long, __loom_keys array<long>, __loom_sig binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            owner, sh = shingle_sets(*columns_of(batch, "__loom_text"))
            size = np.bincount(owner, minlength=n).astype(np.int64)
            f1, f2 = np.zeros(n, U), np.zeros(n, U)
            at = np.concatenate([[0], np.cumsum(size)])
            some = size > 0
            if some.any():
                f1[some] = np.add.reduceat(tk.mix(sh + U(11)), at[:-1][some])
                f2[some] = np.bitwise_xor.reduceat(tk.mix(sh * U(0x9E3779B97F4A7C15) + U(5)), at[:-1][some])
            sig = signatures(owner, sh, n, b.places)
            keys = band_keys(sig, b.bands, b.rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * b.bands, pa.int32()), pa.array(keys.reshape(-1)))
            bytes_ = tk.mix(sig).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(size), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists, pa.array([x.tobytes() for x in bytes_], pa.binary())],
                names=[*carried, "__loom_n", "__loom_f1", "__loom_f2", "__loom_keys", "__loom_sig"],
            )

    return picked.mapInArrow(run, schema)


def meeting(pairs: DataFrame, things: DataFrame, name: str) -> DataFrame:
    """Pairs (a, b) with what `things` (id, name) has for both, as name_a and name_b.

    A pivot b of many partners gets a copy for every PARTNERS of them, so that these meet it in different places.
    """
    fans = pairs.groupBy("b").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("fan"))
    copy = F.coalesce(F.pmod(F.xxhash64("a"), F.col("fan")).cast("int"), F.lit(0))
    dealt_ = pairs.join(fans.where("fan > 1"), "b", "left").select("a", "b", copy.alias("copy"))
    there = things.join(fans.withColumnRenamed("b", "id"), "id").select(F.col("id").alias("b"), F.col(name).alias(f"{name}_b"), F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("copy"))
    here = things.select(F.col("id").alias("a"), F.col(name).alias(f"{name}_a"))
    return dealt_.join(here, "a").join(there, ["b", "copy"]).select("a", "b", f"{name}_a", f"{name}_b")


def likely(pairs: DataFrame, reps: DataFrame, b: Banding) -> DataFrame:
    """Pairs (a, b) whose signatures agree in enough places."""
    both = meeting(pairs, reps.select(F.col("rep").alias("id"), "sig"), "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = columns_of(batch, "sig_a")
            y, _ = columns_of(batch, "sig_b")
            same = (x == y).reshape(batch.num_rows, -1).mean(1) if batch.num_rows else np.zeros(0)
            yield batch.select(["a", "b"]).filter(pa.array(same >= b.estimate))

    return both.mapInArrow(run, "a long, b long")


def texts_of(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t) of the documents named. A merge join at every size: what it shuffles is in proportion to the input."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t")).join(ids.select("id").distinct().hint("merge"), "id", "left_semi")


def linked(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, b: Banding) -> DataFrame:
    """Pairs that are links, judged on full sets. The texts of ids in pairs are gathered once."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    texts = saved(texts_of(ids, docs, id_col, text_col), "texts")
    both = meeting(pairs, texts, "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            (oa, sa), (ob, sb) = shingle_sets(*columns_of(batch, "t_a")), shingle_sets(*columns_of(batch, "t_b"))
            na, nb = np.bincount(oa, minlength=n), np.bincount(ob, minlength=n)
            key = np.sort(np.concatenate([tk.mix(s ^ tk.mix(o.astype(U) + U(1))) for o, s in ((oa, sa), (ob, sb))]))
            twice = key[1:][key[1:] == key[:-1]]
            mine = tk.mix(sa ^ tk.mix(oa.astype(U) + U(1)))
            at = np.minimum(np.searchsorted(twice, mine), max(len(twice) - 1, 0))
            common = np.bincount(oa[twice[at] == mine], minlength=n) if len(twice) else np.zeros(n, np.int64)
            ok = (common > 0) & (100 * common >= b.similarity * (na + nb - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    out = saved(both.mapInArrow(run, "a long, b long").distinct(), "links")
    dropped(texts)
    return out


def cell_links(rep: np.ndarray, comp: np.ndarray, left: np.ndarray, right: np.ndarray, sig: np.ndarray, owner: np.ndarray, sets: np.ndarray, b: Banding, keys: np.ndarray | None = None, key: int = 0) -> list[tuple[int, int]]:
    """Links that join components of a cell: likeliest pairs first, and none between components that are joined already.

    With keys (those of each member), only pairs are judged whose first common key is `key`.
    """
    n = len(rep)
    bounds = np.searchsorted(owner, np.arange(n + 1))
    size = np.diff(bounds)
    root = np.unique(comp, return_inverse=True)[1]
    out = []
    for i in left.tolist():
        other = right[(root[right] != root[i]) & (rep[right] != rep[i])]
        # sizes alone may rule a link out
        other = other[100 * np.minimum(size[other], size[i]) >= b.similarity * np.maximum(size[other], size[i])]
        if not len(other):
            continue
        same = (sig[other] == sig[i]).mean(1)
        enough = np.flatnonzero(same >= b.estimate)
        other = other[enough[np.argsort(-same[enough], kind="stable")]]
        if keys is not None and len(other):
            common = keys[other] == keys[i]
            other = other[keys[i][common.argmax(1)] == key]
        mine = np.sort(sets[bounds[i] : bounds[i + 1]])
        for j in range(0, len(other), 64):
            part = other[j : j + 64]
            part = part[root[part] != root[i]]
            if not len(part):
                continue
            theirs = np.concatenate([sets[bounds[o] : bounds[o + 1]] for o in part.tolist()])
            at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
            common = np.bincount(np.repeat(np.arange(len(part)), size[part])[mine[at] == theirs], minlength=len(part))
            linked_ = (common > 0) & (100 * common >= b.similarity * (size[i] + size[part] - common))
            for o in part[linked_].tolist():
                if root[o] != root[i]:
                    root[root == root[o]] = root[i]
                    out.append((int(rep[i]), int(rep[o])))
    return out


def across(unsettled: DataFrame, clusters: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, b: Banding) -> DataFrame:
    """Links between different components of a bucket: unsettled has (key, rep, comp), clusters (rep, cluster).

    A cell gives out only links that join components, so fewer than it has members.
    """
    weight = (8 * F.col("__loom_n") + 1024).alias("bytes")
    members = unsettled.select("rep", "comp").distinct().join(clusters, "rep").join(classes.select("rep", "sig", "keys", weight), "rep")
    sizes = members.groupBy("cluster").agg(F.sum("bytes").alias("all_bytes"))
    members = saved(members.join(sizes, "cluster"), "members")
    small = members.where(F.col("all_bytes") <= CELL).select(F.lit(False).alias("large"), F.col("cluster").alias("unit"), "rep", "comp", "sig", "keys", F.lit(1).alias("blocks"))
    large = members.where(F.col("all_bytes") > CELL).drop("comp", "cluster", "all_bytes").join(unsettled, "rep")
    blocks = large.groupBy("key").agg(F.ceil(2 * F.sum("bytes") / CELL).cast("int").alias("blocks"))
    # two blocks fill a cell; a bucket that fits into one is not cut
    blocks = blocks.withColumn("blocks", F.when(F.col("blocks") <= 2, 1).otherwise(F.col("blocks")))
    large = large.join(blocks, "key").select(F.lit(True).alias("large"), F.col("key").alias("unit"), "rep", "comp", "sig", "keys", "blocks")
    placed = small.unionByName(large).withColumn("i", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    texts = saved(texts_of(members.select(F.col("rep").alias("id")), docs, id_col, text_col), "texts")
    cells = placed.join(texts.withColumnRenamed("id", "rep").hint("merge"), "rep").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    cells = cells.select("large", "unit", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), F.col("i").alias("own"), "rep", "comp", "sig", "keys", "t")

    def run(table: pa.Table) -> pa.Table:
        x, y = table["x"][0].as_py(), table["y"][0].as_py()
        own, rep, comp = (np.asarray(table[c].to_numpy()) for c in ("own", "rep", "comp"))
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(len(rep), -1)
        keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(len(rep), -1) if table["large"][0].as_py() else None
        owner, sets = shingle_sets(*columns_of(table.select(["t"]).combine_chunks().to_batches()[0], "t"))
        found = cell_links(rep, comp, np.flatnonzero(own == x), np.flatnonzero(own == y), sig, owner, sets, b, keys, table["unit"][0].as_py())
        return pa.table({"a": pa.array([p for p, _ in found], pa.int64()), "b": pa.array([q for _, q in found], pa.int64())})

    out = saved(cells.groupBy("large", "unit", "x", "y").applyInArrow(run, "a long, b long").distinct(), "links")
    dropped(members, texts)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), banding: Banding | None = None) -> DataFrame:
    """One row for each row of docs: id, the columns in keep, n_shingles, component_id and kept."""
    spark, b = docs.sparkSession, banding or Banding()
    prepare(spark)
    keep = [c for c in keep if c not in (id_col, "n_shingles", "component_id", "kept")]
    rows = saved(sketched(docs, id_col, text_col, keep, b), "sketches")
    node = F.col(f"`{id_col}`").cast("long")
    real = rows.where(node.isNotNull() & (F.col("__loom_n") > 0))
    classes = saved(real.groupBy("__loom_n", "__loom_f1", "__loom_f2").agg(F.min(F.struct(node.alias("rep"), F.col("__loom_keys").alias("keys"), F.col("__loom_sig").alias("sig"))).alias("s")).select("__loom_n", "__loom_f1", "__loom_f2", "s.rep", "s.keys", "s.sig"), "classes")
    # an id that is repeated with different texts stands for several classes
    copies = real.join(classes.select("__loom_n", "__loom_f1", "__loom_f2", "rep"), ["__loom_n", "__loom_f1", "__loom_f2"]).select(node.alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()
    keyed = saved(classes.select(F.explode("keys").alias("key"), "rep"), "keys")
    pivots = keyed.groupBy("key").agg(F.min("rep").alias("b"), F.max("rep").alias("top")).where("b <> top").select("key", "b")
    stars = keyed.join(pivots, "key").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
    near = saved(likely(stars, classes, b).distinct(), "near")
    links = linked(near, docs, id_col, text_col, b)
    first = saved(components(links), "groups")
    # buckets that are not settled: members in more than one component
    named = keyed.join(first.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("comp"))
    open_keys = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    unsettled = saved(named.join(open_keys, "key", "left_semi"), "unsettled")
    ties = unsettled.join(pivots, "key").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
    clusters = components(ties, "clusters")
    extra = across(unsettled, clusters.withColumnsRenamed({"node": "rep", "root": "cluster"}), classes, docs, id_col, text_col, b)
    groups = saved(components(links.unionByName(extra).unionByName(copies)), "groups")
    dropped(keyed, near, unsettled, first, links, extra, classes)
    out = rows.join(groups.withColumnsRenamed({"node": "__loom_node", "root": "__loom_root"}), node == F.col("__loom_node"), "left")
    return out.select(
        F.col(f"`{id_col}`"),
        *[F.col(f"`{c}`") for c in keep],
        F.col("__loom_n").alias("n_shingles"),
        F.coalesce("__loom_root", node).alias("component_id"),
        F.coalesce(node == F.coalesce("__loom_root", node), F.lit(True)).alias("kept"),
    )


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes and components of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
