"""What the corpus operators share: shipping code, shared scratch tables, grouping, components."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package and bounds the Arrow batches they get.

    Batches of whole documents are bounded by bytes, so that a few very long texts cannot fill a
    worker. Values that the user has set are left alone.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    for key, default, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "9223372036854775807", str(1 << 20))):
        if spark.conf.get(key).removesuffix("b") == default:
            spark.conf.set(key, value)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where none is set."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file:///tmp/checkpoints"


#: Spark deletes the shuffle files of an execution as soon as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared scratch folder and reads it again, which cuts its lineage.

    A lost executor then costs only the tasks since this table; the shuffle files behind it go with the write.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    _left.add(path)
    return out


#: Scratch tables that are still there.
_left: set[str] = set()


@atexit.register
def _tidy() -> None:
    """What is left in a local scratch folder goes when the driver ends; in a shared store the folder's owner decides."""
    for path in _left:
        if path.startswith(("file:", "/")):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)


def dropped(*tables: DataFrame) -> None:
    """Deletes scratch tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        _left.discard(table._scratch)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of df; for file sources this is the size of the files read."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(spark: SparkSession, size: int, per: int = 16 << 20) -> int:
    """A partition or bucket count that grows with the input: one for each `per` bytes, at least as many as shuffles have."""
    return max(shuffle_partitions(spark), min(1 << 20, -(-size // per)))


def columns_of(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column as one array, and the rows' offsets in it; null rows are empty.

    No copy is made unless nulls hide bytes.
    """
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at - at[0]


def with_text(docs: DataFrame, carried: list[str], text_col: str) -> tuple[DataFrame, str]:
    """The columns carried and, if it is not one of them, the text as __loom_text; and which column has the text."""
    if text_col in carried and dict(docs.dtypes)[text_col] == "string":
        return docs.select(*[F.col(f"`{c}`") for c in carried]), text_col
    return docs.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text_col}`").cast("string").alias("__loom_text")), "__loom_text"


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Connected components of edges (a, b): one row (node, root) for each node, root the smallest node reachable.

    Each partition first contracts its own edges with a union-find, which leaves at most one edge
    per node; rounds of large-star and small-star steps then join the partitions' trees, until no node points at
    one that points on: as many rounds as that takes, of the order of the logarithm of the longest path. Every round
    is written to the shared folder and none collects edges to the driver. Hot roots are harmless:
    the minimum per node is an aggregate with map-side combining, and the join that spreads it is an
    ordinary equi-join, which adaptive execution may split.
    """
    spark = edges.sparkSession
    prepare(spark)

    def contract(batches):
        parent: dict[int, int] = {}

        def find(x):
            top = x
            while (up := parent.get(top, top)) != top:
                top = up
            while x != top:
                parent[x], x = top, parent.get(x, x)
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ra, rb = find(a), find(b)
                parent.setdefault(ra, ra)
                parent.setdefault(rb, rb)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
        nodes = [x for x in parent if find(x) != x]
        for i in range(0, len(nodes), 50_000):
            part = nodes[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["a", "b"])

    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = saved(e.mapInArrow(contract, "a long, b long").distinct(), tag)
    while True:
        # small star: every node points at its smallest neighbour that is smaller than it
        least = now.groupBy("a").agg(F.min("b").alias("m"))
        small = now.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        # large star: larger neighbours are handed to the smallest neighbour
        both = small.distinct()
        down = both.groupBy("a").agg(F.min("b").alias("m"))
        step = both.join(down.withColumnRenamed("a", "k"), F.col("b") == F.col("k"), "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        after = saved(step, tag)
        ends = after.select(F.col("a").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(after.select(F.col("b").alias("k"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        # settled: every node points at one other, and nothing points at a node that points on
        done = not ends.groupBy("k").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 OR up > 0 AND down > 0").take(1)
        dropped(now)
        now = after
        if done:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
