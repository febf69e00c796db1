"""What the corpus operators share: table access, row keys, hashing and batching.

A text is known by ``node``, the 64-bit xxHash of its UTF-8 bytes, so that
exact copies collapse and neither null nor repeated ``doc_id`` values matter.
Two different texts get one node with probability n^2 / 2^65.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder. Where none is named, a local session (tests) takes a temporary one; a cluster has no folder that all can read."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sieveline-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise into the shared checkpoint folder: no recomputation, and safe against lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of written tables, wherever it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def node_of(column: str = "text") -> Column:
    return F.xxhash64(text_or_empty(column))


def held_out(column: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text leaves 0 by 5. A null id is held out too."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on a uint64 array."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


class WordHashes(dict):
    """64-bit hash of a word, remembered; emptied when it holds too many words."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries: polynomial, then finalised."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = h[:n].copy()
    with np.errstate(over="ignore"):
        for i in range(1, k):
            out *= U64(0x9E3779B97F4A7C15)
            out += h[i : i + n]
    return mix(out)


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive entries, by doubling."""
    n, have = len(h) - w + 1, 1
    if n <= 0:
        return np.empty(0, h.dtype)
    out = h
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out[:n]


def give_back() -> None:
    """Return what this worker process has freed to the system: it lives on for other stages, beside those of other cores."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable) -> Callable:
    """A mapInArrow function that gives memory back after its partition."""

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def lean_group(run: Callable) -> Callable:
    """An applyInArrow function that gives memory back after a group."""

    @wraps(run)
    def wrapped(data: pa.Table) -> pa.Table:
        try:
            return run(data)
        finally:
            give_back()

    return wrapped


def scratch(df: DataFrame, *names: str) -> list[str]:
    """Column names made of these that the table does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table of narrow rows that is counted to have at most so many; leave others to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bytes of a record batch that go to a Python worker at once, where the session leaves Spark's default.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Ask for record batches of BATCH_BYTES instead of 64 MB, which both the JVM and the worker hold; a session's own setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, "67108864b", "64m", "64MB"):
        spark.conf.set(name, str(BATCH_BYTES))


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int = 2 << 20, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches of about ``limit`` bytes of text (one row at least), with their texts."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        group = np.cumsum(lengths + 64) // limit
        starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            part = batch.slice(a, b - a)
            yield part, part.column(column).to_pylist()


def slices(counts: np.ndarray) -> np.ndarray:
    """Offsets of runs with these lengths."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node of each connected component of an undirected edge list.

    Alternates large-star and small-star steps; each round is a shuffle of the
    remaining links and ends in the shared checkpoint folder. Minima of a node's
    links have a partial aggregate; they are dealt anew before they meet the links
    again, so that both sides of that join are plain exchanges, which adaptive
    execution splits where one node has very many links.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    links = cut(links)
    parts, last = partitions(links.sparkSession), None
    for _ in range(rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).repartition(parts)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m")).repartition(parts)
        small = large.join(low2, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = cut(small.where("u <> v").distinct())
        state = links.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = links.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    return roots.union(links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
