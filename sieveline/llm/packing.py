"""Packing documents into windows of a fixed number of tokens: best-fit decreasing.

Documents longer than a window are first cut into full windows; what is left of
them, and all others, are pieces. Pieces are placed by falling length, each into
the open window with the least room that still holds it, or into a new one.

Pieces of one length are alike, and so are windows with the same room. So the
best fit is found for whole runs of them: the counts of pieces by length (as
many numbers as a window has tokens, however many documents there are) give a
plan, made with a segment tree indexed by remaining capacity that finds the
tightest open windows. A move of the plan places the pieces of one length with
the ranks first..first+count into as many neighbouring windows at one offset;
there are at most a few hundred thousand moves, whatever the input. A piece then
only needs its rank among those of its length: each task numbers its own, and
sums over tasks give where they begin. No task and not the driver gets the
pieces, and a third of all rows with one length is no more than any other third.

Ids come from the vocabulary of a tokenizers file, by a byte pair encoder that
gives the same ids faster; texts that hold one of the file's special tokens go
through the tokenizers library itself. The driver sends the file to the workers.
Every document ends in END. Null text is empty and is one piece of END alone.
Ids may repeat or be null; extra columns are ignored. Equal rows are packed each.
"""

from __future__ import annotations

import json
import os
import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.llm.common import ensure_checkpoint_dir, lean, small, small_batches, table, text_chunks, text_or_empty
from sieveline.llm.token_counts import PATTERN

VOCABULARY = os.environ.get("SIEVELINE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
#: Tokens of a window, and the id that ends a document.
CAPACITY, END = 2048, 1
#: Rows (task, length, pieces before) that may be broadcast; they are counted first.
BROADCAST_ROWS = 200_000
_PIECES = "start long, length int, ids binary, doc_tokens long, task int, turn long"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 stands for itself, others for letters from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Texts to ids, as the tokenizers file gives them without added tokens."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("sieveline", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.plain = Tokenizer.from_file(path)

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(documents: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Rows (doc_id, start, length, ids, doc_tokens, task, turn): turn numbers a task's pieces of one length from 0. To be written before use: turns follow the task."""
    small_batches(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    name = os.path.basename(vocabulary)
    documents.sparkSession.sparkContext.addFile(vocabulary)

    @lean
    def run(batches):
        encode, task = encoder(SparkFiles.get(name)).encode, TaskContext.get().partitionId()
        turns = np.zeros(capacity + 1, np.int64)
        for batch, texts in text_chunks(batches):
            owner, rows = [], []
            for i, text in enumerate(texts):
                ids = np.append(encode(text), np.uint32(end)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    owner.append(i)
                    rows.append((start, len(part), part.tobytes(), len(ids), task, int(turns[len(part)])))
                    turns[len(part)] += 1
            types = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64())
            made = [pa.array([r[j] for r in rows], t) for j, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner, pa.int64())), *made], names=["doc_id", "start", "length", "ids", "doc_tokens", "task", "turn"])

    return documents.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, {_PIECES}")


class RoomTree:
    """A segment tree over remaining capacities 0..capacity: how many open windows have each; finds the least room that suffices."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, room: int, windows: int) -> None:
        i = room + self.leaves
        while i:
            self.sums[i] += windows
            i >>= 1

    def least(self, room: int) -> int | None:
        """The least capacity of at least ``room`` that an open window has."""
        i = room + self.leaves
        if self.sums[i]:
            return room
        while i > 1:  # up to the first right sibling that is not empty, then down its left edge
            if not i & 1 and self.sums[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.sums[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """(moves, number of windows) of pieces counted by length; a move is (length, first rank, pieces, first window, offset).

    Placing a piece into the tightest window leaves it the tightest one, so long
    as it has room for another piece of that length: a run of alike windows is
    filled with as many layers as fit before the next is taken.
    """
    tree, runs = RoomTree(capacity), {}  # room -> [(first window, windows)]
    moves, opened = [], 0

    def put(room: int, first: int, windows: int) -> None:
        if windows and room:
            runs.setdefault(room, []).append((first, windows))
            tree.add(room, windows)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.least(length)
            if room is None:
                room, first = capacity, opened
                windows = -(-left // (capacity // length))
                opened += windows
            else:
                first, windows = runs[room].pop()
                tree.add(room, -windows)
            layers = room // length
            full = min(windows, left // layers)
            for layer in range(layers if full else 0):
                moves.append((length, rank, full, first, capacity - room + layer * length))
                rank += full
            left -= full * layers
            put(room - layers * length, first, full)
            if full < windows and left < layers:  # the last pieces share one window
                for layer in range(left):
                    moves.append((length, rank, 1, first + full, capacity - room + layer * length))
                    rank += 1
                put(room - left * length, first + full, 1)
                put(room, first + full + 1, windows - full - 1)
                left = 0
    return np.array(moves, np.int64).reshape(-1, 5), opened


def placed(ranked: DataFrame, moves: np.ndarray) -> DataFrame:
    """Adds sequence_id and offset to rows with length and rank; the moves go with the function."""
    order = np.lexsort((moves[:, 1], moves[:, 0]))
    moves = moves[order]
    start = (moves[:, 0] << 48) + moves[:, 1]

    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key = (length.to_numpy(np.int64) << 48) + rank.to_numpy(np.int64)
        at = np.searchsorted(start, key, "right") - 1
        return pd.DataFrame({"sequence_id": moves[at, 3] + key - start[at], "offset": moves[at, 4]})

    at = F.pandas_udf(find, "sequence_id long, offset long")
    return ranked.withColumn("__at", at("length", "rank")).withColumns({"sequence_id": F.col("__at.sequence_id"), "offset": F.col("__at.offset")}).drop("__at")


def packed(documents: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Rows (doc_id, start, length, ids, doc_tokens, sequence_id, offset): every piece, its ids (unsigned 32-bit, little endian), and where it lies. Pieces are written once to the shared folder."""
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pieces-{uuid.uuid4().hex}"
    pieces(documents, vocabulary, capacity, end).write.option("compression", "zstd").parquet(folder)
    own = spark.read.parquet(folder)
    # a task's pieces of one length are numbered without gaps
    sizes = own.groupBy("task", "length").agg((F.max("turn") + 1).alias("pieces"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("before", F.coalesce(F.sum("pieces").over(earlier), F.lit(0))).select("task", "length", "before")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("pieces").alias("n")).collect()}  # at most one row a length
    moves, _ = plan(counts, capacity)
    ranked = own.join(small(before, BROADCAST_ROWS), ["task", "length"]).withColumn("rank", F.col("turn") + F.col("before"))
    return placed(ranked, moves).select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids", "doc_tokens", "sequence_id", "offset")


def sequences(placed_pieces: DataFrame) -> DataFrame:
    """Rows (sequence_id, ids, pieces): the ids of every window, and its pieces (doc_id, start, length, offset), for training."""
    own = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids")))
    made = placed_pieces.groupBy("sequence_id").agg(own.alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return made.select("sequence_id", joined.alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["length"].alias("length"), x["offset"].alias("offset"))).alias("pieces"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
