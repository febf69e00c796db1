"""Which tokens of a text occur in other texts too: a packed exchange.

Each text has a set of 64-bit tokens. Tokens travel to a part chosen by their
upper bits, packed: one row for each part and chunk of texts, holding nodes,
run lengths and 40-bit residuals as bytes. A part sorts what it gets and
answers, packed again and addressed by node, with every token that at least two
different texts hold and a class that grows with the number of those texts.

The number of parts follows the counted bytes of text, so that what one group
of rows needs in a Python worker stays about the same at every size; a part is
sorted in slices of its tokens, so that little more than its rows is in memory.

Tokens that a sample of texts shows to be in more than HEAVY_SHARE of all texts,
or in more than HEAVY_ROWS of them ("heavy"), never travel: they are known to
every task, get the highest class and cannot make one part large. The sample
decides the route of a token only; any set of heavy tokens gives right results.

All results are sets, so recomputed tasks may deliver rows in another order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import U64, lean, lean_group, partitions, slices, small_batches, text_chunks

#: Least texts sampled, in expectation, to find heavy tokens; share and number of texts that make a token heavy; least texts of the sample that must show it.
SAMPLE_TEXTS, HEAVY_SHARE, HEAVY_ROWS, HEAVY_LEAST = 20_000, 0.005, 2_000_000, 50
HEAVY_CLASS = 255
#: Tokens that may go to every task as heavy; of more, the most widespread do.
MOST_HEAVY = 1_000_000
#: Bytes of text whose tokens make a part, most parts, and tokens sorted at once.
PART_BYTES, MOST_PARTS, SLICE = 16 << 20, 1 << 21, 400_000
RESIDUAL = U64((1 << 40) - 1)

Extract = Callable[[list], tuple[list, list]]  # texts -> (distinct tokens of each, size of each)
ROWS = "part int, kind int, nodes binary, counts binary, lo binary, hi binary"
_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("nodes", "counts", "lo", "hi"))])


def routed(h: np.ndarray, parts: int) -> np.ndarray:
    """A hash as a token: its part, then 40 bits."""
    return (((h >> U64(40)) % U64(parts)) << U64(40)) | (h & RESIDUAL)


def frame(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)


def first_of_each(nodes: np.ndarray) -> np.ndarray:
    return np.sort(np.unique(nodes, return_index=True)[1])


def grouped(part: np.ndarray, nodes: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    """(part, distinct nodes, counts, values...) for each part; values stay in order of (part, node)."""
    order = np.lexsort((nodes, part))
    part, nodes, values = part[order], nodes[order], [v[order] for v in values]
    cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.empty(0, np.int64)
    for a, b in zip(cuts, np.append(cuts[1:], len(part))):
        own = nodes[a:b]
        at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        counts = np.diff(np.append(at, len(own))).astype(np.int32)
        yield int(part[a]), own[at], counts, *(v[a:b] for v in values)


def measured(docs: DataFrame) -> tuple[int, int]:
    """(number of texts, number of parts) of rows (node, text)."""
    small_batches(docs.sparkSession)
    total, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    return max(1, total), min(MOST_PARTS, max(partitions(docs.sparkSession), -(-(size or 0) // PART_BYTES)))


def heavy_tokens(docs: DataFrame, extract: Extract, total: int, parts: int, rows: int = HEAVY_ROWS) -> np.ndarray:
    """Tokens in about HEAVY_SHARE of all texts or in ``rows`` of them, by a sample that shows HEAVY_LEAST such texts at least."""
    rate = max(1.0, min(HEAVY_SHARE * total, rows)) / total
    share = min(1.0, max(SAMPLE_TEXTS / total, HEAVY_LEAST / (rate * total)))
    sample = docs.where(F.rand(7) < share) if share < 1 else docs  # by rows, so that a text of very many copies shows
    least = max(HEAVY_LEAST, int(rate * total * share))

    @lean
    def count(batches):
        for batch, texts in text_chunks(batches):
            keep = first_of_each(batch.column("node").to_numpy())
            tokens, _ = extract([texts[i] for i in keep])
            flat, n = np.unique(routed(np.concatenate(tokens), parts) if tokens else np.empty(0, U64), return_counts=True)
            often = n >= 1 + (rate * len(keep) >= 1) + (rate * len(keep) >= 5)  # what is rarer here is not heavy, or counts for little
            yield pa.RecordBatch.from_arrays([pa.array(flat[often].view(np.int64)), pa.array(n[often])], names=["token", "n"])

    found = sample.select("node", "text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(MOST_HEAVY).select("token").collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(U64))


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def shared_tokens(docs: DataFrame, extract: Extract, finish: Callable, schema: pa.Schema, parts: int, heavy: np.ndarray) -> DataFrame:
    """A row of ``schema`` for each distinct node of docs (node, text).

    ``finish(node, size, tokens, classes)`` makes the row's values from the
    tokens that other texts hold too (uint64) and their classes (uint8).
    """

    @lean
    def send(batches):
        for batch, texts in text_chunks(batches):
            nodes = batch.column("node").to_numpy()
            keep = first_of_each(nodes)
            nodes = nodes[keep]
            tokens, sizes = extract([texts[i] for i in keep])
            counts = np.array([len(t) for t in tokens], np.int64)
            flat = routed(np.concatenate(tokens), parts) if tokens else np.empty(0, U64)
            owner = np.repeat(nodes, counts)
            hot = _member(heavy, flat)
            rows = []
            hot_sizes = np.bincount(np.repeat(np.arange(len(nodes)), counts)[hot], minlength=len(nodes)).astype(np.int32)
            hot_flat, at = flat[hot], slices(hot_sizes)
            sizes = np.array(sizes, np.int64)
            home = (nodes.view(U64) % U64(parts)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            cuts = np.flatnonzero(np.concatenate(([True], np.diff(home[order]) != 0))) if len(home) else []
            for a, b in zip(cuts, [*cuts[1:], len(home)]):
                which = order[a:b]
                rows.append((int(home[which[0]]), 1, nodes[which].tobytes(), np.stack([sizes[which], hot_sizes[which].astype(np.int64)]).tobytes(), np.concatenate([hot_flat[at[i] : at[i + 1]] for i in which]).tobytes(), b""))
            flat, owner = flat[~hot], owner[~hot]
            for part, own, n, values in grouped((flat >> U64(40)).astype(np.int64), owner, flat & RESIDUAL):
                rows.append((part, 0, own.tobytes(), n.tobytes(), values.astype(np.uint32).tobytes(), (values >> U64(32)).astype(np.uint8).tobytes()))
            yield frame(_ARROW, rows)

    def settled(node: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The (node, token) pairs whose token has two nodes or more, each once, and the token's class."""
        order = np.argsort(token)
        node, token = node[order], token[order]
        same = token[1:] == token[:-1]
        many = np.zeros(len(token), bool)
        many[1:] |= same
        many[:-1] |= same
        node, token = node[many], token[many]
        order = np.lexsort((node, token))
        node, token = node[order], token[order]
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        node, token = node[fresh], token[fresh]
        _, where, count = np.unique(token, return_inverse=True, return_counts=True)
        df = count[where]
        keep = df > 1
        return node[keep], token[keep], np.minimum(4 * np.log2(df[keep]), HEAVY_CLASS - 1).astype(np.uint8)

    @lean_group
    def answer(data: pa.Table) -> pa.Table:
        rows, sent = [], []
        for part, kind, *blobs in zip(*(data.column(c).to_pylist() for c in _ARROW.names)):
            if kind == 1:
                rows.append((part, 1, *blobs))
            else:
                sent.append(tuple(np.frombuffer(b, t) for b, t in zip(blobs, (np.int64, np.int32, np.uint32, np.uint8))))
        if sent:
            sets = -(-sum(len(m[2]) for m in sent) // SLICE)
            found = []
            for k in range(sets):
                own = [m[2] % np.uint32(sets) == k for m in sent]
                token = np.concatenate([(m[2][o].astype(U64) | (m[3][o].astype(U64) << U64(32)) | U64(part << 40)) for m, o in zip(sent, own)])
                found.append(settled(np.concatenate([np.repeat(m[0], m[1])[o] for m, o in zip(sent, own)]), token))
            node, token, level = (np.concatenate(x) for x in zip(*found))
            for home, own, n, t, c in grouped((node.view(U64) % U64(parts)).astype(np.int64), node, token, level):
                rows.append((home, 2, own.tobytes(), n.tobytes(), t.tobytes(), c.tobytes()))
        return pa.Table.from_batches([frame(_ARROW, rows)])

    @lean_group
    def collect(data: pa.Table) -> pa.Table:
        size_of: dict[int, int] = {}
        nodes, tokens, classes = [], [], []
        for _, kind, *blobs in zip(*(data.column(c).to_pylist() for c in _ARROW.names)):
            own, token = np.frombuffer(blobs[0], np.int64), np.frombuffer(blobs[2], U64)
            if kind == 1:
                sizes, n = np.frombuffer(blobs[1], np.int64).reshape(2, len(own))
                new = np.array([x not in size_of for x in own.tolist()], bool)
                size_of.update(zip(own.tolist(), sizes.tolist()))
                take = np.repeat(new, n)
                nodes.append(np.repeat(own, n)[take])
                tokens.append(token[take])
                classes.append(np.full(int(take.sum()), HEAVY_CLASS, np.uint8))
            else:
                nodes.append(np.repeat(own, np.frombuffer(blobs[1], np.int32)))
                tokens.append(token)
                classes.append(np.frombuffer(blobs[3], np.uint8))
        node = np.concatenate(nodes) if nodes else np.empty(0, np.int64)
        token = np.concatenate(tokens) if nodes else np.empty(0, U64)
        level = np.concatenate(classes) if nodes else np.empty(0, np.uint8)
        order = np.argsort(node, kind="stable")
        node, token, level = node[order], token[order], level[order]
        own = np.array(sorted(size_of), np.int64)
        a, b = np.searchsorted(node, own, "left"), np.searchsorted(node, own, "right")
        rows = [finish(x, size_of[x], token[i:j], level[i:j]) for x, i, j in zip(own.tolist(), a, b)]
        return pa.Table.from_batches([frame(schema, rows)])

    spark_schema = ", ".join(f"{f.name} {_SQL[str(f.type)]}" for f in schema)
    sent = docs.select("node", "text").mapInArrow(send, ROWS)
    return sent.groupBy("part").applyInArrow(answer, ROWS).groupBy("part").applyInArrow(collect, spark_schema)


_SQL = {"int64": "long", "int32": "int", "binary": "binary", "list<item: int64>": "array<long>"}

