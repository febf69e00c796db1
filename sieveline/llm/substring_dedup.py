"""Removal of repeated word windows by super-k-mer partitioning.

A window is ``span`` consecutive words of one document. Its minimiser is the
least hash of the ``seed``-word grams within it; consecutive windows with one
minimiser form a super-k-mer, which travels as one packed string of word hashes
(64 bits each) to the bucket of its minimiser, so that equal windows always meet.
There the windows' hashes are sorted and equal neighbours compared word by word.

Before that a cheaper exchange of the minimisers alone finds those that occur
more than once; only their super-k-mers travel. Windows of heavy minimisers
(found on a sample, which decides the route only) are spread by their own hash
instead, of 128 bits, and repeats within a chunk of texts are settled there, so
a passage that a third of the documents share does not fill one bucket.

Texts are dealt by their hash once, copies collapsed before; what is found
about a text comes back to that place, and rows get it by a join of ids.

Every word covered by a window that also starts anywhere else, in the same
document too, is removed. Copies of a text are counted by their text hash.
Null or empty texts have no words; repeated rows and null ids keep one result
row each; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import U64, WordHashes, grams, lean, lean_group, mix, node_of, sliding_min, table, text_chunks, text_or_empty
from sieveline.llm.postings import ROWS, _ARROW, _member, first_of_each, frame, grouped, heavy_tokens, measured, routed, shared_tokens

SPAN, SEED = 35, 8
#: Occurrences that make a minimiser heavy, if they are not HEAVY_SHARE of the texts before.
HEAVY_ROWS = 50_000
#: Pairs of windows compared word by word at once.
PAIRS = 50_000
_FLAGS = pa.schema([("node", pa.int64()), ("tokens", pa.binary())])
_WIDE = np.dtype([("a", U64), ("b", U64)])


def _wide_hashes(h: np.ndarray, span: int) -> np.ndarray:
    """128-bit hash of every ``span`` consecutive word hashes."""
    out = np.empty(max(0, len(h) - span + 1), _WIDE)
    out["a"], out["b"] = grams(h, span), grams(mix(h + U64(1)), span)
    return out


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _runs(h: np.ndarray, span: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of each super-k-mer; all grams."""
    all_grams = grams(h, seed)
    least = sliding_min(all_grams, span - seed + 1)
    if not len(least):
        return least, np.empty(0, np.int64), np.empty(0, np.int64), all_grams
    at = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    return least[at], at, np.diff(np.append(at, len(least))), all_grams


def _minimisers(span: int, seed: int):
    def extract(texts: list) -> tuple[list, list]:
        hashes = WordHashes()
        out = [np.unique(_runs(hashes.of(words_of(t)), span, seed)[0]) for t in texts]
        return out, [len(x) for x in out]

    return extract


def _stretches(starts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first, number) of stretches of consecutive positions; the input is sorted by both."""
    new = np.ones(len(starts), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    return owner[at], starts[at], np.diff(np.append(at, len(starts)))


def _address(node: np.ndarray, start: np.ndarray, parts: int) -> list[tuple]:
    """Rows that carry repeated windows home, as stretches."""
    order = np.lexsort((start, node))
    node, start = node[order], start[order]
    own, first, number = _stretches(start, node)
    return [
        (part, 2, o.tobytes(), n.tobytes(), f.astype(np.uint32).tobytes(), m.astype(np.uint32).tobytes())
        for part, o, n, f, m in grouped((own.view(U64) % U64(parts)).astype(np.int64), own, first, number)
    ]


def _repeated(hashes: np.ndarray, sequence) -> np.ndarray:
    """Mask of the windows that occur twice: equal hashes, and equal words as ``sequence(i)`` gives them."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    same = h[1:] == h[:-1]
    out = np.zeros(len(h), bool)
    if same.any():
        left, right = order[:-1][same], order[1:][same]
        unlike = np.concatenate([~(sequence(left[i : i + PAIRS]) == sequence(right[i : i + PAIRS])).all(axis=1) for i in range(0, len(left), PAIRS)])
        if unlike.any():  # two windows with one hash: tell them apart by their words
            for value in np.unique(hashes[left[unlike]]):
                group = np.flatnonzero(hashes == value)
                keys = [x.tobytes() for x in sequence(group)]
                for i, key in zip(group, keys):
                    out[i] = keys.count(key) > 1
            settled = np.isin(hashes[left], hashes[left[unlike]])
            left, right = left[~settled], right[~settled]
        out[left] = True
        out[right] = True
    return out


def repeated_windows(rows: DataFrame, texts: DataFrame, span: int = SPAN, seed: int = SEED) -> DataFrame:
    """(node, spans): packed (first window, number) pairs, uint32, of repeated windows of the distinct texts (node, text) of rows."""
    extract = _minimisers(span, seed)
    total, parts = measured(rows)
    heavy = heavy_tokens(rows, extract, total, parts, HEAVY_ROWS)
    flags = shared_tokens(texts, extract, lambda node, n, t, c: (node, np.sort(t).tobytes()), _FLAGS, parts, heavy)

    @lean
    def send(batches):
        hashes = WordHashes()
        for batch, texts in text_chunks(batches):
            nodes = batch.column("node").to_numpy()
            rows, lone = [], []
            known = batch.column("tokens")
            packed = {k: [] for k in ("part", "node", "start", "len", "words")}
            for i in first_of_each(nodes):
                h = hashes.of(words_of(texts[i]))
                low, at, n, seeds = _runs(h, span, seed)
                if not len(low):
                    continue
                token = routed(low, parts)
                flagged = np.frombuffer(known[i].as_py() or b"", U64)
                values, count = np.unique(seeds, return_counts=True)  # a minimiser may come again within its own run
                hot = _member(heavy, token)
                keep = (_member(flagged, token) | _member(values[count > 1], low)) & ~hot
                for t, a, m in zip(token[keep].tolist(), at[keep].tolist(), n[keep].tolist()):
                    packed["part"].append(t >> 40)
                    packed["node"].append(nodes[i])
                    packed["start"].append(a)
                    packed["len"].append(m)
                    packed["words"].append(h[a : a + m + span - 1])
                if hot.any():
                    starts = np.concatenate([np.arange(a, a + m) for a, m in zip(at[hot], n[hot])])
                    lone.append((np.full(len(starts), nodes[i]), starts, _wide_hashes(h, span)[starts]))
            if packed["part"]:
                part, start, m = (np.array(packed[k], np.int64) for k in ("part", "start", "len"))
                index = np.arange(len(part))
                for p, own, n, s, c, w in grouped(part, np.array(packed["node"], np.int64), start, m, index):
                    rows.append((p, 0, own.tobytes(), n.tobytes(), np.stack([s, c]).astype(np.uint32).tobytes(), np.concatenate([packed["words"][j] for j in w]).tobytes()))
            if lone:
                node, start, value = (np.concatenate(x) for x in zip(*lone))
                _, first, where, count = np.unique(value, return_index=True, return_inverse=True, return_counts=True)
                local = count[where] > 1
                rows += _address(node[local], start[local], parts)
                node, start, value = node[first], start[first], value[first]
                for p, own, n, s, v in grouped((value["a"] % U64(parts)).astype(np.int64), node, start, value):
                    rows.append((p, 1, own.tobytes(), n.tobytes(), s.astype(np.uint32).tobytes(), v.tobytes()))
            yield frame(_ARROW, rows)

    @lean_group
    def count(data: pa.Table) -> pa.Table:
        rows, nodes, starts, words, offsets, lens, alone = [], [], [], [], [], [], []
        for part, kind, *b in zip(*(data.column(c).to_pylist() for c in _ARROW.names)):
            if kind == 2:
                rows.append((part, 2, *b))
                continue
            own = np.repeat(np.frombuffer(b[0], np.int64), np.frombuffer(b[1], np.int32))
            if kind == 1:
                alone.append((own, np.frombuffer(b[2], np.uint32).astype(np.int64), np.frombuffer(b[3], _WIDE)))
                continue
            s, m = np.frombuffer(b[2], np.uint32).astype(np.int64).reshape(2, len(own))
            nodes.append(own)
            starts.append(s)
            lens.append(m)
            words.append(np.frombuffer(b[3], U64))
        if nodes:
            node, start, m = np.concatenate(nodes), np.concatenate(starts), np.concatenate(lens)
            flat = np.concatenate(words)
            begin = np.cumsum(m + span - 1) - (m + span - 1)
            ordinal = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            place = np.repeat(begin, m) + ordinal
            value = grams(flat, span)[place]
            node, start = np.repeat(node, m), np.repeat(start, m) + ordinal
            order = np.lexsort((start, node))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (node[order][1:] != node[order][:-1]) | (start[order][1:] != start[order][:-1])
            order = order[fresh]
            node, start, place, value = node[order], start[order], place[order], value[order]
            around = np.arange(span)
            twice = _repeated(value, lambda i: flat[place[i][:, None] + around])
            rows += _address(node[twice], start[twice], parts)
        if alone:
            node, start, value = (np.concatenate(x) for x in zip(*alone))
            order = np.lexsort((start, node, value))
            node, start, value = node[order], start[order], value[order]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (node[1:] != node[:-1]) | (start[1:] != start[:-1])
            node, start, value = node[fresh], start[fresh], value[fresh]
            _, where, n = np.unique(value, return_inverse=True, return_counts=True)
            rows += _address(node[n[where] > 1], start[n[where] > 1], parts)
        return pa.Table.from_batches([frame(_ARROW, rows)])

    @lean_group
    def collect(data: pa.Table) -> pa.Table:
        nodes, first, number = [], [], []
        for _, _, *b in zip(*(data.column(c).to_pylist() for c in _ARROW.names)):
            nodes.append(np.repeat(np.frombuffer(b[0], np.int64), np.frombuffer(b[1], np.int32)))
            first.append(np.frombuffer(b[2], np.uint32))
            number.append(np.frombuffer(b[3], np.uint32))
        node = np.concatenate(nodes) if nodes else np.empty(0, np.int64)
        order = np.argsort(node, kind="stable")
        spans = np.stack([np.concatenate(first), np.concatenate(number)], axis=1)[order] if nodes else np.empty((0, 2), np.uint32)
        own, at = np.unique(node[order], return_index=True)
        return pa.Table.from_batches([frame(_SPANS, [(x, s.tobytes()) for x, s in zip(own.tolist(), np.split(spans, at[1:]))] if len(own) else [])])

    marked = texts.join(flags, "node", "left").select("node", "text", "tokens")
    return marked.mapInArrow(send, ROWS).groupBy("part").applyInArrow(count, ROWS).groupBy("part").applyInArrow(collect, "node long, spans binary")


_SPANS = pa.schema([("node", pa.int64()), ("spans", pa.binary())])


def covered(n_words: int, spans: bytes | None, span: int = SPAN) -> np.ndarray:
    """Mask of the words within repeated windows."""
    edge = np.zeros(n_words + 1, np.int64)
    if spans:
        first, number = np.frombuffer(spans, np.uint32).astype(np.int64).reshape(-1, 2).T
        np.add.at(edge, first, 1)
        np.add.at(edge, first + number + span - 1, -1)
    return np.cumsum(edge)[:n_words] > 0


def _by_text(documents: DataFrame, span: int, seed: int) -> DataFrame:
    """(node, n_words, n_removed, kept) of every distinct text."""
    rows = documents.select(node_of().alias("node"), text_or_empty().alias("text"))
    texts = rows.groupBy("node").agg(F.first("text").alias("text"))  # the same each time it is used, so that it is dealt once
    spans = repeated_windows(rows, texts, span, seed)
    copies = rows.groupBy("node").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    found = spans.withColumn("copies", F.lit(1).cast("long")).union(copies.select("node", F.lit(None).cast("binary").alias("spans"), "copies"))
    found = found.groupBy("node").agg(F.max("spans").alias("spans"), F.max("copies").alias("copies"))

    @lean
    def apply(batches):
        for batch, texts in text_chunks(batches):
            n_words, n_removed, kept = [], [], []
            for text, packed, copies in zip(texts, batch.column("spans").to_pylist(), batch.column("copies").to_pylist()):
                words = words_of(text)
                if (copies or 1) > 1 and len(words) >= span:
                    gone = np.ones(len(words), bool)
                else:
                    gone = covered(len(words), packed, span)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if n_removed[-1] else b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], names=["node", "n_words", "n_removed", "kept"])

    return texts.join(found, "node", "left").select("node", "text", "spans", "copies").mapInArrow(apply, "node long, n_words long, n_removed long, kept binary")


def dedup_substrings(documents: DataFrame, span: int = SPAN, seed: int = SEED, digest: bool = False) -> DataFrame:
    """One row per document row: doc_id, n_words, n_removed, kept (its remaining words, joined by one space; or kept_sha256)."""
    found = _by_text(documents, span, seed)
    if digest:
        found = found.select("node", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return documents.select("doc_id", node_of().alias("node")).join(found, "node").drop("node")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), digest=True)


OP8_SQL = r"""
with w as (
  select doc_id, row_number() over () as r, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
g as (select r, i, md5(array_to_string(ws[i:i + 34], ' ')) as h from (select r, ws, unnest(range(1, len(ws) - 33)) as i from w where len(ws) >= 35)),
d as (select h from g group by h having count(*) > 1),
c as (select distinct r, unnest(range(i, i + 35)) as p from g semi join d using (h)),
x as (select r, list(p) as ps from c group by r),
k as (
  select w.doc_id, len(ws) as n, coalesce(len(ps), 0) as m,
         case when ps is null then array_to_string(ws, ' ') else array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda i: not list_contains(ps, i)), lambda i: ws[i]), ' ') end as kept
  from (select r, doc_id, ws from w) w left join x using (r))
select doc_id, n::bigint as n_words, m::bigint as n_removed, sha256(kept) as kept_sha256 from k
"""
