"""Fill-in-the-middle: texts cut into prefix, middle and suffix by a sparse checkpoint index.

A text's units (code points, or words or lines as other units) are counted in
one pass over its UTF-8 bytes, block by block; every EVERY units the pass
records how many bytes and code points came before. A cut after u units is then
found by binary search among these checkpoints and a short rescan of the bytes
from there: what is kept beside the text is one checkpoint per EVERY units, and
no cut reads more than one such stretch again.

Where a text is cut, and in which form it is written, comes from four numbers of
a digest of its id, so that another split of the files changes nothing:

    plain  the text itself
    psm    <P>prefix<S>suffix<M>middle
    spm    <S>suffix<P>prefix<M>middle

Texts that hold a mark, and empty ones, stay plain. No mark ends as it begins,
so none can arise across a cut, and ``restored`` finds the parts by the marks
alone. Null text is empty; a null id counts as an empty one; ids may repeat
(equal rows give equal rows); columns that clash with added ones are replaced,
all others pass. A task holds one text at a time beside its record batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import lean, small_batches, table, text_chunks, text_or_empty

#: Marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Units between checkpoints, bytes counted at once, and the seed of the digests.
EVERY, BLOCK, SEED = 1024, 1 << 20, "1"
#: Shares, in percent, of texts that are cut at all, and of these that are written suffix first.
CUT_PERCENT, SPM_PERCENT = 90, 20
ADDED = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


def _code_points(block: np.ndarray, before: int) -> np.ndarray:
    return (block & 0xC0) != 0x80


def _words(block: np.ndarray, before: int) -> np.ndarray:
    space = (block == 32) | ((block >= 9) & (block <= 13))
    return ~space & np.concatenate(([before in (32, *range(9, 14))], space[:-1]))


def _lines(block: np.ndarray, before: int) -> np.ndarray:
    return np.concatenate(([before == 10], block[:-1] == 10))


#: Which bytes begin a unit, from a block of bytes and the byte before it; what lies before the first one is a unit of its own.
UNITS = {"code_point": _code_points, "word": _words, "line": _lines}


class Checkpoints:
    """Bytes and code points before every EVERY-th unit of a text, and the number of its units."""

    def __init__(self, data: bytes, unit: str = "code_point", every: int = EVERY, block: int = BLOCK):
        self.data, self.begins, self.every = np.frombuffer(data, np.uint8), UNITS[unit], every
        self.count = self.points = self.rescanned = 0
        marks = [np.zeros((1, 2), np.int64)]
        for offset, part, starts in self._scan(0, len(data), block):
            at = np.flatnonzero(starts)
            chosen = at[(self.count + np.arange(len(at))) % every == 0]
            chosen = chosen[offset + chosen > 0]
            if len(chosen):
                so_far = np.cumsum(_code_points(part, 0))
                marks.append(np.stack((offset + chosen, self.points + so_far[chosen] - 1), axis=1))
            self.count += len(at)
            self.points += int(np.count_nonzero(_code_points(part, 0)))
        index = np.concatenate(marks)
        self.bytes, self.code_points = index[:, 0], index[:, 1]
        self.units = np.arange(len(index), dtype=np.int64) * every

    def _scan(self, a: int, b: int, block: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(offset, bytes, which of them begin a unit); a text's first unit begins with the text."""
        for offset in range(a, b, block):
            part = self.data[offset : min(offset + block, b)]
            starts = self.begins(part, int(self.data[offset - 1]) if offset else 32)
            if offset == 0 and len(starts):
                starts[0] = True
            yield offset, part, starts

    def after(self, units: int) -> tuple[int, int]:
        """(bytes, code points) of the first so many units."""
        if units >= self.count:
            return len(self.data), self.points
        i = int(np.searchsorted(self.units, units, "right")) - 1
        left, byte, points = units - int(self.units[i]), int(self.bytes[i]), int(self.code_points[i])
        if not left:
            return byte, points
        end = int(self.bytes[i + 1]) if i + 1 < len(self.bytes) else len(self.data)
        left += 1  # the unit that begins at the cut
        for offset, part, starts in self._scan(byte, end, 4 * self.every):
            at = np.flatnonzero(starts)
            self.rescanned += len(part)
            if len(at) >= left:
                stop = int(at[left - 1])
                return offset + stop, points + int(np.count_nonzero(_code_points(part[:stop], 0)))
            left -= len(at)
            points += int(np.count_nonzero(_code_points(part, 0)))
        raise AssertionError("a cut lies between its checkpoints")


def cut_text(data: bytes, draws: tuple[int, int, int, int], unit: str = "code_point", every: int = EVERY) -> tuple:
    """(units, form, code points of prefix and of middle or None, output) of a text's bytes."""
    index = Checkpoints(data, unit, every)
    n = index.count
    if not n or draws[2] % 100 >= CUT_PERCENT or any(m in data for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, data
    (a, points_a), (b, points_b) = map(index.after, sorted((draws[0] % (n + 1), draws[1] % (n + 1))))
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if draws[3] % 100 < SPM_PERCENT:
        return n, "spm", points_a, points_b - points_a, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", points_a, points_b - points_a, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(documents: DataFrame, unit: str = "code_point", every: int = EVERY, seed: str = SEED) -> DataFrame:
    """All columns of documents, and n (units), form, prefix_chars, middle_chars (code points; null if plain) and output."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    small_batches(documents.sparkSession)
    kept = [c for c in documents.columns if c not in ADDED and c != "__draws" and c != "__bytes"]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    draws = F.array(*(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)))
    rows = documents.select(*kept, draws.alias("__draws"), text_or_empty().cast("binary").alias("__bytes"))
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())

    @lean
    def run(batches):
        for batch, texts in text_chunks(batches, column="__bytes"):
            made = [cut_text(data, tuple(own), unit, every) for data, own in zip(texts, batch.column("__draws").to_pylist())]
            added = [pa.array([r[i] for r in made], t) for i, t in enumerate(types)]
            # bytes of a Spark string, cut between code points, are UTF-8
            added[4] = added[4].view(pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *added], names=[*kept, *ADDED])

    schema = ", ".join([*(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in kept), *(f"{c} {t}" for c, t in ADDED.items())])
    return rows.mapInArrow(run, schema)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of, from it and its form alone."""
    part = F.split(F.col(output), "<[PSM]>", -1)
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored()).alias("restored_sha256"))


OP11_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
r as (select *, ('0x' || h[1:8])::ubigint as h1, ('0x' || h[9:16])::ubigint as h2, ('0x' || h[17:24])::ubigint as h3, ('0x' || h[25:32])::ubigint as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1))::bigint as a, greatest(h1 % (n + 1), h2 % (n + 1))::bigint as b,
             case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from r),
p as (select *, substring(t, 1, a) as pre, substring(t, a + 1, b - a) as mid, substring(t, b + 1) as suf from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
       sha256(t) as restored_sha256
from p
"""
