"""Token counts by section, from one encoding of the whole document.

A document is encoded once. Its tokens' character spans (from the byte lengths
of the tokens) are joined with the spans of its sections, and every token's
count goes to one section: to the one it overlaps most, by characters, and of
equal overlaps to the first. Counting sections one by one would give other
numbers, since a token may cross a boundary.

Sections are spans that cover the text without gaps: here its lines, each with
the line feed that ends it. The vocabulary file's path is a parameter; the driver
sends the file to the workers. Null or empty text has no tokens and no
sections. Ids may be null or repeat; extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from sieveline.llm.common import lean, small_batches, table, text_chunks, text_or_empty

VOCABULARY = os.environ.get("SIEVELINE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the vocabulary's pre-tokenising pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=2)
def encoder(path: str):
    """(encoding, byte length of each token id)."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("sieveline", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def token_spans(text: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Character starts and ends of the tokens; a token of part of a character spans that character."""
    encoding, sizes = encoder(path)
    ids = np.asarray(encoding.encode_ordinary(text), np.int64)
    end = np.cumsum(sizes[ids])
    start = end - sizes[ids]
    if not text.isascii():
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        return character[start], character[end - 1] + 1
    return start, end


def line_sections(text: str) -> np.ndarray:
    """Ends of a text's lines, in characters."""
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10) + 1
    return ends if len(ends) and ends[-1] == len(text) else np.append(ends, len(text))


def attribute(start: np.ndarray, end: np.ndarray, section_ends: np.ndarray) -> tuple[np.ndarray, int]:
    """(tokens of each section, tokens that cross a boundary)."""
    first = np.searchsorted(section_ends, start, "right")
    last = np.searchsorted(section_ends, end, "left")
    owner, crossing = first.copy(), np.flatnonzero(last > first)
    for i in crossing.tolist():
        bounds = np.clip(np.concatenate(([start[i]], section_ends[first[i] : last[i]], [end[i]])), start[i], end[i])
        owner[i] = first[i] + int(np.argmax(np.diff(bounds)))
    return np.bincount(owner, minlength=len(section_ends)), len(crossing)


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_sections, n_crossing, section_tokens."""
    small_batches(documents.sparkSession)
    kind = dict(documents.dtypes)["doc_id"]
    name = os.path.basename(vocabulary)
    documents.sparkSession.sparkContext.addFile(vocabulary)

    @lean
    def run(batches):
        path = SparkFiles.get(name)
        for batch, texts in text_chunks(batches):
            rows = []
            for text in texts:
                if not text:
                    rows.append((0, 0, 0, []))
                    continue
                ends = line_sections(text)
                counts, crossing = attribute(*token_spans(text, path), ends)
                rows.append((int(counts.sum()), len(ends), crossing, counts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))))], names=["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"])

    return documents.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, n_sections long, n_crossing long, section_tokens array<long>")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
