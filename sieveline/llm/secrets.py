"""Secret scans: fixed patterns, and character Markov models.

Patterns find assignments, access keys and long hexadecimal runs. Besides, runs
of at least ``LEAST_RUN`` characters of A-Z a-z 0-9 + / _ = - that no pattern
covers are scored by two first-order character models, one of random strings
and one of ordinary identifiers: a run whose log-likelihood ratio is at least
``LEAST_RATIO`` nats a character is a secret too (kind ``markov``). The models
are counts with add-one smoothing, trained from labelled samples.

``train_from`` takes its samples from documents: ordinary runs are words that
no pattern covers, random ones are the values that patterns found, both from a
bounded sample of SAMPLE_DOCS texts, plus SYNTHETIC seeded random strings and
as many plain numbers, which count as ordinary.

Offsets are code points, ends exclusive. Null text is empty and has no spans;
ids may be null or repeat; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import lean, small_batches, table, text_chunks, text_or_empty

#: The kinds in order and their patterns; least lengths follow.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
LEAST_RUN, LEAST_RATIO = 16, 1.0
SAMPLE_DOCS, SAMPLE_VALUES, SYNTHETIC, SEED = 4000, 4000, 2000, 5
MARK = "[SECRET]"

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_RUN = np.zeros(256, bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True


def _runs(member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True of at least this length: starts, ends."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], member, [False])).view(np.int8)))
    a, b = edge[::2], edge[1::2]
    long = b - a >= least
    return a[long], b[long]


class MarkovRatio:
    """Log-likelihood ratio of two first-order character models over bytes; byte 0 starts a string."""

    def __init__(self, samples: list[tuple[str, int]]):
        counts = np.ones((2, 256, 256))
        counts[:, :, ~_RUN] = 0
        for text, label in samples:
            s = np.frombuffer(b"\0" + text.encode(), np.uint8)
            np.add.at(counts[int(label)], (s[:-1], s[1:]), 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = np.log(counts / np.maximum(counts.sum(axis=2, keepdims=True), 1e-9))
            ratio = logs[1] - logs[0]
        self.ratio = np.where(np.isfinite(ratio), ratio, 0.0)

    def scores(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mean ratio a character of each run of a byte array."""
        return np.array([(self.ratio[0, flat[a]] + self.ratio[flat[a : b - 1], flat[a + 1 : b]].sum()) / (b - a) for a, b in zip(starts.tolist(), ends.tolist())])


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of assignments and access keys."""
    found = []
    if "=" in text or ":" in text:
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found


def find_spans(texts: list[str], model: MarkovRatio | None) -> list[list[tuple[int, int, str]]]:
    """Every text's spans, sorted by start, then kind in the order of KINDS."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    flat = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    begin = np.cumsum([0] + [len(d) + 1 for d in data])
    spans = [pattern_spans(t) for t in texts]
    found = []
    for kind, member, least in (("hex", _HEX, LEAST_HEX), ("markov", _RUN, LEAST_RUN)):
        if kind == "markov" and model is None:
            continue
        a, b = _runs(member[flat], least)
        if kind == "markov" and len(a):
            keep = model.scores(flat, a, b) >= LEAST_RATIO
            a, b = a[keep], b[keep]
        owner = np.searchsorted(begin, a, "right") - 1
        found += zip(owner.tolist(), (a - begin[owner]).tolist(), (b - begin[owner]).tolist(), [kind] * len(a))
    ends, at = {}, {}
    for i, a, b, kind in found:
        if not texts[i].isascii():
            if i not in at:  # bytes that start a character, counted up to each byte
                at[i] = np.concatenate(([0], np.cumsum((np.frombuffer(data[i], np.uint8) & 0xC0) != 0x80)))
            a, b = int(at[i][a]), int(at[i][b])
        if kind == "hex":
            spans[i].append((a, b, kind))
        else:
            if i not in ends:
                ends[i] = _merged(spans[i])
            starts, stops = ends[i]
            k = bisect.bisect_left(starts, b) - 1  # the last merged span that starts before b
            if k < 0 or stops[k] <= a:
                spans[i].append((a, b, kind))
    for s in spans:
        s.sort(key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    return spans


def _merged(spans: list) -> tuple[list, list]:
    """Starts and ends of the union of spans, in order."""
    starts, stops = [], []
    for a, b, _ in sorted(spans):
        if stops and a <= stops[-1]:
            stops[-1] = max(stops[-1], b)
        else:
            starts.append(a)
            stops.append(b)
    return starts, stops


def train_from(documents: DataFrame) -> MarkovRatio:
    small_batches(documents.sparkSession)
    total = max(1, documents.count())
    share = int(min(1.0, SAMPLE_DOCS / total) * (1 << 30))

    @lean
    def sample(batches):
        for _, texts in text_chunks(batches):
            good, bad = set(), set()
            for text, spans in zip(texts, find_spans(texts, None)):
                bad.update(ASSIGN.fullmatch(text, a, b)[2] if kind == "assign" else text[a:b] for a, b, kind in spans)
                starts, stops = _merged(spans)
                rest = " ".join(text[a:b] for a, b in zip([0, *stops], [*starts, len(text)]))
                good.update(re.findall(r"[A-Za-z0-9+/_=-]{6,}", rest))
            rows = [(x, 0) for x in sorted(good)] + [(x, 1) for x in sorted(bad) if x]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([y for _, y in rows], pa.int32())], names=["value", "label"])

    rows = documents.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < share).select(text_or_empty().alias("text"))
    values = rows.mapInArrow(sample, "value string, label int").distinct()
    samples = [(r[0], r[1]) for k in (0, 1) for r in values.where(F.col("label") == k).orderBy(F.xxhash64("value"), "value").limit(SAMPLE_VALUES).collect()]
    rng = np.random.default_rng(SEED)
    for alphabet in ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"):
        samples += [("".join(rng.choice(list(alphabet), 32)), 1) for _ in range(SYNTHETIC // 4)]
    samples += [("".join(rng.choice(list("0123456789"), 16)), 0) for _ in range(SYNTHETIC)]  # plain numbers are ordinary
    return MarkovRatio(samples)


def _joined(spans: list, kinds: tuple = KINDS) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans if k in kinds)


def scan(documents: DataFrame, model: MarkovRatio | None) -> DataFrame:
    """doc_id, spans (kind:start:end, joined) and counts by kind; base holds the patterns' spans alone."""
    small_batches(documents.sparkSession)
    kind = dict(documents.dtypes)["doc_id"]

    @lean
    def find(batches):
        for batch, texts in text_chunks(batches):
            spans = find_spans(texts, model)
            counts = [[sum(x[2] == k for x in s) for s in spans] for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array([_joined(s, KINDS[:3]) for s in spans], pa.string()), pa.array([_joined(s) for s in spans], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base", "spans"])

    return documents.select("doc_id", text_or_empty().alias("text")).mapInArrow(find, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_markov long, base string, spans string")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return scan(documents, train_from(documents)).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def redacted(text: str | None, spans: list) -> str | None:
    """The text with overlapping spans merged and each replaced by MARK."""
    if not spans:
        return text
    out, at, end = [], 0, -1
    for a, b, _ in spans:
        if a >= end:
            out += [text[at if at > end else max(at, end) : a], MARK] if end >= 0 else [text[:a], MARK]
            end = b
        else:
            end = max(end, b)
        at = end
    return "".join(out) + text[end:]


def redact(documents: DataFrame, model: MarkovRatio | None = None) -> DataFrame:
    """Documents with their secrets replaced; n_chars, where present, follows. Other columns and null texts stay."""
    small_batches(documents.sparkSession)
    model = model or train_from(documents)

    @lean
    def clean(batches):
        for batch, texts in text_chunks(batches):
            done = [redacted(t, s) for t, s in zip(texts, find_spans([t or "" for t in texts], model))]
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, batch.schema.field(i), pa.array(done, batch.schema.field(i).type))

    out = documents.mapInArrow(clean, documents.schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(documents.dtypes)["n_chars"])) if "n_chars" in documents.columns else out
