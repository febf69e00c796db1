"""Toxicity by non-negative positive-unlabelled learning.

A linear model over the presence of features is trained in numpy from confirmed
toxic texts (P) and unlabelled texts (U) with the risk estimator

    pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)]),   l(z) = log(1 + e^-z)

where pi is the share of toxic texts among labelled training rows. When the
bracket is negative the step goes against its gradient, as the method has it.
Features are 64-bit hashes of whole words and of their first 4, 5 and 6 letters,
which forms of one word share. An absolute penalty (soft thresholds after each
step) leaves few weights, of either sign; these are fitted again under a smaller
one. The bias is set to the cut of least estimated error.
A feature takes part when ``LEAST_SHARE`` of P or of U has it (and ``LEAST_TEXTS``
texts at least): below, the penalty keeps its weight at 0 anyway. So there are at
most 2 / LEAST_SHARE times as many as a text has on average. P and U are
bounded samples (SAMPLE_P, SAMPLE_U texts in expectation) of rows whose
crc32(doc_id) leaves no 0 by 5; labels are used for nothing else.

The score is 1 / (1 + e^-g). Null and empty texts score the model's bias; with
no toxic labels, and where documents are empty, every score is 0. Ids may repeat
(a label counts once by id) or be null (held out, as in ``held_out``); extra
columns are ignored; equal texts get equal scores. Copies of rows may swell a
sample to twice its expected size at most.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import held_out, lean, slices, small_batches, table, text_chunks, text_or_empty

SAMPLE_P, SAMPLE_U, LEAST_SHARE, LEAST_TEXTS, OPENINGS = 2000, 6000, 0.02, 3, (4, 5, 6)
EPOCHS, BATCH_P, BATCH_U, RATE, PENALTY, FINAL_STEPS, SEED = 40, 256, 768, 0.05, 1e-3, 200, 3
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features_of(word: str) -> list[int]:
    """Hashes of a word and of its openings, as signed 64-bit integers."""
    found = [xxhash.xxh3_64_intdigest(word.encode())]
    found += [xxhash.xxh3_64_intdigest(word[:n].encode(), seed=n) for n in OPENINGS if len(word) > n]
    return [h - (1 << 64) if h >> 63 else h for h in found]


class _Places(dict):
    """The places of a word's features in an index, remembered; emptied when it holds too many words."""

    LIMIT = 200_000

    def __init__(self, index: dict[int, int]):
        self.index_of_hash = index

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.LIMIT:
            self.clear()
        own = self[word] = tuple(i for i in map(self.index_of_hash.get, features_of(word)) if i is not None)
        return own

    def of(self, words: set[str]) -> np.ndarray:
        """Sorted distinct places of all features of a text."""
        out: set[int] = set()
        for word in words:
            own = self[word]
            if own:
                out.update(own)
        return np.array(sorted(out), np.int64)


class PULinear:
    def __init__(self, hashes: list[int], weights: np.ndarray, bias: float):
        kept = np.flatnonzero(weights)
        self.index = {hashes[j]: i for i, j in enumerate(kept)}
        self.weights, self.bias = weights[kept], bias

    def scores(self, texts: list[str]) -> np.ndarray:
        places = _Places(self.index)
        out = np.array([self.weights[places.of(words_of(text))].sum() for text in texts]) + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


class Presence:
    """Texts as lists of the places of their features: row ``i`` is ``places[start[i]:start[i + 1]]``."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.width, self.start = width, slices(np.array([len(r) for r in rows], np.int64))
        self.places = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)

    @classmethod
    def of(cls, matrix: np.ndarray) -> Presence:
        return cls([np.flatnonzero(r) for r in matrix], matrix.shape[1])

    def __len__(self) -> int:
        return len(self.start) - 1

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``rows``, place) of all their features."""
        sizes = self.start[rows + 1] - self.start[rows]
        ends = np.cumsum(sizes)
        return np.repeat(np.arange(len(rows)), sizes), self.places[np.repeat(self.start[rows] - ends + sizes, sizes) + np.arange(sizes.sum())]

    def only(self, kept: np.ndarray) -> Presence:
        """The same texts with these features alone."""
        at = np.full(self.width, -1, np.int64)
        at[kept] = np.arange(len(kept))
        places, row = at[self.places], np.repeat(np.arange(len(self)), np.diff(self.start))
        out = Presence([], len(kept))
        out.places, out.start = places[places >= 0], slices(np.bincount(row[places >= 0], minlength=len(self)))
        return out

    def sums(self, weights: np.ndarray) -> np.ndarray:
        row, place = self.take(np.arange(len(self)))
        return np.bincount(row, weights[place], len(self))


def train(positive: Presence, unlabelled: Presence, prior: float, epochs: int = EPOCHS, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Weights and bias: a sparse pass, then one over the features it kept, under a fifth of the penalty."""
    first, _ = _descend(positive, unlabelled, prior, epochs, PENALTY, seed, BATCH_P, BATCH_U)
    kept = np.flatnonzero(first)
    p, u, weights = positive.only(kept), unlabelled.only(kept), np.zeros(positive.width)
    weights[kept], bias = _descend(p, u, prior, FINAL_STEPS, PENALTY / 5, seed, len(p), len(u))
    return weights, bias - _threshold(p.sums(weights[kept]) + bias, u.sums(weights[kept]) + bias, prior)


def _threshold(p: np.ndarray, u: np.ndarray, prior: float) -> float:
    """The cut with the least estimated error, prior * P(missed | P) + max(0, P(taken | U) - prior * P(taken | P)), midway between two values."""
    values = np.unique(np.concatenate((p, u)))
    cuts = (values[1:] + values[:-1]) / 2 if len(values) > 1 else values
    taken_p = 1 - np.searchsorted(np.sort(p), cuts) / len(p)
    taken_u = 1 - np.searchsorted(np.sort(u), cuts) / len(u)
    risk = prior * (1 - taken_p) + np.maximum(0, taken_u - prior * taken_p)
    return float(cuts[np.flatnonzero(risk <= risk.min() + 1e-12)[-1]])


def _descend(positive: Presence, unlabelled: Presence, prior: float, epochs: int, penalty: float, seed: int, batch_p: int, batch_u: int) -> tuple[np.ndarray, float]:
    rng = np.random.default_rng(seed)
    n = positive.width
    theta, m, s = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    theta[n] = -2.0
    step, steps = 0, epochs * max(1, -(-len(unlabelled) // batch_u))
    for _ in range(epochs):
        order = rng.permutation(len(unlabelled))
        for i in range(0, len(order), batch_u):
            picked = (rng.integers(0, len(positive), batch_p) if batch_p < len(positive) else np.arange(len(positive)), order[i : i + batch_u])
            (rp, cp), (ru, cu) = positive.take(picked[0]), unlabelled.take(picked[1])
            gp, gu = (np.bincount(r, theta[c], len(x)) + theta[n] for r, c, x in zip((rp, ru), (cp, cu), picked))
            sp, su = (1 / (1 + np.exp(-np.clip(g, -30, 30))) for g in (gp, gu))
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            mean = lambda r, c, k: np.append(np.bincount(c, k[r], n), k.sum()) / len(k)
            rest = mean(ru, cu, su) - prior * mean(rp, cp, sp)
            grad = prior * mean(rp, cp, sp - 1) + rest if negative >= 0 else -rest
            step += 1
            m += 0.1 * (grad - m)
            s += 0.01 * (grad * grad - s)
            rate = RATE * (1 - step / (steps + 1)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-3)
            theta -= rate * m / (1 - 0.9**step)
            theta[:n] = np.sign(theta[:n]) * np.maximum(0, np.abs(theta[:n]) - rate[:n] * penalty)
    return theta[:n].copy(), float(theta[n])


def fit(documents: DataFrame, labels: DataFrame) -> PULinear | None:
    small_batches(documents.sparkSession)
    rows = documents.where(~held_out() & F.col("text").isNotNull()).select("doc_id", "text")
    marks = labels.where(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total, toxic = marks.agg(F.count(F.lit(1)), F.count_if(F.col("toxic") == 1)).first()
    if not toxic:
        return None
    prior = toxic / total
    draw = lambda df, bound, n, tag: df.where(F.pmod(F.xxhash64("doc_id", F.lit(tag)), F.lit(1 << 30)) < int(min(1.0, bound / max(1, n)) * (1 << 30)))
    p = rows.join(F.broadcast(draw(marks.where("toxic = 1"), SAMPLE_P, toxic, 1).select("doc_id").orderBy("doc_id").limit(2 * SAMPLE_P)), "doc_id")
    u = draw(rows, SAMPLE_U, rows.count(), 2)

    @lean
    def tokens(batches):
        for batch, texts in text_chunks(batches):
            hashes = [sorted({h for w in words_of(t) for h in features_of(w)}) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("p"), pa.array(hashes, pa.list_(pa.int64()))], names=["id", "p", "features"])

    sample = p.withColumn("p", F.lit(1)).union(u.withColumn("p", F.lit(0))).mapInArrow(tokens, "id string, p int, features array<long>")
    n_p, n_u = sample.agg(F.count_if(F.col("p") == 1), F.count_if(F.col("p") == 0)).first()
    if not n_p or not n_u:
        return None
    counts = sample.select("p", F.explode("features").alias("h")).groupBy("h").agg(F.count_if(F.col("p") == 1).alias("np"), F.count_if(F.col("p") == 0).alias("nu"))
    enough = (F.col("np") >= max(LEAST_TEXTS, LEAST_SHARE * n_p)) | (F.col("nu") >= max(LEAST_TEXTS, LEAST_SHARE * n_u))
    hashes = sorted(r[0] for r in counts.where(enough).select("h").collect())
    known = np.array(hashes, np.int64)

    @lean
    def positions(batches):
        for batch in batches:
            own = [np.flatnonzero(np.isin(known, np.array(x, np.int64))).astype(np.uint32).tobytes() for x in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("p"), pa.array(own, pa.binary())], names=["id", "p", "at"])

    placed = sample.mapInArrow(positions, "id string, p int, at binary").orderBy(F.desc("p"), F.xxhash64("at", "id"), "at", "id").limit(2 * (SAMPLE_P + SAMPLE_U))
    found = sorted((r[1], r[0] or "", bytes(r[2])) for r in placed.collect())
    split = {kind: Presence([np.frombuffer(at, np.uint32) for k, _, at in found if k == kind], len(hashes)) for kind in (0, 1)}
    if not len(split[0]) or not len(split[1]):
        return None
    return PULinear(hashes, *train(split[1], split[0], prior))


def score(documents: DataFrame, model: PULinear | None) -> DataFrame:
    """doc_id and score of every row."""
    small_batches(documents.sparkSession)
    kind = dict(documents.dtypes)["doc_id"]

    @lean
    def run(batches):
        for batch, texts in text_chunks(batches):
            values = model.scores(texts) if model else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(values, 9))], names=["doc_id", "score"])

    return documents.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = score(documents, fit(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
