"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in windows of ``WINDOW`` bytes (every
byte of every text, states start at zero in each window), labels every
position with a distribution over the languages seen in training, and pools:
a document's probabilities are the means over its positions. It is trained in
numpy by backpropagation through time with Adam, on windows of a bounded
sample of labelled rows: about ``DOCS_PER_LANG`` documents of each language and
``WINDOWS_PER_DOC`` windows of each.

A text without letters (characters of a Unicode letter category; null and empty
texts have none) is ``und`` with score 0. If no row is labelled every text is
``und``. Ids may be null (held out, as in ``held_out``) or repeat; columns of the
names that are added are replaced, other extra columns stay; equal texts get one
label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from sieveline.llm.common import held_out, lean, scratch, small_batches, table, text_chunks

HIDDEN, WINDOW, BATCH = 8, 128, 4096
#: Bytes of text labelled at once.
TEXT_BYTES = 2 << 20
DOCS_PER_LANG, WINDOWS_PER_DOC = 400, 3
EPOCHS, STEP_BATCH, RATE, SEED = 6, 128, 0.02, 17
#: A rejected document has no letters or a score below this.
LEAST_SCORE = 0.5


class BiGRU:
    """Weights in float32; arrays are (features, batch). Gates: update, reset, candidate."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        f = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.languages, self.hidden = languages, hidden
        self.w = {}
        for d in "fb":
            self.w["P" + d] = f(3 * hidden, 256, scale=0.3)
            self.w["U" + d] = f(3 * hidden, hidden, scale=hidden**-0.5)
            self.w["c" + d] = np.zeros((hidden, 1), np.float32)
            self.w["V" + d] = f(len(languages), hidden, scale=hidden**-0.5)
        self.w["v"] = np.zeros((len(languages), 1), np.float32)

    def _step(self, d: str, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """New state and what backpropagation needs."""
        n = self.hidden
        a = np.take(self.w["P" + d], x, axis=1)
        u = self.w["U" + d] @ h
        g = a[: 2 * n]
        g += u[: 2 * n]
        g *= 0.5
        np.tanh(g, out=g)
        g *= 0.5
        g += 0.5
        q = u[2 * n :]
        q += self.w["c" + d]
        c = a[2 * n :]
        c += g[n:] * q
        np.tanh(c, out=c)
        new = h - c
        new *= g[:n]
        new += c
        return new, g, q, c

    def logits(self, x: np.ndarray, mask: np.ndarray):
        """Yields (t, logits) from the last position to the first; x and mask are (time, batch)."""
        steps, batch = x.shape
        h = np.zeros((self.hidden, batch), np.float32)
        ahead = np.empty((steps, self.hidden, batch), np.float32)
        for t in range(steps):
            h = self._step("f", h, x[t])[0]
            ahead[t] = h
        h = np.zeros((self.hidden, batch), np.float32)
        for t in range(steps - 1, -1, -1):
            h = self._step("b", h, x[t])[0]
            h *= mask[t]
            yield t, self.w["Vf"] @ ahead[t] + self.w["Vb"] @ h + self.w["v"]

    def pooled(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over each window's positions: of probabilities, and of labels (batch, languages)."""
        k, out = len(self.languages), []
        for i in range(0, len(windows), BATCH):
            x = np.ascontiguousarray(windows[i : i + BATCH].T)
            mask = (np.arange(x.shape[0])[:, None] < lengths[i : i + BATCH]).astype(np.float32)
            probs, labels = np.zeros((k, x.shape[1]), np.float32), np.zeros((k, x.shape[1]), np.float32)
            for t, z in self.logits(x, mask):
                top = z.max(axis=0)
                z -= top
                label = (z == 0).astype(np.float32)
                np.exp(z, out=z)
                z *= mask[t] / z.sum(axis=0)
                probs += z
                label *= mask[t]
                labels += label
            out.append((probs.T, labels.T))
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over positions; x, mask (time, batch), y (batch)."""
        steps, batch = x.shape
        n, w = self.hidden, self.w
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        kept: dict[str, list] = {}
        states: dict[str, list] = {}
        for d, times in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            h = np.zeros((n, batch), np.float32)
            kept[d], states[d] = [None] * steps, [None] * steps
            for t in times:
                new, g, q, c = self._step(d, h, x[t])
                kept[d][t] = (h, g, q, c)
                h = new * mask[t]
                states[d][t] = h
        total, weight = 0.0, np.float32(1.0 / mask.sum())
        back: dict[str, list] = {"f": [None] * steps, "b": [None] * steps}
        for t in range(steps):
            z = w["Vf"] @ states["f"][t] + w["Vb"] @ states["b"][t] + w["v"]
            z -= z.max(axis=0)
            p = np.exp(z)
            p /= p.sum(axis=0)
            total -= float((np.log(p[y, np.arange(batch)] + 1e-12) * mask[t]).sum())
            p[y, np.arange(batch)] -= 1
            p *= mask[t] * weight
            grad["v"] += p.sum(axis=1, keepdims=True)
            for d in "fb":
                grad["V" + d] += p @ states[d][t].T
                back[d][t] = w["V" + d].T @ p
        for d, times in (("f", range(steps - 1, -1, -1)), ("b", range(steps))):
            dh = np.zeros((n, batch), np.float32)
            for t in times:
                h, g, q, c = kept[d][t]
                dh = (dh + back[d][t]) * mask[t]
                z, r = g[:n], g[n:]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * q * r * (1 - r)
                dq = dc * r
                da = np.concatenate((dz, dr, dc))
                du = np.concatenate((dz, dr, dq))
                grad["U" + d] += du @ h.T
                grad["c" + d] += dq.sum(axis=1, keepdims=True)
                one_hot = np.zeros((batch, 256), np.float32)
                one_hot[np.arange(batch), x[t]] = 1
                grad["P" + d] += da @ one_hot
                dh = dh * z + w["U" + d].T @ du
        return total * float(weight), grad

    def train(self, windows: np.ndarray, lengths: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> "BiGRU":
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, steps = 0, epochs * -(-len(y) // STEP_BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(order), STEP_BATCH):
                own = order[i : i + STEP_BATCH]
                x = np.ascontiguousarray(windows[own].T)
                mask = (np.arange(x.shape[0])[:, None] < lengths[own]).astype(np.float32)
                _, grad = self.loss_and_gradient(x, y[own], mask)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                step += 1
                rate = RATE * (1 - step / (steps + 1))
                for k, g in grad.items():
                    g *= min(1.0, 1.0 / (norm + 1e-12))
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.01 * (g * g - s[k])
                    self.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)
        return self


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows of bytes, their lengths, the text of each), all bytes of all texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), counts)
    flat = np.zeros(int(counts.sum()) * WINDOW, np.uint8)
    at = np.concatenate(([0], np.cumsum(counts))) * WINDOW
    for t, a in zip(texts, at):
        flat[a : a + len(t)] = np.frombuffer(t, np.uint8)
    lengths = np.full(len(owner), WINDOW, np.int64)
    last = np.cumsum(counts)[counts > 0] - 1
    lengths[last] = (sizes - (counts - 1) * WINDOW)[counts > 0]
    return flat.reshape(-1, WINDOW), lengths, owner


def fit(documents: DataFrame, per_lang: int = DOCS_PER_LANG) -> BiGRU | None:
    """Train on labelled rows that are not held out; None if there are none."""
    small_batches(documents.sparkSession)
    rows = documents.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, per_lang / n) * (1 << 30)))))
    rows = rows.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(SEED)), F.lit(1 << 30)) < share[F.col("lang")]).select("doc_id", "lang", "text")

    @lean
    def pick(batches):
        for batch, texts in text_chunks(batches):
            out = []
            for k, lang, text in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), texts):
                data = text.encode("utf-8", "surrogatepass")
                rng = np.random.default_rng(abs(hash(int(k))) if isinstance(k, int) else 1)
                starts = rng.integers(0, max(1, len(data) - WINDOW + 1), WINDOWS_PER_DOC)
                out += [(lang, data[a : a + WINDOW]) for a in sorted(set(starts.tolist())) if data]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary())], names=["lang", "window"])

    picked = rows.mapInArrow(pick, "lang string, window binary")
    # rows may be copies of each other: at most twice the expected sample comes to the driver
    picked = picked.orderBy(F.xxhash64("window"), "window", "lang").limit(2 * per_lang * WINDOWS_PER_DOC * len(counts))
    sample = sorted((lang, bytes(w)) for lang, w in picked.collect())
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return None
    x, lengths, _ = windows_of([w for _, w in sample])
    y = np.array([languages.index(lang) for lang, _ in sample])
    return BiGRU(languages).train(x, lengths, y)


#: Columns that ``identify`` adds.
ADDED = ("lang_pred", "score", "position_labels")


def identify(documents: DataFrame, model: BiGRU | None, names: tuple[str, str, str] = ADDED) -> DataFrame:
    """All columns of documents and, under these names, language, score and positions by label (in the order of the model's languages)."""
    languages = model.languages if model else []
    small_batches(documents.sparkSession)
    documents = documents.drop(*names).withColumn("text", F.col("text").cast("string"))

    @lean
    def label(batches):
        for batch, texts in text_chunks(batches, TEXT_BYTES):
            data = [t.encode("utf-8", "surrogatepass") if t and any(map(str.isalpha, t)) else b"" for t in texts]
            n = len(data)
            probs, labels = np.zeros((n, max(1, len(languages)))), np.zeros((n, max(1, len(languages))))
            x, lengths, owner = windows_of(data)
            if len(owner) and model:
                p, q = model.pooled(x, lengths)
                np.add.at(probs, owner, p)
                np.add.at(labels, owner, q)
            total = np.maximum(lengths_of(data), 1)
            mean = probs / total[:, None]
            best = mean.argmax(axis=1)
            found = [bool(d) and model is not None for d in data]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([languages[b] if f else "und" for b, f in zip(best.tolist(), found)], pa.string()),
                 pa.array(np.where(found, np.clip(np.round(mean[np.arange(n), best], 6), 0, 1), 0.0)), pa.array(labels.astype(np.int64).tolist(), pa.list_(pa.int64()))],
                names=[*batch.schema.names, *names])

    return documents.mapInArrow(label, StructType([*documents.schema.fields, *(StructField(n, t) for n, t in zip(names, (StringType(), DoubleType(), ArrayType(LongType()))))]))


def lengths_of(data: list[bytes]) -> np.ndarray:
    return np.array([len(d) for d in data], np.int64)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(documents)
    return identify(documents.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents whose language is found with a score of LEAST_SCORE or more; columns unchanged."""
    found, score, _ = names = scratch(docs, *ADDED)
    judged = identify(docs, fit(docs), tuple(names))
    return judged.where((F.col(found) != "und") & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)
