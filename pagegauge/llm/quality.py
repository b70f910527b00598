"""Document quality by a byte-level convolutional network in numpy.

Each text is its UTF-8 bytes, cut into overlapping chunks that cover all of
it.  A byte is embedded, learned filters slide over the bytes of a chunk, the
largest response of each filter in the chunk is kept, and one logistic output
is formed of the mean over the chunks and the maximum over the chunks.  All
chunks of all texts count, however long the text.

Training: a bounded sample of labelled rows (``max_rows`` labels with the
smallest hashes, and at most ``max_chunks`` chunks of each, spread over the
whole text) is fitted in one task by about ``steps`` mini-batches of gradient
descent (8 to 40 passes) with a fixed seed.  The weights are a few kilobytes.

Defined results: a null or empty text is one chunk of padding and gets the
network's score of it; repeated rows get equal scores; without training rows
every score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegauge.llm.batches import slices

CHUNK, STEP = 512, 384
WIDTH, STRIDE, DIM, FILTERS = 14, 2, 6, 32
SEED = 7


def chunked(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all chunks (rows of CHUNK, padded with 0) and the number of chunks of each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    counts = np.array([max(1, -(-(len(r) - CHUNK) // STEP) + 1) for r in raw], np.int64)
    out = np.zeros((int(counts.sum()), CHUNK), np.uint8)
    k = 0
    for r, n in zip(raw, counts.tolist(), strict=True):
        padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
        padded[:len(r)] = np.frombuffer(r, np.uint8)
        out[k:k + n] = np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]
        k += n
    return out, counts


class Network:
    """Embedding, one convolution, maxima per chunk, mean and maximum over chunks, logistic output."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.p = {
            "embed": rng.normal(0, 0.5, (256, DIM)).astype(f),
            "conv": rng.normal(0, (2 / (WIDTH * DIM)) ** 0.5, (WIDTH * DIM, FILTERS)).astype(f),
            "bias": np.zeros(FILTERS, f),
            "out": rng.normal(0, 0.1, 2 * FILTERS).astype(f),
            "base": np.zeros(1, f),
        }
        self.p["embed"][0] = 0  # padding

    def _windows(self, chunks: np.ndarray) -> np.ndarray:
        embedded = self.p["embed"][chunks].reshape(len(chunks), CHUNK * DIM)
        return np.lib.stride_tricks.sliding_window_view(
            embedded, WIDTH * DIM, axis=1)[:, ::STRIDE * DIM]

    def responses(self, chunks: np.ndarray, block: int = 64) -> np.ndarray:
        """Largest response of each filter in each chunk."""
        out = np.empty((len(chunks), FILTERS), np.float32)
        for a in range(0, len(chunks), block):
            windows = self._windows(chunks[a:a + block])
            n, m, w = windows.shape
            values = np.ascontiguousarray(windows).reshape(n * m, w) @ self.p["conv"]
            out[a:a + block] = values.reshape(n, m, FILTERS).max(1)
        return np.maximum(out + self.p["bias"], 0)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        chunks, counts = chunked(texts)
        top = self.responses(chunks)
        starts = np.cumsum(counts) - counts
        features = np.hstack([np.add.reduceat(top, starts) / counts[:, None], np.maximum.reduceat(top, starts)])
        return 1 / (1 + np.exp(-np.clip(features @ self.p["out"] + self.p["base"], -30, 30).astype(np.float64)))

    def fit(self, texts: list[str], labels: np.ndarray, max_chunks: int, epochs: int, rate: float) -> None:
        """Adam on the log loss, texts shuffled with the fixed seed."""
        rng = np.random.default_rng(SEED)
        parts = [chunked([t])[0] for t in texts]
        parts = [c if len(c) <= max_chunks else c[np.linspace(0, len(c) - 1, max_chunks).astype(int)] for c in parts]
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(parts))
            for a in range(0, len(order), 16):
                step += 1
                own = order[a:a + 16]
                grads = self._gradients([parts[k] for k in own], labels[own])
                pace = rate * (1 - epoch / epochs)
                for name, g in grads.items():
                    m, v = moments[name]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.p[name] -= pace * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
                self.p["embed"][0] = 0

    def _gradients(self, parts: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        chunks = np.concatenate(parts)
        counts = np.array([len(p) for p in parts])
        starts = np.cumsum(counts) - counts
        windows = np.ascontiguousarray(self._windows(chunks))
        n, m, w = windows.shape
        values = (windows.reshape(n * m, w) @ self.p["conv"]).reshape(n, m, FILTERS)
        at = values.argmax(1)
        raw = np.take_along_axis(values, at[:, None, :], 1)[:, 0] + self.p["bias"]
        top = np.maximum(raw, 0)
        mean, best = np.add.reduceat(top, starts) / counts[:, None], np.maximum.reduceat(top, starts)
        features = np.hstack([mean, best])
        score = 1 / (1 + np.exp(-np.clip(features @ self.p["out"] + self.p["base"], -30, 30)))
        error = ((score - labels) / len(labels)).astype(np.float32)
        back = error[:, None] * self.p["out"]
        owner = np.repeat(np.arange(len(counts)), counts)
        is_best = top == best[owner]
        d_top = back[owner, :FILTERS] / counts[owner, None] + back[owner, FILTERS:] * is_best
        d_raw = d_top * (raw > 0)
        chosen = windows[np.arange(n)[:, None], at]  # n, FILTERS, w
        d_conv = np.einsum("nfw,nf->wf", chosen, d_raw)
        d_window = d_raw[:, :, None] * self.p["conv"].T[None]
        where = at[:, :, None] * STRIDE + np.arange(WIDTH)
        used = chunks[np.arange(n)[:, None, None], where]
        d_embed = np.zeros_like(self.p["embed"])
        np.add.at(d_embed, used.ravel(), d_window.reshape(n, FILTERS, WIDTH, DIM).reshape(-1, DIM))
        decay = np.float32(1e-4)
        return {"embed": d_embed, "conv": d_conv + decay * self.p["conv"], "bias": d_raw.sum(0),
                "out": features.T @ error + decay * self.p["out"], "base": np.array([error.sum()], np.float32)}


def train(
    docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id",
    max_rows: int = 5000, max_chunks: int = 16, steps: int = 2000, rate: float = 0.004,
) -> bytes | None:
    """Fit on the ``max_rows`` labels with the smallest hashes of their key; None without two classes.

    The labels are chosen before they meet the documents, so what is broadcast is bounded and no text is shuffled
    but those of the sample.
    """

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["order"], r["text"]))
        labels = np.array([r["label"] for r in rows], np.float32)
        model = None
        if len(set(labels.tolist())) == 2:
            model = Network()
            epochs = min(40, max(8, steps * 16 // len(rows)))
            model.fit([r["text"] for r in rows], labels, max_chunks, epochs, rate)
            model = pickle.dumps(model.p)
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    chosen = labels.select(
        F.col(key).alias("_key"), F.col(label).cast("int").alias("label"), F.xxhash64(F.col(key)).alias("order")).where(
        F.col("_key").isNotNull() & F.col("label").isin(0, 1)).orderBy("order", "_key", "label").limit(max_rows)
    sample = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(
        F.broadcast(chosen), "_key").select("order", "text", "label")
    found = sample.repartition(1).mapInArrow(fit, "model binary").head(1)
    return found[0]["model"] if found else None


def score(docs: DataFrame, model: bytes | None, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of the documents and their score; no other column is looked at."""
    kept = [c for c in docs.columns if c != name]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + f", `{name}` double"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network()
        if model is not None:
            network.p = pickle.loads(model)
        for batch in batches:
            for part in slices(batch, text, 1 << 19):
                texts = [t or "" for t in part.column(text).to_pylist()]
                value = network.scores(texts) if model is not None else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value, pa.float64())], [*kept, name])

    return docs.select(*kept).mapInArrow(scored, schema)


def held_out(key: str, folds: int) -> Column:
    """Rows of the last part of ``crc32(key as text)``, for tests of a model only."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds
