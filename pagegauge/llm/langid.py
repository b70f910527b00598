"""Language by cross-parsing: in how few longest matches a text is covered by each language's sample.

Training: of each label, the ``sample_bytes`` of labelled text that come first
in an order of hashes (whole texts, the last one cut to the bound) are joined,
one language per task, and made into a suffix automaton, which accepts exactly
their substrings.  Prediction: a text is lower-cased and cut into blocks of
bytes; each block is parsed greedily into phrases, each as long as the
automaton goes on.  Phrases per byte estimate the cross entropy against the
language; they are normalised by what the same parse costs on held-back text of
that language, and the language with the fewest wins.

The automaton is a table of states by byte classes, and all blocks of a batch
advance together, one byte of every block at a time, so the work is a few
array operations per byte whatever the number of languages.

Defined results: ``und`` with score 0 for a null text, one without a letter,
or without any learned language; equal costs go to the alphabetically first
label; an empty table gives no rows; repeated rows get equal results.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagegauge.llm.batches import slices
from pagegauge.llm.store import settled

#: Bytes of text that make a language's automaton, and bytes that normalise its costs.
SAMPLE_BYTES, HELD_BACK_BYTES = 1 << 16, 1 << 14
BLOCK = 512
#: Blocks that advance together.
LANES = 2048
#: Sampled ids that may be broadcast; more (hundreds of languages) are joined by an exchange.
BROADCAST_ROWS = 100_000
#: Spreads the score: how many times costs differ in the exponent, per phrase of the best parse.
SHARPNESS = 30.0


class Automaton:
    """Suffix automaton of a byte string as a table ``next[state * classes + class]``; 0 leads nowhere."""

    def __init__(self, data: bytes, classes: np.ndarray, n_classes: int):
        self.table = self._build(classes[np.frombuffer(data, np.uint8)].tolist(), n_classes)

    @staticmethod
    def _build(symbols: list[int], n_classes: int) -> np.ndarray:
        # State 0 is the dead end, state 1 the start.
        moves: list[dict[int, int]] = [{}, {}]
        link, length = [0, 0], [0, 0]
        last = 1
        for c in symbols:
            cur = len(moves)
            moves.append({})
            length.append(length[last] + 1)
            link.append(1)
            p = last
            while p and c not in moves[p]:
                moves[p][c] = cur
                p = link[p]
            if p:
                q = moves[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(moves)
                    moves.append(dict(moves[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[cur] = clone
                    while p and moves[p].get(c) == q:
                        moves[p][c] = clone
                        p = link[p]
            last = cur
        table = np.zeros((len(moves), n_classes), np.int32)
        for state, out in enumerate(moves):
            for c, to in out.items():
                table[state, c] = to
        return table.ravel()


_NO_LETTER = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def folded(text: str | None) -> bytes:
    """Lower case, every run of ASCII characters other than letters as one blank."""
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_NO_LETTER).split())


def blocks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks as rows of bytes (padded with 0), their lengths and the text each belongs to."""
    counts = [max(1, -(-len(t) // BLOCK)) for t in texts]
    out = np.zeros((sum(counts), BLOCK), np.uint8)
    sizes, owner, k = [], np.repeat(np.arange(len(texts)), counts), 0
    for t in texts:
        data = np.frombuffer(t, np.uint8)
        for a in range(0, max(1, len(data)), BLOCK):
            part = data[a:a + BLOCK]
            out[k, :len(part)] = part
            sizes.append(len(part))
            k += 1
    return out, np.array(sizes, np.int64), owner


class Model:
    """Automata of all languages in one table, with the cost that is normal for each."""

    def __init__(self, samples: list[tuple[str, bytes, bytes]]):
        self.labels = [label for label, _, _ in sorted(samples)]
        used = np.unique(np.frombuffer(b"".join(s for _, s, _ in samples), np.uint8))
        self.classes = np.zeros(256, np.int32)  # class 0: a byte of no sample
        self.classes[used] = np.arange(1, len(used) + 1)
        self.n_classes = len(used) + 1
        tables = [Automaton(s, self.classes, self.n_classes).table for _, s, _ in sorted(samples)]
        starts = np.cumsum([0, *[len(t) for t in tables]])[:-1]
        # Entries hold the place of the next state's row, so a step is one look-up; each dead end is 0.
        self.table = np.concatenate([
            np.where(t > 0, t * self.n_classes + first, 0) for t, first in zip(tables, starts, strict=True)
        ]).astype(np.int32) if tables else np.zeros(0, np.int32)
        self.start = (starts + self.n_classes).astype(np.int32)
        self.normal = np.ones(len(tables))
        for k, (_, sample, held_back) in enumerate(sorted(samples)):
            self.normal[k] = max(self._phrases([held_back or sample[-HELD_BACK_BYTES:]])[0, k], 1e-9)

    def _phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases per byte of each text (rows) in each language (columns)."""
        blocks, sizes, owner = blocks_of(texts)
        out = np.zeros((len(texts), len(self.labels)))
        order = np.argsort(-sizes, kind="stable")
        for a in range(0, len(order), LANES):
            lanes = order[a:a + LANES]
            np.add.at(out, owner[lanes], self._parse(self.classes[blocks[lanes]], sizes[lanes]))
        return out / np.maximum(np.bincount(owner, sizes, len(texts)), 1)[:, None]

    def _parse(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of each block; the blocks come longest first."""
        start = self.start[None, :]
        state = np.repeat(start, len(symbols), 0)
        count = np.ones(state.shape, np.int32)
        alive = np.searchsorted(-sizes, -np.arange(int(sizes[0])) - 1, side="right") if len(sizes) else []
        columns = np.ascontiguousarray(symbols.T)
        for k, n in enumerate(alive):
            c = columns[k, :n, None]
            to = self.table[state[:n] + c]
            ended = to == 0
            # The byte at which a phrase ended begins the next one; one that the sample lacks is a phrase itself.
            again = self.table[start + c]
            lacking = again == 0
            count[:n] += ended
            count[:n] += lacking & (state[:n] != start)
            to = np.where(ended, np.where(lacking, start, again), to)
            state[:n] = to
        return count

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        labels, scores = ["und"] * len(texts), [0.0] * len(texts)
        own = [k for k, t in enumerate(texts) if t and self.labels and any(map(str.isalpha, t))]
        if own:
            cost = self._phrases([folded(texts[k]) for k in own]) / self.normal
            best = cost.argmin(1)
            low = cost[np.arange(len(own)), best]
            weight = np.exp(-SHARPNESS * (cost / np.maximum(low, 1e-12)[:, None] - 1))
            share = 1 / weight.sum(1)
            for k, b, s in zip(own, best.tolist(), share.tolist(), strict=True):
                labels[k], scores[k] = self.labels[b], s
        return labels, scores


def samples(labelled: DataFrame, size: int = SAMPLE_BYTES, held_back: int = HELD_BACK_BYTES) -> DataFrame:
    """(lang, sample, held_back): the first texts of each language in an order of hashes, up to the bounds.

    Which rows those are is decided on ids alone: of each language at most one row per 96 bytes of the bounds, so
    one task can join their texts (and few enough that each task drops the others before the exchange).
    """
    rows = labelled.where("lang is not null and text is not null").select(
        F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("order"), "text").where(
        F.length("text") >= 1)
    most = (size + held_back) // 96
    first = Window.partitionBy("lang").orderBy("order")
    ids = settled(rows.select("lang", "order").withColumn("_k", F.row_number().over(first)).where(
        F.col("_k") <= most).select("lang", "order").distinct(), "lang-sample")
    few = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    chosen = rows.join(few, ["lang", "order"]).select(
        "lang", "order", F.substring("text", 1, size + held_back).alias("text"))

    def join(key, table):
        out, total = [], 0
        for text in table.sort_by([("order", "ascending"), ("text", "ascending")]).column("text").to_pylist():
            out.append(folded(text))
            total += len(out[-1]) + 1
            if total >= size + held_back:
                break
        data = b" ".join(out)
        cut = min(held_back, len(data) // 5)
        return pa.table({"lang": pa.array([key[0].as_py()]), "sample": pa.array([data[cut:cut + size]], pa.binary()),
                         "held_back": pa.array([data[:cut]], pa.binary())})

    return chosen.groupBy("lang").applyInArrow(join, "lang string, sample binary, held_back binary")


def predict(docs: DataFrame, found: list[tuple[str, bytes, bytes]], text: str = "text") -> DataFrame:
    """All columns of the documents with ``lang_pred`` and ``score``; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(found)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for batch in batches:
            for part in slices(batch, text):
                labels, scores = model.predict(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                    [*kept, "lang_pred", "score"])

    return docs.select(*kept).mapInArrow(predicted, f"{schema}, `lang_pred` string, `score` double")


_MODELS: dict[int, Model] = {}


def _model(found: list[tuple[str, bytes, bytes]]) -> Model:
    """The worker's model, built once for the same samples."""
    key = hash(pickle.dumps(found))
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(found)
    return _MODELS[key]
