"""Vector bin packing of token sequences.

A bin (training sequence) has three simultaneous limits: tokens, segments and
loss-bearing tokens.  The dot-product heuristic fills one bin at a time: of the
waiting examples that fit, it takes the one whose demand vector has the
largest product with the room left, both in parts of the limits.  When nothing
fits (or one segment is left), the longest example is cut to the room, so bins
end full unless the segment limit closes them.

Packing needs no shuffle: each task packs the rows of its own partition over a
window of bounded size and leaves one partly filled bin, which is cut into
powers of two, which need no padding.  A repeated task sees the same rows and
makes the same bins.

Defined results: a null or empty text is one end token; equal texts and
repeated rows are packed each on their own; a text longer than a bin becomes
several pieces; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.llm.batches import slices, texts_of
from pagegauge.llm.tokens import encoder

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, loss_tokens long, ids binary")


@dataclass(frozen=True)
class Limits:
    """Room of a bin; ``waiting_tokens`` bounds the examples that wait in a task."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048
    waiting_tokens: int = 1 << 19


@dataclass
class Packer:
    """Fills bins from examples ``(key, tokens, loss_from)``: tokens from ``loss_from`` on bear loss.

    ``place`` and ``finish`` yield closed bins, each a list of pieces ``(key, start, length)``.
    """

    limits: Limits = field(default_factory=Limits)

    def __post_init__(self):
        self.keys: list = []
        self.start = np.zeros(0, np.int64)
        self.end = np.zeros(0, np.int64)
        self.loss_from = np.zeros(0, np.int64)
        self.new: list[tuple[int, int]] = []
        self.waiting = 0
        self._open()

    def _open(self) -> None:
        self.bin: list[tuple[object, int, int]] = []
        self.room = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], np.int64)

    def place(self, key, tokens: int, loss_from: int = 0) -> Iterator[list]:
        self.keys.append(key)
        self.new.append((tokens, loss_from))
        self.waiting += tokens
        if self.waiting >= self.limits.waiting_tokens:
            yield from self._pack(self.limits.waiting_tokens // 2)

    def finish(self) -> Iterator[list]:
        yield from self._pack(0)
        if self.bin:
            yield from self._powers()
        self._open()

    def _admit(self) -> None:
        if self.new:
            tokens, loss_from = np.array(self.new, np.int64).T
            self.start = np.concatenate([self.start, np.zeros(len(tokens), np.int64)])
            self.end = np.concatenate([self.end, tokens])
            self.loss_from = np.concatenate([self.loss_from, loss_from])
            self.new = []

    def _pack(self, until: int) -> Iterator[list]:
        """Fill bins until fewer than ``until`` tokens wait."""
        self._admit()
        scale = 1.0 / np.array([self.limits.tokens, self.limits.segments, self.limits.loss])
        tokens = self.end - self.start
        loss = np.minimum(tokens, np.maximum(0, self.end - np.maximum(self.start, self.loss_from)))
        while self.waiting > until:
            fits = (tokens > 0) & (tokens <= self.room[0]) & (loss <= self.room[2])
            weight = self.room * scale * scale
            gain = np.where(fits, tokens * weight[0] + loss * weight[2] + weight[1], -1.0)
            k = int(gain.argmax())
            last = self.room[1] == 1
            if gain[k] < 0 or last and tokens[k] < self.room[0]:
                k = int(tokens.argmax())  # nothing fits or fills the last segment: cut the longest to the room
            a = int(self.start[k])
            free = max(0, int(self.loss_from[k]) - a)
            n = int(min(tokens[k], self.room[0], free + self.room[2]))
            if n:
                bearing = max(0, n - free)
                self.bin.append((self.keys[k], a, n))
                self.room -= (n, 1, bearing)
                self.start[k] += n
                tokens[k] -= n
                loss[k] -= bearing
                self.waiting -= n
            if n == 0 or not self.room[0] or not self.room[1]:
                yield self.bin
                self._open()
        left = np.flatnonzero(tokens > 0)
        self.keys = [self.keys[k] for k in left]
        self.start, self.end, self.loss_from = self.start[left], self.end[left], self.loss_from[left]

    def _powers(self) -> Iterator[list]:
        """Cut the last bin into bins whose sizes are powers of two."""
        size = sum(n for _, _, n in self.bin)
        pieces = self.bin[::-1]
        while size:
            room = 1 << (size.bit_length() - 1)
            size -= room
            out = []
            while room:
                key, a, n = pieces.pop()
                take = min(n, room)
                out.append((key, a, take))
                room -= take
                if take < n:
                    pieces.append((key, a + take, n - take))
            yield out


def pack_documents(
    docs: DataFrame, vocabulary: str, end_id: int = 1, limits: Limits | None = None, text: str = "text",
    key: str = "doc_id", with_ids: bool = True, loss_start: str | None = None,
) -> DataFrame:
    """One row per piece; its ids are the little-endian unsigned 32-bit integers in ``ids``.

    ``loss_start`` names a column with the number of ids (of a prompt) before the first that bears loss; without it,
    or where it is null or negative, every id of the example bears loss.
    """
    limits = limits or Limits()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(vocabulary), Packer(limits)
        task = TaskContext.get()
        first = (task.partitionId() if task else 0) << 40
        held: dict[int, list] = {}  # number of a document in this task: its id, ids, tokens not yet placed, loss start
        made = [0, 0]
        out: list[tuple] = []

        def close(bins):
            for pieces in bins:
                at = 0
                for number, start, n in pieces:
                    entry = held[number]
                    ids = entry[1][start:start + n].astype("<u4").tobytes()
                    bearing = max(0, start + n - max(start, entry[3]))
                    out.append((entry[0], start, n, zlib.crc32(ids), len(entry[1]), first + made[0], at, bearing,
                                ids if with_ids else None))
                    at += n
                    entry[2] -= n
                    if not entry[2]:
                        del held[number]
                made[0] += 1

        def flush():
            columns = list(zip(*out, strict=True)) if out else [[]] * 9
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 8 + [pa.binary()], strict=True)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", "ids"])

        for batch in batches:
            for part in slices(batch, "text"):
                ids_of = enc.ids(texts_of(part, "text"))
                starts = part.column("loss_start").to_pylist()
                for doc, ids, start in zip(part.column("doc_id").to_pylist(), ids_of, starts, strict=True):
                    ids = np.append(ids, np.uint32(end_id))
                    start = min(max(start, 0), len(ids))
                    held[made[1]] = [doc, ids, len(ids), start]
                    close(packer.place(made[1], len(ids), start))
                    made[1] += 1
                    if len(out) >= 2000:
                        yield flush()
        close(packer.finish())
        yield flush()

    start = F.lit(0) if loss_start is None else F.coalesce(F.col(loss_start), F.lit(0))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                       start.cast("long").alias("loss_start"))
    return rows.mapInArrow(packed, SCHEMA)
