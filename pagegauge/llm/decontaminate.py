"""Benchmark passages in documents, with edits: pigeonhole pieces, then Myers' bit-parallel distance.

Texts are compared in lower case with every run of ASCII white space and
punctuation as one blank, as UTF-8 bytes.  A test item of ``n`` bytes may be
met with ``floor(n * error_rate)`` edits.  It is cut into one piece more than
that budget, so any occurrence within the budget holds one piece unchanged at
about its place.  An automaton of all pieces reads each document once; its
hits, joined along diagonals, give windows, and the distance of the item to
the best substring of each window is computed with Myers' method on integers
of as many bits as the item has bytes.

Items shorter than ``min_bytes`` would also occur inside other words; they are
searched with a blank at either end, which stands for the end of a word (or of
the document) and counts in the distance.  Their budget is that of the item
alone, so below ``1 / error_rate`` bytes only unchanged ones match.  The items are read in blocks of bounded size:
each block is one pass over the documents, and only a block is broadcast.

Defined results: one row per document and item with the smallest distance; a
null or empty text or item matches nothing; equal items match each by its own
id, repeated rows each give rows; a null id stays null; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.llm.batches import slices, texts_of
from pagegauge.llm.store import fresh

ERROR_RATE, MIN_BYTES = 0.08, 40
#: Bytes of items in one block: what a pass over the documents broadcasts.
BLOCK_BYTES = 1 << 20

_LOWER = bytes(range(65, 91))
_FOLD = bytes(
    32 if b < 33 or chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" or b == 127 else b + 32 if b in _LOWER else b
    for b in range(256))


def folded(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD).split())


def pieces_of(item: bytes, budget: int) -> list[tuple[int, bytes]]:
    """The item cut into ``budget + 1`` pieces of nearly equal size, with their places."""
    cuts = [len(item) * k // (budget + 1) for k in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """Myers' method for one item: the smallest distance to any substring of a text."""

    def __init__(self, item: bytes):
        self.size = len(item)
        self.masks: dict[int, int] = defaultdict(int)
        for k, byte in enumerate(item):
            self.masks[byte] |= 1 << k

    def best(self, text: bytes, budget: int) -> tuple[int, int] | None:
        """Distance and end of the best substring within the budget, the first of equals."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        up, down, distance, found = full, 0, self.size, None
        get = self.masks.get
        for k, byte in enumerate(text):
            eq = get(byte, 0)
            x = eq | down
            d0 = ((((x & up) + up) ^ up) | x) & full
            hp = (down | ~(d0 | up)) & full
            hn = up & d0
            if hp & top:
                distance += 1
            elif hn & top:
                distance -= 1
            hp <<= 1
            up = ((hn << 1) | ~(d0 | hp)) & full
            down = hp & d0
            if distance <= budget:
                found = (distance, k + 1)
                budget = distance - 1
                if budget < 0:
                    break
        return found


class Finder:
    """All items of a block, ready to search documents."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float, min_bytes: int):
        self.items = []
        places: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            item = folded(text)
            if not item:
                continue
            budget, short = int(len(item) * error_rate), len(item) < min_bytes
            own = b" " + item + b" " if short else item
            k = len(self.items)
            self.items.append((item_id, len(item), own, short, budget, Pattern(own), np.bincount(
                np.frombuffer(own, np.uint8), minlength=256)))
            for at, piece in pieces_of(own, budget):
                places[piece].append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in places.items():
            self.automaton.add_word(piece.decode("latin-1"), (len(piece), tuple(owners)))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def matches(self, text: str) -> Iterator[tuple[int | None, int, int]]:
        """(item id, distance, end in the folded text) for each item found."""
        data = folded(text)
        if self.empty or not data:
            return
        padded = b" " + data + b" "
        hits: dict[int, list[int]] = {}
        for end, (size, owners) in self.automaton.iter(padded.decode("latin-1")):
            for k, at in owners:
                hits.setdefault(k, []).append(end + 1 - size - at)
        for k, starts in hits.items():
            item_id, _, item, short, budget, pattern, histogram = self.items[k]
            # Only short items see the blanks around the document; places count from its first byte.
            whole, shift = (padded, 1) if short else (data, 0)
            best = None
            for a, b in _windows([s + shift - 1 for s in starts], len(item), budget, len(whole)):
                window = whole[a:b]
                # Bytes of the item that the window lacks cost an edit each.
                missing = histogram - np.bincount(np.frombuffer(window, np.uint8), minlength=256)
                if missing[missing > 0].sum() > budget:
                    continue
                found = pattern.best(window, budget if best is None else best[0] - 1)
                if found:
                    best = (found[0], min(len(data), a + found[1] - shift))
                    if not best[0]:
                        break
            if best:
                yield item_id, *best


def _windows(starts: list[int], size: int, budget: int, total: int) -> Iterator[tuple[int, int]]:
    """Ranges of the text that hold every occurrence with a hit, overlapping ones joined up to a few items."""
    starts = sorted(set(starts))
    first = last = starts[0]
    for s in [*starts[1:], None]:
        if s is not None and s - last <= 2 * budget + 1 and s - first <= 4 * size:
            last = s
            continue
        yield max(0, first - budget), min(total, last + size + budget)
        first = last = s


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, str]]]:
    """The test items, in blocks of about ``block_bytes``; the number of blocks follows their total size."""
    items = benchmark.where("text is not null").select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // block_bytes + 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        yield [(r.item_id, r.text) for r in items.where(block == k).collect()]


def leaks(
    docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_bytes: int = MIN_BYTES,
) -> DataFrame:
    """(doc_id, item_id, distance, item_bytes, end): every document that holds a test item within its budget."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession

    def search(items: list[tuple[int | None, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(items)

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(shared.value, error_rate, min_bytes)
            sizes = {item_id: size for item_id, size, *_ in finder.items}
            for batch in batches:
                rows = []
                for part in slices(batch, "text"):
                    for doc, text in zip(part.column("doc_id").to_pylist(), texts_of(part, "text"), strict=True):
                        rows += [(doc, i, d, sizes[i], e) for i, d, e in finder.matches(text)]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(
                        columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()], strict=True)],
                    ["doc_id", "item_id", "distance", "item_bytes", "end"])

        return texts.mapInArrow(found, "doc_id long, item_id long, distance int, item_bytes int, end long")

    return reduce(DataFrame.union, map(search, item_blocks(benchmark)))


def clean(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_bytes: int = MIN_BYTES,
          nameless: bool = False) -> DataFrame:
    """The documents without any test item, with all their columns, each row judged by its own text.

    Rows without an id stay, unless ``nameless`` has them searched as well.
    """
    text = fresh(docs, "_text")
    spark, names, schema = docs.sparkSession, docs.columns, docs.schema
    searched = F.lit(True) if nameless else F.col("doc_id").isNotNull()

    def without(rows: DataFrame, items: list[tuple[int | None, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(items)

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(shared.value, error_rate, min_bytes)
            for batch in batches:
                for part in slices(batch, text):
                    free = [next(finder.matches(t), None) is None for t in texts_of(part, text)]
                    yield part.filter(pa.array(free, pa.bool_())).select(names)

        return rows.withColumn(text, F.when(searched, F.col("text").cast("string"))).mapInArrow(kept, schema)

    return reduce(without, item_blocks(benchmark), docs)
