"""Byte-pair encoding and decoding with a pair occurrence index.

``encode`` cuts texts at white space into units and encodes each distinct unit
of a worker once.  Units not seen yet are taken together: the vocabulary's own
normalizer and splitter make words of them, all distinct words are laid out as
one sequence of symbols, and an index maps every adjacent pair that has a merge
rule to all its positions.  Ranks are taken in ascending order from a heap; all
positions of the lowest active rank are merged, and only the lists of the pairs
beside them change.  A word thus sees its merges in the same order as when it
is encoded alone, since words never touch and a rule only uses symbols that
earlier rules make (a vocabulary for which that is not so gets a ValueError).  ``decode`` maps ids back.

Both are one pass over their rows without a shuffle; memory follows a slice of
texts and two generations of units (``unitcache``), not the partition.

Vocabularies whose words hold no white space and whose file has no decoder are
handled (others get a ValueError).  Cutting at white space beforehand is exact
for them: no composition, case mapping or pattern reaches across it.

Defined results: a null or empty text, or one of white space only, has no ids;
no ids decode to an empty text; special tokens in a text keep their own id
unless ``special`` is false; ids that the vocabulary lacks are left out of a
decoded text; rows stay separate also where ids or texts repeat or are null;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.llm.batches import slices, texts_of
from pagegauge.llm.unitcache import Learnt, UnitIds

#: White space by Unicode; str.split() also cuts at the four separators U+001C to U+001F.
_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_SEPARATORS = re.compile("[\\x1c-\\x1f]")
#: Letters that normalize to their own lower case, then marks: words that need no library.  U+0130 is not among them.
_SIMPLE = re.compile("([A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u012f\\u0131-\\u024f]+)([!-&(-/:-@\\[-`{-~]*)")
#: Units, and words, of a generation of a worker's memory.
UNITS = 200_000
#: Units whose words are split by the library in one call.
_JOINED = 2000


class PairIndex:
    """Merges all words given at once; ``rules`` are pairs of symbols in rank order, with what they become."""

    def __init__(self, rules: list[tuple[int, int, int]], symbols: int):
        self.rules, self.base = rules, symbols + 1  # the last symbol parts words
        made = {new: k for k, (_, _, new) in enumerate(rules)}
        if any(made.get(s, -1) >= k for k, (a, b, _) in enumerate(rules) for s in (a, b)):
            raise ValueError("a rule uses a symbol that a later rule makes")
        self.rank = {a * self.base + b: k for k, (a, b, _) in enumerate(rules)}
        keys = np.fromiter(self.rank, np.int64, len(self.rank))
        self.order = np.argsort(keys)
        self.keys = np.append(keys[self.order], np.iinfo(np.int64).max)

    def merged(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols of words, each followed by ``base - 1``, after all merges; -1 where a symbol was taken up."""
        base, rules, rank = self.base, self.rules, self.rank.get
        pairs = symbols[:-1] * base + symbols[1:]
        found = np.searchsorted(self.keys, pairs)
        active = np.flatnonzero(self.keys[found] == pairs)
        ranks = self.order[found[active]]
        order = np.argsort(ranks, kind="stable")
        active, ranks = active[order], ranks[order]
        starts = np.flatnonzero(np.diff(ranks, prepend=-1))
        at = dict(zip(ranks[starts].tolist(), (x.tolist() for x in np.split(active, starts[1:])), strict=True)) \
            if len(starts) else {}
        heap = list(at)  # ascending, so a heap
        symbol = symbols.tolist()
        after = list(range(1, len(symbol) + 1))
        before = list(range(-1, len(symbol) - 1))
        before[0] = len(symbol) - 1  # what parts words stands also before the first
        while heap:
            lowest = heapq.heappop(heap)
            a, b, new = rules[lowest]
            places = at.pop(lowest)
            if len(places) > 1:
                places.sort()
            for i in places:
                if symbol[i] != a:
                    continue
                j = after[i]
                if symbol[j] != b:
                    continue
                symbol[i], symbol[j] = new, -1
                k, h = after[j], before[i]
                after[i], before[k] = k, i
                if (r := rank(symbol[h] * base + new)) is not None:
                    if (places_of := at.get(r)) is not None:
                        places_of.append(h)
                    else:
                        at[r] = [h]
                        heapq.heappush(heap, r)
                if (r := rank(new * base + symbol[k])) is not None:
                    if (places_of := at.get(r)) is not None:
                        places_of.append(i)
                    else:
                        at[r] = [i]
                        heapq.heappush(heap, r)
        return np.array(symbol, np.int64)


class Decoder:
    """Texts of ids; all that decoding needs of a vocabulary file."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            self._read(json.load(f))

    def _read(self, spec: dict) -> None:
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        if spec["decoder"] is not None or not self.end or spec["normalizer"] is None or model["type"] != "BPE":
            raise ValueError("only vocabularies of words with an end mark and without a decoder are handled")
        words = model["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = np.full(max(words.values()) + 1, None, object)
        for word, k in words.items():
            self.strings[k] = word

    def text(self, ids: np.ndarray) -> str:
        known = self.strings[ids[(ids >= 0) & (ids < len(self.strings))]]
        return " ".join(x for x in known.tolist() if x is not None)


class Coder(Decoder):
    """Ids of texts too."""

    def __init__(self, file: str, special: bool = True, generation: int = UNITS):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(file)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self._read(spec)
        vocabulary, end = spec["model"]["vocab"], self.end
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]} if special else {}
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        # A character of the vocabulary stands for one byte: those printable in Latin-1 for themselves, the rest in
        # order from U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [k for k in range(256) if k not in plain]
        character = {k: chr(k) for k in plain} | {k: chr(256 + n) for n, k in enumerate(rest)}
        self.byte_of = {ord(c): k for k, c in character.items()}
        self.inner = np.array([vocabulary[character[k]] for k in range(256)])
        self.last = np.array([vocabulary[character[k] + end] for k in range(256)])
        rules = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.pairs = PairIndex([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in rules], len(self.strings))
        self.words, self.units = UnitIds(self._merge, generation), UnitIds(self._learn, generation)

    def _split(self, units: list[str]) -> tuple[list[bytes], np.ndarray]:
        """The words of units in order, and the number of words of each unit, by the vocabulary's own rules."""
        words: list[bytes] = []
        counts = [np.zeros(0, np.int64)]
        for k in range(0, len(units), _JOINED):
            text = self.normalizer.normalize_str(" ".join(units[k:k + _JOINED]))
            lengths = np.fromiter(map(len, text.split(" ")), np.int64)
            found = self.splitter.pre_tokenize_str(text)
            words += [w.translate(self.byte_of).encode("latin-1") for w, _ in found]
            first = np.fromiter((o[0] for _, o in found), np.int64, len(found))
            unit = np.searchsorted(np.cumsum(lengths + 1), first, side="right")
            counts.append(np.bincount(unit, minlength=len(lengths)))
        return words, np.concatenate(counts)

    def _learn(self, units: list[str]) -> Learnt:
        words: list[bytes] = []
        simple, odd, counts = [], [], []
        for unit in units:
            if found := _SIMPLE.fullmatch(unit):
                bare, marks = found.groups()
                words.append(bare.lower().encode())
                if marks:
                    words.append(marks.encode())
                    counts.append(2)
                else:
                    counts.append(1)
                simple.append(unit)
            else:
                odd.append(unit)
        more, odd_counts = self._split(odd) if odd else ([], np.zeros(0, np.int64))
        flat, per_word = self.words.of(words + more)
        own = np.concatenate([np.array(counts, np.int64), odd_counts])
        before = np.concatenate([[0], np.cumsum(per_word)])[np.concatenate([[0], np.cumsum(own)])]
        return simple + odd, flat, np.diff(before)

    def _merge(self, words: list[bytes]) -> Learnt:
        # Every word with a place for what parts it from the next one; no text holds the byte 255.
        points = np.frombuffer(b"\xff".join(words) + b"\xff", np.uint8)
        ends = np.flatnonzero(points == 255)
        symbols = self.inner[points]
        symbols[ends - 1] = self.last[points[ends - 1]]
        symbols[ends] = self.pairs.base - 1
        merged = self.pairs.merged(symbols)
        live = merged >= 0
        live[ends] = False
        counts = np.add.reduceat(live, np.concatenate([[0], ends[:-1] + 1]), dtype=np.int64)
        return words, merged[live].astype(np.uint32), counts

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each."""
        units: list[str] = []
        bounds = [0]
        marks: list[tuple[int, int, int]] = []  # a special token: unit before which it stands, text, id
        for k, text in enumerate(texts):
            parts = self.marks.split(text) if self.marks and "<" in text else [text]
            for p, part in enumerate(parts):
                if p % 2:
                    marks.append((len(units), k, self.special[part]))
                elif _SEPARATORS.search(part):
                    units += filter(None, _SPACE.split(part))
                else:
                    units += part.split()
            bounds.append(len(units))
        flat, counts = self.units.of(units)
        ends = np.concatenate([[0], np.cumsum(counts)])
        per_text = np.diff(ends[bounds])
        if marks:
            at, owner, ids = map(np.array, zip(*marks, strict=True))
            flat = np.insert(flat, ends[at], ids)
            np.add.at(per_text, owner, 1)
        return flat, per_text


@lru_cache(1)
def coder(file: str, special: bool) -> Coder:
    """The worker's coder of a vocabulary file, built once."""
    return Coder(file, special)


@lru_cache(1)
def decoder(file: str) -> Decoder:
    return Decoder(file)


def encode(docs: DataFrame, vocabulary: str, special: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): one row per row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary, special)
        for batch in batches:
            for part in slices(batch, "text"):
                flat, counts = own.ids(texts_of(part, "text"))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))],
                    ["doc_id", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids, text) of rows (doc_id, ids)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(vocabulary)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                lists = part.column("ids")
                flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                ends = np.cumsum(pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
                texts = [own.text(x) for x in np.split(flat, ends[:-1])] if len(ends) else []
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", F.col("ids").cast("array<int>")).mapInArrow(
        run, f"doc_id {kind}, ids array<int>, text string")
