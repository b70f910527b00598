"""Token ids of whole texts with the tokenizers library, one encoding per distinct word.

Both vocabularies split a text at white space before they merge, so the ids of
a text are the ids of its blank-separated units in order.  A unit is encoded
once and then looked up (``unitcache``); a text for which that is not certain (a blank beside
other white space, control separators, strings of special tokens) goes to the
library whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from pagegauge.llm.unitcache import GENERATION, Learnt, UnitIds

BYTE_LEVEL, WORD_LEVEL = "byte_bpe_50k.json", "word_bpe_49k.json"

_MARKS = ".,:;!?*%&$#()|"
_ODD_FOR_WORDS = re.compile("[\x1c-\x1f]")


class Encoder:
    """``ids(texts)`` yields one array of unsigned 32-bit ids per text."""

    def __init__(self, file: str, generation: int = GENERATION):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        self.byte_level = self.tokenizer.normalizer is None
        self.size = self.tokenizer.get_vocab_size()
        words = self.tokenizer.get_vocab()
        #: Byte level: tokens that hold a leading blank, so start a unit.  Else: tokens that end a run of one kind.
        self.edge = np.zeros(self.size, bool)
        self.edge[[k for word, k in words.items()
                   if (word.startswith("\u0120") if self.byte_level else word.endswith("</w>"))]] = True
        self.units = UnitIds(self._learn, generation)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32)
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, text: str) -> list[str] | None:
        """The text cut at blanks (byte level) or at any white space; None if cutting is not safe."""
        if self.byte_level:
            units = text.split(" ")
            return units if "" not in units and units == list(map(str.strip, units)) else None
        if _ODD_FOR_WORDS.search(text):
            return None
        # The vocabulary has no capitals; only the sigma's lower case depends on its neighbours.
        return (text if "\u03a3" in text else text.lower()).split()

    def _joined(self, units: list[str], runs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many units with a leading blank, encoded as few long texts, and the number of ids of each.

        ``runs``: of how many runs of one kind of character each unit consists, if that is known.
        """
        all_ids, all_counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(units), 1000):
            block = units[k:k + 1000]
            text = " " + " ".join(block)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            edges = np.flatnonzero(self.edge[ids])
            if self.byte_level:
                counts = np.diff(edges, append=len(ids))
            elif runs is not None and len(edges) == (last := np.cumsum(runs[k:k + 1000]))[-1]:
                counts = np.diff(edges[last - 1], prepend=-1)
            else:
                encoded = self.tokenizer.encode(text, add_special_tokens=False)
                at = np.fromiter((o[0] for o in encoded.offsets), np.int64, len(ids))
                ends = np.cumsum(np.fromiter(map(len, block), np.int64) + 1)
                counts = np.bincount(np.searchsorted(ends, at, side="right"), minlength=len(block))
            all_ids.append(ids)
            all_counts.append(counts)
        return np.concatenate(all_ids), np.concatenate(all_counts)

    def _learn(self, units: list[str]) -> Learnt:
        if self.byte_level:
            flat, counts = self._joined(units)
        else:
            # Letters make one run, trailing marks a second; other forms are located by their offsets.
            bare = [u.rstrip(_MARKS) for u in units]
            plain = np.fromiter(map(str.isalpha, bare), bool, len(bare))
            runs = 1 + (np.fromiter(map(len, units), np.int64) != np.fromiter(map(len, bare), np.int64))
            odd = [u for u, p in zip(units, plain, strict=True) if not p]
            units = [u for u, p in zip(units, plain, strict=True) if p]
            flat, counts = map(np.concatenate, zip(self._joined(units, runs[plain]), self._joined(odd), strict=True))
            units += odd
        return units, flat, counts

    def ids(self, texts: list[str | None], chars: int = 1 << 20) -> Iterator[np.ndarray]:
        """One array per text, in order; a null text counts as empty."""
        block: list[str] = []
        size = 0
        for text in texts:
            block.append(text or "")
            size += len(block[-1])
            if size >= chars:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        units: list[str] = []
        bounds, cut, whole, first = [0], [], [], []
        for k, text in enumerate(texts):
            if not text:
                continue
            parts = self._units(text)
            if parts is None:
                whole.append(k)
                continue
            if self.byte_level:
                first.append(parts[0])  # has no leading blank
                units += parts[1:]
            else:
                units += parts
            cut.append(k)
            bounds.append(len(units))
        if cut:
            flat, counts = self.units.of(units)
            ends = np.concatenate([[0], np.cumsum(counts)])[bounds]
            for k, a, b in zip(cut, ends, ends[1:], strict=False):
                out[k] = flat[a:b]
        for k, ids in zip(cut, self._whole(first), strict=False):
            out[k] = np.concatenate([ids, out[k]])
        for k, ids in zip(whole, self._whole([texts[k] for k in whole]), strict=True):
            out[k] = ids
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """The worker's encoder of a vocabulary file, loaded once."""
    if file not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[file] = Encoder(file)
    return _ENCODERS[file]
