"""Byte-pair coding by the pair index against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagegauge.llm import bpe, queries
from pagegauge.llm.tokens import BYTE_LEVEL, WORD_LEVEL
from pagegauge.llm.unitcache import UnitIds
from tests.llm.test_texts import ODD, docs_of

FILE = public_tokenizers.path(WORD_LEVEL)
MORE = ["<|endoftext|><|endoftext|> x<|startoftext|>", "a\x00b \xff", "aaaaaaaaaaa hahahahahahaha", "é ́x",
        "Å K ά", "ẞ İı", "  x  ", "a\x1fb\x1c", "", "x" * 5000, "'s don't''t'll"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def made(seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("ab É'1.,\n\t ßΣ日<|>") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    wide = ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x300, 0x36F), rng.randint(0x1E00, 0x30FF), 32]))
                    for _ in range(40)) for _ in range(500)]
    letters = ["x%sy %s" % (chr(k), chr(k)) for k in range(1, 0x250)]  # every character of the short way
    return [*ODD, *MORE, *plain, *wide, *letters]


@pytest.mark.parametrize("generation", [50, bpe.UNITS])
def test_ids_and_texts_equal_library(library, generation):
    texts = made()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    coder = bpe.Coder(FILE, generation=generation)
    got = []
    for k in range(0, len(texts), 37):
        flat, counts = coder.ids(texts[k:k + 37])
        got += [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
    assert got == want
    assert [coder.text(np.array(i, np.int64)) for i in want] == [library.decode(i, skip_special_tokens=False) for i in want]
    library.encode_special_tokens = True
    plain = bpe.Coder(FILE, special=False)
    flat, counts = plain.ids(MORE)
    assert flat.tolist() == [i for e in library.encode_batch(MORE, add_special_tokens=False) for i in e.ids]
    library.encode_special_tokens = False


def test_pair_index_equals_merging_word_by_word():
    rng = random.Random(5)
    # Symbols 0..3; each rule uses those made before it.
    rules = list({(a, b): (a, b, n) for n in range(4, 60) for a, b in [(rng.randrange(n), rng.randrange(n))]}.values())
    rules.sort(key=lambda r: r[2])
    n = 60
    with pytest.raises(ValueError, match="later rule"):
        bpe.PairIndex(rules[::-1], n)
    index = bpe.PairIndex(rules, n)
    words = [[rng.randrange(4) for _ in range(rng.randint(1, 30))] for _ in range(300)]

    def alone(word):
        rank = {(a, b): (k, c) for k, (a, b, c) in enumerate(rules)}
        while True:
            best = min(((rank[p][0], i) for i, p in enumerate(zip(word, word[1:], strict=False)) if p in rank), default=None)
            if best is None:
                return word
            i = best[1]
            word = [*word[:i], rank[word[i], word[i + 1]][1], *word[i + 2:]]

    flat = np.array([s for w in words for s in [*w, index.base - 1]])
    merged = index.merged(flat)
    got = [[]]
    for s in merged[merged >= 0].tolist():
        if s == index.base - 1:
            got.append([])
        else:
            got[-1].append(s)
    assert got[:-1] == [alone(w) for w in words]


def test_unit_cache_keeps_frequent_units_and_forgets_the_rest():
    asked = []

    def learn(units):
        asked.extend(units)
        return units, np.array([len(u) for u in units], np.uint32), np.ones(len(units), np.int64)

    cache = UnitIds(learn, 20)
    rng = random.Random(6)
    for k in range(300):
        units = ["often", *(f"{'r' * rng.randint(1, 9)}{k}" for _ in range(5))]
        flat, counts = cache.of(units)
        assert flat.tolist() == [len(u) for u in units] and counts.tolist() == [1] * 6
        assert len(cache.young.index) <= 30 and len(cache.old.index) <= 30
    assert asked.count("often") == 1
    assert cache.of([])[0].tolist() == []


def test_frames(spark, library):
    texts = [None, "", " \n", "Hello <|endoftext|> world", "dup", "dup", "long " * 300_000]
    docs = docs_of(spark, [*enumerate(texts), (None, "dup")])
    rows = bpe.decode(bpe.encode(docs, FILE), FILE).collect()
    assert len(rows) == 8
    for r in rows:
        text = "dup" if r.doc_id is None else texts[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.ids == ids and r.text == library.decode(ids, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(docs.limit(0), FILE), FILE).collect() == []
    given = spark.createDataFrame([(1, [None, -5, 320, 10 ** 6]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(given, FILE).collect()} == {1: library.id_to_token(320), 2: ""}
    with pytest.raises(ValueError, match="end mark"):
        bpe.Coder(public_tokenizers.path(BYTE_LEVEL))


def test_query(spark, library, tmp_path):
    texts = made(2)[:400]
    docs_of(spark, [*enumerate(texts), (1000, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in queries.QUERIES["op13_byte_pairs"](spark, str(tmp_path)).collect()}
    assert len(found) == 401
    for k, text in [*enumerate(texts), (1000, "")]:
        ids = library.encode(text, add_special_tokens=False).ids
        want = [hashlib.sha256(s.encode()).hexdigest() for s in (
            " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        assert [found[k].n_tokens, found[k].ids_sha256, found[k].decoded_sha256] == [len(ids), *want]
