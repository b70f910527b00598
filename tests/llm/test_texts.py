"""Token ids, shingles, packing and token files against the library and brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagegauge.llm import packing, tokenfiles, words
from pagegauge.llm.store import scratch
from pagegauge.llm.tokens import BYTE_LEVEL, WORD_LEVEL, Encoder

ODD = ["", " ", "a  b", "x\n y", "don't 'tis we'll", "<|endoftext|> a <|startoftext|>b", "É É é ΣΑΣ Σ", "a\x1cb c",
       "日本語 テキスト🙂 x", "\ta", "a\n", "a\n\nb c", "İstanbul ſ", "x\u0085y z　w", "12345 6.7e-3", "foo, bar. baz!!"]
SCHEMA = "doc_id long, text string, score double, node string, ids binary"


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, 0.5, "x", b"") for k, t in texts], SCHEMA)


@pytest.mark.parametrize("file", [BYTE_LEVEL, WORD_LEVEL])
def test_encoder_equals_library(file):
    path = public_tokenizers.path(file)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    rng = random.Random(1)
    made = ["".join(rng.choice("ab É'1.,\n\t ßΣ日") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts = [*ODD, *made, " ".join(ODD) * 3]
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    for cache in (10, 100_000):
        assert [x.tolist() for x in Encoder(path, cache).ids(texts, 200)] == want
    assert [x.tolist() for x in Encoder(path).ids([None])] == [[]]


def brute_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_shingles_equal_brute_force(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["A", "b", "Éa", "c d", "e\t"]) for _ in range(rng.randint(0, 80))) for _ in range(200)]
    texts += [None, "", "one", "one two three four", "x " * 3000, "long" * 400_000 + " a b c d e f"]
    for block in (words.BLOCK, 7):
        monkeypatch.setattr(words, "BLOCK", block)
        sets = words.shingle_sets([words.words_of(t) for t in texts])
        assert [len(s) for s in sets] == [len(brute_shingles(t)) for t in texts]
        assert len(np.unique(np.concatenate(sets))) == len(set().union(*map(brute_shingles, texts)))
        assert all((np.diff(s.astype(object)) > 0).all() for s in sets)


def thue_morse(n, letters):
    return "".join(letters[k.bit_count() % 2] for k in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_on_which_polynomials_collide(n):
    one, other = thue_morse(n, "ab"), thue_morse(n, "ba")
    a, b = words.shingle_sets([words.words_of(one), words.words_of(other)])
    assert len(a) == len(b) == 1 and a[0] != b[0]
    # A short text is told from the same words in another order or number, and from those of a longer text.
    sets = words.shingle_sets([words.words_of(t) for t in ("a b", "b a", "a", "a a", "a a a a a", "a a a a a a")])
    assert len({s.tobytes() for s in sets}) == 5 and sets[4].tobytes() == sets[5].tobytes()


def test_packer_keeps_all_limits():
    rng = random.Random(3)
    limits = packing.Limits(tokens=64, segments=4, loss=40, waiting_tokens=2000)
    packer = packing.Packer(limits)
    items = [(rng.randint(1, 200), rng.randint(0, 30)) for _ in range(500)]
    bins = [b for k, (n, free) in enumerate(items) for b in packer.place(k, n, free)] + list(packer.finish())
    placed = {k: [] for k in range(len(items))}
    for pieces in bins:
        assert sum(n for _, _, n in pieces) <= 64 and len(pieces) <= 4
        assert sum(max(0, a + n - max(a, items[k][1])) for k, a, n in pieces) <= 40
        for k, a, n in pieces:
            placed[k].append((a, n))
    for k, (size, _) in enumerate(items):
        at = 0
        for a, n in sorted(placed[k]):
            assert a == at and n > 0
            at += n
        assert at == size


def test_packed_documents(spark):
    texts = [(1, "word " * 5000), (2, None), (2, None), (3, ""), (None, "Some text, here"), (4, "aé 日本")]
    rows = packing.pack_documents(docs_of(spark, texts), public_tokenizers.path(WORD_LEVEL)).collect()
    plain = Tokenizer.from_file(public_tokenizers.path(WORD_LEVEL))
    plain.encode_special_tokens = True
    want = sorted((str(k), plain.encode(t or "", add_special_tokens=False).ids + [1]) for k, t in texts)
    got, bins = {}, {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        got.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        total = sum(n for _, n in pieces)
        assert total <= 2048 and total & (total - 1) == 0
    joined = sorted((str(k[0]), np.frombuffer(b"".join(i for _, i in sorted(v)), "<u4").tolist()) for k, v in got.items()
                    if k[1] > 1)
    assert joined == [w for w in want if len(w[1]) > 1]
    assert sum(r.doc_tokens == 1 for r in rows) == 3
    assert packing.pack_documents(docs_of(spark, []), public_tokenizers.path(WORD_LEVEL)).count() == 0


def test_packed_documents_keep_the_loss_limit(spark):
    texts = [(k, "word " * (5 + k % 90)) for k in range(300)]
    docs = docs_of(spark, texts).withColumn("loss_start", F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 37))
    limits = packing.Limits(tokens=128, segments=6, loss=70, waiting_tokens=2000)
    rows = packing.pack_documents(
        docs.coalesce(1), public_tokenizers.path(WORD_LEVEL), limits=limits, loss_start="loss_start").collect()
    bins, total = {}, {}
    for r in rows:
        free = r.doc_id % 37 if r.doc_id % 4 else 0
        assert r.loss_tokens == max(0, r.start + r.length - max(r.start, free))
        bins.setdefault(r.sequence_id, []).append(r)
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert all(sum(r.loss_tokens for r in b) <= 70 and sum(r.length for r in b) <= 128 and len(b) <= 6 for b in bins.values())
    assert any(sum(r.loss_tokens for r in b) < sum(r.length for r in b) for b in bins.values())
    assert total == {r.doc_id: r.doc_tokens for r in rows} and len(total) == 300


def test_token_files_round_trip(spark):
    texts = [(5, "b"), (5, "a"), (1, None), (None, "none"), (9, "x y " * 2000), (7, "")] + [(k, f"text {k}") for k in range(20, 90)]
    folder = scratch(spark, "test-files")
    manifest = tokenfiles.write_token_files(docs_of(spark, texts), folder, public_tokenizers.path(BYTE_LEVEL), 2, 50257)
    rows = tokenfiles.read_token_files(manifest, folder, with_ids=True).orderBy("start").collect()
    plain = Tokenizer.from_file(public_tokenizers.path(BYTE_LEVEL))
    ordered = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for (doc, text), r in zip(ordered, rows, strict=True):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens) == (doc, at, len(ids))
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.ids_crc32 == zlib.crc32(r.ids)
        at += len(ids)
    wide = scratch(spark, "test-files")
    manifest = tokenfiles.write_token_files(docs_of(spark, texts), wide, public_tokenizers.path(BYTE_LEVEL), 2, 1 << 17)
    assert manifest.first().kind == "<u4"
    assert tokenfiles.read_token_files(manifest, wide).agg({"ids_crc32": "sum"}).collect() == [
        Row(**{"sum(ids_crc32)": sum(r.ids_crc32 for r in rows)})]
    none = tokenfiles.write_token_files(docs_of(spark, []), scratch(spark, "t"), public_tokenizers.path(BYTE_LEVEL), 2, 50257)
    assert none.agg({"n_docs": "sum"}).first()[0] in (None, 0)
