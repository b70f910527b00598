"""Near duplicates and decontamination against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from pagegauge.llm import decontaminate, minhash, words
from tests.llm.test_texts import brute_shingles, docs_of, thue_morse


def brute_components(texts):
    sets = [(k, brute_shingles(t)) for k, t in texts]
    label = {k: k for k, _ in sets if k is not None}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1:]:
            if x and y and None not in (a, b) and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return [(k, len(s), label.get(k), k is None or label[k] == k) for k, s in sets]


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else f"new{rng.random()}" for w in text.split())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = []
    for _ in range(12):
        base = " ".join(f"w{rng.randint(0, 10 ** 6)}" for _ in range(rng.randint(3, 150)))
        texts += [base, base.upper(), base + "  ", *(edited(rng, base, 0.02) for _ in range(4)), edited(rng, base, 0.06)]
        texts.append(f"{passage} {base[:200]}")
    chain = [f"c{k}" for k in range(100)]
    for _ in range(12):  # each like the next, the ends unlike
        chain = chain[8:] + [f"d{rng.random()}" for _ in range(8)]
        texts.append(" ".join(chain))
    texts += [None, "", "   ", "one two", "one two", "One\tTWO", "three", "x " * 4000, "x " * 3000]
    rng.shuffle(texts)
    return [*enumerate(texts, 10), (None, "one two"), (None, None)]


def test_near_duplicates_equal_brute_force(spark, corpus):
    rows = minhash.near_duplicates(docs_of(spark, corpus)).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(brute_components(corpus), key=repr)


def test_repeated_rows_and_empty_tables(spark):
    twice = docs_of(spark, [(3, "a b c"), (3, "a b c"), (8, "a b c"), (9, None)])
    assert sorted(map(tuple, minhash.near_duplicates(twice).collect())) == [
        (3, 1, 3, True), (3, 1, 3, True), (8, 1, 3, False), (9, 0, 9, True)]
    kept = minhash.deduplicated(twice)
    assert kept.columns == twice.columns and sorted(r.doc_id for r in kept.collect()) == [3, 9]
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_rows_that_share_an_id_or_have_none_go_by_their_own_text(spark):
    base = [" ".join(f"{c}{k}" for k in range(80)) for c in "abcde"]
    near = [f"{b} more" for b in base]
    rows = [(1, base[0]), (3, near[0]), (3, base[1]), (3, base[1]), (4, near[1]), (None, near[1]), (None, base[2]),
            (None, base[2].upper()), (None, near[2]), (None, base[3]), (None, None), (None, " "), (9, None), (9, "")]
    kept = minhash.deduplicated(docs_of(spark, rows)).collect()
    got = sorted(((r.doc_id, (r.text or "").strip().lower()[:3]) for r in kept), key=repr)
    assert got == sorted([(1, "a0 "), (3, "b0 "), (None, "c0 "), (None, "d0 "), (None, ""), (None, ""), (9, "")], key=repr)
    found = minhash.near_duplicates(docs_of(spark, rows[:5])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in found) == [
        (1, 1, True), (3, 1, False), (3, 3, True), (3, 3, True), (4, 3, False)]


def test_different_texts_with_like_letters_are_not_linked(spark):
    rows = [(k + 1, thue_morse(n, letters)) for k, (n, letters) in enumerate(
        (n, x) for n in (1024, 2048, 4096) for x in ("ab", "ba"))]
    found = minhash.near_duplicates(docs_of(spark, rows)).collect()
    assert all(r.component_id == r.doc_id and r.kept and r.n_shingles == 1 for r in found) and len(found) == 6


def test_components_equal_a_plain_search(spark):
    rng = random.Random(6)
    links = [(k, k + 1) for k in range(1000, 1040)] + [(500, k) for k in range(501, 530)] + [(k, 999) for k in range(900, 930)]
    links += [(rng.randint(1, 60), rng.randint(1, 60)) for _ in range(40)]
    label = {k: k for link in links for k in link}
    for a, b in links:
        low, high = sorted((label[a], label[b]))
        label = {k: low if v == high else v for k, v in label.items()}
    table = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in minhash.components(table, "test").collect()}
    assert all(got.get(k, k) == v for k, v in label.items())
    assert minhash.components(table.limit(0), "test").count() == 0


def members(sets, components, blocks):
    sig = [((minhash.minima(s) * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint8).tobytes() for s in sets]
    return sig, components, blocks


def test_blocks_find_every_link_between_components(corpus):
    texts = [t for _, t in corpus if t and len(t.split()) > 5]
    lists = [words.words_of(t) for t in texts]
    sets = words.shingle_sets(lists)
    sig, comp, block = members(sets, list(range(len(sets))), [k % 2 for k in range(len(sets))])
    table = pa.table({"node": list(range(len(sets))), "component": comp, "n": [len(s) for s in sets],
                      "block": pa.array(block, pa.int32()), "signature": pa.array(sig, pa.binary()), "text": texts})
    links = {tuple(r.values()) for b in (0, 1) for r in minhash._linked(table.filter(pa.compute.equal(
        table["block"], b))).to_pylist()} | {tuple(r.values()) for r in minhash._linked(table).to_pylist()}
    label = list(range(len(sets)))
    for a, b in links:
        label = [label[a] if x == label[b] else x for x in label]
    for i, x in enumerate(sets):
        for j in range(i):
            common = len(np.intersect1d(x, sets[j]))
            if 100 * common >= 75 * (len(x) + len(sets[j]) - common):
                assert label[i] == label[j]


def test_bayes_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 2000, np.uint64)
    lost = 0
    for k in range(60):
        x = np.unique(np.concatenate([base[:1714], rng.integers(0, 1 << 62, 286, np.uint64)]))
        y = np.unique(np.concatenate([base[:1714], rng.integers(0, 1 << 62, 285, np.uint64)]))
        a, b = (np.frombuffer((minhash.minima(s) >> np.uint32(3)).astype(np.uint8).tobytes(), np.uint8)[None] for s in (x, y))
        lost += not len(minhash.plausible(a, b))
    assert lost == 0
    assert minhash.fewest_matches()[-1] > 60


def test_leaks_equal_brute_force(spark):
    rng = random.Random(7)
    def prose(n):
        return " ".join("".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 7))) for _ in range(n))
    items = [(k, prose(20)) for k in range(6)] + [(6, "short one"), (7, None), (8, ""), (9, "What colour has ink?"),
                                                 (10, "The answers are four and five."), (11, "ox")]
    def spoil(text, edits):
        out = list(text)
        for _ in range(edits):
            out[rng.randrange(len(out))] = rng.choice(["z", "", "zz"])
        return "".join(out)
    docs = [(k, f"{prose(40)} {spoil(items[k % 6][1], k)} {prose(30)}") for k in range(30)]
    docs += [(40, items[1][1].upper().replace(" ", ",\n")), (41, None), (42, ""), (43, "Short  one!"), (44, "a short one b"), (45, "a shorty one b"),
             (46, "ashort one"), (47, "so what color has ink is it"), (48, "Whatcolour has ink"), (49, "the answer are fur and five"),
             (50, "the ox"), (51, "an oxen"), (52, "ox"), (53, "answers: the answers are four, and five; ox!"), (None, items[0][1])]
    found = decontaminate.leaks(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.distance for r in found.collect()}
    want = {}
    for d, text in docs:
        data = decontaminate.folded(text)
        for i, item in items:
            item = decontaminate.folded(item)
            if not item:
                continue
            budget, own = int(len(item) * decontaminate.ERROR_RATE), data
            if len(item) < decontaminate.MIN_BYTES:  # blanks stand for the ends of words
                item, own = b" " + item + b" ", b" " + data + b" "
            row = [0] * (len(own) + 1)
            for a, x in enumerate(item, 1):
                new = [a]
                for b, y in enumerate(own, 1):
                    new.append(min(row[b] + 1, new[-1] + 1, row[b - 1] + (x != y)))
                row = new
            if data and min(row) <= budget:
                want[d, i] = min(row)
    assert got == want and len(want) > 8
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = decontaminate.clean(docs_of(spark, docs), bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want if d is not None}
    assert decontaminate.leaks(docs_of(spark, []), bench).count() == 0
    assert decontaminate.leaks(docs_of(spark, docs), bench.limit(0)).count() == 0
