"""Batch helpers against brute force."""

import itertools
import random
import time
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from pagegauge.functions import kernels as K, markup, patterns as P

R = random.Random(7)


def table_distance(a, b):
    """Full dynamic programming table."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i][j] = min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    return d


def noisy_pairs(n, sizes=(0, 1, 5, 30, 63, 64, 65, 130, 200)):
    for _ in range(n):
        a = "".join(R.choice("abcdeé") for _ in range(R.choice(sizes)))
        b = "".join(R.choice(["", "z", "ab"]) if R.random() < 0.2 else c for c in a)
        yield a, b if R.random() < 0.8 else b[::-1]


def test_distances_match_dynamic_programming():
    pairs = list(noisy_pairs(400))
    found = K.distances([a for a, _ in pairs], [b for _, b in pairs])
    for (a, b), got in zip(pairs, found):
        assert got == table_distance(a, b)[-1][-1] == K.distance(a, b)


def scripted(a, b):
    """Steps read from the full table, last one first."""
    d, i, j = table_distance(a, b), len(a), len(b)
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            kind = K.MATCH
        elif i and j and d[i][j] == d[i - 1][j - 1] + 1:
            kind = K.SUBSTITUTE
        elif i and d[i][j] == d[i - 1][j] + 1:
            kind = K.DELETE
        else:
            kind = K.INSERT
        yield kind, -1 if kind == K.INSERT else i - 1, -1 if kind == K.DELETE else j - 1
        i -= kind != K.INSERT
        j -= kind != K.DELETE


def named(script):
    return [(K.KINDS[k], i, j) for k, i, j in script.tolist()]


@pytest.mark.parametrize(("history", "grouped"), [(1 << 22, True), (1 << 22, False), (2000, True), (1, True)])
def test_edit_scripts_follow_the_preference_order(monkeypatch, history, grouped):
    monkeypatch.setattr(K, "HISTORY", history)
    monkeypatch.setattr(K, "GROUP_ROWS", 1 if grouped else 1000)
    pairs = [*noisy_pairs(150), ("", ""), ("", "ab"), ("ab", ""), ("aab", "ab"), ("x" * 70, "y" * 3), ("\U0001f600a", "a")]
    left, right = [a for a, _ in pairs], [b for _, b in pairs]
    want = [list(scripted(a, b))[::-1] for a, b in pairs]
    assert [named(x) for x in K.edit_scripts(left, right)] == want
    assert [named(K.edit_script(a, b)) for a, b in pairs] == want
    errors = [[s for s in x if s[0] != K.MATCH] for x in want]
    assert [named(x) for x in K.edit_scripts(left, right, keep=False)] == errors
    assert K.edit_scripts([], []) == []


@pytest.mark.parametrize("grouped", [True, False])
def test_lcs_and_distances_of_a_batch(monkeypatch, grouped):
    monkeypatch.setattr(K, "GROUP_ROWS", 1 if grouped else 1000)
    pairs = [*noisy_pairs(300), ("", "a"), ("a", "")]
    found = K.lcs_lengths([a for a, _ in pairs], [b for _, b in pairs])
    assert found.tolist() == [K.lcs_length(a, b) for a, b in pairs]
    found = K.distances([a for a, _ in pairs], [b for _, b in pairs])
    assert found.tolist() == [table_distance(a, b)[-1][-1] for a, b in pairs]


def test_overlap_is_the_multiset_intersection():
    pairs = list(noisy_pairs(100))
    found = K.char_overlaps([a for a, _ in pairs], [b for _, b in pairs])
    assert [sum((Counter(a) & Counter(b)).values()) for a, b in pairs] == found.tolist()


def test_lcs_is_bounded_by_insert_delete_distance():
    for a, b in noisy_pairs(60, (0, 3, 20)):
        line = [0] * (len(b) + 1)
        for x in a:
            line = list(itertools.accumulate(
                range(len(b)), lambda acc, j: max(acc, line[j + 1], line[j] + (x == b[j])), initial=0))
        assert K.lcs_length(a, b) == line[-1]


def forest(grid):
    return (("table", "", tuple(
        ("tr", "", tuple(("th" if r == 0 else "td", c, ()) for c in row)) for r, row in enumerate(grid))),)


@lru_cache(None)
def size(f):
    return sum(1 + size(t[2]) for t in f)


@lru_cache(None)
def forest_distance(f, g):
    if not f or not g:
        return float(size(f) + size(g))
    v, w = f[-1], g[-1]
    rename = 1.0 if v[0] != w[0] else (
        K.distance(v[1], w[1]) / max(len(v[1]), len(w[1]), 1) if v[0] in ("td", "th") else 0.0)
    return min(
        forest_distance(f[:-1] + v[2], g) + 1, forest_distance(f, g[:-1] + w[2]) + 1,
        forest_distance(f[:-1], g[:-1]) + forest_distance(v[2], w[2]) + rename)


def test_grid_distance_is_exact():
    def grid():
        cols = R.randint(1, 3)
        return [[R.choice(["a", "b", "ab", "abc", ""]) for _ in range(cols)] for _ in range(R.randint(1, 4))]
    pairs = []
    for _ in range(300):
        g = grid()
        h = [[c if R.random() > 0.3 else R.choice(["q", "ab"]) for c in r] for r in g if R.random() > 0.2] or grid()
        pairs.append((g, h if R.random() < 0.6 else grid()))
    for (g, h), got in zip(pairs, K.grid_distances(pairs)):
        assert got == pytest.approx(forest_distance(forest(g), forest(h)))
        full = K._shape_distances([(g, h)], len(g), len(g[0]), len(h), len(h[0]))[0]
        assert full == pytest.approx(got)
        assert K.grid_distances([(h, g)])[0] == pytest.approx(got)


def test_assignment_is_optimal():
    for _ in range(150):
        rows, cols = R.randint(1, 5), R.randint(1, 5)
        score = np.array([[R.randint(0, 9) / 10 for _ in range(cols)] for _ in range(rows)])
        wide = score if score.shape[0] <= score.shape[1] else score.T
        best = max(sum(wide[i, p[i]] for i in range(len(wide)))
                   for p in itertools.permutations(range(wide.shape[1]), len(wide)))
        chosen = K.assign(score)
        assert len(chosen) == min(score.shape) == len({i for i, _ in chosen}) == len({j for _, j in chosen})
        assert sum(score[i, j] for i, j in chosen) == pytest.approx(best)


def test_tree_distance_on_markup():
    t = "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>"
    a, b = markup.first_table(t), markup.first_table(t.replace("<td>2</td>", ""))
    assert markup.tree_size(a) == 7 and markup.tree_distance(a, a) == 0
    assert markup.tree_distance(a, b) == 1 and markup.tree_distance(a, None) == 7
    assert markup.tree_distance(a, markup.first_table(t.replace("th>", "td>"))) == 2


def test_texts_outside_the_gate_are_composed():
    for code in range(0x300):
        assert unicodedata.is_normalized("NFC", chr(code)), hex(code)
        assert unicodedata.combining(chr(code)) == 0
    assert P.MAYBE_NOT_COMPOSED.endswith("˿]")


def test_masks_follow_the_pair_and_not_the_vocabulary():
    import tracemalloc

    rng = np.random.default_rng(0)
    left = ["".join(map(chr, rng.integers(0x100, 0x100 + 50_000, 60))) for _ in range(4000)]
    right = [t[:20] + "a" + t[25:] for t in left]
    tracemalloc.start()
    found = K.distances(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found == 5).all() and peak < 200 * 2 ** 20


def test_characters_are_counted_without_sorting_them():
    words = ["the quick brown fox", "é\U0001f600 ab", "", "aaaa"]
    for left, right in ((words, words[::-1]), ([], []), ([""], [""]), (["a"], [""])):
        want = [sum(min(a.count(c), b.count(c)) for c in set(a)) for a, b in zip(left, right)]
        assert K.char_overlaps(left, right).tolist() == want
    text = "the quick brown fox jumps over the lazy dog " * 12
    left, right = [text] * 10000, [text.replace("th", "tn")] * 10000
    began = time.process_time()
    K.char_overlaps(left, right)
    K.char_overlaps(left, right)
    batch = time.process_time() - began
    began = time.process_time()
    np.unique(np.frombuffer("".join(left + right).encode("utf-32-le"), np.uint32), return_inverse=True)
    assert batch < 2 * (time.process_time() - began)


def test_nested_markup_is_cut_and_refused_quickly(monkeypatch):
    # A benchmark page: bare tags need no HTML parser, and a tree too deep to read is not read.
    deep = "<table><tr><th>" + "<b>" * 1200 + "w</th></tr><tr><td>x</td></tr></table>"
    monkeypatch.setattr(markup._Builder, "feed", lambda *_: pytest.fail("parsed"))
    monkeypatch.setattr(markup, "freeze", lambda *_: pytest.fail("frozen"))
    with pytest.raises(RecursionError):
        markup.tree_distance(markup.read_table(deep), markup.read_table("<table><tr><td>x</td></tr></table>"))


def test_bare_markup_is_read_as_the_parser_reads_it():
    def dump(node):
        return node.tag, [c if isinstance(c, str) else dump(c) for c in node.children]

    pieces = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</TD>", "<th>", "<b>", "</b>", "<br>", "x y", "a>b", " \n", "<p>", "</p>"]
    for _ in range(500):
        html = "".join(R.choice(pieces) for _ in range(R.randint(0, 14)))
        builder = markup._Builder()
        builder.feed(html)
        builder.close()
        assert dump(markup.parse(html)) == dump(builder.root)


def test_plain_rows_are_aligned_near_the_diagonal(monkeypatch):
    def html(rows):
        return "<table>" + "".join(f"<tr>{''.join(f'<td>{c}</td>' for c in row)}</tr>" for row in rows) + "</table>"

    def whole(a, b):
        a, b = markup._frozen_table(a), markup._frozen_table(b)
        line = [0]
        for child in b[2]:
            line.append(line[-1] + child[1])
        for child in a[2]:
            fresh = [line[0] + child[1]]
            for k, other in enumerate(b[2]):
                fresh.append(min(line[k + 1] + child[1], fresh[-1] + other[1], line[k] + whole(child, other)))
            line = fresh
        return (a[0] != b[0]) + line[-1]

    for _ in range(300):
        a = [[R.choice(["a", "b", "", "cd"]) for _ in range(R.randint(0, 4))] for _ in range(R.randint(0, 6))]
        b = [row for row in a if R.random() < 0.7] if R.random() < 0.5 else [[R.choice("abx")] * R.randint(0, 3) for _ in range(R.randint(0, 6))]
        a, b = markup.read_table(html(a)), markup.read_table(html(b))
        assert markup.tree_distance(a, b) == whole(a, b)

    # Two of 300 rows are gone: a few diagonals are enough.
    seen, change = [], markup._row_distance
    monkeypatch.setattr(markup, "_row_distance", lambda a, b: seen.append(1) or change(a, b))
    rows = [[f"a{k}", f"b{k}", "c", "d"] for k in range(300)]
    copy = [[f"x{k}" if k % 20 == 0 else row[0], *row[1:]] for k, row in enumerate(rows) if k not in (110, 210)]
    assert markup.tree_distance(markup.read_table(html(rows)), markup.read_table(html(copy))) == 10 + 15
    assert len(seen) < 300 * 12


def test_grids_settled_together_are_those_settled_alone(monkeypatch):
    words = ["the", "tne", "a", "", "Alpha", "Alphb", "x" * 70, "x" * 69 + "y", "é"]
    pairs = []
    for k in range(400):
        a = [[R.choice(words) for _ in range(1 + k % 3)] for _ in range(R.randint(1, 6))]
        b = [[c.replace("th", "tn") if R.random() < 0.7 else c for c in row] for row in a if R.random() < 0.8] or a[:1]
        pairs.append((a, b) if k % 2 else (b, a[::-1] if k % 5 == 0 else a))
    alone = [K._settled(a, b) for a, b in pairs]
    assert K._settled_together(pairs) == alone and None in alone and 0.0 in alone
    monkeypatch.setattr(K, "_settled", lambda *_: pytest.fail("one by one"))
    K.grid_distances(pairs)
