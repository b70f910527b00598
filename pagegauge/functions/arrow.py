"""Arrow-batched functions, only where no column expression exists.

Every function skips NULL rows, so callers gate the input with ``when`` and
rows that do not need Python cost nothing but a NULL in the batch.
"""

from __future__ import annotations

import difflib
import html as html_entities
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from pagegauge.functions import kernels, markup

# Ship these helpers with the tasks; executors need no installed package.
cloudpickle.register_pickle_by_value(kernels)
cloudpickle.register_pickle_by_value(markup)
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


STRING, INT, LONG, DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
GRID_LIST = T.ArrayType(T.ArrayType(T.ArrayType(STRING)))
CHAR_STEPS = T.ArrayType(_struct(kind=STRING, gt_pos=INT, pred_pos=INT))
WORD_STEPS = T.ArrayType(_struct(kind=STRING, gt=STRING, pred=STRING))
CHUNKS = T.ArrayType(_struct(kind=STRING, pos=INT, text=STRING, n_words=INT))
TREE_SIZES = _struct(edit_distance=INT, gt_tree_size=INT, pred_tree_size=INT, error=STRING)
TABLES = _struct(grids=GRID_LIST, error=STRING)
#: Characters kept of an error.
ERROR_CHARS = 200
MATCHES = T.ArrayType(_struct(gt_index=INT, pred_index=INT, teds=DOUBLE))


def _present(*arrays: pa.Array) -> np.ndarray:
    """Row numbers where no input is NULL."""
    live = np.ones(len(arrays[0]), dtype=bool)
    for array in arrays:
        live &= pc.is_valid(array).to_numpy(zero_copy_only=False)
    return np.flatnonzero(live)


def _needed(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Row numbers where a list of either side has items; others are equal or stand for lists not needed."""
    rows = _present(left, right)
    sizes = [pc.list_value_length(side).fill_null(0).to_numpy(zero_copy_only=False) for side in (left, right)]
    return rows[(sizes[0] + sizes[1])[rows] > 0]


def _spread(rows: np.ndarray, values, length: int, kind: pa.DataType) -> pa.Array:
    """Put ``values`` at ``rows`` and NULL elsewhere."""
    out = [None] * length
    for row, value in zip(rows.tolist(), values):
        out[row] = value
    return pa.array(out, type=kind)


def _attempt(call, *args) -> tuple:
    """(result, None), or (None, what went wrong): one unreadable page must not end the job, its row says why."""
    try:
        return call(*args), None
    except Exception as error:
        return None, f"{type(error).__name__}: {error}"[:ERROR_CHARS]


def _as_symbols(left: pa.ListArray, right: pa.ListArray) -> tuple[list[str], list[str]]:
    """Rewrite token lists as strings with one code point per distinct token of the batch."""
    flat = pa.concat_arrays([left.flatten(), right.flatten()]).dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.uint32)
    codes += 1
    codes[codes >= 0xD800] += 0x800
    text = codes.tobytes().decode("utf-32-le")
    out, at = [], 0
    for side in (left, right):
        strings = []
        for size in pc.list_value_length(side).to_pylist():
            strings.append(text[at:at + size])
            at += size
        out.append(strings)
    return out[0], out[1]


@arrow_udf(STRING)
def clean_unicode(text: pa.Array) -> pa.Array:
    """Decode HTML entities, then compose to NFC."""
    return pa.array(
        [None if t is None else unicodedata.normalize("NFC", html_entities.unescape(t))
         for t in text.to_pylist()], type=pa.string())


@arrow_udf(STRING)
def unescape_html(text: pa.Array) -> pa.Array:
    return pa.array(
        [None if t is None else html_entities.unescape(t) for t in text.to_pylist()],
        type=pa.string())


@arrow_udf(STRING)
def strip_accents(text: pa.Array) -> pa.Array:
    """Decompose and keep ASCII only."""
    return pa.array(
        [None if t is None else unicodedata.normalize("NFD", t).encode("ascii", "ignore").decode()
         for t in text.to_pylist()], type=pa.string())


@arrow_udf(LONG)
def char_distance(left: pa.Array, right: pa.Array) -> pa.Array:
    rows = _present(left, right)
    found = kernels.distances(left.take(rows).to_pylist(), right.take(rows).to_pylist())
    return _spread(rows, found.tolist(), len(left), pa.int64())


@arrow_udf(LONG)
def token_distance(left: pa.Array, right: pa.Array) -> pa.Array:
    rows = _needed(left, right)
    found = kernels.distances(*_as_symbols(left.take(rows), right.take(rows)))
    return _spread(rows, found.tolist(), len(left), pa.int64())


@arrow_udf(LONG)
def char_overlap(left: pa.Array, right: pa.Array) -> pa.Array:
    rows = _present(left, right)
    found = kernels.char_overlaps(left.take(rows).to_pylist(), right.take(rows).to_pylist())
    return _spread(rows, found.tolist(), len(left), pa.int64())


@arrow_udf(LONG)
def item_overlap(left: pa.Array, right: pa.Array) -> pa.Array:
    rows = _needed(left, right)
    if not len(rows):
        return pa.nulls(len(left), pa.int64())
    left_live, right_live = left.take(rows), right.take(rows)
    flat = pa.concat_arrays([left_live.flatten(), right_live.flatten()]).dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size_l = pc.list_value_length(left_live).to_numpy(zero_copy_only=False)
    size_r = pc.list_value_length(right_live).to_numpy(zero_copy_only=False)
    cut, ids = int(size_l.sum()), np.arange(len(rows))
    found = kernels.overlap(
        codes[:cut], np.repeat(ids, size_l), codes[cut:], np.repeat(ids, size_r),
        len(rows), max(len(flat.dictionary), 1))
    return _spread(rows, found.tolist(), len(left), pa.int64())


def _lists(rows: np.ndarray, sizes: list[int], values: pa.Array, length: int) -> pa.Array:
    """One list per row; rows not given are NULL."""
    counts = np.zeros(length, np.int64)
    counts[rows] = sizes
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    absent = np.ones(length, bool)
    absent[rows] = False
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(absent))


def _steps(found: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros((0, 3), np.int64), *found])


def _kinds(steps: np.ndarray) -> pa.Array:
    return pa.DictionaryArray.from_arrays(
        pa.array(steps[:, 0].astype(np.int8)), pa.array(kernels.KINDS)).cast(pa.string())


@arrow_udf(CHAR_STEPS)
def char_alignment(left: pa.Array, right: pa.Array) -> pa.Array:
    """Non-matching steps of the character alignment."""
    rows = _present(left, right)
    found = kernels.edit_scripts(left.take(rows).to_pylist(), right.take(rows).to_pylist(), keep=False)
    steps = _steps(found)
    values = pa.StructArray.from_arrays(
        [_kinds(steps), pa.array(steps[:, 1].astype(np.int32)), pa.array(steps[:, 2].astype(np.int32))],
        ["kind", "gt_pos", "pred_pos"])
    return _lists(rows, [len(x) for x in found], values, len(left))


def _word_steps(left: pa.Array, right: pa.Array, keep: bool) -> pa.Array:
    """Aligned word pairs, in order, with matches if ``keep``; a missing side is NULL."""
    rows = _present(left, right)
    sides = left.take(rows), right.take(rows)
    found = kernels.edit_scripts(*_as_symbols(*sides), keep=keep)
    steps, sizes = _steps(found), [len(x) for x in found]

    def taken(side: pa.ListArray, place: np.ndarray) -> pa.Array:
        before = np.cumsum([0, *pc.list_value_length(side).to_pylist()])[:-1]
        at = place + np.repeat(before, sizes)
        return side.flatten().take(pa.array(at, pa.int64(), mask=place < 0))

    values = pa.StructArray.from_arrays(
        [_kinds(steps), taken(sides[0], steps[:, 1]), taken(sides[1], steps[:, 2])], ["kind", "gt", "pred"])
    return _lists(rows, sizes, values, len(left))


@arrow_udf(WORD_STEPS)
def word_alignment(left: pa.Array, right: pa.Array) -> pa.Array:
    """Every aligned word pair, in order; a missing side is NULL."""
    return _word_steps(left, right, True)


@arrow_udf(WORD_STEPS)
def word_changes(left: pa.Array, right: pa.Array) -> pa.Array:
    """The aligned word pairs that differ."""
    return _word_steps(left, right, False)


@arrow_udf(INT)
def lcs_length(left: pa.Array, right: pa.Array) -> pa.Array:
    rows = _present(left, right)
    found = kernels.lcs_lengths(*_as_symbols(left.take(rows), right.take(rows)))
    return _spread(rows, found.tolist(), len(left), pa.int32())


@arrow_udf(CHUNKS)
def diff_chunks(left: pa.Array, right: pa.Array) -> pa.Array:
    """Word runs only in the reference (deleted) or only in the prediction (inserted)."""
    kind = pa.list_(pa.struct([
        ("kind", pa.string()), ("pos", pa.int32()), ("text", pa.string()), ("n_words", pa.int32())]))

    def chunks(a, b):
        found = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
        for tag, i1, i2, j1, j2 in found:
            if tag != "equal" and j2 > j1:
                yield {"kind": "inserted", "pos": j1, "text": " ".join(b[j1:j2]), "n_words": j2 - j1}
            if tag != "equal" and i2 > i1:
                yield {"kind": "deleted", "pos": i1, "text": " ".join(a[i1:i2]), "n_words": i2 - i1}

    return pa.array(
        [None if a is None or b is None else list(chunks(a, b))
         for a, b in zip(left.to_pylist(), right.to_pylist())], type=kind)


@arrow_udf(T.ArrayType(DOUBLE))
def best_ious(left: pa.Array, right: pa.Array) -> pa.Array:
    """For every box of the left side the highest IoU with a box of the right side, 0 where none meets it."""
    rows = _needed(left, right)

    def boxes(page) -> np.ndarray:
        found = [[np.nan if v is None else v for v in [*(box or []), *[None] * 4][:4]] for box in page]
        return np.array(found, np.float64).reshape(-1, 4)

    found = [kernels.best_ious(boxes(a), boxes(b)).tolist() for a, b in zip(
        left.take(rows).to_pylist(), right.take(rows).to_pylist())]
    return _spread(rows, found, len(left), pa.list_(pa.float64()))


@arrow_udf(TABLES)
def parse_tables(text: pa.Array) -> pa.Array:
    """Raw cell text of all tables for markup the pattern parser cannot read, or the error of a row."""
    found = [(None, None) if t is None else _attempt(markup.tables, t) for t in text.to_pylist()]
    return pa.StructArray.from_arrays(
        [pa.array([grids for grids, _ in found], pa.list_(pa.list_(pa.list_(pa.string())))),
         pa.array([error for _, error in found], pa.string())], ["grids", "error"])


@arrow_udf(TREE_SIZES)
def markup_distance(left: pa.Array, right: pa.Array) -> pa.Array:
    """Top-down distance of the first table of each side on the raw markup tree, or the error of a row."""
    kind = pa.struct([
        ("edit_distance", pa.int32()), ("gt_tree_size", pa.int32()), ("pred_tree_size", pa.int32()),
        ("error", pa.string())])

    def compare(a, b):
        ref, pred = markup.read_table(a), markup.read_table(b)
        return {
            "edit_distance": markup.tree_distance(ref, pred),
            "gt_tree_size": markup.tree_size(ref), "pred_tree_size": markup.tree_size(pred)}

    return pa.array(
        [None if a is None or b is None else sizes or {"error": error} for a, b in zip(left.to_pylist(), right.to_pylist())
         for sizes, error in [_attempt(compare, a, b)]], type=kind)


def _cut(items, array: pa.ListArray, kind) -> list:
    """Items of a list column, listed one after the other, as one ``kind`` for every row."""
    ends = np.cumsum(pc.list_value_length(array).to_numpy(zero_copy_only=False)).tolist()
    return [kind(items[start:end]) for start, end in zip([0, *ends], ends)]


def _grids(array: pa.ListArray, kind=list) -> list:
    """Grids of a column; texts are taken out at once, which takes a fraction of the time of nested lists."""
    rows = array.flatten()
    cells = rows.flatten()
    if array.null_count or rows.null_count or cells.null_count:
        return [kind(map(kind, grid)) for grid in array.to_pylist()]
    return _cut(_cut(cells.to_numpy(zero_copy_only=False).tolist(), rows, kind), array, kind)


@arrow_udf(DOUBLE)
def grid_similarity(left: pa.Array, right: pa.Array) -> pa.Array:
    """Tree-edit similarity of two grids."""
    rows = _needed(left, right)
    pairs = list(zip(_grids(left.take(rows)), _grids(right.take(rows))))
    sizes = np.array([max(kernels.grid_size(a), kernels.grid_size(b)) for a, b in pairs])
    found = np.maximum(0.0, 1.0 - kernels.grid_distances(pairs) / np.maximum(sizes, 1))
    return _spread(rows, found.tolist(), len(left), pa.float64())


@arrow_udf(MATCHES)
def table_matches(left: pa.Array, right: pa.Array) -> pa.Array:
    """Best one-to-one matching of the grids of two pages.

    Copies of a grid share one comparison across the whole batch.
    """
    kind = pa.list_(pa.struct(
        [("gt_index", pa.int32()), ("pred_index", pa.int32()), ("teds", pa.float64())]))
    rows = _needed(left, right)
    sides = [
        _cut(_grids(live.flatten(), tuple), live, list) for live in (side.take(rows) for side in (left, right))]
    wanted = dict.fromkeys(
        (a, b) for ref, pred in zip(*sides) for a in set(ref) for b in set(pred))
    pairs = list(wanted)
    sizes = np.array([max(kernels.grid_size(a), kernels.grid_size(b)) for a, b in pairs])
    score = dict(zip(pairs, np.maximum(0.0, 1.0 - kernels.grid_distances(pairs) / np.maximum(sizes, 1))))

    def match(ref, pred):
        if not ref or not pred:
            return []
        if len(ref) == len(pred) == 1:
            return [{"gt_index": 0, "pred_index": 0, "teds": float(score[ref[0], pred[0]])}]
        matrix = np.array([[score[a, b] for b in pred] for a in ref])
        return [
            {"gt_index": i, "pred_index": j, "teds": float(matrix[i, j])}
            for i, j in kernels.assign(matrix)]

    return _spread(rows, [match(r, p) for r, p in zip(*sides)], len(left), kind)
