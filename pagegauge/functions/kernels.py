"""Small numeric helpers used inside Arrow batches.

Published methods only: bit-vector edit distance (Myers 1999, blocked form by
Hyyro 2003), bit-vector LCS (Crochemore et al. 2001), ordered tree edit
distance (Zhang and Shasha 1989) specialised to the three-level tree of a
grid, and shortest augmenting path assignment.  Everything here sees one Arrow
batch; partitioning and pairing are Spark's job.
"""

from __future__ import annotations

import numpy as np

MAX_CELLS = 1 << 22  # numpy working-set bound per chunk, in array elements


# --- edit distance -------------------------------------------------------------

def trim(a, b):
    """Drop the common prefix and suffix; neither changes the distance."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    a, b = a[lo:], b[lo:]
    k = common_suffix(a, b)
    return (a[: len(a) - k], b[: len(b) - k]) if k else (a, b)


def common_suffix(a, b) -> int:
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[len(a) - mid:] == b[len(b) - mid:]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def positions(seq) -> dict:
    """Bit mask of the places of every distinct symbol."""
    masks: dict = {}
    for i, symbol in enumerate(seq):
        masks[symbol] = masks.get(symbol, 0) | (1 << i)
    return masks


def _advance(masks: dict, symbols, vp: int, vn: int, full: int, zero: list | None = None, vertical: list | None = None):
    """The state (vertical +1, vertical -1) after some symbols; what a trace back needs goes to the lists.

    Complements are taken with ``full``: Python's are negative, which costs several passes over a long integer.
    """
    for symbol in symbols:
        eq = masks.get(symbol, 0)
        diag = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        up = (((vn | ((diag | vp) ^ full)) << 1) | 1) & full
        vp, vn = (((vp & diag) << 1) & full) | ((diag | up) ^ full), up & diag
        if zero is not None:
            zero.append(diag)
            vertical.append(vp)
    return vp, vn


def distance(a, b) -> int:
    """Edit distance of two sequences of hashable symbols."""
    a, b = trim(a, b)
    if not a or not b:
        return len(a) + len(b)
    if len(a) < len(b):
        a, b = b, a
    full = (1 << len(a)) - 1
    vp, vn = _advance(positions(a), b, full, 0, full)
    # The last column starts at the length of b and changes by one bit of either kind per row.
    return len(b) + vp.bit_count() - vn.bit_count()


#: From so many pairs on, a step of array operations takes less time than one long-integer step for each (measured);
#: with trace backs, only for texts of up to so many words.
GROUP_ROWS, SCRIPT_WORDS = 64, 12


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def distances(left: list[str], right: list[str]) -> np.ndarray:
    """Edit distance of many string pairs, advancing whole groups column by column."""
    out = np.zeros(len(left), dtype=np.int64)
    groups: dict[int, list] = {}
    for k, (a, b) in enumerate(zip(left, right)):
        if a == b:
            continue
        a, b = trim(a, b)
        if not a or not b:
            out[k] = len(a) + len(b)
            continue
        if len(a) < len(b):
            a, b = b, a
        groups.setdefault((len(a) + 63) // 64, []).append((len(b), k, a, b))
    for n_words, members in groups.items():
        members.sort(key=lambda m: -m[0])
        symbols = max(len(set(m[2])) for m in members) + 1
        size = max(1, MAX_CELLS // (n_words * symbols))
        for start in range(0, len(members), size):
            chunk = members[start:start + size]
            if len(chunk) < GROUP_ROWS:
                for _, k, a, b in chunk:
                    out[k] = distance(a, b)
            else:
                out[[m[1] for m in chunk]] = _group_distances(chunk, n_words)
    return out


def _coded(chunk: list, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(masks of the symbols of every left side, symbols of every right side, both lengths) of a group.

    Members are (right length, number, left, right), longest right side first.
    """
    rows = len(chunk)
    lengths = np.array([len(m[2]) for m in chunk])
    widths = np.array([m[0] for m in chunk])
    pattern = _codes("".join(m[2] for m in chunk))
    row = np.repeat(np.arange(rows), lengths)
    # Symbols are numbered within each pair, so masks grow with a pair's symbols, not with the batch's.
    known, symbol = np.unique((row.astype(np.int64) << 32) | pattern, return_inverse=True)
    first = np.searchsorted(known, np.arange(rows, dtype=np.int64) << 32)
    symbol = symbol - first[row]
    other = int(symbol.max()) + 1
    place = np.arange(len(pattern)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    masks = np.zeros((rows, other + 1, n_words), dtype=np.uint64)
    np.bitwise_or.at(
        masks, (row, symbol, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64)
    )
    text = _codes("".join(m[3] for m in chunk))
    owner = np.repeat(np.arange(rows), widths)
    keys = (owner.astype(np.int64) << 32) | text
    found = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    text = np.where(known[found] == keys, found - first[owner], other)
    steps = int(widths[0])
    columns = np.full((rows, steps), other, dtype=np.int64)
    columns[np.arange(steps)[None, :] < widths[:, None]] = text
    return masks, columns, lengths, widths


def _group_distances(chunk: list, n_words: int, history: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Distances of a group; ``history`` receives the bits that a trace back needs.

    What it holds of word w after column c is at (c + w, row, w).  With a history, left sides may be shorter than the
    group's words, and the distances mean nothing.
    """
    masks, columns, lengths, widths = _coded(chunk, n_words)
    rows, steps = columns.shape
    one = np.uint64(1)
    vp = np.full((rows, n_words), ~np.uint64(0))
    vn = np.zeros((rows, n_words), dtype=np.uint64)
    carry_p = np.zeros((rows, n_words + 1), dtype=np.uint64)
    carry_n = np.zeros((rows, n_words + 1), dtype=np.uint64)
    carry_p[:, 0] = one
    shift = np.full((rows, n_words), 63, dtype=np.uint64)
    shift[:, -1] = ((lengths - 1) & 63).astype(np.uint64)
    score, index, word = lengths.astype(np.int64), np.arange(rows)[:, None], np.arange(n_words)
    # Word w reads column t - w at step t, so its carry from word w - 1 is ready.
    for t in range(steps + n_words - 1):
        lo, hi = max(0, t - steps + 1), min(n_words, t + 1)
        w = word[lo:hi]
        eq = masks[index, columns[:, t - w], w[None, :]]
        p, n, in_p, in_n = vp[:, lo:hi], vn[:, lo:hi], carry_p[:, lo:hi], carry_n[:, lo:hi]
        across = eq | n
        eq |= in_n
        diag = (((eq & p) + p) ^ p) | eq
        hp, hn = n | ~(diag | p), p & diag
        out_p, out_n = (hp >> shift[:, lo:hi]) & one, (hn >> shift[:, lo:hi]) & one
        up, down = (hp << one) | in_p, (hn << one) | in_n
        if history is not None:
            history[0][t, :, lo:hi] = diag | n
        vp[:, lo:hi], vn[:, lo:hi] = down | ~(across | up), up & across
        if history is not None:
            history[1][t, :, lo:hi] = vp[:, lo:hi]
        carry_p[:, lo + 1:hi + 1], carry_n[:, lo + 1:hi + 1] = out_p, out_n
        if hi == n_words:
            live = int(np.searchsorted(-widths, -(t - n_words + 1), side="left"))
            score[:live] += out_p[:live, -1].astype(np.int64) - out_n[:live, -1].astype(np.int64)
    return score


MATCH, SUBSTITUTE, DELETE, INSERT = "match", "substitution", "deletion", "insertion"


#: Kinds of a step by its number.
KINDS = (MATCH, SUBSTITUTE, DELETE, INSERT)
#: 64-bit words of alignment history held at a time.
HISTORY = 1 << 22
#: Characters compared at once on the way back.
STRIDE = 8


def _trace(a: str, b: str, i: int, j: int, stop: int, zero, vertical, offset: int, keep: bool, out: list) -> tuple[int, int]:
    """Walk back from (i, j) to column ``stop``: match, then substitution, deletion, insertion.

    ``zero(j, i)``: the cost did not rise along the diagonal; ``vertical(j, i)``: it rose down the column.
    """
    while i and j > stop:
        if a[i - 1] == b[j - 1]:
            # Matches that are not kept are passed over in strides.
            while not keep and i >= STRIDE and j - stop >= STRIDE and a[i - STRIDE:i] == b[j - STRIDE:j]:
                i -= STRIDE
                j -= STRIDE
            if not (i and j > stop and a[i - 1] == b[j - 1]):
                continue
            kind = 0
        elif not zero(j - 1 - offset, i - 1):
            kind = 1
        else:
            kind = 2 if vertical(j - 1 - offset, i - 1) else 3
        if kind or keep:
            out.append((kind, -1 if kind == 3 else i - 1, -1 if kind == 2 else j - 1))
        i -= kind != 3
        j -= kind != 2
    return i, j


def _finish(a: str, b: str, i: int, j: int, keep: bool, out: list) -> np.ndarray:
    """Steps in reading order, with what is left at the front and the matches at the end."""
    out.extend((2, k, -1) for k in range(i - 1, -1, -1))
    out.extend((3, -1, k) for k in range(j - 1, -1, -1))
    return np.array(out[::-1], np.int64).reshape(-1, 3)


def _tail(a: str, b: str, keep: bool) -> tuple[int, int, list]:
    tail = common_suffix(a, b)
    matches = [(0, len(a) - 1 - k, len(b) - 1 - k) for k in range(tail)] if keep else []
    return len(a) - tail, len(b) - tail, matches


def edit_script(a: str, b: str, keep: bool = True) -> np.ndarray:
    """Optimal alignment as rows (number of the kind, place in a, place in b); -1 where a side is absent.

    Matches are left out unless ``keep``.  States are kept for every so many columns only and the columns between are
    computed again on the way back, so memory grows with the square root of the second text.
    """
    i, j, out = _tail(a, b, keep)
    if i and j:
        masks, full = positions(a[:i]), (1 << i) - 1
        stride = j if i * j <= 64 * HISTORY else max(16, int(j ** 0.5))
        kept, state = [], (full, 0)
        for start in range(0, j, stride):
            kept.append(state)
            if start + stride < j:
                state = _advance(masks, b[start:start + stride], *state, full)
        while i and j:
            start = (j - 1) // stride * stride
            zero, vertical = [], []
            _advance(masks, b[start:j], *kept[start // stride], full, zero, vertical)
            i, j = _trace(a, b, i, j, start, lambda c, r, z=zero: (z[c] >> r) & 1,
                          lambda c, r, v=vertical: (v[c] >> r) & 1, start, keep, out)
    return _finish(a, b, i, j, keep, out)


def _rounded(n_words: int) -> int:
    """A number of words with few significant bits, so that lengths that differ a little share a group."""
    step = 1 << max(0, n_words.bit_length() - 3)
    return -(-n_words // step) * step


#: Edits up to which an alignment is found in a band of 64 diagonals: no best path leaves 32 below or 31 above the main one.
BAND_EDITS = 31


def _band_history(chunk: list, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits for a trace back inside a band that moves down a row per column (Hyyro 2003), one row of words per pair.

    Bit k of the first at column c (from 0) is for row c - 32 + k, of the second for row c - 31 + k.
    """
    masks, columns, _, _ = _coded(chunk, n_words)
    rows, steps = columns.shape
    none = np.zeros((rows, masks.shape[1], 1), np.uint64)
    masks = np.concatenate([none, masks] + [none] * (max(0, steps // 64 + 2 - n_words) + 1), axis=2)
    history = np.zeros((steps, rows), np.uint64), np.zeros((steps, rows), np.uint64)
    index, one = np.arange(rows), np.uint64(1)
    vp, vn = np.full(rows, ~np.uint64(0) << np.uint64(32)), np.zeros(rows, np.uint64)
    for c in range(steps):
        word, shift = divmod(c - 32, 64)
        eq = masks[index, columns[:, c], word + 1]
        if shift:
            eq = (eq >> np.uint64(shift)) | (masks[index, columns[:, c], word + 2] << np.uint64(64 - shift))
        diag = (((eq & vp) + vp) ^ vp) | eq | vn
        hp, hn, low = vn | ~(diag | vp), diag & vp, diag >> one
        vp, vn = hn | ~(low | hp), low & hp
        history[0][c], history[1][c] = diag, vp
    return np.ascontiguousarray(history[0].T), np.ascontiguousarray(history[1].T)


def _band_scripts(members: list, n_words: int, keep: bool, found: list) -> list:
    """Alignments of pairs with few edits; the members that have too many."""
    rest, start = [], 0
    members.sort(key=lambda m: -m[0])
    symbols = max(len(set(m[2])) for m in members) + 1
    while start < len(members):
        words = n_words + members[start][0] // 64 + 4
        chunk = members[start:start + max(1, min(MAX_CELLS // (words * symbols), HISTORY // (2 * members[start][0])))]
        start += len(chunk)
        if len(chunk) < GROUP_ROWS:
            rest += chunk
            continue
        diagonal, vertical = _band_history(chunk, n_words)
        for row, member in enumerate(chunk):
            j, k, a, b, out = member
            z, v, steps = memoryview(diagonal[row]), memoryview(vertical[row]), list(out)
            try:
                i, j = _trace(a, b, len(a), j, 0, lambda c, r: (z[c] >> (r - c + 32)) & 1,
                              lambda c, r: (v[c] >> (r - c + 31)) & 1, 0, keep, steps)
            except ValueError:  # above the band
                rest.append(member)
                continue
            if i + j + (sum(s[0] > 0 for s in steps) if keep else len(steps)) > BAND_EDITS:
                rest.append(member)
            else:
                found[k] = _finish(a, b, i, j, keep, steps)
    return rest


def edit_scripts(left: list[str], right: list[str], keep: bool = True) -> list[np.ndarray]:
    """``edit_script`` of many pairs: whole groups advance column by column into bit matrices, then are walked back.

    A band is tried first; what it finds at a cost below its width is the path that the whole matrix gives.
    """
    found: list = [None] * len(left)
    groups: dict[int, list] = {}
    for k, (a, b) in enumerate(zip(left, right)):
        i, j, out = _tail(a, b, keep)
        if i and j:
            groups.setdefault(_rounded((i + 63) // 64), []).append((j, k, a[:i], b[:j], out))
        else:
            found[k] = _finish(a, b, i, j, keep, out)
    for n_words, members in groups.items():
        if 1 < n_words <= SCRIPT_WORDS:
            near = [m for m in members if abs(len(m[2]) - m[0]) <= BAND_EDITS]
            if near:
                far = [m for m in members if abs(len(m[2]) - m[0]) > BAND_EDITS]
                groups[n_words] = far + _band_scripts(near, n_words, keep, found)
    for n_words, members in groups.items():
        if not members:
            continue
        members.sort(key=lambda m: -m[0])
        symbols = max(len(set(m[2])) for m in members) + 1
        start = 0
        while start < len(members):
            steps = members[start][0]
            size = min(MAX_CELLS // (n_words * symbols), HISTORY // (n_words * (steps + n_words)))
            chunk = members[start:start + max(1, size)]
            start += len(chunk)
            if size < 1 or n_words > SCRIPT_WORDS or len(chunk) < GROUP_ROWS:
                for _, k, _, _, _ in chunk:
                    found[k] = edit_script(left[k], right[k], keep)
                continue
            history = tuple(np.zeros((steps + n_words - 1, len(chunk), n_words), np.uint64) for _ in range(2))
            _group_distances(chunk, n_words, history)
            for row, (j, k, a, b, out) in enumerate(chunk):
                # Word w of column c of a row, as one sequence of integers.
                zero, vertical = (memoryview(h[:j + n_words - 1, row].tobytes()).cast("Q") for h in history)
                i, j = _trace(
                    a, b, len(a), j, 0,
                    lambda c, r, z=zero: (z[(c + (r >> 6)) * n_words + (r >> 6)] >> (r & 63)) & 1,
                    lambda c, r, v=vertical: (v[(c + (r >> 6)) * n_words + (r >> 6)] >> (r & 63)) & 1, 0, keep, out)
                found[k] = _finish(a, b, i, j, keep, out)
    return found


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    masks, full = positions(a), (1 << len(a)) - 1
    state = full
    for symbol in b:
        hit = state & masks.get(symbol, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def lcs_lengths(left: list[str], right: list[str]) -> np.ndarray:
    """``lcs_length`` of many pairs, advancing whole groups column by column."""
    out = np.zeros(len(left), dtype=np.int64)
    groups: dict[int, list] = {}
    for k, (a, b) in enumerate(zip(left, right)):
        if a and b:
            groups.setdefault(_rounded((len(a) + 63) // 64), []).append((len(b), k, a, b))
    for n_words, members in groups.items():
        members.sort(key=lambda m: -m[0])
        symbols = max(len(set(m[2])) for m in members) + 1
        size = max(1, MAX_CELLS // (n_words * symbols))
        for start in range(0, len(members), size):
            chunk = members[start:start + size]
            if len(chunk) < GROUP_ROWS:
                for _, k, a, b in chunk:
                    out[k] = lcs_length(a, b)
            else:
                out[[m[1] for m in chunk]] = _group_lcs(chunk, n_words)
    return out


def _group_lcs(chunk: list, n_words: int) -> np.ndarray:
    masks, columns, _, _ = _coded(chunk, n_words)
    rows, steps = columns.shape
    # Places beyond a row's own length hold no symbol and stay set; they count for nothing.
    state = np.full((rows, n_words), ~np.uint64(0))
    carry = np.zeros((rows, n_words + 1), dtype=np.uint64)
    index, word = np.arange(rows)[:, None], np.arange(n_words)
    # Word w reads column t - w at step t, so its carry from word w - 1 is ready.
    for t in range(steps + n_words - 1):
        lo, hi = max(0, t - steps + 1), min(n_words, t + 1)
        w = word[lo:hi]
        own = state[:, lo:hi]
        hit = own & masks[index, columns[:, t - w], w[None, :]]
        total = own + hit
        over = total < own
        total = total + carry[:, lo:hi]
        over |= total < carry[:, lo:hi]
        state[:, lo:hi] = total | (own & ~hit)
        carry[:, lo + 1:hi + 1] = over
    return n_words * 64 - np.bitwise_count(state).sum(axis=1).astype(np.int64)


# --- multiset overlap -----------------------------------------------------------

def overlap(codes_l, rows_l, codes_r, rows_r, n_rows: int, n_codes: int) -> np.ndarray:
    """Per row, the size of the multiset intersection of two coded item lists."""
    if n_rows * n_codes <= 16 * max(len(codes_l) + len(codes_r), 1024):
        left = np.bincount(rows_l * n_codes + codes_l, minlength=n_rows * n_codes)
        right = np.bincount(rows_r * n_codes + codes_r, minlength=n_rows * n_codes)
        return np.minimum(left, right).reshape(n_rows, n_codes).sum(axis=1)
    key_l, count_l = np.unique(rows_l * n_codes + codes_l, return_counts=True)
    key_r, count_r = np.unique(rows_r * n_codes + codes_r, return_counts=True)
    both, at_l, at_r = np.intersect1d(key_l, key_r, assume_unique=True, return_indices=True)
    shared = np.minimum(count_l[at_l], count_r[at_r])
    return np.bincount(both // n_codes, weights=shared, minlength=n_rows).astype(np.int64)


def char_overlaps(left: list[str], right: list[str]) -> np.ndarray:
    coded_l, coded_r = _codes("".join(left)), _codes("".join(right))
    # Code points are numbered by a table; sorting all characters of a batch took longer than its edit distances.
    seen = np.zeros(max(int(coded_l.max(initial=0)), int(coded_r.max(initial=0))) + 1, bool)
    seen[coded_l], seen[coded_r] = True, True
    number = np.cumsum(seen) - 1
    size_l, size_r = [len(s) for s in left], [len(s) for s in right]
    return overlap(
        number[coded_l], np.repeat(np.arange(len(left)), size_l),
        number[coded_r], np.repeat(np.arange(len(right)), size_r),
        len(left), max(int(number[-1]) + 1, 1),
    )


# --- tree edit distance on grids --------------------------------------------------

def grid_size(grid) -> int:
    """Nodes of table > row > cell."""
    return 1 + len(grid) + sum(len(row) for row in grid)


def _cell_costs(texts: list[str], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """1 - similarity of many pairs of texts, given by their numbers."""
    lengths = np.array([len(t) for t in texts])
    longest = np.maximum(np.maximum(lengths[left], lengths[right]), 1)
    if lengths.max(initial=0) > 63:
        return distances([texts[k] for k in left], [texts[k] for k in right]) / longest
    alphabet, symbol = np.unique(_codes("".join(texts)), return_inverse=True)
    steps = int(lengths.max(initial=0))
    symbols = np.full((len(texts), max(steps, 1)), len(alphabet))
    symbols[np.arange(max(steps, 1))[None, :] < lengths[:, None]] = symbol
    masks = np.zeros((len(texts), len(alphabet) + 1), dtype=np.uint64)
    row, place = np.nonzero(symbols < len(alphabet))
    np.bitwise_or.at(masks, (row, symbols[row, place]), np.uint64(1) << place.astype(np.uint64))
    one = np.uint64(1)
    vp, vn = np.full(len(left), ~np.uint64(0)), np.zeros(len(left), dtype=np.uint64)
    top = np.maximum(lengths[left] - 1, 0).astype(np.uint64)
    score = lengths[left].astype(np.int64)
    for j in range(steps):
        eq = masks[left, symbols[right, j]]
        across = eq | vn
        diag = (((eq & vp) + vp) ^ vp) | eq
        hp, hn = vn | ~(diag | vp), vp & diag
        change = ((hp >> top) & one).astype(np.int64) - ((hn >> top) & one).astype(np.int64)
        score += np.where(j < lengths[right], change, 0)
        up, down = (hp << one) | one, hn << one
        vp, vn = down | ~(across | up), up & across
    return np.where(lengths[left] == 0, lengths[right], score) / longest


def _row_cost(a, b, same_tag: bool, limit: float) -> float:
    """Cost of renaming row ``a`` cell by cell to ``b``; infinite once above ``limit``."""
    if not same_tag:
        return float(len(a)) if len(a) <= limit else np.inf
    if a == b:
        return 0.0
    # Every letter that only one side has takes an edit, which often rules a row out before any distance is computed.
    least, differing = 0.0, []
    for x, y in zip(a, b):
        if x != y:
            longest = max(len(x), len(y))
            own, other = set(x), set(y)
            bound = max(len(own - other), len(other - own), abs(len(x) - len(y)), 1) / longest
            least += bound
            if least > limit + 1e-9:
                return np.inf
            differing.append((x, y, longest, bound))
    cost = 0.0
    for x, y, longest, bound in differing:
        least -= bound
        cost += distance(x, y) / longest
        if cost + least > limit + 1e-9:
            return np.inf
    return cost if cost <= limit else np.inf


def _settled(ref, pred) -> float | None:
    """The distance when a bound already proves it, else None.

    Take grids of one width where the longer has k extra rows.  A mapping that
    only deletes must keep whole rows in order, so the cheapest one is a row
    alignment.  Any other mapping also inserts a node and deletes one more,
    which costs 2 on top of the size difference; an alignment whose renames
    cost at most 2 is therefore optimal.
    """
    if ref == pred:
        return 0.0
    if len(ref[0]) != len(pred[0]):
        return None
    long, short = (ref, pred) if len(ref) >= len(pred) else (pred, ref)
    extra = len(long) - len(short)
    # Equal rows at either end are aligned with each other in a cheapest alignment; a header with the other header only.
    first, last = 0, len(short)
    while first < last and long[first] == short[first]:
        first += 1
    while last > max(first, 1) and long[last + extra - 1] == short[last - 1]:
        last -= 1
    best = [0.0] * (extra + 1)
    for j in range(first, last):
        row = short[j]
        reach, line = np.inf, []
        for t in range(extra + 1):
            reach = min(reach, best[t])
            limit = 2.0 - reach
            line.append(np.inf if limit < 0 else reach + _row_cost(
                long[j + t], row, (j + t == 0) == (j == 0), limit))
        best = line
    renames = min(best)
    return extra * (len(ref[0]) + 1) + renames if renames <= 2.0 else None


#: Alignments with more steps are settled one by one, where most steps are passed over.
SETTLED_STEPS = 1 << 14


def _settled_together(pairs: list) -> list[float | None]:
    """``_settled`` of many pairs: those of one shape are aligned at once, diagonal by diagonal."""
    out: list[float | None] = [None] * len(pairs)
    shapes: dict[tuple, list[int]] = {}
    for k, (ref, pred) in enumerate(pairs):
        if ref == pred:
            out[k] = 0.0
        elif len(ref[0]) == len(pred[0]):
            rows = max(len(ref), len(pred)), min(len(ref), len(pred))
            if rows[1] * (rows[0] - rows[1] + 1) > SETTLED_STEPS:
                out[k] = _settled(ref, pred)
            else:
                shapes.setdefault((*rows, len(ref[0])), []).append(k)
    for (n_long, n_short, width), members in shapes.items():
        size = max(1, MAX_CELLS // (8 * n_short * max(width, n_long - n_short + 1)))
        for start in range(0, len(members), size):
            chunk = members[start:start + size]
            sides = [sorted(pairs[k], key=len, reverse=True) for k in chunk]
            for k, found in zip(chunk, _settled_shape(sides, n_long - n_short, width).tolist()):
                out[k] = found if found < np.inf else None
    return out


def _settled_shape(pairs: list, extra: int, width: int) -> np.ndarray:
    """What ``_settled`` finds for pairs (longer, shorter) of one shape; infinite where nothing is proven."""
    sides = [[t for grid in side for row in grid for t in row] for side in zip(*pairs)]
    texts = list(dict.fromkeys(sides[0] + sides[1]))
    known = {t: k for k, t in enumerate(texts)}
    long, short = (np.array([known[t] for t in side]).reshape(len(pairs), -1, width) for side in sides)
    n_short = short.shape[1]
    lengths = np.array([len(t) for t in texts])
    # Letters as bits, several letters to a bit at worst: a bit that only one side has takes an edit.
    letters = np.zeros(len(texts), np.uint64)
    np.bitwise_or.at(letters, np.repeat(np.arange(len(texts)), lengths), np.uint64(1) << (_codes("".join(texts)) & 63).astype(np.uint64))
    costs = np.full((len(pairs), n_short, extra + 1), np.inf)
    for t in range(extra + 1):
        a, b = long[:, t:t + n_short], short
        own, other = letters[a], letters[b]
        least = np.maximum(np.bitwise_count(own & ~other), np.bitwise_count(other & ~own)).astype(np.int64)
        least = np.maximum(np.maximum(least, np.abs(lengths[a] - lengths[b])), 1)
        least = np.where(a == b, 0.0, least / np.maximum(np.maximum(lengths[a], lengths[b]), 1)).sum(axis=2)
        pair, row = np.nonzero(least <= 2.0 + 1e-9)
        x, y = a[pair, row], b[pair, row]
        keys, inverse = np.unique(x * len(texts) + y, return_inverse=True)
        each = np.zeros(len(keys))
        left, right = keys // len(texts), keys % len(texts)
        differ = np.flatnonzero(left != right)
        if len(differ):
            used, place = np.unique(np.concatenate([left[differ], right[differ]]), return_inverse=True)
            each[differ] = _cell_costs([texts[k] for k in used.tolist()], *np.split(place, 2))
        each, cost = each[inverse].reshape(x.shape), np.zeros(len(pair))
        for column in range(width):
            cost += each[:, column]
        costs[pair, row, t] = cost
    # A header is renamed to a body row cell by cell.
    costs[:, 0, 1:] = width
    best = np.zeros((len(pairs), extra + 1))
    for j in range(n_short):
        reach = np.minimum.accumulate(best, axis=1)
        best = np.where(costs[:, j] <= 2.0 - reach, reach + costs[:, j], np.inf)
    renames = best.min(axis=1)
    return np.where(renames <= 2.0, extra * (width + 1) + renames, np.inf)


def grid_distances(pairs: list) -> np.ndarray:
    """Exact ordered tree edit distance of many (grid, grid) pairs.

    Insert and delete cost 1; renaming across tags costs 1; renaming a cell
    to one with the same tag costs 1 minus their text similarity.
    """
    out = np.zeros(len(pairs))
    shapes: dict[tuple, list[int]] = {}
    for k, ((ref, pred), known) in enumerate(zip(pairs, _settled_together(pairs))):
        if known is not None:
            out[k] = known
        else:
            shapes.setdefault((len(ref), len(ref[0]), len(pred), len(pred[0])), []).append(k)
    for shape, members in shapes.items():
        n1, c1, n2, c2 = shape
        size = max(1, MAX_CELLS // ((n1 * (c1 + 1) + 1) * (n2 * (c2 + 1) + 1)))
        for start in range(0, len(members), size):
            chunk = members[start:start + size]
            out[chunk] = _shape_distances([pairs[k] for k in chunk], *shape)
    return out


def _shape_distances(pairs: list, n1: int, c1: int, n2: int, c2: int) -> np.ndarray:
    """Forest distance of row forests, all pairs of one shape at once."""
    vocabulary: dict[str, int] = {}
    coded = [
        [[vocabulary.setdefault(t, len(vocabulary)) for row in grid for t in row] for grid in side]
        for side in zip(*pairs)
    ]
    left, right = np.array(coded[0]), np.array(coded[1])
    texts = list(vocabulary)
    keys, inverse = np.unique(
        left[:, :, None] * len(texts) + right[:, None, :], return_inverse=True
    )
    costs = _cell_costs(texts, keys // len(texts), keys % len(texts))
    cell = costs[inverse].reshape(len(pairs), n1, c1, n2, c2)
    cell[:, 0, :, 1:, :] = 1.0  # header cell against body cell: different tags
    cell[:, 1:, :, 0, :] = 1.0

    batch, s1, s2 = len(pairs), c1 + 1, c2 + 1
    row_pairs = np.zeros((batch, n1, n2, s1, s2))
    row_pairs[..., 0] = np.arange(s1)
    row_pairs[..., 0, :] = np.arange(s2)
    for x in range(1, s1):
        for y in range(1, s2):
            row_pairs[..., x, y] = np.minimum(
                np.minimum(row_pairs[..., x - 1, y], row_pairs[..., x, y - 1]) + 1,
                row_pairs[..., x - 1, y - 1] + cell[:, :, x - 1, :, y - 1],
            )
    # Subtree distances, nodes of a row in postorder: its cells, then the row.
    tree = np.empty((batch, n1, s1, n2, s2))
    tree[:, :, :c1, :, :c2] = cell
    tree[:, :, c1, :, :c2] = c1 + np.minimum(1.0, cell.min(axis=2))
    tree[:, :, :c1, :, c2] = c2 + np.minimum(1.0, cell.min(axis=4))
    tree[:, :, c1, :, c2] = row_pairs[..., c1, c2]
    tree = tree.reshape(batch, n1 * s1, n2 * s2)

    size1 = np.tile(np.r_[np.ones(c1, int), s1], n1)
    size2 = np.tile(np.r_[np.ones(c2, int), s2], n2)
    nodes1, nodes2 = n1 * s1, n2 * s2
    forest = np.zeros((batch, nodes1 + 1, nodes2 + 1))
    forest[:, :, 0] = np.arange(nodes1 + 1)
    forest[:, 0, :] = np.arange(nodes2 + 1)
    for diagonal in range(2, nodes1 + nodes2 + 1):
        i = np.arange(max(1, diagonal - nodes2), min(nodes1, diagonal - 1) + 1)
        j = diagonal - i
        apart = np.minimum(forest[:, i - 1, j], forest[:, i, j - 1]) + 1
        joined = forest[:, i - size1[i - 1], j - size2[j - 1]] + tree[:, i - 1, j - 1]
        forest[:, i, j] = np.minimum(apart, joined)
    return forest[:, nodes1, nodes2]


# --- one-to-one assignment --------------------------------------------------------

def assign(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a one-to-one matching with the largest total score."""
    if score.shape[0] > score.shape[1]:
        return sorted((r, c) for c, r in assign(score.T))
    cost = score.max() - score
    n, m = cost.shape
    potential_r, potential_c = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        shortest, came_from = np.full(m, np.inf), np.full(m, -1)
        done = np.zeros(m, dtype=bool)
        row, column, reached = start, -1, 0.0
        visited = [start]
        while True:
            slack = reached + cost[row] - potential_r[row] - potential_c
            better = ~done & (slack < shortest)
            shortest[better], came_from[better] = slack[better], column
            column = int(np.argmin(np.where(done, np.inf, shortest)))
            reached = shortest[column]
            done[column] = True
            if owner[column] < 0:
                break
            row = int(owner[column])
            visited.append(row)
        potential_r[start] += reached
        inner = [c for c in np.flatnonzero(done) if c != column]
        for c in inner:
            potential_r[owner[c]] += reached - shortest[c]
            potential_c[c] -= reached - shortest[c]
        while column >= 0:
            previous = int(came_from[column])
            owner[column] = owner[previous] if previous >= 0 else start
            column = previous
    return sorted((int(r), c) for c, r in enumerate(owner) if r >= 0)


# --- boxes ---------------------------------------------------------------------

def best_ious(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The highest IoU of every left box (x1, y1, x2, y2) with a right one; NaN stands for NULL, as ``geometry.iou`` treats it.

    Both sides go down the page, so a run of left boxes is compared with the right ones between its top and bottom only.
    """
    out = np.zeros(len(left))
    gaps = bool(np.isnan(left).any() or np.isnan(right).any())
    right = right[np.argsort(right[:, 1], kind="stable")]
    # No box before a place reaches farther down than this.
    reach = np.maximum.accumulate(right[:, 3])
    order = np.argsort(left[:, 1], kind="stable")
    size = max(1, min(256, MAX_CELLS // max(1, len(right))))
    for start in range(0, len(order), size):
        rows = order[start:start + size]
        a = left[rows]
        lo = 0 if gaps else int(np.searchsorted(reach, a[:, 1].min(), side="right"))
        hi = len(right) if gaps else int(np.searchsorted(right[:, 1], a[:, 3].max(), side="left"))
        if lo >= hi:
            continue
        ax1, ay1, ax2, ay2 = (a[:, k, None] for k in range(4))
        bx1, by1, bx2, by2 = (right[None, lo:hi, k] for k in range(4))
        inside = np.fmax(0.0, np.fmin(ax2, bx2) - np.fmax(ax1, bx1)) * np.fmax(
            0.0, np.fmin(ay2, by2) - np.fmax(ay1, by1))
        union = (np.fmax(0.0, ax2 - ax1) * np.fmax(0.0, ay2 - ay1)
                 + np.fmax(0.0, bx2 - bx1) * np.fmax(0.0, by2 - by1) - inside)
        out[rows] = np.divide(inside, union, out=np.zeros_like(inside), where=(inside > 0) & (union > 0)).max(axis=1)
    return out
