"""Near duplicates: banded MinHash candidates, sequential Bayesian verification, exact check of survivors.

1. One pass over the texts gives each document the size of its shingle set, a
   128-bit digest of its words, a signature of minima (one byte each) and the
   keys of its bands.  Documents with equal words form one class, represented
   by its smallest id; everything below sees representatives only, under
   numbers of their own that follow the order of the ids.
2. First round: the smallest member of a bucket (band key) is its center, and
   every document is paired with one center only, the one with which it shares
   most buckets, so there are never more candidates than documents.
3. A candidate's signatures are compared batch by batch.  With a uniform prior
   the similarity after ``m`` minima with ``k`` matches is Beta(k+1, m-k+1); a
   pair is dropped as soon as the posterior probability of reaching the
   threshold is below ``MISS``.
4. Documents connected by survivors are a family.  Its members are dealt out as
   blocks that meet in pairs; there, pairs that no batch rules out are checked
   exactly on their full shingle sets, unless their components have become one
   meanwhile.  A text is sent once per block pair, and at most as many links as
   members become rows, however many pairs of a block are similar.
5. Links give components by hooking to the smallest neighbour, pointer jumping
   and contraction.
6. Second round: members of *different* components are compared inside each
   bucket, again in blocks that meet in pairs, and again only a forest over the
   survivors becomes rows.  The families it gives are checked as in step 4, and
   components are formed anew from all links.

A pair at the threshold shares no band with probability below 1e-5 (128
minima, bands of 4); that and ``MISS`` are the only ways to lose a link.

Defined results: a null or empty text has an empty set and is linked with
nothing; a null document id is its own row with a null component (but
``deduplicated`` takes part in the graph with it, after all ids); rows that
repeat an id are judged each by its own text, and so are their components; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegauge.llm.batches import slices
from pagegauge.llm.store import fresh, settled
from pagegauge.llm.words import digest, mixed, shingle_sets, words_of

MINIMA, ROWS, SHINGLE = 128, 4, 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Chosen probability of dropping a pair that reaches the threshold, at each look.
MISS = 1e-7
BATCH = 16
#: Members of a block in the second round.
BLOCK = 256
#: Members of a block in exact checks, and pairs screened at a time.
FAMILY_BLOCK, CHUNK = 384, 1 << 15
#: Bound of the broadcast bit map of ids: 2**24 bits are 262,144 rows of 64 bits.
MAP_BITS = 24


@cache
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(3)
    return (rng.integers(1, 1 << 32, MINIMA, np.uint32) | np.uint32(1),
            rng.integers(0, 1 << 32, MINIMA, np.uint32))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest of each of the MINIMA hash functions over a set of 64-bit shingle hashes."""
    a, b = _multipliers()
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 2048):
        value = low[k:k + 2048, None] * a + b
        value ^= high[k:k + 2048, None]
        value *= np.uint32(0x9E3779B1)
        np.minimum(out, value.min(0), out=out)
    return out


def band_keys(minimum: np.ndarray) -> np.ndarray:
    bands = minimum.reshape(-1, ROWS).astype(np.uint64)
    key = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, k])
    return key.view(np.int64)


@cache
def fewest_matches(miss: float = MISS, percent: int = PERCENT) -> tuple[int, ...]:
    """After each batch, the fewest matching minima with which a pair may still reach the threshold.

    A byte of a minimum also matches by chance, in 1 of 256 cases.
    """
    s = percent / 100
    p = s + (1 - s) / 256
    found = []
    for m in range(BATCH, MINIMA + 1, BATCH):
        # P(Beta(k+1, m-k+1) >= p) = P(Binomial(m+1, p) <= k)
        below, k = 0.0, -1
        while below < miss:
            k += 1
            below += comb(m + 1, k) * p ** k * (1 - p) ** (m + 1 - k)
        found.append(k)
    return tuple(found)


def plausible(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Indexes of the rows of two signature arrays that no batch rules out."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    for k, fewest in enumerate(fewest_matches()):
        if not len(alive):
            break
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (left[alive, part] == right[alive, part]).sum(1)
        keep = matches >= fewest
        alive, matches = alive[keep], matches[keep]
    return alive


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = [words_of(t) for t in part.column("text").to_pylist()]
            sets = shingle_sets(words, SHINGLE)
            mins = [minima(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"),
                part.column("raw"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([digest(w) if w else None for w in words], pa.binary()),
                pa.array([None if m is None else ((m * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(
                    np.uint8).tobytes() for m in mins], pa.binary()),
                pa.array([None if m is None else band_keys(m) for m in mins], pa.list_(pa.int64())),
            ], ["doc_id", "raw", "n_shingles", "words", "signature", "bands"])


def raw_key(text: str = "text") -> Column:
    """Tells texts apart without Python; a null counts as an empty text."""
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))


def features(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), raw_key().alias("raw"), F.col("text").cast("string").alias("text")
    ).mapInArrow(_features, "doc_id long, raw string, n_shingles long, words binary, signature binary, bands array<long>")


def _signatures(column: pa.Array) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint8).reshape(-1, MINIMA)


def _size_fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            kept = plausible(_signatures(batch.column("sig_a")), _signatures(batch.column("sig_b")))
            yield batch.select(["a", "b"]).take(pa.array(kept))


def _forest(nodes: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest number reachable from each of ``nodes`` numbers over edges (x, y)."""
    label = np.arange(nodes)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _linked(members: pa.Table) -> pa.Table:
    """Links that join components of two blocks of a family (or of one), exactly checked."""
    members = members.sort_by("node")
    node, component = members.column("node").to_numpy(), members.column("component").to_numpy()
    n, block = members.column("n").to_numpy(), members.column("block").to_numpy()
    signature = _signatures(members.column("signature"))
    x, y = np.triu_indices(len(node), 1)
    apart = (component[x] != component[y]) & _size_fits(n[x], n[y])
    if block.min() != block.max():
        apart &= block[x] != block[y]
    x, y = x[apart], y[apart]
    kept = np.concatenate([np.zeros(0, np.int64), *[
        k + plausible(signature[x[k:k + CHUNK]], signature[y[k:k + CHUNK]]) for k in range(0, len(x), CHUNK)]])
    x, y = x[kept], y[kept]
    used = np.unique(np.concatenate([x, y]))
    words = [words_of(t) for t in members.column("text").take(pa.array(used)).to_pylist()]
    sets = dict(zip(used.tolist(), shingle_sets(words, SHINGLE), strict=True))
    parent = {c: c for c in component.tolist()}

    def top(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    links = []
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        p, q = top(component[i]), top(component[j])
        if p != q:
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * common >= PERCENT * (len(sets[i]) + len(sets[j]) - common):
                parent[max(p, q)] = min(p, q)
                links.append((int(node[i]), int(node[j])))
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def holding(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, text) of the nodes in ``rows`` (node, doc_id, raw); most other texts are left out before the exchange.

    A bit map of the hashed ids, of at most 2**MAP_BITS bits, is broadcast as rows of 64 bits; the join after it is
    exact.  With more ids than bits it lets all texts pass.
    """
    rows = settled(rows, "minhash-ids")
    bits = min(1 << MAP_BITS, 1 << max(16, (16 * rows.count()).bit_length()))
    place = F.pmod(F.xxhash64("doc_id", "raw"), F.lit(bits))
    same = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), "raw"]
    keys = ["_id", "_none", "raw"]

    words = rows.select((place / 64).cast("long").alias("_word"), (place % 64).cast("int").alias("_bit")
                        ).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_map"))
    near = texts.withColumn("_word", (place / 64).cast("long")).join(F.broadcast(words), "_word").where(
        F.getbit("_map", (place % 64).cast("int")) == 1).select(*same, "text")
    # Rows with one id and text are one node.
    return near.dropDuplicates(keys).join(rows.select(*same, "node"), keys).select("node", "text")


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, component): the smallest node reachable over undirected links (a, b).

    Every node hooks to its smallest neighbour, chains of hooks are doubled until they end, and the links between
    what is left are contracted; each round works on the remaining links only.
    """
    def ordered(a: str, b: str) -> list:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    edges = settled(links.select(*ordered("a", "b")).where("a != b").distinct(), f"{name}-links")
    found = None
    while True:
        both = edges.select(F.col("a").alias("node"), "b").union(edges.select(F.col("b").alias("node"), "a"))
        hooks = settled(both.groupBy("node").agg(F.least("node", F.min("b")).alias("label")), f"{name}-hooks")
        moving = True
        while moving:
            jump = hooks.select(F.col("node").alias("label"), F.col("label").alias("_to"))
            further = settled(hooks.join(jump, "label").select("node", "label", "_to"), f"{name}-hooks")
            moving = not further.where("label != _to").isEmpty()
            hooks = further.select("node", F.col("_to").alias("label"))
        if found is None:
            found = hooks
        else:
            step = hooks.select(F.col("node").alias("label"), F.col("label").alias("_to"))
            found = settled(found.join(step, "label", "left").select(
                "node", F.coalesce("_to", "label").alias("label")), f"{name}-labels")
        ends = [hooks.select(F.col("node").alias(end), F.col("label").alias(f"_{end}")) for end in ("a", "b")]
        edges = settled(edges.join(ends[0], "a").join(ends[1], "b").where("_a != _b").select(
            *ordered("_a", "_b")).distinct(), f"{name}-links")
        if edges.isEmpty():
            return found.select("node", F.col("label").alias("component"))


def confirmed(survivors: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) within the families that survivors (a, b) connect.

    ``members``: (node, component, n, signature, doc_id, raw); ``texts``: (doc_id, raw, text).
    """
    families = components(survivors, "minhash-families")
    sizes = families.groupBy("component").agg(F.ceil(F.count("*") / FAMILY_BLOCK).cast("int").alias("blocks"))
    placed = settled(families.join(sizes, "component").select(
        "node", F.col("component").alias("family"), "blocks",
        F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")), "minhash-placed")
    own = settled(placed.join(members, "node"), "minhash-placed")
    full = own.join(holding(texts, own.select("node", "doc_id", "raw")), "node")
    # Block k meets every block, itself included.
    pairs = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "node", "component", "n", "block", "signature", "text")

    def check(key, table):
        return _linked(table)

    return pairs.groupBy("family", "i", "j").applyInArrow(check, "a long, b long")


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What survivors among the members of two blocks connect; only different components are compared."""
    def arrays(members: dict):
        return (np.array(members["node"], np.int64), np.array(members["component"], np.int64),
                np.array(members["n"], np.int64), np.frombuffer(b"".join(members["sig"]), np.uint8).reshape(-1, MINIMA))

    for batch in batches:
        for row in batch.to_pylist():
            node_a, comp_a, n_a, sig_a = arrays(row["left"])
            node_b, comp_b, n_b, sig_b = arrays(row["right"])
            close = (comp_a[:, None] != comp_b) & _size_fits(n_a[:, None], n_b)
            close &= (node_a[:, None] < node_b) if row["i"] == row["j"] else (node_a[:, None] != node_b)
            x, y = np.nonzero(close)
            kept = np.concatenate([np.zeros(0, np.int64), *[
                k + plausible(sig_a[x[k:k + CHUNK]], sig_b[y[k:k + CHUNK]]) for k in range(0, len(x), CHUNK)]])
            # Instead of all survivors, each member with the smallest one it is connected to.
            every = np.unique(np.concatenate([node_a[x[kept]], node_b[y[kept]]]))
            smallest = every[_forest(len(every), np.searchsorted(every, node_a[x[kept]]),
                                     np.searchsorted(every, node_b[y[kept]]))]
            edge = smallest != every
            yield pa.RecordBatch.from_arrays([pa.array(smallest[edge]), pa.array(every[edge])], ["a", "b"])


def _judged(docs: DataFrame, nameless: bool) -> DataFrame:
    """(doc_id, raw, n_shingles, words, first_raw, component_id, kept), one row per document.

    ``kept``: it is of the smallest class of its component, and has the smallest id there; ``first_raw``: the smallest
    text with that id in its class.  Without ``nameless``, rows without an id are linked with nothing.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_key().alias("raw"),
                        F.col("text").cast("string").alias("text"))
    feats = settled(features(docs), "minhash-features")
    found = feats.where("words is not null" if nameless else "words is not null and doc_id is not null")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw")).alias("_first")
    classes = settled(found.groupBy("words").agg(least).select("words", "_first.*").orderBy(
        "none", "doc_id", "raw", "words").select(
        "words", F.col("doc_id").alias("first_id"), F.col("raw").alias("first_raw"),
        F.monotonically_increasing_id().alias("node")), "minhash-classes")
    first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("raw") == F.col("first_raw"))
    nodes = settled(found.join(classes, "words").where(first).dropDuplicates(["words"]).select(
        "node", "doc_id", "raw", F.col("n_shingles").alias("n"), "signature", "bands"), "minhash-nodes")

    bands = nodes.select("node", "n", F.explode("bands").alias("band"))
    centers = bands.groupBy("band").agg(F.min("node").alias("center"), F.count("*").alias("size")).where("size > 1")
    members = settled(bands.join(centers, "band"), "minhash-members")

    signatures = nodes.select("node", "signature", "n")
    left = signatures.select(F.col("node").alias("a"), F.col("signature").alias("sig_a"), F.col("n").alias("n_a"))
    right = signatures.select(F.col("node").alias("b"), F.col("signature").alias("sig_b"), F.col("n").alias("n_b"))
    fits = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")

    shared = members.where("node != center").groupBy("node", "center").agg(F.count("*").alias("_c"))
    stars = shared.groupBy("node").agg(F.max(F.struct("_c", (-F.col("center")).alias("_minus"))).alias("_best")).select(
        (-F.col("_best._minus")).alias("a"), F.col("node").alias("b"))
    screened = stars.join(right, "b").join(left, "a").where(fits).select("a", "b", "sig_a", "sig_b").mapInArrow(
        _screen, "a long, b long")
    alone = nodes.select("node", F.col("node").alias("component"), "n", "signature", "doc_id", "raw")
    first = settled(confirmed(settled(screened, "minhash-first"), alone, texts), "minhash-links")
    labels = components(first, "minhash-first")

    # Buckets whose members lie in different components.
    labelled = members.join(labels, "node", "left").select(
        "band", "node", "n", F.coalesce("component", "node").alias("component"))
    open_bands = labelled.groupBy("band").agg(
        F.min("component").alias("_low"), F.max("component").alias("_high"), F.count("*").alias("size")).where(
        "_low != _high").select("band", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    in_blocks = labelled.join(open_bands, "band").join(
        nodes.select("node", "signature"), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    fields = F.sort_array(F.collect_list(F.struct("node", "component", "n", F.col("signature").alias("sig"))))
    blocks = settled(in_blocks.groupBy("band", "block", "blocks").agg(fields.alias("m")).select(
        "band", F.col("block").cast("int").alias("block"), "blocks",
        F.struct(*[F.col(f"m.{c}").alias(c) for c in ("node", "component", "n", "sig")]).alias("m")), "minhash-blocks")
    lefts = blocks.select("band", F.col("block").alias("i"), F.col("m").alias("left"),
                          F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    rights = blocks.select("band", F.col("block").alias("j"), F.col("m").alias("right"))
    crossed = lefts.join(rights, ["band", "j"]).select("i", "j", "left", "right").mapInArrow(
        _cross, "a long, b long").distinct()
    joined = alone.drop("component").join(labels, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    second = settled(confirmed(settled(crossed, "minhash-second"), joined, texts), "minhash-links")
    if not second.isEmpty():
        labels = components(first.union(second), "minhash-all")

    roots = labels.join(classes.select(F.col("node").alias("component"), F.col("first_id").alias("_root")), "component")
    judged = feats.select("doc_id", "raw", "n_shingles", "words").join(classes, "words", "left").join(
        roots.select("node", "component", "_root"), "node", "left")
    root = F.when(F.col("component").isNotNull(), F.col("_root")).when(
        F.col("node").isNotNull(), F.col("first_id")).otherwise(F.col("doc_id"))
    kept = F.coalesce("component", "node").eqNullSafe(F.col("node")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    alone = F.col("words").isNull() if nameless else F.col("words").isNull() | F.col("doc_id").isNull()
    return judged.select("doc_id", "raw", "n_shingles", "words", "first_raw",
                         F.when(F.col("doc_id").isNotNull(), root).alias("component_id"), (alone | kept).alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per document."""
    return _judged(docs, nameless=False).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The smallest row of each component, with all its columns; of rows that repeat an id and their words, one.

    Rows without an id are linked as others are, and come after all ids; those of them without words all stay.
    """
    judged = _judged(docs, nameless=True).where("kept")
    wordless = judged.where("words is null and doc_id is not null").groupBy("doc_id").agg(F.min("raw").alias("raw"))
    chosen = judged.where("words is not null and raw = first_raw").select("doc_id", "raw").union(
        wordless.select("doc_id", "raw")).distinct()
    names = id_, none, raw = [fresh(docs, c) for c in ("_id", "_none", "_raw")]

    def keyed(rows: DataFrame, key: Column) -> DataFrame:
        own = F.col("doc_id").cast("long")
        return rows.withColumns({id_: F.coalesce(own, F.lit(0)), none: own.isNull(), raw: key})

    wanted = keyed(chosen, F.col("raw")).select(names)
    rows = keyed(docs, raw_key()).join(wanted, names, "left_semi").dropDuplicates(names).select(docs.columns)
    blank = ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
    return rows.union(docs.where(F.col("doc_id").cast("long").isNull() & blank))
