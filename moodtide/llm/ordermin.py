"""Near duplicates by order MinHash: candidates from ordered minimum shingles, verified by banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import plain_text, written

#: Words per shingle and least similarity (the contract's defaults).
SHINGLE = 5
THRESHOLD = 0.8
#: Sketch: bands, and ordered minima in each. Two long texts with similarity 0.8 share a band with probability 0.997,
#: with 0.9 practically always, with 0.3 with 0.002. Few shingles make it less, so pairs with a text of fewer than
#: EXACT different shingles are found by their rarest shingles as well, without loss.
BANDS = 32
MINIMA = 8
EXACT = 40
#: Bands in which close relatives agree at once, in the order tried; most rows of an id list sent to every executor.
CLOSE = (8, 4, 2)
#: Texts of a band up to which they are paired, texts in a block beyond, and blocks in a row of a grid cell.
FEW = 8
BLOCK = 48
GRID = 4
SENT_ROWS = 500_000
#: Bytes of hashes that a worker remembers between comparisons.
PREPARED = 32 << 20

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xBF58476D1CE4E5B9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _Q
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word of a text, in order; words are lower-cased."""
    raw = np.frombuffer(b" ".join(text.lower().encode("utf-8", "replace").split()), np.uint8)
    if not raw.size:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(raw == 32)
    start, end = np.concatenate([[0], gaps + 1]), np.append(gaps, raw.size)
    powers = np.cumprod(np.full(raw.size, _P, np.uint64))
    inverse = np.cumprod(np.full(raw.size, np.uint64(pow(int(_P), -1, 1 << 64)), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers)])
    return _mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A hash of every run of ``size`` words in order; a shorter text has its whole as the only one."""
    n = max(words.size - size + 1, 1) if words.size else 0
    out = np.full(n, np.uint64(words.size if words.size < size else size), np.uint64)
    for k in range(min(size, words.size)):
        out = _mix(out * _P + words[k:k + n])
    return out


def labelled(shingles: np.ndarray) -> np.ndarray:
    """The hashes with the number of each equal one before it mixed in, so that repetitions differ."""
    order = np.argsort(shingles, kind="stable")
    ranked = shingles[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if first.all():
        return shingles
    at = np.arange(ranked.size)
    out = np.empty_like(shingles)
    out[order] = _mix(ranked + (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64) * _Q)
    return out


_SEEDS = _mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _P)


def band_keys(shingles: np.ndarray) -> np.ndarray | None:
    """One key per band: of the shingles with the least permuted hashes, the hashes in text order. None without words."""
    if not shingles.size:
        return None
    marks = labelled(shingles)
    most = min(MINIMA, marks.size)
    keys = np.empty(BANDS, np.uint64)
    step = max(1, (1 << 20) // marks.size)
    for low in range(0, BANDS, step):
        seeds = _SEEDS[low:low + step, None]
        permuted = (marks[None, :] ^ seeds) * (seeds | np.uint64(1))
        permuted ^= permuted >> np.uint64(32)
        permuted *= _Q
        least = np.argpartition(permuted, most - 1, axis=1)[:, :most] if most < marks.size else np.tile(np.arange(most), (seeds.size, 1))
        inside = marks[np.sort(least, axis=1)]
        key = seeds[:, 0].copy()
        for k in range(most):
            key = _mix(key * _P + inside[:, k])
        keys[low:low + step] = key
    return keys.view(np.int64)


def node_of(text: Column) -> Column:
    """What stands for a text in all joins: its md5; null for a text without words."""
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5(text)))


def sketched(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, node, keys and short of every row; both are null where the same text stood in the batch before.

    ``short`` has the different shingles of a text that may be linked to one of fewer than EXACT.
    """
    most = int((EXACT - 1) / threshold + 1e-9)
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), node_of(plain_text()).alias("node"), plain_text().alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            again = batch["node"].duplicated() | batch["node"].isna()
            keys, short = [], []
            for text, skip in zip(batch["_text"], again):
                shingles = shingle_hashes(word_hashes("" if skip else text))
                keys.append(band_keys(shingles))
                short.append(short_shingles(shingles, most) if shingles.size else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "node": batch["node"], "keys": keys, "short": short})

    return texts.mapInPandas(run, "doc_id string, node binary, keys array<bigint>, short array<bigint>").withColumn("doc_id", F.col("doc_id").cast(kind))


def short_shingles(shingles: np.ndarray, most: int) -> np.ndarray | None:
    """The different shingle hashes of a text, None if they are more than ``most``."""
    shingles = np.unique(shingles)
    return shingles.view(np.int64) if shingles.size <= most else None


def rare_keys(nodes: DataFrame, threshold: float) -> DataFrame:
    """node and key: of each short text the shingles one of which every linked short text shares.

    A prefix filter: with all shingles in one order, two sets of similarity t share one of the first
    n - ceil(t * n) + 1 of each. The order puts shingles of many texts last, so that common passages pair nothing.
    """
    each = nodes.filter(F.col("short").isNotNull()).select("node", F.explode("short").alias("shingle"))
    common = each.groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") > FEW)
    common = written(common, "near-common")
    ordered = (
        each.join(_sent(common, _is_small(common)), "shingle", "left")
        .groupBy("node")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.xxhash64("shingle").alias("h")))).alias("all"))
    )
    first = F.size("all") - F.ceil(F.lit(threshold) * F.size("all") - 1e-9).cast("int") + 1
    return ordered.select("node", F.explode(F.slice("all", F.lit(1), F.least(first, F.size("all")))).alias("x")).select("node", F.col("x.h").alias("key"))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct shingles."""
    both = np.intersect1d(a, b, assume_unique=True).size
    return both / max(a.size + b.size - both, 1)


def banded_distance(x: np.ndarray, y: np.ndarray, limit: int) -> int:
    """Word edit distance, or ``limit + 1`` if it is greater.

    Furthest-reaching points on the diagonals of a band that widens by one edit at a time; equal words are
    skipped over in windows. Memory grows with the band, time with the band and the edits.
    """
    n = min(x.size, y.size)
    if n:
        differs = np.flatnonzero(x[:n] != y[:n])
        skip = int(differs[0]) if differs.size else n
        x, y, n = x[skip:], y[skip:], n - skip
        differs = np.flatnonzero(x[::-1][:n] != y[::-1][:n])
        skip = int(differs[0]) if differs.size else n
        x, y = x[:x.size - skip], y[:y.size - skip]
    if abs(x.size - y.size) > limit:
        return limit + 1
    if not x.size or not y.size:
        return max(x.size, y.size)
    window = np.arange(64)
    xs, ys = np.append(x, np.uint64(0)), np.append(y, np.uint64(0))

    def slid(reach: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        live = np.flatnonzero((reach < x.size) & (reach + diagonal < y.size) & (reach >= 0))
        while live.size:
            i, j = reach[live, None] + window, (reach + diagonal)[live, None] + window
            equal = (xs[np.minimum(i, x.size)] == ys[np.minimum(j, y.size)]) & (i < x.size) & (j < y.size)
            run = np.where(equal.all(axis=1), window.size, equal.argmin(axis=1))
            reach[live] += run
            live = live[run == window.size]
        return reach

    goal = y.size - x.size
    reach = slid(np.zeros(1, np.int64), np.zeros(1, np.int64))
    for edits in range(limit + 1):
        if abs(goal) <= edits and reach[goal + edits] >= x.size:
            return edits
        padded = np.concatenate([[-1, -1], reach, [-1, -1]])
        diagonal = np.arange(-edits - 1, edits + 2)
        insert, change, delete = padded[:-2], padded[1:-1] + 1, padded[2:] + 1
        change, delete = np.where(padded[1:-1] < 0, -1, change), np.where(padded[2:] < 0, -1, delete)
        reach = np.maximum(np.maximum(insert, change), delete)
        reach = np.minimum(reach, np.minimum(x.size, y.size - diagonal))
        reach = slid(reach, diagonal)
    return limit + 1


class _Prepared:
    """The word and shingle hashes of texts, remembered up to ``PREPARED`` bytes; a task forgets them when it ends."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.size = 0

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if text not in self.held:
            words = word_hashes(text)
            found = words, np.unique(shingle_hashes(words))
            size = found[0].nbytes + found[1].nbytes + len(text)
            if self.size + size > PREPARED:
                self.forget()
            self.held[text] = found
            self.size += size
        return self.held[text]


_prepared = _Prepared()


def linked(a: str, b: str, threshold: float = THRESHOLD) -> bool:
    """Whether two texts are near copies: shingle similarity and word edit similarity both reach the threshold."""
    (x, s), (y, t) = _prepared(a), _prepared(b)
    if min(s.size, t.size) < threshold * max(s.size, t.size) or similarity(s, t) < threshold:
        return False
    limit = int((1 - threshold) * max(x.size, y.size) + 1e-9)
    return banded_distance(x, y, limit) <= limit


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are linked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            for batch in batches:
                good = [linked(a, b, threshold) for a, b in zip(batch["ta"], batch["tb"])]
                if any(good):
                    yield batch.loc[good, ["a", "b"]]
        finally:
            _prepared.forget()

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").mapInPandas(run, "a binary, b binary")


def _sent(df: DataFrame, small: bool) -> DataFrame:
    """A table of ids, sent to every executor if it was counted to be small, else as it is."""
    return F.broadcast(df) if small else df


def _is_small(df: DataFrame) -> bool:
    return df.limit(SENT_ROWS + 1).count() <= SENT_ROWS


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each node's component. Least labels spread along edges and along labels.

    While the labels are few they are sent to the edges, which then are shuffled once a round.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "near-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label"))
    labels = written(labels.select("node", "label"), "near-labels")
    small = _is_small(labels)
    while True:
        seen = both.join(_sent(labels.withColumnRenamed("node", "b"), small), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = seen.join(_sent(labels, small), "node").select("node", "label", F.least("label", "near").alias("next"))
        beyond = labels.select(F.col("node").alias("next"), F.col("label").alias("over"))
        moved = least.join(_sent(beyond, small), "next").select("node", F.col("label").alias("old"), F.least("next", "over").alias("label"))
        moved = written(moved, "near-labels")
        labels = moved.select("node", "label")
        if moved.filter("old != label").isEmpty():
            return labels


def near_labels(docs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """node, label for every text that shares a band with another; the label is the least node of its class.

    The rare shingles of short texts count as bands here. Every pair of texts that share a band ends up verified or in one class. Texts that agree in several bands at
    once, the closest relatives, are held against one centre first, so that large groups become few classes at
    little cost. Then only bands that still hold several classes go on: their texts of different classes are
    paired, or compared block against block where a band is crowded. Copies and texts already in one class are
    never paired.
    """
    nodes = sketches.filter(F.col("keys").isNotNull()).groupBy("node").agg(F.first("keys").alias("keys"), F.first("short").alias("short"))
    rows = nodes.select("node", F.explode("keys").alias("key")).unionByName(rare_keys(nodes, threshold))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    buckets = written(rows.join(shared, "key").select("key", "node"), "near-buckets")
    small = _is_small(buckets)  # labels, groups and keys have no more rows
    labels = written(buckets.select("node").distinct().withColumn("label", F.col("node")), "near-labels")
    texts = written(_texts(docs, sketches, labels.select("node")), "near-texts")
    related = nodes.join(_sent(labels.select("node"), small), "node")

    for together in CLOSE:
        joint = F.array(*(F.xxhash64(*(F.col("keys")[i + k] for k in range(together))) for i in range(0, BANDS, together)))
        own = related.select("node", F.explode(joint).alias("key")).join(_sent(labels, small), "node")
        centres = own.groupBy("key").agg(
            F.min(F.struct("node", "label")).alias("c"), F.min("label").alias("low"), F.max("label").alias("high")
        ).filter("low != high")
        centres = centres.select("key", F.col("c.node").alias("a"), F.col("c.label").alias("of"))
        pairs = own.join(centres, "key").filter("of != label").select("a", F.col("node").alias("b")).distinct()
        labels = _merged(labels, written(verified(pairs, texts, threshold), "near-links"), small)

    own = buckets.join(_sent(labels, small), "node")
    groups = own.groupBy("key", "label").agg(F.count("*").alias("n"))
    keys = groups.groupBy("key").agg(F.count("*").alias("classes"), F.sum("n").alias("size")).filter("classes > 1").drop("classes")
    mixed = own.join(_sent(keys, small), "key").join(_sent(groups, small), ["key", "label"])
    mixed = written(mixed.select("key", "node", "label", "n", "size"), "near-mixed")
    few = mixed.filter(F.col("size") <= FEW)
    other = few.select("key", F.col("node").alias("b"), F.col("label").alias("of"))
    pairs = few.select("key", F.col("node").alias("a"), "label").join(other, "key").filter("label != of AND a < b").select("a", "b").distinct()
    labels = _merged(labels, written(verified(pairs, texts, threshold), "near-links"), small)
    return _merged(labels, written(_block_links(mixed.filter(F.col("size") > FEW), texts, threshold), "near-links"), small)


def _block_links(rows: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between the classes of crowded bands, found block against block.

    The texts of a band are dealt into blocks of about ``BLOCK``, a large class into blocks of its own; blocks of
    one class are not held against each other. The pairs of blocks of a band form a grid, cut into cells of about
    ``GRID`` by ``GRID`` blocks: each cell is a group of its own, so a band is spread over as many tasks as it has cells,
    and a block is copied once per row of cells, not once per block. A cell compares its texts of different classes
    and gives one link for each two classes that have one: no row is made for a pair that is none.
    """
    cells = _cells(rows, texts)

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        try:
            blocks = list(cell.itertuples(index=False))
            across = [(x, y) for x in blocks for y in blocks if _meet(x, y)]
            found = [
                link
                for x, y in across
                for link in links_between((x.nodes, x.labels, x.texts), (y.nodes, y.labels, y.texts), threshold)
            ]
            return pd.DataFrame(found, columns=["a", "b"])
        finally:
            _prepared.forget()

    return cells.groupBy("key", "row", "column").applyInPandas(run, "a binary, b binary").distinct()


def _meet(x, y) -> bool:
    """Whether two blocks of a cell are held against each other there: the first of its row, the second of its column."""
    if (x.group, y.group) != (x.row, x.column) or (x.home is not None and x.home == y.home):
        return False
    return x.row != x.column or x.block <= y.block


def _cells(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The blocks of crowded bands (nodes, labels, texts), each once per cell of the grid that it has a part in."""
    own = F.when(F.col("n") >= BLOCK, F.col("label"))
    parts = F.ceil(F.when(own.isNotNull(), F.col("n")).otherwise(F.col("size")) / BLOCK)
    part = F.pmod(F.xxhash64(F.when(own.isNotNull(), F.col("node")).otherwise(F.col("label"))), parts)
    side = F.ceil(F.col("size") / (BLOCK * GRID)).cast("int")
    blocks = (
        rows.select("key", "node", "label", own.alias("home"), part.alias("part"), side.alias("side"))
        .join(texts, "node")
        .groupBy("key", "home", "part")
        .agg(
            F.first("side").alias("side"),
            F.collect_list("node").alias("nodes"), F.collect_list("label").alias("labels"), F.collect_list("text").alias("texts"),
        )
        .withColumn("block", F.xxhash64("home", "part"))
        .withColumn("group", F.pmod("block", "side").cast("int"))
    )
    blocks = written(blocks.drop("part"), "near-blocks")
    spread = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("side") - 1)))
    placed = spread.withColumns({"row": F.least("group", "other"), "column": F.greatest("group", "other")})
    return placed.drop("other", "side")


def links_between(one: tuple, two: tuple, threshold: float) -> Iterator[tuple[bytes, bytes]]:
    """One linked pair for each two classes with such a pair between two blocks (nodes, labels, texts)."""
    known = [_prepared(text) for text in two[2]]
    sizes = np.array([s.size for _, s in known])
    shingles, place = np.unique(np.concatenate([s for _, s in known]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    done: set[tuple[bytes, bytes]] = set()
    for a, label, text in zip(*one):
        x, s = _prepared(text)
        at = np.minimum(np.searchsorted(shingles, s), shingles.size - 1)
        mark = np.zeros(shingles.size, np.int64)
        mark[at[shingles[at] == s]] = 1
        shared = np.add.reduceat(mark[place], starts)
        for k in np.flatnonzero(shared >= threshold * (s.size + sizes - shared)):
            b, of = two[0][k], two[1][k]
            classes = (min(label, of), max(label, of))
            if label == of or classes in done:
                continue
            y = known[k][0]
            limit = int((1 - threshold) * max(x.size, y.size) + 1e-9)
            if banded_distance(x, y, limit) <= limit:
                done.add(classes)
                yield a, b


def _merged(labels: DataFrame, links: DataFrame, small: bool) -> DataFrame:
    """The labels after their classes have been joined along new links between nodes."""
    if links.isEmpty():
        return labels
    held = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
    between = links.join(_sent(held("a"), small), "a").join(_sent(held("b"), small), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    over = components(between).select(F.col("node").alias("label"), F.col("label").alias("over"))
    return written(labels.join(_sent(over, small), "label", "left").select("node", F.coalesce("over", "label").alias("label")), "near-labels")


def _texts(docs: DataFrame, sketches: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and text of the given nodes, read from one row of each; no text is shuffled while the list is small."""
    chosen = sketches.join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    chosen = written(chosen, "near-chosen")
    list_ = _sent(chosen, _is_small(chosen))
    own = docs.select(node_of(plain_text()).alias("node"), F.col("doc_id"), plain_text().alias("text"))
    same = (own["node"] == list_["node"]) & own["doc_id"].eqNullSafe(list_["doc_id"])
    return own.join(list_, same, "left_semi").select("node", "text").dropDuplicates(["node"])


def classed(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, class_id and class_size.

    The class is that of all texts linked by chains of near copies; its id is the least doc_id in it (null if all
    are null). Rows of equal text are one text. A text without words is a class of its own row.
    """
    return _of_rows(*_sketches_and_labels(docs, threshold)).select("doc_id", "class_id", "class_size")


def _sketches_and_labels(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    sketches = written(sketched(docs, threshold), "near-sketches")
    return sketches, near_labels(docs, sketches, threshold)


def _of_rows(sketches: DataFrame, labels: DataFrame) -> DataFrame:
    per_node = sketches.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    per_node = per_node.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    per_class = per_node.groupBy("label").agg(F.min("first").alias("class_id"), F.sum("n").alias("class_size"))
    of_node = per_node.select("node", "label").join(per_class, "label")
    with_words = sketches.filter(F.col("node").isNotNull()).select("doc_id", "node").join(of_node, "node")
    without = sketches.filter(F.col("node").isNull()).select(
        "doc_id", "node", F.lit(None).cast("binary").alias("label"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size")
    )
    return with_words.select(*without.columns).unionByName(without)


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with one row of each class: of the least doc_id, then of the least md5. All columns are kept.

    Texts without words all stay.
    """
    sketches, labels = _sketches_and_labels(docs, threshold)
    nodes = sketches.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    nodes = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")
    kept = nodes.groupBy("label").agg(F.min(order).alias("k")).select(F.col("k.node").alias("__node"), F.col("k.doc_id").alias("__id"))
    kept = written(kept, "near-kept")
    repeated = (
        sketches.filter(F.col("node").isNotNull()).groupBy("node", "doc_id").count().filter("count > 1")
        .select(F.col("node").alias("__node"), F.col("doc_id").alias("__id"))
    )
    repeated = written(repeated, "near-repeated")
    small = lambda t: _sent(t, _is_small(t))
    own = docs.withColumn("__own", node_of(plain_text()))
    same = lambda t: (F.col("__own") == t["__node"]) & own["doc_id"].eqNullSafe(t["__id"])
    chosen = own.filter(F.col("__own").isNotNull()).join(small(kept), same(kept), "left_semi")
    if not repeated.isEmpty():
        again = small(repeated)
        chosen = chosen.join(again, same(repeated), "left_anti").unionByName(
            chosen.join(again, same(repeated), "left_semi").dropDuplicates(["__own", "doc_id"])
        )
    return chosen.unionByName(own.filter(F.col("__own").isNull())).select(*(F.col(c) for c in docs.columns))
