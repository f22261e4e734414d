"""Spelling variant grouping: k-d trees over letter-count vectors.

One edit changes a word's letter counts by one up, one down, or one of each: an L1 distance of two at most. Words of a
length are put into a k-d tree over their counts. A word searches the tree of its own length for one letter up and one
down, and the tree of the next length for one letter up; boxes further away are pruned, and the letter order of what is
left is compared. So each pair of near words is met once, and tells both of its words.

The upper part of each tree is fitted on a bounded sample (``SAMPLE`` words, by hash) and cuts a length into cells of
about ``CELL`` words; every word goes to its own cell and to those others that its box reaches. In a cell the tree goes
on to leaves of ``LEAF`` words. Searches answer with a count and the best near word, so no pairs are shuffled.

Rows: a null text has no words, a null id counts as the empty string. Equal rows count as often as they stand there.
Very long texts are split whole, very long words compared whole; counts above ``MOST`` of one letter are taken as that
in the boxes, which only widens them. Of near words with equal counts the smallest by code points is the form. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.sizing import each
from .common import fraction, plain_text, written

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SMALL = _CAPITALS.lower()
#: Fixed by the contract: the letters of a run, spelt out for the matcher's sake.
_RUN = "[" + _CAPITALS + _SMALL + "".join(map(chr, range(0xC0, 0x100))) + "]+"
#: Fixed by the contract.
TYPO_EVERY = 199
LEAST_LETTERS = 6
LEAST_COUNT = 5
FORM_TIMES = 5

#: Words that the upper trees are fitted on.
SAMPLE = 100_000
#: Words of a cell, as the sample foretells.
CELL = 50_000
LEAF = 24
#: Entries of a count vector: a to z, and accented letters folded into the rest.
WIDTH = 32
MOST = 15
#: Pairs compared letter by letter at once.
PAIRS = 1 << 18


def words(docs: DataFrame) -> DataFrame:
    """word and n: the runs of letters after the contract's planted typos, as far as long and frequent enough."""
    kept = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), plain_text().alias("x"))
    runs = each(kept, F.regexp_extract_all(F.translate("x", _CAPITALS, _SMALL), F.lit(_RUN), F.lit(0)), "id", name="run")
    runs = runs.filter(F.length("run") >= LEAST_LETTERS)
    marked = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    cut = F.overlay("run", F.lit(""), (F.col("h") % F.length("run") + 1).cast("int"), F.lit(1))
    typed = marked.select(F.when(F.col("h") % TYPO_EVERY == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = typed.filter(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


def codes_of(found: list[str]) -> np.ndarray:
    """Words of one length as a matrix of letters."""
    return np.frombuffer("".join(found).encode("latin-1"), np.uint8).reshape(len(found), -1)


def counts_of(codes: np.ndarray) -> np.ndarray:
    """Letter-count vectors."""
    letters = np.where(codes < 0xC0, codes - ord("a"), 26 + codes % (WIDTH - 26)).astype(np.int64)
    rows = np.arange(len(codes))[:, None] * WIDTH
    counts = np.bincount((rows + letters).ravel(), minlength=len(codes) * WIDTH)
    return np.minimum(counts, MOST).reshape(-1, WIDTH).astype(np.int8)


class Tree:
    """A k-d tree over count vectors: inner nodes split one letter's count, leaves hold vector numbers.

    ``leaf`` ends the splitting. A node is (box low, box high, left, right, numbers, letter, split); numbers stand in
    leaves only. Boxes are those of the vectors, or with ``open_boxes`` all that the splits let through, so that vectors
    which the tree was not built on fall into them too.
    """

    def __init__(self, counts: np.ndarray, leaf: int, open_boxes: bool = False):
        self.counts, self.leaf, self.open_boxes, self.leaves = counts, leaf, open_boxes, 0
        everything = (np.zeros(WIDTH, np.int8), np.full(WIDTH, MOST, np.int8))
        self.root = self._grown(np.arange(len(counts)), *everything)

    def _grown(self, numbers: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple:
        own = self.counts[numbers]
        if len(own) and not self.open_boxes:
            low, high = own.min(0), own.max(0)
        letter = split = None
        if len(numbers) > self.leaf:
            letter = int(own.astype(np.float32).var(0).argmax())
            values = own[:, letter]
            split = int(np.median(values))
            split -= bool((values <= split).all())
        if letter is None or not 0 < (is_left := own[:, letter] <= split).sum() < len(numbers):
            self.leaves += 1
            return (low, high, None, None, numbers, self.leaves - 1, None)
        left_high, right_low = high.copy(), low.copy()
        left_high[letter], right_low[letter] = split, split + 1
        left = self._grown(numbers[is_left], low, left_high)
        return (low, high, left, self._grown(numbers[~is_left], right_low, high), None, letter, split)

    def reached(self, asked: np.ndarray, up: int, down: int) -> Iterator[tuple[tuple, np.ndarray]]:
        """Leaves, each with the numbers of the asking vectors from which ``up`` and ``down`` steps may reach its box."""
        open_nodes = [(self.root, np.arange(len(asked)))]
        while open_nodes:
            node, who = open_nodes.pop()
            own = asked[who]
            near = np.maximum(node[0] - own, 0).sum(1) <= up
            near &= np.maximum(own - node[1], 0).sum(1) <= down
            who = who[near]
            if not len(who):
                continue
            if node[2] is None:
                yield node, who
            else:
                open_nodes += [(node[2], who), (node[3], who)]

    def home(self, vectors: np.ndarray) -> np.ndarray:
        """The number of the leaf that each vector falls into."""
        out = np.zeros(len(vectors), np.int32)
        open_nodes = [(self.root, np.arange(len(vectors)))]
        while open_nodes:
            node, who = open_nodes.pop()
            if node[2] is None:
                out[who] = node[5]
            elif len(who):
                is_left = vectors[who, node[5]] <= node[6]
                open_nodes += [(node[2], who[is_left]), (node[3], who[~is_left])]
        return out


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Row by row: whether one replaced letter, or one more letter in the longer matrix, makes the words equal."""
    if short.shape[1] == long.shape[1]:
        return (short != long).sum(1) == 1
    n = short.shape[1]
    ahead = np.concatenate([short != long[:, :n], np.ones((len(short), 1), bool)], 1).argmax(1)
    behind = np.concatenate([(short != long[:, 1:])[:, ::-1], np.ones((len(short), 1), bool)], 1).argmax(1)
    return ahead + behind >= n


def near_pairs(tree: Tree, codes: np.ndarray, asked: np.ndarray, within: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of asking words and of words of the tree that are one edit apart; ``within`` takes each pair of a set once."""
    more = codes.shape[1] - asked.shape[1]
    vectors = counts_of(asked)
    up, down = 1, 1 - more
    letter, level = np.nonzero(np.arange(MOST)[None, :] < tree.counts.max(0)[:, None])
    unary = lambda v: (v[:, letter] > level).astype(np.float32)
    ours, theirs = unary(vectors), unary(tree.counts)
    sums, sums_of = vectors.sum(1, dtype=np.int32), tree.counts.sum(1, dtype=np.int32)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for leaf, who in tree.reached(vectors, up, down):
        held = leaf[4]
        for at in range(0, len(who), 1 << 14):
            part = who[at : at + (1 << 14)]
            shared = ours[part] @ theirs[held].T
            close = (sums_of[held][None, :] - shared <= up) & (sums[part][:, None] - shared <= down)
            a, b = np.nonzero(close)
            a, b = part[a], held[b]
            if within:
                a, b = a[a < b], b[a < b]
            for k in range(0, len(a), PAIRS):
                true = one_edit(asked[a[k : k + PAIRS]], codes[b[k : k + PAIRS]])
                found.append((a[k : k + PAIRS][true], b[k : k + PAIRS][true]))
    none = np.empty(0, np.int64)
    return np.concatenate([none, *(f[0] for f in found)]), np.concatenate([none, *(f[1] for f in found)])


def upper_trees(sample: list[str], share: float) -> dict[int, Tree]:
    """A tree for each length in the sample, with leaves of about ``CELL`` words when the sample is that share of all."""
    by_length = defaultdict(list)
    for word in sample:
        by_length[len(word)].append(word)
    return {n: Tree(counts_of(codes_of(own)), max(1, int(CELL * share)), open_boxes=True) for n, own in by_length.items()}


SENT = "cell string, home boolean, word string, n long"
NEAR = "word string, n_near long, best struct<n: long, word: string>"


def sent_to_cells(vocabulary: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """Each word to its cell, to the later cells of its length and to the cells of the next length that it may reach."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = batch["word"].to_pylist(), batch["n"].to_numpy()
            by_length = defaultdict(list)
            for i, word in enumerate(found):
                by_length[len(word)].append(i)
            for length, rows in by_length.items():
                numbers = np.array(rows)
                vectors = counts_of(codes_of([found[i] for i in rows]))
                sent = []
                for more in (0, 1):
                    tree = trees.get(length + more)
                    home = tree.home(vectors) if tree and not more else np.zeros(len(rows), np.int32)
                    if not more:
                        sent += [(f"{length}:{c}", True, i) for c, i in zip(home.tolist(), rows, strict=True)]
                    if tree is None:
                        sent += [(f"{length + 1}:0", False, i) for i in rows] if more else []
                        continue
                    for leaf, who in tree.reached(vectors, 1, 1 - more):
                        who = who if more else who[home[who] < leaf[5]]
                        sent += [(f"{length + more}:{leaf[5]}", False, i) for i in numbers[who].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([s[0] for s in sent], pa.string()),
                        pa.array([s[1] for s in sent], pa.bool_()),
                        pa.array([found[s[2]] for s in sent], pa.string()),
                        pa.array(counts[[s[2] for s in sent]], pa.int64()),
                    ],
                    [c.split()[0] for c in SENT.split(", ")],
                )

    return vocabulary.mapInArrow(cells, SENT)


def searched(cell: pa.Table) -> pa.Table:
    """Of one cell: how many near words each word has there, and the best of them."""
    found, home = cell["word"].to_pylist(), cell["home"].to_numpy()
    counts = cell["n"].to_numpy()
    length = int(cell["cell"][0].as_py().split(":")[0])
    own = np.flatnonzero(home)
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    if len(own):
        codes = codes_of([found[i] for i in own])
        tree = Tree(counts_of(codes), LEAF)
        for asking, within in ((own, True), (np.flatnonzero(~home), False)):
            for size in (length, length - 1):
                who = np.array([i for i in asking if len(found[i]) == size], np.int64)
                if len(who):
                    a, b = near_pairs(tree, codes, codes_of([found[i] for i in who]), within)
                    ends += [(who[a], own[b]), (own[b], who[a])]
    none = np.empty(0, np.int64)
    self_, other = np.concatenate([none, *(e[0] for e in ends)]), np.concatenate([none, *(e[1] for e in ends)])
    ranks = np.empty(len(found), np.int64)
    ranks[sorted(range(len(found)), key=found.__getitem__)] = np.arange(len(found))
    order = np.lexsort((ranks[other], -counts[other], self_))
    self_, other = self_[order], other[order]
    heads, times = np.unique(self_, return_index=True)[1], np.unique(self_, return_counts=True)[1]
    best = [{"n": int(counts[i]), "word": found[i]} for i in other[heads]]
    return pa.Table.from_arrays(
        [
            pa.array([found[i] for i in self_[heads]], pa.string()),
            pa.array(times, pa.int64()),
            pa.array(best, pa.struct([("n", pa.int64()), ("word", pa.string())])),
        ],
        ["word", "n_near", "best"],
    )


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n, n_near, and the form with its count, for every word of the vocabulary."""
    total = vocabulary.count()
    share = min(1.0, SAMPLE / max(total, 1))
    sample = [row.word for row in vocabulary.filter(fraction("word") < share).select("word").collect()]
    cells = sent_to_cells(vocabulary, upper_trees(sample, share))
    told = cells.groupBy("cell").applyInArrow(searched, NEAR)
    best = F.min(F.struct((-F.col("best.n")).alias("less"), F.col("best.word").alias("word"))).alias("best")
    joined = vocabulary.join(told.groupBy("word").agg(F.sum("n_near").alias("n_near"), best), "word", "left")
    form_n = -F.col("best.less")
    formed = F.coalesce(form_n >= FORM_TIMES * F.col("n"), F.lit(False))
    return joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(formed, F.col("best.word")).alias("form"),
        F.when(formed, form_n).alias("form_n"),
    )


def rooted(forms: DataFrame) -> DataFrame:
    """``forms`` with the root of each word: forms followed to the last by doubling steps.

    Counts grow by a factor at each form, so chains are short and a few rounds end them.
    """
    links = forms.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = written(
            links.join(further, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ),
            "spelling-roots",
        )
        if not links.filter("moved").limit(1).count():
            break
        links = links.select("word", "root")
    return forms.join(links.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def grouped(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of the documents."""
    vocabulary = written(words(docs), "spelling-words")
    forms = written(near_words(vocabulary), "spelling-forms")
    return rooted(forms).select("word", "form", "root", "n", "n_near", "form_n")
