"""Filter interaction audit: count-weighted decision diagrams of failure masks, reordered by adjacent level swaps.

Every document gets a mask with one bit per filter that it fails. Spark counts the documents of each part and mask; a
part's diagram over those counts (32 masks at most with five filters) has one level per filter, two branches per node
(pass, fail) and at each node the number of documents that reach it. All orders are visited by swaps of two adjacent
levels, and in each order the all-pass path reads off what every step keeps and removes.

Rows: a null text counts as empty, a null part as the empty string. A null id is smaller than none and greater than
none, so such a row never fails E and never makes another fail. Rows with the same id and text do not fail each other.
Of several labels of one id, a document is good (toxic) if any says so. Equal rows count as often as they stand there.
Very long texts are measured whole. No documents give no parts and no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from math import factorial

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import plain_text, words_of

FILTERS = "ABCDE"
#: Fixed by the contract: texts under this number of words fail A.
LEAST_WORDS = 200
#: Fixed by the contract: the marks that fail D.
MARKS = "#$%&*|"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What is summed along with the documents of a mask.
WEIGHTS = ("docs", "good", "toxic")


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, text_key, the mask of A to D, and ``docs``, how many rows are the same in all of these.

    The mask depends on the text alone, so the rows of a text repeated everywhere fold before the first shuffle.
    """
    measured = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), plain_text().alias("x")).select(
        "doc_id", "part", "x", words_of(F.col("x")).alias("words")
    )
    capitals = F.length("x") - F.length(F.translate("x", CAPITALS, ""))
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.contains("x", F.lit(mark))
    fails = (
        F.size("words") < LEAST_WORDS,
        100 * F.size(F.array_distinct("words")) < 50 * F.size("words"),
        100 * capitals > 3 * F.length("x"),
        marked,
    )
    mask = sum((F.when(fail, 1 << i).otherwise(0) for i, fail in enumerate(fails)), F.lit(0))
    found = measured.select("doc_id", "part", F.unhex(F.sha2("x", 256)).alias("text_key"), mask.alias("mask"))
    return found.groupBy("doc_id", "part", "text_key", "mask").agg(F.count("*").alias("docs"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, and of the documents with it: how many, how many good, how many toxic.

    E is decided against the least id of a text. That id is joined on id and text together, so a text that a third of
    all documents share is no hot key.
    """
    entries = failures(docs)
    first = entries.groupBy("text_key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("is_good"), F.max((F.col("toxic") == 1).cast("int")).alias("is_toxic")
    )
    repeats = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    told = entries.join(first, ["text_key", "doc_id"], "left").join(marks, "doc_id", "left")
    return (
        told.select(
            "part",
            (F.col("mask") + repeats).cast("int").alias("mask"),
            "docs",
            (F.col("docs") * F.coalesce("is_good", F.lit(0))).alias("good"),
            (F.col("docs") * F.coalesce("is_toxic", F.lit(0))).alias("toxic"),
        )
        .groupBy("part", "mask")
        .agg(*[F.sum(name).alias(name) for name in WEIGHTS])
    )


class Diagram:
    """A diagram over masks: nodes by level, each (pass child, fail child), with the weight that reaches each node.

    Equal nodes of a level are one node. Weights stand at the leaves, one leaf per mask that occurs; the weight of an
    inner node is the sum of its children, so it needs no update when levels above or below it are swapped.
    """

    def __init__(self, variables: Sequence[str], weights: dict[int, tuple[int, ...]]):
        self.order = list(variables)
        self.bits = {name: 1 << i for i, name in enumerate(variables)}
        self.nothing = tuple(0 for _ in next(iter(weights.values()), WEIGHTS))
        self.unique: dict[tuple, tuple] = {}
        self.root = self._grown(0, 0, weights)

    def _node(self, level: int, passed: tuple | None, failed: tuple | None) -> tuple | None:
        if passed is None and failed is None:
            return None
        key = (level, id(passed), id(failed))
        if key not in self.unique:
            total = tuple(a + b for a, b in zip(self.weight(passed), self.weight(failed), strict=True))
            self.unique[key] = (passed, failed, total)
        return self.unique[key]

    def _grown(self, level: int, mask: int, weights: dict) -> tuple | None:
        if level == len(self.order):
            return (None, None, weights[mask]) if mask in weights else None
        bit = self.bits[self.order[level]]
        return self._node(level, self._grown(level + 1, mask, weights), self._grown(level + 1, mask | bit, weights))

    def weight(self, node: tuple | None) -> tuple[int, ...]:
        return self.nothing if node is None else node[2]

    def swap(self, level: int) -> None:
        """Exchange the variables of this level and the next; nodes further down stay the objects they are."""
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]
        self.unique = {key: node for key, node in self.unique.items() if key[0] > level + 1}
        self.root = self._swapped(self.root, 0, level, {})

    def _swapped(self, node: tuple | None, at: int, level: int, done: dict) -> tuple | None:
        if node is None:
            return None
        if id(node) not in done:
            passed, failed = node[0], node[1]
            if at < level:
                parts = [self._swapped(child, at + 1, level, done) for child in (passed, failed)]
            else:
                pp, pf = (passed[0], passed[1]) if passed else (None, None)
                fp, ff = (failed[0], failed[1]) if failed else (None, None)
                parts = [self._node(level + 1, pp, fp), self._node(level + 1, pf, ff)]
            done[id(node)] = self._node(at, *parts)
        return done[id(node)]

    def path(self) -> Iterator[tuple[str, tuple[int, ...], tuple[int, ...]]]:
        """Along the all-pass path: the filter, the weight that passes it and the weight it takes away."""
        node = self.root
        for name in self.order:
            passed, failed = (node[0], node[1]) if node else (None, None)
            yield name, self.weight(passed), self.weight(failed)
            node = passed


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels to swap one after another so that all n! orders are met, each once, from the first on."""
    places, heading = list(range(n)), [-1] * n
    for _ in range(factorial(n) - 1):
        moving = max(
            (x for i, x in enumerate(places) if 0 <= i + heading[x] < n and places[i + heading[x]] < x), default=None
        )
        at = places.index(moving)
        to = at + heading[moving]
        places[at], places[to] = places[to], places[at]
        for x in range(moving + 1, n):
            heading[x] = -heading[x]
        yield min(at, to)


STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def part_steps(part: str, weights: dict[int, tuple[int, int, int]], filters: str = FILTERS) -> list[tuple]:
    """All orders and steps of one part, from its counts by mask."""
    bit = {name: 1 << i for i, name in enumerate(filters)}
    failing = {name: sum(w[0] for mask, w in weights.items() if mask & bit[name]) for name in filters}
    alone = {name: weights.get(bit[name], (0,))[0] for name in filters}
    diagram, rows, shares = Diagram(filters, weights), [], Counter()
    swaps = adjacent_swaps(len(filters))
    while True:
        order = "".join(diagram.order)
        for step, (name, kept, lost) in enumerate(diagram.path(), 1):
            shares[name] += lost[0]
            rows.append((part, order, step, kept[0], lost[0], failing[name] - lost[0], alone[name], lost[1], lost[2]))
        level = next(swaps, None)
        if level is None:
            return [(*row, shares[row[1][row[2] - 1]]) for row in rows]
        diagram.swap(level)


def steps(counts: DataFrame) -> DataFrame:
    """One row per part, order and step from ``mask_counts``; a part has one row per mask, so its group is small."""

    def of_part(rows: pd.DataFrame) -> pd.DataFrame:
        weights = {int(r.mask): (int(r.docs), int(r.good), int(r.toxic)) for r in rows.itertuples()}
        return pd.DataFrame(part_steps(rows["part"].iloc[0], weights), columns=[c.split()[0] for c in STEPS.split(", ")])

    return counts.groupBy("part").applyInPandas(of_part, STEPS)


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter keeps, removes and finds already gone, in every order and part."""
    return steps(mask_counts(docs, labels))
