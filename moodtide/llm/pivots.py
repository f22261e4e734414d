"""Exact top-k inner products over a pivot-distance index, searched by growing sets of annuli."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import written

#: Fixed by the contract: the scale of the integers, every how manieth id is a query, results per query.
SCALE = 64
QUERY_STEP = 20
TOP = 20
#: Most pivots (drawn by hash), most annuli of a pivot, vectors and queries in a block.
PIVOTS = 1024
ANNULI = 64
BLOCK = 1024
QUERY_BLOCK = 256
#: Annuli a query looks into per round; the last round takes all that its bound leaves.
ROUNDS = (2, 16, None)


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and q, the components times ``scale`` rounded down.

    Null vectors, vectors with null or non-finite components and rows without an id take no part. Rows that repeat
    an id all stay.
    """
    x = F.col("embedding")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return (
        embeddings.filter(x.isNotNull() & F.col("vec_id").isNotNull() & ~odd)
        .select("vec_id", F.transform(x, lambda v: F.floor(scale * v.cast("double")).cast("long")).alias("q"))
    )


class Space:
    """What all tasks need: width, pivots and the greatest norm of the vectors.

    Vectors are padded with zeros to one width. Each gets one more component that brings its norm to the greatest
    one, queries get 0 there: then the squared distance of a query is |query|^2 + greatest^2 - 2 * score, so that
    the nearest vectors are those with the highest scores and the triangle inequality bounds the score.
    """

    def __init__(self, width: int, top: int, square: int, pivots: list[list[int]]):
        self.width, self.square = width, float(square)
        #: Products are exact in floating point below 2^53; beyond that Python's integers are used.
        self.exact = max(width, 1) * float(top) ** 2 < 2.0**53
        self.kind = np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.int64
        self.pivots = self.padded(pivots).astype(np.float64)
        self.raised = np.sqrt(np.maximum(self.square - (self.pivots**2).sum(axis=1), 0))

    def padded(self, rows) -> np.ndarray:
        out = np.zeros((len(rows), self.width), np.int64)
        for i, row in enumerate(rows):
            out[i, :len(row)] = row
        return out

    def packed(self, rows) -> list[bytes]:
        return [row.tobytes() for row in self.padded(rows).astype(self.kind)]

    def unpacked(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.kind).reshape(-1, self.width) if self.width else np.zeros((0, 0), self.kind)

    def to_pivots(self, rows, query: bool) -> np.ndarray:
        """Distances to all pivots, of vectors or of queries."""
        x = self.padded(rows).astype(np.float64)
        own = (x**2).sum(axis=1)
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.square - own, 0))
        square = (own if query else self.square)
        square = np.broadcast_to(square, len(x))[:, None] + self.square - 2 * (x @ self.pivots.T + extra[:, None] * self.raised[None])
        return np.sqrt(np.maximum(square, 0))

    def scores(self, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        if self.exact:
            return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
        return queries.astype(object) @ vectors.astype(object).T


def placed(vectors: DataFrame, space: Space, annuli: int) -> tuple[DataFrame, list[tuple]]:
    """Blocks (ring, part, ids, data) of all vectors, and per ring its number, pivot, least and greatest distance.

    A ring is an annulus around a pivot that holds the vectors nearest to that pivot; its bounds are quantiles
    within the cell. Large rings, also those of many equal vectors, are split into blocks by hash.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            far = space.to_pivots(batch["q"].tolist(), False)
            cell = far.argmin(axis=1) if len(batch) else np.zeros(0, int)
            near = far[np.arange(len(batch)), cell]
            yield pd.DataFrame({"vec_id": batch["vec_id"], "spot": np.arange(len(batch)), "cell": cell, "r": near, "v": space.packed(batch["q"].tolist())})

    keyed = written(vectors.mapInPandas(run, "vec_id long, spot long, cell int, r double, v binary"), "pivot-keyed")
    steps = [k / annuli for k in range(1, annuli)]
    if steps:
        cuts = keyed.groupBy("cell").agg(F.percentile_approx("r", steps, 1000).alias("cuts"))
        ring = F.size(F.filter("cuts", lambda c: c < F.col("r")))
        ringed = keyed.join(F.broadcast(cuts), "cell").withColumn("ring", F.col("cell") * annuli + ring).drop("cuts")
    else:
        ringed = keyed.withColumn("ring", F.col("cell"))
    measured = written(ringed.groupBy("ring").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")), "pivot-rings")
    rings = measured.collect()  # PIVOTS * ANNULI at most
    parts = measured.select("ring", F.ceil(F.col("n") / BLOCK).alias("parts"))
    gathered = (
        ringed.join(F.broadcast(parts), "ring")
        .withColumn("part", F.pmod(F.xxhash64("vec_id", "spot"), "parts"))
        .groupBy("ring", "part")
        .agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))
        .select("ring", F.col("rows.vec_id").alias("ids"), F.col("rows.v").alias("vs"))
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"ring": batch["ring"], "ids": batch["ids"], "data": [b"".join(v) for v in batch["vs"]]})

    blocks = written(gathered.mapInPandas(pack, "ring int, ids array<bigint>, data binary"), "pivot-blocks")
    return blocks, [(r["ring"], r["ring"] // annuli, r["low"], r["high"]) for r in rings]


def nearest(vectors: DataFrame, top: int = TOP, query_step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` vectors with the highest inner products of every query, without itself.

    Queries are the vectors (as of ``quantised``) whose id divides by ``query_step``; of rows that repeat such an id the
    least vector asks. Candidates are all rows with other ids, repeated ones each by itself. Rings are taken in the order
    of their least possible distance; a query stops before the first ring that the triangle inequality shows to
    be farther than its ``top``-th best so far. Equal scores go to the smaller id. Fewer vectors give fewer rows.
    """
    spark = vectors.sparkSession
    vectors = written(vectors, "pivot-vectors")
    square = F.aggregate("q", F.lit(0).cast("double"), lambda s, v: s + v.cast("double") * v.cast("double"))
    biggest = F.aggregate("q", F.lit(0).cast("long"), lambda s, v: F.greatest(s, F.abs(v)))
    n, width, most, norm = vectors.agg(F.count("*"), F.max(F.size("q")), F.max(biggest), F.max(square)).first()
    pivots = max(8, min(PIVOTS, math.isqrt(n) // 8))
    annuli = max(1, min(ANNULI, n // (pivots * BLOCK)))
    drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("q").collect()
    space = Space(width or 0, most or 0, norm or 0, [r["q"] for r in drawn])
    empty = spark.createDataFrame([], "query_id long, vec_id long, score long")
    if not n or not width:
        return empty.select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    blocks, rings = placed(vectors, space, annuli)
    number, pivot, low, high = (np.array(c) for c in zip(*rings))

    def planned(start: int, width_: int | None):
        """Which rings the queries look into from place ``start`` of their order on."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                q = batch["q"].tolist()
                far = space.to_pivots(q, True)[:, pivot]
                least = np.maximum(np.maximum(far - high[None], low[None] - far), 0)
                bound = np.array([np.inf if s is None else float(s) for s in batch["least"]])
                own = np.array([float(np.dot(np.array(x, float), np.array(x, float))) for x in q])
                reach = np.where(np.isinf(bound), np.inf, np.sqrt(np.maximum(own + space.square - 2 * bound, 0)) * (1 + 1e-9) + 1e-6)
                packed = space.packed(q)
                order = np.argsort(least, axis=1, kind="stable")[:, start:None if width_ is None else start + width_]
                row, at = np.nonzero(np.take_along_axis(least, order, axis=1) <= reach[:, None])
                if not row.size:
                    continue
                yield pd.DataFrame({
                    "ring": number[order[row, at]],
                    "query_id": batch["vec_id"].to_numpy()[row],
                    "least": [None if np.isinf(bound[i]) else str(int(bound[i])) for i in row],
                    "v": [packed[i] for i in row],
                })

        return run

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, data, asked in zip(batch["ids"], batch["data"], batch["asked"]):
                ids = np.asarray(ids, np.int64)
                order = np.argsort(ids, kind="stable")
                ids, vectors_ = ids[order], space.unpacked(data)[order]
                queries = space.unpacked(b"".join(a["v"] for a in asked))
                found = []
                for a, line in zip(asked, space.scores(queries, vectors_)):
                    good = ids != a["query_id"]
                    if a["least"] is not None:
                        good &= (line >= int(a["least"])).astype(bool)
                    at = np.flatnonzero(good)
                    best = at[np.argsort(-line[at], kind="stable")[:top]]
                    found.append(pd.DataFrame({"query_id": a["query_id"], "vec_id": ids[best], "score": line[best].astype(np.int64)}))
                if found:
                    yield pd.concat(found)

    asking_rows = vectors.filter(F.col("vec_id") % query_step == 0).groupBy("vec_id").agg(F.min("q").alias("q"))
    queries = written(asking_rows, "pivot-queries")
    best, start = empty, 0
    ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for step in ROUNDS:
        least = best.filter(F.col("rank") == top).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least")) if start else None
        asking = queries.join(least, "vec_id", "left") if start else queries.withColumn("least", F.lit(None).cast("long"))
        asking = asking.withColumn("least", F.col("least").cast("string"))  # a text: a null would make Python's numbers floats
        pairs = asking.mapInPandas(planned(start, step), "ring int, query_id long, least string, v binary")
        pairs = written(pairs, "pivot-pairs")
        crowd = F.broadcast(pairs.groupBy("ring").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("parts")))
        asked = (
            pairs.join(crowd, "ring")
            .groupBy("ring", F.pmod(F.xxhash64("query_id"), "parts").alias("part"))
            .agg(F.collect_list(F.struct("query_id", "least", "v")).alias("asked"))
            .select("ring", "asked")
        )
        found = blocks.join(asked, "ring").select("ids", "data", "asked").mapInPandas(search, "query_id long, vec_id long, score long")
        both = found.unionByName(best.select("query_id", "vec_id", "score"))
        best = written(both.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top), "pivot-best")
        start += step or 0
    return best.select("query_id", "rank", "vec_id", "score")
