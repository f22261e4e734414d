"""Mixing sources to target weights by pivotal rounding along a distributed reduction tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import fraction, plain_text, words_of, written

#: Fixed by the contract: source weights by code point order, the share of all words, the most copies.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
#: Documents that meet in one node of the tree, on average.
FAN_IN = 64


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (number of words; 0 for a null text) of every row."""
    return docs.select("doc_id", "source", F.size(words_of(plain_text())).cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row per source: source_size, n_docs, target.

    Sources in code point order, null last, take the weights in turn. The shared words are dealt by weight;
    what exceeds ``cap`` times a source's size is dealt again among the others until none is above. That is the
    level at which the least capped sources meet their share, found from running sums over the sources alone.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), (turn % len(weights)).cast("int"))
    ranked = totals.withColumn("weight", weight).withColumn("most", cap * F.col("source_size").cast("double"))
    rising = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = rising.rowsBetween(W.unboundedPreceding, -1), rising.rowsBetween(W.currentRow, W.unboundedFollowing)
    everywhere = W.partitionBy()
    level = (share * F.sum("source_size").over(everywhere) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(after)
    leveled = ranked.withColumn("level", level).withColumn("place", F.row_number().over(rising))
    first = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("place", "level"))
    fits = F.min(first).over(everywhere)["level"]
    return leveled.select(
        "source",
        "source_size",
        "n_docs",
        F.least("most", F.coalesce(fits * F.col("weight"), F.col("most"))).alias("target"),
    )


def _folded(units: Column, seed: int) -> Column:
    """Fold an array of (key, doc_id, size, mass_unit, p) in its order, two at a time.

    Of the pair, words move from one to the other until one copy probability is 0 or 1; which way is drawn so
    that every probability keeps its mean, and the words expected of both stay the same whichever way.
    """
    unit = "struct<key:bigint,doc_id:bigint,size:bigint,m:double,p:double>"
    empty = F.struct(F.lit(None).cast(unit).alias("rest"), F.lit(None).cast("array<struct<doc_id:bigint,size:bigint,extra:int>>").alias("done"))

    def settled(x: Column, extra: int) -> Column:
        return F.array(F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), F.lit(extra).alias("extra")))

    def left(x: Column, mass: Column) -> Column:
        return F.struct(x["key"].alias("key"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["m"].alias("m"),
                        F.least(F.greatest(mass / x["m"], F.lit(0.0)), F.lit(1.0)).alias("p"))

    def met(state: Column, b: Column) -> Column:
        a, done = state["rest"], F.coalesce(state["done"], F.array().cast("array<struct<doc_id:bigint,size:bigint,extra:int>>"))
        has_a, has_b, lacks_a, lacks_b = a["p"] * a["m"], b["p"] * b["m"], (1 - a["p"]) * a["m"], (1 - b["p"]) * b["m"]
        to_a, to_b = F.least(lacks_a, has_b), F.least(has_a, lacks_b)
        up = fraction(F.lit(seed), a["doc_id"], a["size"], b["doc_id"], b["size"]) * (to_a + to_b) < to_b
        pair = lambda rest, out: F.struct(rest.alias("rest"), F.concat(done, out).alias("done"))
        return (
            F.when(a.isNull(), F.struct(b.alias("rest"), done.alias("done")))
            .when(up & (lacks_a <= has_b), pair(left(b, has_b - lacks_a), settled(a, 1)))
            .when(up, pair(left(a, has_a + has_b), settled(b, 0)))
            .when(has_a <= lacks_b, pair(left(b, has_b + has_a), settled(a, 0)))
            .otherwise(pair(left(a, has_a - lacks_b), settled(b, 1)))
        )

    return F.aggregate(units, empty, met)


def rounded(units: DataFrame, largest: int, seed: int, fan_in: int = FAN_IN) -> DataFrame:
    """source, doc_id, size, extra (0 or 1) for units (source, n_docs, doc_id, size, m, p), p in (0, 1).

    Each level of the tree deals the units of a source to nodes of about ``fan_in`` by a hash of their id, folds
    every node, and hands the one unsettled unit of each to the next level; the last is drawn by its probability.
    A source with a third of all rows only has more nodes. ``largest`` is the most units that a source has.
    """
    settled, level, now = None, 0, units
    while True:
        nodes = F.greatest(F.ceil(F.col("n_docs") / float(fan_in ** (level + 1))), F.lit(1)).cast("long")
        key = F.xxhash64(F.lit(seed + level), "doc_id", "size")
        dealt = now.select("source", "n_docs", F.pmod(key, nodes).alias("node"),
                           F.struct(key.alias("key"), "doc_id", "size", "m", "p").alias("unit"))
        folded = dealt.groupBy("source", "n_docs", "node").agg(F.collect_list("unit").alias("units"))
        state = folded.select("source", "n_docs", _folded(F.sort_array("units"), seed).alias("state"))
        last = largest <= fan_in ** (level + 1)
        kept = written(state.select("source", "n_docs", "state.rest", "state.done"), f"mix-level-{level}")
        done = kept.select("source", F.explode("done").alias("d")).select("source", "d.*")
        now = kept.select("source", "n_docs", "rest.doc_id", "rest.size", "rest.m", "rest.p")
        settled = done if settled is None else settled.unionByName(done)
        if last:
            drawn = (fraction(F.lit(seed), F.lit("last"), F.col("doc_id"), F.col("size")) < F.col("p")).cast("int")
            return settled.unionByName(now.select("source", "doc_id", "size", drawn.alias("extra")))
        level += 1


def decided(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = 20240601) -> DataFrame:
    """One row per unit: doc_id, source, size, source_size, target, rows, whole, extra.

    A unit is the rows that agree in doc_id, source and size, one row as a rule. Each of its ``rows`` has ``whole``
    copies, and ``extra`` of them one more. Every document of a source has the same expected copies, target /
    source_size: of a unit's rows as many get one more as is certain, and only the fraction of one row is left to the
    rounding, which moves words between pairs, so that a source takes its target up to one document.
    """
    sizes = written(sized(docs), "mix-sizes")
    targets = written(source_targets(sizes, weights, share, cap), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = targets.select("source", "source_size", "n_docs", "target", F.floor(rate).cast("int").alias("whole"),
                           (rate - F.floor(rate)).alias("p"))
    counted = sizes.groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows"))
    units = counted.join(F.broadcast(rates) if _few(rates) else rates, counted["source"].eqNullSafe(rates["source"])).drop(rates["source"])
    expected = F.when(F.col("size") > 0, F.col("rows") * F.col("p")).otherwise(F.lit(0.0))
    units = units.withColumn("sure", F.floor(expected).cast("long")).withColumn("p", expected - F.floor(expected))
    units = written(units, "mix-units")
    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    drawn = rounded(
        units.filter("p > 0").select("source", "n_docs", "doc_id", "size", F.col("size").cast("double").alias("m"), "p"), largest, seed
    )
    same = [units[c].eqNullSafe(drawn[c]) for c in ("source", "doc_id", "size")]
    return units.join(drawn, same[0] & same[1] & same[2], "left").select(
        units["doc_id"],
        units["source"],
        units["size"],
        "source_size",
        "target",
        "rows",
        "whole",
        (F.col("sure") + F.coalesce(drawn["extra"], F.lit(0))).alias("extra"),
    )


#: Rows of a unit that are listed from one entry.
LISTED = 1 << 16


def mixed(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken (copies times size).

    Of rows that agree in doc_id, source and size the first so many have one copy more, see ``decided``. Documents
    without words take none more than their source's whole copies, of no words. A null source is a source of its own,
    null ids are told apart by their sizes. All draws are hashes: reruns agree. An empty table gives an empty result.
    """
    units = decided(docs, **options)
    starts = F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(LISTED).cast("long"))
    listed = units.withColumn("start", F.explode(starts))
    number = F.explode(F.sequence("start", F.least(F.col("start") + LISTED, F.col("rows")) - 1))
    rows = listed.withColumn("number", number)
    copies = F.col("whole") + F.when(F.col("number") < F.col("extra"), 1).otherwise(0)
    return rows.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        copies.cast("int").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
    )


def _few(rates: DataFrame, most: int = 20_000) -> bool:
    """Whether the summary of the sources is small enough to send to every executor."""
    return rates.limit(most + 1).count() <= most


def copied(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix takes them: each row as often as its copies say, none where they are 0.

    Columns are those of the input. Rows are matched to their decision by doc_id, source and size. Rows that share a
    decision are first folded to the different ones among them, and take its copies in the order of their digests.
    """
    units = written(decided(docs, **options), "mix-decided")
    some = units.filter((F.col("whole") > 0) | (F.col("extra") > 0)).select("doc_id", "source", "size", "rows", "whole", "extra")
    some = some.select(*(F.col(c).alias(f"__{c}") for c in some.columns))
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__words") == F.col("__size"))
    counted = docs.withColumn("__words", F.size(words_of(plain_text())).cast("long"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    single = counted.join(some.filter("__rows = 1"), same).select(*own, (F.col("__whole") + F.col("__extra")).alias("__copies"))
    taken = single
    if not units.filter("rows > 1").isEmpty():
        unit = ["__doc_id", "__source", "__size", "__whole", "__extra"]
        several = counted.join(some.filter("__rows > 1"), same).groupBy(*own, *unit).agg(F.count("*").alias("__times"))
        order = W.partitionBy("__doc_id", "__source", "__size").orderBy(F.sha2(F.to_json(F.struct(*own)), 256))
        before = F.coalesce(F.sum("__times").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        more = F.greatest(F.least(F.col("__times"), F.col("__extra") - before), F.lit(0))
        taken = single.unionByName(several.select(*own, (F.col("__times") * F.col("__whole") + more).alias("__copies")))
    listed = taken.filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies").cast("long"))))
    return listed.select(*own)
