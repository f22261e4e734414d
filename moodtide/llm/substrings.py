"""Exact substring removal: difference-cover blockwise sorting of suffixes.

A byte goes if a string of ``length`` bytes that starts earlier (smaller id, or further up in the same document) holds
it. Two suffixes matter to each other only if they tie for ``length`` bytes, so suffixes are sorted by keys of that
depth, and only those that can tie at all:

1. *Cover sample.* With a perfect difference set as the cover, any two suffixes of the corpus meet the cover together
   within one period. Strings of ``length - period + 1`` bytes at cover places (a seventh of all places) are sorted
   bucket by bucket. The rank of a string is its place in that order; one rank in two places is a tie, and a suffix
   none of whose cover samples is tied has no equal anywhere and is settled.
2. *Suffix buckets.* The other suffixes are keyed by their first ``length`` bytes (80 bits) and sorted bucket by bucket.
   In each run of equal keys all but the earliest are repeats.
3. *Removal.* Each block marks the bytes of its repeats.

Texts never move after the first step writes them as a table of blocks (about ``BLOCK`` bytes, a longer text alone),
bucketed by block: what is known of a block is joined to it where it lies. A block sends each key once and gets one bit
per key back, so a passage that all documents share is one key per block. A task sorts one bucket at a time; the number
of buckets follows the input. Equal whole texts are found first by their digest, so a copy costs 32 bytes, not its
suffixes.

Orders use digests of the strings in place of their bytes, since only ties count. A false tie of 48-bit sample ranks
costs time, never rows; 80-bit suffix keys that collide would cost a row: below 10^-5 expected at 30 GB.

Rows: a null text counts as empty; a null id comes after all others; rows with equal ids are documents of their own,
in the order of their digests, and of equal rows one is the earliest. Texts shorter than ``length`` lose nothing and
take nothing. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..session import fresh_path
from .common import written

#: Perfect difference sets by their period; all differences but 0 occur exactly once.
COVERS = {
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
}
#: Depth of a match in bytes.
LENGTH = 100
#: Bytes of text in a block, unless one text is longer.
BLOCK = 8 << 20
#: Bytes of text per bucket of suffixes; a bucket of that much text is sorted in one piece.
BUCKET = 16 << 20
#: Places hashed at once, so that the working arrays stay in the processor's cache.
SLICE = 1 << 17
RANK_BITS = 48

DOCS = "block long, place int, doc_id long, text_key binary, body binary"
SENT = "bucket int, block long, data binary, ids array<long>, ties array<long>, owners binary"
TOLD = "block long, kind int, bucket int, data binary"
FIRST, SAMPLES, REPEATS = 0, 1, 2
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def period_for(length: int) -> int:
    """The longest period that leaves sample strings of 40 % of the depth at least."""
    fitting = [p for p in COVERS if length - p + 1 >= max(8, 0.4 * length)]
    if not fitting:
        raise ValueError("matches must be 14 bytes at least")
    return max(fitting)


def digests(body: np.ndarray, starts: np.ndarray, width: int, kinds: tuple[int, ...] = (0,)) -> list[np.ndarray]:
    """64-bit digests of the ``width`` bytes at each start, one array per kind, eight bytes at a time."""
    out = [np.empty(len(starts), np.uint64) for _ in kinds]
    words = np.ndarray((max(len(body) - 7, 0),), "<u8", body, 0, (1,))
    steps = [*range(0, width - 7, 8)]
    if steps[-1] + 8 < width:
        steps.append(width - 8)
    for at in range(0, len(starts), SLICE):
        part = starts[at : at + SLICE]
        found = [np.full(len(part), width, np.uint64) for _ in kinds]
        for step in steps:
            read = words[part + step]
            for kind, value in zip(kinds, found, strict=True):
                value ^= read
                value *= _MULTIPLIERS[kind]
                value ^= value >> np.uint64(29 + 3 * kind)
        for kind, value, whole in zip(kinds, found, out, strict=True):
            value *= _MULTIPLIERS[1 - kind]
            whole[at : at + SLICE] = value ^ (value >> np.uint64(32))
    return out


class Texts:
    """The earliest copies of a block's texts, one after another in the order of documents."""

    def __init__(self, docs: pa.Table, first: set[int], length: int):
        self.length, self.period = length, period_for(length)
        ids, keys, places = (docs[c].to_pylist() for c in ("doc_id", "text_key", "place"))
        bodies = docs["body"]
        chosen = [
            (ids[i] is None, ids[i] or 0, keys[i], i)
            for i in range(docs.num_rows)
            if places[i] in first and len(bodies[i].as_buffer()) >= length
        ]
        chosen.sort(key=lambda doc: doc[:3])
        self.rows = [doc[3] for doc in chosen]
        parts = [np.frombuffer(bodies[i].as_buffer(), np.uint8) for i in self.rows]
        self.body = np.concatenate([*parts, np.zeros(8, np.uint8)])
        self.ends = np.cumsum([0, *map(len, parts)])
        self.ids = np.array([doc[1] for doc in chosen], np.int64)
        self.ties = np.array([(doc[0] << 62) | int.from_bytes(doc[2][:8], "big") >> 2 for doc in chosen], np.int64)

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Cover places and the ranks of the strings there."""
        width = self.length - self.period + 1
        cover = np.array(COVERS[self.period])
        places = []
        for start, end in zip(self.ends[:-1], self.ends[1:], strict=True):
            all_of = (np.arange(0, end - start, self.period)[:, None] + cover).ravel()
            places.append(start + all_of[all_of <= end - start - width])
        starts = np.concatenate([np.empty(0, np.int64), *places])
        return starts, digests(self.body, starts, width)[0] >> np.uint64(64 - RANK_BITS)

    def candidates(self, tied_elsewhere: np.ndarray) -> np.ndarray:
        """Suffixes with a tied cover sample; the argument marks ranks, in their order, that other blocks hold too."""
        starts, ranks = self.samples()
        _, place, times = np.unique(ranks, return_inverse=True, return_counts=True)
        tied = starts[((times > 1) | tied_elsewhere)[place]]
        steps = np.zeros(len(self.body) + 1, np.int32)
        owner = np.searchsorted(self.ends, tied, "right") - 1
        np.add.at(steps, np.maximum(tied - self.period + 1, self.ends[owner]), 1)
        np.add.at(steps, tied + 1, -1)
        near = np.cumsum(steps)[: self.ends[-1]] > 0
        for end in self.ends[1:]:
            near[end - self.length + 1 : end] = False
        return np.flatnonzero(near)

    def suffixes(self, tied_elsewhere: np.ndarray) -> tuple[np.ndarray, ...]:
        """Candidates; for each the number of its key; of each key the two digests, and its first candidate."""
        starts = self.candidates(tied_elsewhere)
        head, tail = digests(self.body, starts, self.length, (0, 1))
        tail >>= np.uint64(48)
        order = np.argsort(head, kind="stable")
        same = head[order][1:] == head[order][:-1]
        if (tail[order][1:][same] != tail[order][:-1][same]).any():
            order = np.lexsort((starts, tail, head))
        head, tail = head[order], tail[order]
        new = np.ones(len(order), bool)
        new[1:] = (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        return starts, of, head[new], tail[new], starts[order][new]

    def sent_order(self, head: np.ndarray, first: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
        """Keys in the order they are sent in: by bucket, then by document; with both of these."""
        bucket = bucket_of(head, 64, buckets)
        owner = np.searchsorted(self.ends, first, "right") - 1
        n = len(head)
        if buckets * len(self.ends) * n < 1 << 63:  # one sort of whole numbers, the key's own place as the last digit
            order = np.sort((bucket.astype(np.int64) * len(self.ends) + owner) * n + np.arange(n)) % max(n, 1)
        else:
            order = np.lexsort((owner, bucket))
        return order, bucket[order], owner[order]


def bucket_of(ranks: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """The bucket of each rank: equal ranges of the rank's upper 32 bits."""
    return ((ranks >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values in ascending order; sorting is several times faster than the hash table of ``np.unique``."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of each run of equal values."""
    cuts = np.flatnonzero(np.diff(values)) + 1
    edges = [0, *cuts.tolist(), len(values)]
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        if end > start:
            yield int(values[start]), start, end


def _packed(ranks: np.ndarray) -> bytes:
    """Ascending ranks as one full rank and 32-bit gaps, or all in full where a gap is wider."""
    gaps = np.diff(ranks)
    if len(gaps) and gaps.max() >= 1 << 32:
        return b"\1" + ranks.astype("<u8").tobytes()
    return b"\0" + ranks[:1].astype("<u8").tobytes() + gaps.astype("<u4").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if data[0]:
        return np.frombuffer(data, "<u8", offset=1)
    first = np.frombuffer(data, "<u8", count=1, offset=1)
    return np.cumsum(np.concatenate([first, np.frombuffer(data, "<u4", offset=9).astype(np.uint64)]), dtype=np.uint64)


def blocks_table(docs: DataFrame) -> DataFrame:
    """The documents with their block, as a table bucketed by block in the shared folder.

    Blocks are cut as the rows come, without a shuffle; the written table fixes them.
    """
    spark = docs.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, place, held = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            blocks, places = [], []
            for size in pc.binary_length(batch["body"]).to_pylist():
                if place and held + size > BLOCK:
                    block, place, held = block + 1, 0, 0
                blocks.append(block)
                places.append(place)
                place, held = place + 1, held + size
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int64()), pa.array(places, pa.int32()), batch["doc_id"], batch["text_key"], batch["body"]],
                [c.split()[0] for c in DOCS.split(", ")],
            )

    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", body.alias("body")).select("doc_id", F.unhex(F.sha2("body", 256)).alias("text_key"), "body")
    path = fresh_path(spark, "suffix-blocks")
    name = f"suffix_blocks_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = rows.mapInArrow(cut, DOCS).write.bucketBy(parts, "block").sortBy("block").option("path", path).format("parquet")
    made.saveAsTable(name)
    return spark.table(name)


def first_copies(blocks: DataFrame) -> DataFrame:
    """To each block the places of its texts that no earlier document repeats."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "block", "place")
    least = blocks.groupBy("text_key").agg(F.min(order).alias("least")).select("least.block", "least.place")
    told = F.collect_list("place").cast("array<int>")
    return least.groupBy("block").agg(F.to_json(told).cast("binary").alias("data")).select(
        "block", F.lit(FIRST).alias("kind"), F.lit(0).alias("bucket"), "data"
    )


def _notes(told: pa.Table) -> tuple[set[int], dict[int, np.ndarray]]:
    """What a block was told: its first copies, and per kind the bits of its keys in the order they were sent in."""
    rows = sorted(told.select(["kind", "bucket", "data"]).to_pylist(), key=lambda row: (row["kind"], row["bucket"]))
    first = {int(x) for row in rows if row["kind"] == FIRST for x in row["data"].decode().strip("[]").split(",") if x}
    bits = {}
    for kind in (SAMPLES, REPEATS):
        own = [row["data"] for row in rows if row["kind"] == kind]
        counts = [int.from_bytes(data[:4], "little") for data in own]
        parts = [np.unpackbits(np.frombuffer(d, np.uint8, offset=4), count=n) for d, n in zip(own, counts, strict=True)]
        bits[kind] = np.concatenate([np.empty(0, np.uint8), *parts]).astype(bool)
    return first, bits


def _bits(marks: np.ndarray) -> bytes:
    return len(marks).to_bytes(4, "little") + np.packbits(marks).tobytes()


def _by_bucket(answer, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gather the rows of one bucket after another and answer each; rows come sorted by bucket."""
    names = [c.split()[0] for c in TOLD.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def told(rows: list[dict]) -> pa.RecordBatch:
        columns = zip(*answer(rows), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["bucket"] != row["bucket"]:
                yield told(held)
                held = []
            held.append(row)
    if held:
        yield told(held)


def tied_samples(rows: list[dict]) -> list[tuple]:
    """Of a bucket of cover samples: for each block, which of its ranks another block holds too."""
    parts = [_unpacked(row["data"]) for row in rows]
    ranks = np.concatenate(parts)
    order = np.argsort(ranks, kind="stable")
    equal = ranks[order][1:] == ranks[order][:-1]
    tied = np.zeros(len(ranks), bool)
    tied[order[1:][equal]] = True
    tied[order[:-1][equal]] = True
    ends = np.cumsum([0, *map(len, parts)])
    return [(row["block"], SAMPLES, row["bucket"], _bits(tied[a:b])) for row, a, b in zip(rows, ends[:-1], ends[1:], strict=True)]


def late_suffixes(rows: list[dict]) -> list[tuple]:
    """Of a bucket of suffix keys: for each block, which of its keys an earlier document of another block holds."""
    heads, tails, ids, ties, owners, sizes = [], [], [], [], [], []
    known = 0
    for row in rows:
        n = len(row["data"]) // 10
        heads.append(np.frombuffer(row["data"], "<u8", count=n))
        tails.append(np.frombuffer(row["data"], "<u2", offset=8 * n))
        owners.append(np.frombuffer(row["owners"], "<u4") + known)
        ids += row["ids"]
        ties += row["ties"]
        known = len(ids)
        sizes.append(n)
    head, tail, owner = np.concatenate(heads), np.concatenate(tails), np.concatenate(owners)
    age = np.empty(known, np.int64)
    age[np.lexsort((ties, ids, np.array(ties, np.int64) >> 62))] = np.arange(known)
    order = np.argsort(head, kind="stable")
    same = head[order][1:] == head[order][:-1]
    some = np.zeros(len(order), bool)
    some[1:] |= same
    some[:-1] |= same
    order = order[some]
    order = order[np.lexsort((age[owner[order]], tail[order], head[order]))]
    late = np.zeros(len(head), bool)
    late[order[1:]] = (head[order[1:]] == head[order[:-1]]) & (tail[order[1:]] == tail[order[:-1]])
    ends = np.cumsum([0, *sizes])
    return [(row["block"], REPEATS, row["bucket"], _bits(late[a:b])) for row, a, b in zip(rows, ends[:-1], ends[1:], strict=True)]


def _answered(sent: DataFrame, answer, buckets: int) -> DataFrame:
    """The answers to all buckets, each sorted by itself."""
    parts = min(buckets, int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = sent.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(lambda batches: _by_bucket(answer, batches), TOLD)


def _of_blocks(blocks: DataFrame, notes: DataFrame, made, schema: str) -> DataFrame:
    """Each block with what it was told, where it lies; the notes move, the texts do not."""
    return blocks.groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(made, schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_SENT = pa.schema(
    [
        ("bucket", pa.int32()), ("block", pa.int64()), ("data", pa.binary()), ("ids", pa.list_(pa.int64())),
        ("ties", pa.list_(pa.int64())), ("owners", pa.binary()),
    ]
)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", _SPANS), ("kept", pa.binary())])
RESULT = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, the removed spans in bytes, and the bytes that are kept, for every document."""
    period_for(length)
    blocks = blocks_table(docs)
    size = blocks.agg(F.sum(F.octet_length("body")).alias("bytes")).first().bytes or 0
    buckets = max(1, -(-size // BUCKET))
    first = written(first_copies(blocks), "suffix-first")

    def send_samples(key: tuple, own: pa.Table, told: pa.Table) -> pa.Table:
        texts = Texts(own, _notes(told)[0], length)
        ranks = distinct(texts.samples()[1])
        sent = [
            (bucket, key[0].as_py(), _packed(ranks[a:b]), None, None, None)
            for bucket, a, b in _runs(bucket_of(ranks, RANK_BITS, buckets))
        ]
        return _table(sent, _SENT)

    def send_suffixes(key: tuple, own: pa.Table, told: pa.Table) -> pa.Table:
        first, bits = _notes(told)
        texts = Texts(own, first, length)
        _, _, head, tail, place = texts.suffixes(bits[SAMPLES])
        order, bucket, owner = texts.sent_order(head, place, buckets)
        sent = []
        for number, a, b in _runs(bucket):
            new = np.ones(b - a, bool)
            new[1:] = owner[a + 1 : b] != owner[a : b - 1]  # owners ascend within a bucket
            who, owners = owner[a:b][new], np.cumsum(new) - 1
            data = head[order[a:b]].astype("<u8").tobytes() + tail[order[a:b]].astype("<u2").tobytes()
            sent.append(
                (number, key[0].as_py(), data, texts.ids[who].tolist(), texts.ties[who].tolist(), owners.astype("<u4").tobytes())
            )
        return _table(sent, _SENT)

    def cut_out(key: tuple, own: pa.Table, told: pa.Table) -> pa.Table:
        first, bits = _notes(told)
        texts = Texts(own, first, length)
        starts, of, head, _, place = texts.suffixes(bits[SAMPLES])
        order = texts.sent_order(head, place, buckets)[0]
        late = np.zeros(len(head), bool)
        late[order] = bits[REPEATS]
        gone = starts[late[of] | (starts != place[of])]
        steps = np.zeros(len(texts.body) + 1, np.int32)
        steps[gone] += 1
        steps[gone + length] -= 1
        covered = np.cumsum(steps)[: texts.ends[-1]] > 0
        at = {row: i for i, row in enumerate(texts.rows)}
        ids, places, bodies = own["doc_id"].to_pylist(), own["place"].to_pylist(), own["body"]
        rows = []
        for i, doc_id in enumerate(ids):
            body = bodies[i].as_buffer()
            if i in at:
                mask = covered[texts.ends[at[i]] : texts.ends[at[i] + 1]]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).reshape(-1, 2).tolist()
                kept = np.frombuffer(body, np.uint8)[~mask].tobytes() if edges else body.to_pybytes()
            elif len(body) >= length and places[i] not in first:
                edges, kept = [[0, len(body)]], b""
            else:
                edges, kept = [], body.to_pybytes()
            rows.append((doc_id, len(body), [{"start": a, "end": b} for a, b in edges], kept))
        return _table(rows, _RESULT)

    tied = written(_answered(_of_blocks(blocks, first, send_samples, SENT), tied_samples, buckets), "suffix-samples")
    late = written(_answered(_of_blocks(blocks, first.union(tied), send_suffixes, SENT), late_suffixes, buckets), "suffix-repeats")
    return _of_blocks(blocks, first.union(tied).union(late), cut_out, RESULT)


def digest(result: DataFrame) -> DataFrame:
    """The counts and the digest of what is kept."""
    taken: Column = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span.end - span.start)
    return result.select(
        "doc_id",
        "n_bytes",
        taken.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
