"""The audit against SQL (see test_against_sql), against filters applied one by one, and on hard rows."""

from itertools import permutations

import duckdb
import pytest

from moodtide.llm import audit, queries

from ..oracle import compare
from .rows import HARD, LONG, frame

LABELS = "doc_id long, quality int, toxic int"


def one_by_one(rows, labels):
    """Every order applied left to right to the rows, as the contract words it."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for doc_id, text, lang, _ in rows:
        text = text or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text):
            fails.add("C")
        if any(c in "#$%&*|" for c in text):
            fails.add("D")
        if doc_id is not None and any((t or "") == text and i is not None and i < doc_id for i, t, _, _ in rows):
            fails.add("E")
        docs.append((lang or "", fails, doc_id))
    out = {}
    for part in {d[0] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            for step, name in enumerate(order, 1):
                lost = [d for d in left if name in d[1]]
                failing = [d for d in docs if d[0] == part and name in d[1]]
                left = [d for d in left if name not in d[1]]
                out[part, order, step] = [
                    len(left), len(lost), len(failing) - len(lost), sum(d[1] == {name} for d in failing),
                    sum(d[2] in good for d in lost), sum(d[2] in toxic for d in lost),
                ]
    for (part, order, step), row in list(out.items()):
        row.append(sum(r[1] for (p, o, s), r in out.items() if p == part and o[s - 1] == order[step - 1]))
    return {k: tuple(v) for k, v in out.items()}


MORE = [
    (20, "ONE TWO # three", "en", "a"),
    (21, "word " * 300, "en", "a"),
    (22, " ".join(f"w{i}" for i in range(250)), "en", "a"),
    (23, " ".join(f"W{i} |" for i in range(250)), None, "a"),
    (24, " ".join(f"w{i}" for i in range(250)), "de", "a"),
]
MARKED = [(1, 1, 0), (2, 0, 1), (2, 1, None), (20, 1, 1), (24, 1, 0), (None, 1, 1), (99, 1, 1)]


@pytest.mark.parametrize("clash", [(), ("mask", "docs", "first", "x", "part", "good")])
def test_all_orders_as_one_by_one(spark, clash):
    docs = frame(spark, HARD + MORE, clash)
    got = audit.audited(docs, spark.createDataFrame(MARKED, LABELS).selectExpr("*", "'z' AS text"))
    rows = {(r[0], r[1], r[2]): tuple(r[3:]) for r in got.collect()}
    assert rows == one_by_one(HARD + MORE, MARKED)
    assert len(rows) == len({(r[2] or "") for r in HARD + MORE}) * 120 * 5


def test_hard_rows_as_sql(spark, tmp_path):
    frame(spark, HARD + MORE).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(MARKED, LABELS).coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert compare(spark, con, queries.QUERIES["op13_filter_audit"], queries.SQL["op13_filter_audit"], str(tmp_path)) is None


def test_swaps_meet_every_order_and_keep_the_counts():
    weights = {mask: (mask % 7 + 1, mask % 3, mask % 2) for mask in range(0, 32, 3)}
    diagram, seen = audit.Diagram("ABCDE", weights), set()
    total = tuple(map(sum, zip(*weights.values(), strict=True)))
    for level in [*audit.adjacent_swaps(5), None]:
        seen.add("".join(diagram.order))
        assert diagram.weight(diagram.root) == total
        *_, (_, kept, _) = diagram.path()
        assert kept == weights[0]
        if level is not None:
            diagram.swap(level)
    assert len(seen) == 120


def test_empty_tables_and_one_long_text(spark):
    none = spark.createDataFrame([], LABELS)
    assert audit.audited(frame(spark, []), none).count() == 0
    row = audit.audited(frame(spark, [(1, LONG, "en", "s")]), none).filter("filter_order = 'ABCDE' AND step = 2").first()
    assert (row.kept, row.removed) == (0, 1)
