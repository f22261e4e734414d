"""Hard rows that every operator must take: nulls, empty and very long texts, ties, repeated rows, clashing names."""

LONG = "alpha beta gamma delta " * 30_000
NOTE = "the quick brown fox jumps over the lazy dog and then it runs far away into the deep dark wood near the old mill"

HARD = [
    (1, NOTE, "en", "a"),
    (2, NOTE, "en", "a"),
    (2, NOTE, "en", "a"),
    (2, NOTE, "en", "a"),
    (3, None, "en", "b"),
    (4, "", None, "b"),
    (5, " \t\n\x0b ", "en", None),
    (6, LONG, "en", "b"),
    (7, "écrit à Ünï 日本語 😀 ▁x\x00y", "fr", None),
    (None, NOTE + " again", None, None),
    (None, "only once", "en", "c"),
    (None, None, None, None),
    (8, "x", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def frame(spark, rows, clash=()):
    """Documents; ``clash`` adds columns of those names."""
    out = spark.createDataFrame(rows, SCHEMA)
    for name in clash:
        out = out.selectExpr("*", f"'kept' AS `{name}`")
    return out
