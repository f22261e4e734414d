import random
import re

import pytest
from pyspark.sql import functions as F

from moodtide.functions import text as tx
from moodtide.sources import keywords as kw


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "n int, text string")


def run(spark, values, column):
    rows = texts(spark, values).select("n", column(F.col("text")).alias("out")).orderBy("n").collect()
    return [row.out for row in rows]


CLEANED = [
    (None, ""),
    ("", ""),
    ("   ", ""),
    ("Plain words", "plain words"),
    ("Tabs\tand\nlines  and   gaps ", "tabs and lines and gaps"),
    ("No-break\u00a0space and\u2003wide\u3000gaps", "nobreak space and wide gaps"),
    ("See https://a.b/c?d=1 now", "see now"),
    ("www.x.y/z, ends", "ends"),
    ("joined:http://x.y", "joined"),
    ("link http://x.y\u00a0after", "link after"),
    ("wwwhat is taken along", "is taken along"),
    ("@user said #Tag1 and_more", "said andmore"),
    ("@ alone # signs", "alone signs"),
    ("#été @Zoë_1 stays", "stays"),
    ("#日本語 gone", "gone"),
    ("#a-b keeps b", "b keeps b"),
    ("Café déjà vu", "caf dj vu"),
    ("ÉCOLE", "cole"),
    ("don't 42 times!", "dont times"),
    ("x_y", "xy"),
    ("emoji 😀 here", "emoji here"),
    ("K is a sign for kelvin", "k is a sign for kelvin"),
]


@pytest.mark.parametrize(("text", "clean"), CLEANED)
def test_cleaned_by_hand(spark, text, clean):
    assert run(spark, [text], tx.clean_text) == [clean]
    assert run(spark, [text], tx.words) == [clean.split()]


def mixed(count):
    """Texts put together from pieces that meet in awkward ways."""
    pieces = ["http", "https://a.b/c", "www", "www.x.y", "@", "#", "@user", "#Tag1", " ", "\n", "\u00a0", "a", "Bc", "é", "É", "42", "_", "!", "😀", "the"]
    rng = random.Random(7)
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 14))) for _ in range(count)]


def test_what_cleaning_promises(spark):
    values = mixed(2000)
    once = run(spark, values, tx.clean_text)
    assert all(re.fullmatch(r"(?:[a-z]+(?: [a-z]+)*)?", c) for c in once)
    assert not any(re.search("(?:http|www)[a-z]", c) for c in once)
    assert run(spark, once, tx.clean_text) == once
    assert run(spark, values, tx.words) == [c.split() for c in once]


def test_ascii_classes_on_request(spark):
    given = ["a\u00a0b", "#été x"]
    assert run(spark, given, lambda c: tx.clean_text(c, unicode=False)) == ["ab", "t x"]
    assert run(spark, given, tx.clean_text) == ["a b", "x"]


def test_tokens_split_joined_pairs_and_drop_stopwords(spark):
    got = run(spark, ["I cannot say, gonna lemme go! wannabe #tag", "THE and of", "", None], tx.tokens)
    assert got == [["say", "gon", "na", "lem", "go", "wannabe"], [], [], []]
    assert run(spark, ["I cannot say"], tx.preprocess) == ["say"]


def test_tweet_recipe_on_its_published_examples(spark):
    # Three published examples.
    given = [
        "I love this product! #amazing @company https://example.com",
        "@user This is terrible... why would anyone buy this? #disappointed",
        "It's okay I guess. Nothing special. Check out www.example.com for more info",
    ]
    assert run(spark, given, tx.preprocess_tweet) == [
        "i love this product! amazing [USER] [URL]",
        "[USER] this is terrible... why would anyone buy this? disappointed",
        "it's okay i guess. nothing special. check out [URL] for more info",
    ]


def test_tweet_link_ends_at_hash_and_tilde(spark):
    assert run(spark, ["see https://a.b/c?d=e~f", "https://a.b/#x y"], tx.preprocess_tweet) == ["see [URL]~f", "[URL]x y"]


def test_social_recipe_marks_mentions_as_links(spark):
    given = ["\tHi @Bob see http://x.y #Go \n", "\u00a0@Zoë #été\u3000"]
    assert run(spark, given, tx.clean_text_social) == ["hi [URL] see [URL] go", "[URL] été"]


def test_word_count_counts_empty_pieces(spark):
    assert run(spark, ["a  b ", ""], tx.word_count) == [4, 1]


def test_ellipsis_only_beyond_the_limit(spark):
    got = run(spark, ["x" * 200, "x" * 201, None], lambda c: tx.ellipsize(c, 200))
    assert got == ["x" * 200, "x" * 200 + "...", ""]


def test_first_and_all_tags(spark):
    values = ["#one and #two", "http://x.y/p#frag", "none", None]
    assert run(spark, values, tx.first_hashtag) == ["one", "frag", "", None]
    assert run(spark, values, tx.all_hashtags) == [["one", "two"], ["frag"], [], None]


@pytest.mark.parametrize("table", [False, True])
def test_keywords_match_whole_phrases(spark, table):
    posts = texts(spark, ["Learn Machine   learning, now", "machines learning", "AI!", "said", "#python", "a machine", None])
    tracked = ["python", "AI", "machine learning"]
    if table:
        rows = kw.match_keyword_table(posts, kw.keyword_table(spark, tracked), key="n").collect()
        found = sorted((row.n, row.keyword) for row in rows)
    else:
        rows = posts.select("n", F.explode(kw.matched_keywords(F.col("text"), tracked)).alias("keyword")).collect()
        found = sorted((row.n, row.keyword) for row in rows)
    assert found == [(0, "machine learning"), (2, "AI"), (4, "python")]


def test_keyword_table_has_no_longest_phrase(spark):
    posts = texts(spark, ["one two three four five six seven", "two three", ""])
    tracked = kw.keyword_table(spark, ["two three four five six seven", "Two-Three", "!!"])
    got = sorted((r.n, r.keyword) for r in kw.match_keyword_table(posts, tracked, key="n").collect())
    assert got == [(0, "Two-Three"), (0, "two three four five six seven"), (1, "Two-Three")]
    assert kw.match_keyword_table(posts, tracked.filter("keyword = '!!'"), key="n").count() == 0


def test_patterns_tried_at_every_character_are_bit_tests(spark):
    frame = texts(spark, ["x"])
    for column in (tx.clean_text, tx.words, tx.tokens):
        plan = frame.select(column(F.col("text")))._jdf.queryExecution().analyzed().toString()
        searched = plan.replace(f"[{tx.WIDE_SPACES}]", "")  # only where the bytes can hold one
        assert not [c for c in searched if ord(c) > 0xFF]


def test_patterns_match_what_their_plain_forms_match(spark):
    rng = random.Random(11)
    pieces = ["http", "https", "htt", "www", "ww", "://a", "@", "#", "é1_", "日本", " ", " ", "　", " ", " ", "’", "\x85", "a", "Zz", "!?", "😀", "4"]
    values = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 16))) for _ in range(3000)]
    spaces, letters = tx.SPACES, "abcdefghijklmnopqrstuvwxyz"

    def plain(text):
        out = re.sub(f"(?:http|www|https)[^{spaces}]+", "", text.lower())
        out = re.sub(rf"[@#]\w*|[^{letters}@#{spaces}]+", "", out)
        return [word for word in re.split(f"[{spaces}]+", out) if word]

    assert run(spark, values, tx.words) == [plain(v) for v in values]
