"""Text cleaning, tokens, tags and display text, all as JVM-side column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

# The patterns of the three cleaning recipes.
PLAIN_LINK = r"http\S+|www\S+|https\S+"
SOCIAL_LINK_OR_MENTION = r"http\S+|www\S+|@\w+"
TWEET_LINK = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
TWEET_WWW = r"www\.(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
TWEET_MENTION = r"@[A-Za-z0-9_]+"
TWEET_TAG = r"#([A-Za-z0-9_]+)"
HASHTAG = r"#(\w+)"
MENTION = r"@(\w+)"

# What counts as white space and as a word's character in Unicode text.
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WORD_CHARACTERS = r"\p{L}\p{N}_"
LETTERS = "abcdefghijklmnopqrstuvwxyz"

# White space by its place: a class of Latin-1 characters is one bit test, every other character adds a test of its own.
NARROW_SPACES = "".join(c for c in SPACES if c <= "\xff")
WIDE_SPACES = "".join(c for c in SPACES if c > "\xff")
#: The first bytes that some wide space begins with in UTF-8; texts without them hold none.
WIDE_LEADS = (b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")

# Word pairs the word tokenizer writes as one word.
JOINED_PAIRS = r"\b(?:(can)(not)|(gim|lem)(me)|(gon|wan)(na)|(got)(ta))\b"

# The English stop words removed before modelling.
STOPWORDS = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
    yourselves he him his himself she she's her hers herself it it's its itself they them their
    theirs themselves what which who whom this that that'll these those am is are was were be been
    being have has had having do does did doing a an the and but if or because as until while of at
    by for with about against between into through during before after above below to from up down
    in out on off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will just don
    don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn
    doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn
    needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
    """.split()
)


def in_unicode(pattern: str) -> str:
    """The pattern with its classes of white space and word characters spelt out for Unicode text."""
    return pattern.replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]").replace(r"\w", f"[{WORD_CHARACTERS}]")


def _regex(pattern: str, unicode: bool) -> str:
    return in_unicode(pattern) if unicode else pattern


def _strip(text: Column, unicode: bool) -> Column:
    return F.regexp_replace(text, _regex(r"^\s+|\s+$", unicode), "")


def _one_class_first(spaces: str, word: str) -> tuple[str, str]:
    """Patterns of links, and of tags and runs of what is neither letter nor space, that begin with one small class.

    They match what ``PLAIN_LINK`` and ``[^letters spaces @#]+|[@#]word*`` match, but fail on nearly all characters
    with a single bit test, where alternatives are all tried at every character.
    """
    link = f"[hw](?:(?<=h)ttp|(?<=w)ww)[^{spaces}]+"
    rest = f"[^{LETTERS}{spaces}](?:(?<=[@#])[{word}]*|(?<![@#])[^{LETTERS}{spaces}@#]*)"
    return link, rest


LINK, TAG_OR_NOT_LETTER = _one_class_first(" \\t\\n\\x0B\\f\\r", r"\w")
LINK_UNICODE, TAG_OR_NOT_LETTER_UNICODE = _one_class_first(NARROW_SPACES, WORD_CHARACTERS)


def _narrow(text: Column, changed: Column) -> Column:
    """``changed`` with each wide space as a blank; it is searched only where the bytes of ``text`` can hold one."""
    held = reduce(or_, [F.contains(text.cast("binary"), F.lit(lead)) for lead in WIDE_LEADS])
    return F.when(held, F.regexp_replace(changed, f"[{WIDE_SPACES}]", " ")).otherwise(changed)


def _bare(text: Column, unicode: bool) -> Column:
    """Lower-case letters and white space only, wide spaces as blanks.

    Links go first. Tags go in the same pass as the other characters: a sign takes the word
    after it along, so nothing is matched twice. The letters are spelt out because a class of
    single characters is one bit test, where ranges make a chain of tests whose type checks
    hold up the other threads of an executor; so do characters beyond Latin-1.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    if not unicode:
        return F.regexp_replace(F.regexp_replace(low, LINK, ""), TAG_OR_NOT_LETTER, "")
    return F.regexp_replace(F.regexp_replace(_narrow(text, low), LINK_UNICODE, ""), TAG_OR_NOT_LETTER_UNICODE, "")


def _gap(unicode: bool) -> str:
    """The white space that ``_bare`` leaves."""
    return f"[{NARROW_SPACES}]+" if unicode else r"\s+"


def clean_text(text: Column, unicode: bool = True) -> Column:
    """Lower-case letters and single spaces only; links, mentions and tags removed."""
    return F.trim(F.regexp_replace(_bare(text, unicode), _gap(unicode), " "))


def clean_text_social(text: Column, unicode: bool = True) -> Column:
    """Lower-case; links and mentions become ``[URL]``; tags lose their sign."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, _regex(SOCIAL_LINK_OR_MENTION, unicode), "[URL]")
    out = F.regexp_replace(out, _regex(HASHTAG, unicode), "$1")
    return _strip(out, unicode)


def preprocess_tweet(text: Column, unicode: bool = True) -> Column:
    """Lower-case; links become ``[URL]``, mentions ``[USER]``; tags lose their sign."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, TWEET_LINK, "[URL]")
    out = F.regexp_replace(out, TWEET_WWW, "[URL]")
    out = F.regexp_replace(out, TWEET_MENTION, "[USER]")
    out = F.regexp_replace(out, TWEET_TAG, "$1")
    return F.trim(F.regexp_replace(out, _regex(r"\s+", unicode), " "))


def words(text: Column, unicode: bool = True) -> Column:
    """The words of the cleaned text, stop words included."""
    return F.array_remove(F.split(_bare(text, unicode), _gap(unicode)), "")


def tokens(text: Column, unicode: bool = True, stopwords: tuple[str, ...] = STOPWORDS, min_length: int = 1) -> Column:
    """Words of the cleaned text with joined pairs split, short words and stop words dropped."""
    parted = F.regexp_replace(_bare(text, unicode), "(?=[cglw])" + JOINED_PAIRS, "$1$3$5$7 $2$4$6$8")
    return F.filter(
        F.split(parted, _gap(unicode)),
        lambda word: (F.length(word) >= min_length) & ~word.isin(*stopwords),
    )


def preprocess(text: Column, unicode: bool = True) -> Column:
    """Clean, tokenise and join with single spaces; the text the classifier sees."""
    return F.array_join(tokens(text, unicode), " ")


def word_count(text: Column) -> Column:
    """Pieces between single spaces, counting the empty ones."""
    return F.size(F.split(text, " "))


def first_hashtag(text: Column) -> Column:
    return F.regexp_extract(text, HASHTAG, 1)


def all_hashtags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(HASHTAG), 1)


def all_mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MENTION), 1)


def ellipsize(text: Column, length: int) -> Column:
    """Text cut to ``length`` characters and marked with three dots only if it was longer."""
    full = F.coalesce(text, F.lit(""))
    return F.when(F.length(full) > length, F.concat(F.substring(full, 1, length), F.lit("..."))).otherwise(full)


def first_filled(*candidates: Column) -> Column:
    """The first candidate that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def phrase_text(text: Column) -> Column:
    """Lower-case words with one space around each, so a phrase can be found whole."""
    return F.concat(
        F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" ")
    )
