"""Column layouts of landed records, conformed posts and scored results."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, LONG, INT, DOUBLE, TIME = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampType()


def _layout(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


POST = _layout(
    id=STRING, platform=STRING, text=STRING, title=STRING, description=STRING,
    created_at=TIME, collected_at=TIME, lang=STRING,
    author_id=STRING, author=STRING, channel=STRING, subreddit=STRING,
    likes=LONG, retweets=LONG, upvotes=LONG, downvotes=LONG, score=LONG, num_comments=LONG,
    keywords=T.ArrayType(STRING),
)

# The narrow nine-column batch layout, kept for callers that want exactly it.
BATCH = _layout(
    id=STRING, text=STRING, platform=STRING, created_at=TIME, author_id=STRING,
    likes=INT, retweets=INT, collected_at=TIME, keywords=T.ArrayType(STRING),
)

COMMENT = _layout(
    id=STRING, platform=STRING, text=STRING, created_at=TIME, collected_at=TIME,
    author=STRING, parent_id=STRING, video_id=STRING, score=LONG, likes=LONG,
)

PROBABILITIES = _layout(negative=DOUBLE, neutral=DOUBLE, positive=DOUBLE)
SENTIMENT = _layout(
    label=STRING, polarity=DOUBLE, subjectivity=DOUBLE, confidence=DOUBLE, probabilities=PROBABILITIES
)
METADATA = _layout(author_id=STRING, likes=LONG, retweets=LONG, score=LONG)
RESULT = _layout(
    post_id=STRING, platform=STRING, text=STRING, created_at=TIME,
    sentiment=SENTIMENT, processed_at=TIME, metadata=METADATA,
)

# Landed API records, one JSON document per line.
TWEET_JSON = _layout(
    id=LONG, text=STRING, created_at=STRING, author_id=LONG, lang=STRING,
    public_metrics=_layout(like_count=LONG, retweet_count=LONG),
)

SUBMISSION_JSON = _layout(
    id=STRING, title=STRING, selftext=STRING, created_utc=DOUBLE, author=STRING, subreddit=STRING,
    ups=LONG, downs=LONG, score=LONG, num_comments=LONG,
)

SUBMISSION_COMMENT_JSON = _layout(
    id=STRING, body=STRING, created_utc=DOUBLE, author=STRING, score=LONG, parent_id=STRING, position=LONG
)

VIDEO_SEARCH_JSON = _layout(
    items=T.ArrayType(
        _layout(
            id=_layout(videoId=STRING),
            snippet=_layout(title=STRING, description=STRING, channelTitle=STRING, publishedAt=STRING),
        )
    )
)

VIDEO_COMMENTS_JSON = _layout(
    video_id=STRING,
    items=T.ArrayType(
        _layout(
            snippet=_layout(
                topLevelComment=_layout(
                    id=STRING,
                    snippet=_layout(textDisplay=STRING, authorDisplayName=STRING, publishedAt=STRING, likeCount=LONG),
                )
            )
        )
    ),
)

VIDEO_STATS_JSON = _layout(video_id=STRING, viewCount=STRING, likeCount=STRING, commentCount=STRING)
