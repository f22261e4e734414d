"""Fixed values shared by the operators."""

from __future__ import annotations

# The label and platform domains and the tracked defaults.
LABELS = ("positive", "neutral", "negative")
LABEL_CODES = {"negative": 0, "neutral": 1, "positive": 2}
PLATFORMS = ("twitter", "reddit", "youtube")
DEFAULT_KEYWORDS = ("python", "AI", "machine learning")
DEFAULT_SUBREDDITS = ("python", "MachineLearning", "artificial")

# Thresholds and windows.
POLARITY_THRESHOLD = 0.1
MIN_TEXT_LENGTH = 10
PREVIEW_LENGTH = 200
SUMMARY_HOURS = 24
TREND_DAYS = 7
RETENTION_DAYS = 30
UPDATE_INTERVAL_SECONDS = 30
DAILY_POST_TARGET = 1000
TIMING_WINDOW = 100
HIGH_CONFIDENCE = 0.7
RETRAIN_ACCURACY = 0.8
VOCABULARY_SIZE = 5000
MAX_SEQUENCE_LENGTH = 128

# Bounds below which a lookup table may be sent to every executor.
LOOKUP_ROW_BOUND = 200_000
LOOKUP_BYTE_BOUND = 64 * 1024 * 1024

# A join key with more rows than this is spread over several tasks.
HOT_KEY_ROWS = 1_000_000
