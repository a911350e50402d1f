"""Data model: column contracts and the fixed values results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# State names by state id.
STATE_NAMES = {
    0: "Stable",
    1: "Early Vulnerability Signal",
    2: "Elevated Distress",
    3: "Severe Community Distress Signal",
}

# Drift level names by level.
LEVEL_NAMES = {0: "normal", 1: "warning", 2: "alert", 3: "critical"}

# Drift cut points in standard deviations.
LEVEL_CUTS = (1.0, 2.0, 3.0)

# Signals watched by the drift monitor, in tie-breaking order.
DRIFT_SIGNALS = (
    "avg_negative",
    "hopelessness_density",
    "topic_shift_jsd",
    "topic_shift_jsd_4w",
    "suicidality_density",
    "isolation_density",
    "post_volume",
)

# Composite score, feature column -> weight.
SCORE_WEIGHTS = {
    "avg_negative": 0.25,
    "hopelessness_density": 0.20,
    "help_seeking_density": 0.15,
    "suicidality_density": 0.20,
    "isolation_density": 0.10,
    "economic_stress_density": 0.05,
    "domestic_stress_density": 0.05,
}

# State thresholds in standard deviations above the mean (default; configured).
STATE_CUTS = (0.5, 1.0, 2.0)
STATE_CUTS_CONFIGURED = (0.3, 0.6, 1.0)

# Bodies that mean "no text".
DELETED_BODIES = ("[deleted]", "[removed]", "")

# Author names that mean "no author".
NO_AUTHOR = ("", "[deleted]", "[removed]", "None")

# Lexicon families; the first three are per-word means, the rest per-post rates.
PER_WORD_FAMILIES = ("hopelessness", "help_seeking", "distress")
PER_POST_FAMILIES = ("suicidality", "isolation", "economic_stress", "domestic_stress")

PANEL_KEYS = ("community", "iso_year", "iso_week", "week_start")

# Feature column layout per family.
FAMILY_COLUMNS = {
    "linguistic": (
        "avg_word_count", "std_word_count", "avg_char_count", "avg_type_token_ratio",
        "avg_flesch_kincaid", "first_person_singular_ratio", "first_person_plural_ratio",
    ),
    "sentiment": (
        "avg_compound", "avg_positive", "avg_negative", "avg_neutral",
        "pct_very_negative", "pct_negative", "pct_neutral", "pct_positive",
    ),
    "distress": (
        "hopelessness_density", "help_seeking_density", "distress_density",
        "suicidality_density", "isolation_density", "economic_stress_density",
        "domestic_stress_density",
    ),
    "behavioral": (
        "post_volume", "avg_comments", "unique_posters", "new_poster_ratio",
        "posting_time_entropy",
    ),
    "topic": ("dominant_topic", "topic_entropy", "topic_shift_jsd", "topic_shift_jsd_4w"),
}

RAW_POST = T.StructType([
    T.StructField("post_id", T.StringType()),
    T.StructField("created_utc", T.LongType()),
    T.StructField("selftext", T.StringType()),
    T.StructField("community", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("data_source", T.StringType()),
])

# Required columns per artifact.
CONTRACTS = {
    "raw": ("post_id", "created_utc", "selftext", "community"),
    "weekly": ("community", "iso_year", "iso_week", "week_start", "post_count",
               "unique_authors", "new_author_ratio"),
    "features": PANEL_KEYS,
}
