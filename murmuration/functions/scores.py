"""Score and display expressions over account features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the five signals in the score.
SCORE_WEIGHTS = {
    "new7": 0.30,
    "new30": 0.20,
    "burst_signal": 0.20,
    "concentration_signal": 0.15,
    "volume_signal": 0.15,
}

# A missing median gap counts as 999 minutes; gaps are scaled by 10 minutes.
MISSING_GAP_MINUTES = 999.0
GAP_SCALE_MINUTES = 10.0

# Node colours (new account, high score, anything else).
COLOR_NEW, COLOR_HIGH, COLOR_PLAIN = "#d85a30", "#e0a106", "#3d6f8f"

# Exclusive upper bounds of the dataset size classes.
SIZE_CLASSES = (
    (1_000, "n<1K"),
    (10_000, "1K<n<10K"),
    (100_000, "10K<n<100K"),
    (1_000_000, "100K<n<1M"),
    (10_000_000, "1M<n<10M"),
)


def coordination_score(features: DataFrame) -> DataFrame:
    """Add the five signals and their weighted sum; a signal, not a classification.

    The volume signal is relative to the busiest account of the whole frame. That maximum is
    an uncorrelated scalar subquery, so no row is shuffled or joined for it.
    """
    busiest = features.agg(F.max("activity_count")).scalar()
    signals = features.withColumns({
        "new7": F.coalesce(F.col("new_account_7d"), F.lit(False)).cast("int"),
        "new30": F.coalesce(F.col("new_account_30d"), F.lit(False)).cast("int"),
        "burst_signal": 1.0
        / (1.0 + F.coalesce("median_interarrival_min", F.lit(MISSING_GAP_MINUTES)) / GAP_SCALE_MINUTES),
        "concentration_signal": F.coalesce(F.col("max_subreddit_share"), F.lit(0.0)),
        "volume_signal": F.log1p("activity_count") / F.log1p(F.greatest(busiest, F.lit(2))),
    })
    total = sum((F.lit(w) * F.col(name) for name, w in SCORE_WEIGHTS.items()), F.lit(0.0))
    return signals.withColumn("coordination_score", total)


def size_class(rows: Column) -> Column:
    chosen = None
    for bound, label in SIZE_CLASSES:
        chosen = F.when(rows < bound, label) if chosen is None else chosen.when(rows < bound, label)
    return chosen.otherwise("n>10M")


def node_color(new7: Column, score: Column) -> Column:
    return F.when(new7, COLOR_NEW).when(score >= 0.5, COLOR_HIGH).otherwise(COLOR_PLAIN)


def node_radius(degree: Column) -> Column:
    return F.least(F.lit(22), degree + 6)


def fixed(value: Column, digits: int) -> Column:
    """Number text with a fixed count of decimals; null stays null."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value.cast("double")))


def flag_text(value: Column) -> Column:
    return F.when(value, "True").when(~value, "False")


def node_tip(account: Column, degree: Column, features: set[str]) -> Column:
    """Hover text: account, connections, then each known feature on its own line."""
    shown = {
        "activity_count": ("activity: ", lambda c: fixed(c, 0)),
        "coordination_score": ("signal score: ", lambda c: fixed(c, 3)),
        "new_account_7d": ("new ≤7d: ", flag_text),
        "new_account_30d": ("new ≤30d: ", flag_text),
        "max_subreddit_share": ("max subreddit share: ", lambda c: fixed(c, 2)),
    }
    lines = [account, F.concat(F.lit("connections: "), degree.cast("string"))]
    for name, (label, text) in shown.items():
        if name in features:
            lines.append(F.concat(F.lit(label), text(F.col(name))))
    return F.concat_ws("\n", *lines)


def escape_html(text: Column) -> Column:
    out = text
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def escape_cell(text: Column) -> Column:
    return F.coalesce(F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit(""))
