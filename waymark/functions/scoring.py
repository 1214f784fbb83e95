"""Scores of places as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(value: Column, bands: list[tuple[float, float]], lowest: float) -> Column:
    """The points of the first band whose lower bound the value reaches; bands from high to low."""
    out = F.lit(float(lowest))
    for bound, points in reversed(bands):
        out = F.when(value >= bound, float(points)).otherwise(out)
    return out


def quality_score(summary: Column, has_mood: Column, has_image: Column, has_point: Column, category: Column, address: Column) -> Column:
    """40, plus 15 for a summary of over 10 characters, 10 each for moods, coordinates, 15 for an image, 5 each for category and address; at most 100."""
    points = lambda ok, n: F.when(F.coalesce(ok, F.lit(False)), n).otherwise(0)
    total = 40 + points(F.length(F.trim(summary)) > 10, 15) + points(has_mood, 10) + points(has_image, 15) + points(has_point, 10) + points(F.length(category) > 0, 5) + points(F.length(address) > 0, 5)
    return F.least(F.lit(100), total)


def hot_score(views: Column, is_short: Column, rating: Column, verified: Column) -> Column:
    """struct(hot, trust): views bands (15 without a clip), rating bands (25 if unknown), 20 or 10 for verification."""
    clip = F.when(views.isNull(), 15.0).otherwise(ladder(views, [(100_000, 40), (50_000, 35), (10_000, 28), (3_000, 20)], 15))
    clip = F.least(F.lit(45.0), clip + F.when(views.isNotNull() & F.coalesce(is_short, F.lit(False)), 5.0).otherwise(0.0))
    rated = F.when(rating.isNull(), 25.0).otherwise(ladder(rating, [(4.5, 35), (4.0, 30), (3.5, 25)], 20))
    bonus = F.when(F.coalesce(verified, F.lit(False)), 20.0).otherwise(10.0)
    return F.struct(F.round(F.least(F.lit(100.0), clip + rated + bonus), 1).alias("hot"), F.round(2.5 * rated + bonus, 1).alias("trust"))


def valid_clip(url: Column, title: Column, views: Column, likes: Column, news: list[str], stale: list[str]) -> Column:
    """A url, 10,000 views or 500 likes, no news word and no stale year in the title."""
    out = F.length(url) > 0
    out = out & ((F.coalesce(views, F.lit(0)) >= 10_000) | (F.coalesce(likes, F.lit(0)) >= 500))
    for word in [*news, *stale]:
        out = out & ~F.coalesce(F.contains(F.lower(title), F.lit(word)), F.lit(False))
    return F.coalesce(out, F.lit(False))


def super_hot(clip_ok: Column, views: Column, hot: Column, age_days: Column, verified: Column, rating: Column) -> Column:
    """A valid clip of 50,000 views, a hot score of 80, a verified place of the last 7 days, or a rating of 4.6."""
    return F.coalesce(clip_ok & (views >= 50_000), F.lit(False)) | F.coalesce(hot >= 80, F.lit(False)) | F.coalesce((age_days <= 7) & verified, F.lit(False)) | F.coalesce(rating >= 4.6, F.lit(False))


def bad_summary(summary: Column, name: Column, tag_words: list[str]) -> Column:
    """Null, under 5 characters, the name itself, Latin tags only, or a tag word in under 30 characters."""
    s = F.trim(summary)
    tagged = F.lit(False)
    for word in tag_words:
        tagged = tagged | F.contains(F.lower(s), F.lit(word))
    return s.isNull() | (F.length(s) < 5) | (F.lower(s) == F.lower(F.trim(name))) | s.rlike(r"^[a-z]+(,\s*[a-z]+)*$") | (tagged & (F.length(s) < 30))
