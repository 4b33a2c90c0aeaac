"""Missing and out-of-range values: NaN never leaves an expression, null does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE_WORDS = ("true", "t", "yes", "y", "1")


def number(c: Column) -> Column:
    """A double, or null for what isn't a finite number."""
    value = c.try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def whole(c: Column) -> Column:
    """A long, or null for what isn't a whole number."""
    value = number(c)
    return F.when(value == F.rint(value), value.cast("long"))


def flag(c: Column) -> Column:
    """A boolean from text or numbers; what isn't a yes is a no, null too."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator where the denominator is positive, else null."""
    return F.when(denominator > 0, numerator / denominator)


def clip(c: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def power01(c: Column, exponent: float) -> Column:
    return F.pow(clip(c, 0.0, 1.0), F.lit(exponent))


def relative_delta_percent(current: Column, baseline: Column) -> Column:
    return F.when(baseline != 0, 100 * (current - baseline) / F.abs(baseline))


def step_ratio(a: Column, b: Column) -> Column:
    """|b - a| relative to the larger of the two sizes."""
    return F.try_divide(F.abs(b - a), F.greatest(F.abs(a), F.abs(b)))


def in_range(c: Column, low: float, high: float) -> Column:
    return F.coalesce((c >= low) & (c <= high), F.lit(False))


def shares(*parts: Column) -> list[Column]:
    """Each part's share of their sum; negative parts count as 0; null if nothing is left."""
    own = [F.greatest(p, F.lit(0.0)) for p in parts]
    total = own[0]
    for p in own[1:]:
        total = total + p
    return [F.when(total > 0, p / total) for p in own]


def js_divergence(p: list[Column], q: list[Column]) -> Column:
    """Jensen-Shannon divergence (natural log) of two shares; zero terms add nothing."""

    def kl(a: list[Column], m: list[Column]) -> Column:
        total = F.lit(0.0)
        for x, y in zip(a, m, strict=True):
            total = total + F.when((x > 0) & (y > 0), x * F.log(x / y)).otherwise(0.0)
        return total

    mid = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    return 0.5 * kl(p, mid) + 0.5 * kl(q, mid)


def eligible(frames: Column, validated: Column, least_frames: int = 8) -> Column:
    """Enough independent frames and more than two validated components."""
    return F.coalesce((frames >= least_frames) & (validated > 2), F.lit(False))


def fragile(relative_width: Column, spread: Column, width_limit: float = 25.0, spread_limit: float = 15.0) -> Column:
    return F.coalesce(relative_width > width_limit, F.lit(False)) | F.coalesce(spread > spread_limit, F.lit(False))


# The domain's grades and the scores up to which each reaches (the last has no end).
QUALITY_GRADES = ((59.999, "reject"), (74.999, "diagnostic"), (84.999, "usable_with_caution"), (92.999, "good"), (None, "strong"))


def quality_grade(score: Column, grades: tuple[tuple[float | None, str], ...] = QUALITY_GRADES) -> Column:
    """The first grade whose end a score does not pass; null for a null score. The last grade has no end."""
    out = F.when(score.isNotNull(), grades[-1][1])
    for end, grade in reversed(grades[:-1]):
        out = F.when(score <= end, grade).otherwise(out)
    return out
