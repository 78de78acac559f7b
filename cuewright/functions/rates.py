"""Rates, budgets and the fitting of speech into time windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Characters spoken a second in the target language; fixed value.
TARGET_CPS = 14


def speech_rate(n: Column, window_ms: Column) -> Column:
    """Units a second; 0 where the window isn't positive."""
    return F.when(window_ms > 0, n / (window_ms / 1000.0)).otherwise(F.lit(0.0))


def budget_factor(rate: Column) -> Column:
    return F.when(rate >= 5.5, F.lit(1.0)).when(rate >= 4.0, F.lit(1.15)).otherwise(F.lit(1.2))


def spoken_ms(text: Column) -> Column:
    """Time that ASCII letters and digits take."""
    return F.length(F.regexp_replace(text, "[^A-Za-z0-9]", "")) * 1000.0 / TARGET_CPS


def max_chars(duration_ms: Column, cps: float = TARGET_CPS) -> Column:
    return F.when(duration_ms > 0, F.greatest(F.lit(1), F.floor(duration_ms / 1000.0 * cps))).otherwise(F.lit(0)).cast("long")


def fit(trimmed: Column, budget: Column, extend: Column, max_rate: float = 1.3) -> Column:
    """status, rate and final_ms of speech of ``trimmed`` ms in a window that may grow by ``extend``:
    speech is filled up to the window, or to the longer one; what doesn't fit at all stays as long as it is."""
    longer = budget + extend
    out = lambda status, rate, final: F.struct(F.lit(status).alias("status"), rate.cast("double").alias("rate"), final.cast("long").alias("final_ms"))
    one = F.lit(1.0)
    return (
        F.when(trimmed <= budget, out("success", one, budget))
        .when(trimmed <= max_rate * budget, out("rate_adjusted", trimmed / budget, budget))
        .when((extend > 0) & (trimmed <= longer), out("extended", one, longer))
        .when((extend > 0) & (trimmed <= max_rate * longer), out("extended", trimmed / longer, longer))
        .otherwise(out("failed", trimmed / F.greatest(budget, F.lit(1)), trimmed))
    )


def alignment_tier(spoken: Column, window: Column, aggressive: Column, start: Column | None = None, next_start: Column | None = None) -> Column:
    """How speech of ``spoken`` ms gets into a window: filled up, let run over where the next one
    starts late enough, or sped up by the share of the window to the speech; fixed limits."""
    share = window / spoken
    free = (start + spoken <= next_start) if start is not None and next_start is not None else F.lit(False)
    return (
        F.when(spoken <= window, "padding")
        .when(free, "overflow_allowed")
        .when(share >= 0.8, "safe")
        .when(share >= 0.625, "moderate")
        .when((share >= 0.5) & aggressive, "aggressive")
        .otherwise("hard_cut")
    )


#: Sounds with which a line may be spoken fast; fixed values.
SOUNDS = ("ha", "haha", "ah", "oh", "hey", "bro", "wow", "yeah", "ok", "okay")


def aggressive_allowed(text: Column) -> Column:
    """Whether a line may be spoken at more than 1.25 times its pace: one of at most three words, or with a sound
    somewhere in it, in any case; an empty or missing line may not."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    sounds = F.exists(F.array(*(F.lit(s) for s in SOUNDS)), lambda s: F.lower(text).contains(s))
    return F.coalesce((text != "") & ((words <= 3) | sounds), F.lit(False))


#: Words of address that allow a loose translation; fixed values.
ADDRESS = ("哥", "爸", "妈", "姐", "弟", "妹", "平安哥")


def loose_allowed(duration_ms: Column, text: Column) -> Column:
    """Very short windows and forms of address may be translated loosely."""
    return (duration_ms < 800) | text.rlike("|".join(ADDRESS))


def length_fit(candidate: Column, compressed: Column, limit: Column) -> Column:
    """status and text of a translation within ``limit`` characters: as it is, compressed, or the
    compressed one cut; too long without a compressed one is failed, without any candidate too."""
    bare = lambda t: F.regexp_replace(strip(t), '^"(.*)"$', "$1")
    one, two = bare(candidate), bare(compressed)
    out = lambda status, t: F.struct(F.lit(status).alias("status"), t.alias("text"))
    return (
        F.when(F.coalesce(candidate, F.lit("")) == "", out("failed", F.lit("")))
        .when(F.length(one) <= limit, out("ok", one))
        .when(F.coalesce(compressed, F.lit("")) == "", out("failed", one))
        .when(F.length(two) <= limit, out("compressed", two))
        .otherwise(out("truncated", F.rtrim(F.left(two, limit))))
    )


def speed(spoken: Column, budget: Column) -> Column:
    """The bucket of the speed that brings speech into a budget; 1 where the budget is empty."""
    return F.when(budget > 0, speed_bucket(spoken / budget)).otherwise(F.lit(1.0))


def speed_bucket(ratio: Column) -> Column:
    """A speed to one decimal, a half to even, from 0.7 to 1.3."""
    return F.least(F.greatest(F.bround(ratio, 1), F.lit(0.7)), F.lit(1.3))
