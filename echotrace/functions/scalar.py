"""Scalar expressions, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v) -> Column:
    """v divided by its Euclidean length (at least 1e-12)."""
    v = F.col(v) if isinstance(v, str) else v
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))


def clip_power(sim, p: float) -> Column:
    """sim cut to [0, 1], to the power p."""
    sim = F.col(sim) if isinstance(sim, str) else sim
    return F.pow(F.least(F.greatest(sim, F.lit(0.0)), F.lit(1.0)), F.lit(float(p)))


def round6(x) -> Column:
    """Six decimals: the precision at which similarities are compared."""
    return F.round(x, 6)


def reweighted(w, idf_a, idf_b, rho_a, rho_b, use_idf: bool, use_rho: bool) -> Column:
    if use_idf:
        w = w * idf_a * idf_b
    return w / (rho_a * rho_b + F.lit(1e-6)) if use_rho else w


def xor(a, b) -> Column:
    return F.col(a).bitwiseXOR(F.col(b)).cast("int")


def time_text(seconds) -> Column:
    """m:ss, or h:mm:ss from an hour on; fractions are cut, negative times are 0:00."""
    s = F.floor(F.greatest(F.col(seconds) if isinstance(seconds, str) else seconds, F.lit(0.0))).cast("bigint")
    h, m, sec = F.floor(s / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint"), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, sec)).otherwise(F.format_string("%d:%02d", m, sec))


#: Keyframes a second, slack, and the most for any video.
KEYFRAMES_PER_SECOND, KEYFRAME_SLACK, MAX_KEYFRAMES = 5, 100, 648_000


def keyframe_budget(duration) -> Column:
    d = F.col(duration) if isinstance(duration, str) else duration
    return F.when(d <= 0, F.lit(MAX_KEYFRAMES)).otherwise(F.least(F.floor(d * KEYFRAMES_PER_SECOND) + KEYFRAME_SLACK, F.lit(MAX_KEYFRAMES))).cast("bigint")


def significant_crop(w, h, src_w, src_h, tolerance: float = 0.97) -> Column:
    return (F.col(w) < tolerance * F.col(src_w)) | (F.col(h) < tolerance * F.col(src_h))


def density(inliers, span, least: float) -> Column:
    return F.col(inliers) / F.greatest(F.col(span), F.lit(least))


def crops_of(log) -> Column:
    """All crop=W:H:X:Y detections of a decoder's log, in order, as structs."""
    found = F.regexp_extract_all(log, F.lit(r"(crop=\d+:\d+:\d+:\d+)"), F.lit(1))
    part = lambda x, i: F.split(F.substring(x, 6, 1000), ":")[i].cast("int")
    return F.transform(found, lambda x: F.struct(*[part(x, i).alias(n) for i, n in enumerate("whxy")]))


def pts_of(log) -> Column:
    """All presentation times of a decoder's log."""
    return F.transform(F.regexp_extract_all(log, F.lit(r"pts_time:\s*([\-\d.eE+]+)"), F.lit(1)), lambda x: x.try_cast("double"))


def pair_seed(a: int, b: int) -> int:
    """The 32-bit seed of a pair's permutations."""
    return ((a + 1) * 0x9E3779B97F4A7C15 + b) & 0xFFFFFFFF
