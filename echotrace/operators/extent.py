"""Along a line: the nearest frame in time, the extent of the match, and the acceptance gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.scalar import density


def nearest_in_time(cells: DataFrame, lines: DataFrame, tau: float) -> DataFrame:
    """(a, b, i, ta, tb, sim): for every frame of a, the frame of b nearest to alpha ta + beta, if within tau; ties go to the lower index."""
    off = F.abs(F.col("tb") - (F.col("alpha") * F.col("ta") + F.col("beta")))
    near = cells.join(lines.select("a", "b", "alpha", "beta"), ["a", "b"]).withColumn("off", off).filter(F.col("off") <= tau)
    return near.groupBy("a", "b", "i", "ta").agg(F.min_by(F.struct("tb", "sim"), F.struct("off", "j")).alias("x")).select("a", "b", "i", "ta", "x.tb", "x.sim")


def extent(near: DataFrame, floor: float) -> DataFrame:
    """(a, b, a_start, a_end, b_start, b_end, mean_sim, n_supporting) of the matches not below the median and the floor; at least four before and after."""
    middle = near.groupBy("a", "b").agg(F.percentile("sim", 0.5).alias("median"), F.count("*").alias("n")).filter("n >= 4")
    kept = near.join(middle, ["a", "b"]).filter(F.col("sim") >= F.greatest("median", F.lit(floor)))
    out = kept.groupBy("a", "b").agg(F.min("ta").alias("a_start"), F.max("ta").alias("a_end"), F.min("tb").alias("b_start"), F.max("tb").alias("b_end"), F.avg("sim").alias("mean_sim"), F.count("*").alias("n_supporting"))
    return out.filter("n_supporting >= 4")


def span() -> F.Column:
    return F.greatest(F.col("a_end") - F.col("a_start"), F.col("b_end") - F.col("b_start"))


def gated(tested: DataFrame, extents: DataFrame, s: Settings) -> DataFrame:
    """Segments of the pairs that pass all gates: z, p, span, mean similarity, density."""
    strong = tested.filter((F.col("z_score") >= s.min_zscore) & (F.col("pvalue") <= s.max_pvalue))
    rows = strong.join(extents, ["a", "b"]).withColumn("span", span())
    ok = (F.col("span") >= s.min_segment_seconds) & (F.col("mean_sim") >= s.min_segment_score) & (density("n_supporting", "span", 1.0) >= s.min_inlier_density)
    return rows.filter(ok).select("a", "b", "a_start", "a_end", "b_start", "b_end", F.col("alpha").alias("speed_ratio"), F.lit(False).alias("mirrored"), F.col("n_supporting").cast("int").alias("inliers"), F.col("mean_sim").alias("score"), "pvalue", F.col("support").alias("weighted_support"), "z_score")


def filtered_segments(segments: DataFrame, s: Settings) -> DataFrame:
    """Segments of robust lines that are similar, long and dense enough."""
    rows = segments.withColumn("span", span())
    ok = (F.col("score") >= s.min_segment_score) & (F.col("span") >= s.min_segment_seconds) & (density("inliers", "span", 1e-3) >= s.min_inlier_density)
    return rows.filter(ok).drop("span")
