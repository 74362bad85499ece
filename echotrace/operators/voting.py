"""Weighted line votes and their permutation test, in DataFrame operations.

The same quantities as ``hough`` computes with arrays, one row for each cell or bin; they
serve queries that SQL can check and pairs whose matrices should not meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.scalar import clip_power, dot, round6


def sampled(frames: DataFrame, most: int) -> DataFrame:
    """At most that many evenly spread frames of every video, numbered from 0 in pos.

    Frames stand in the order (mirrored, ts, frame_id).  Of n > most frames, those at
    floor(j (n - 1) / (most - 1)) stay, computed in whole numbers.
    """
    own = Window.partitionBy("video_id")
    rows = frames.withColumn("rn", F.row_number().over(own.orderBy("mirrored", "ts", "frame_id")) - 1).withColumn("n", F.count("*").over(own))
    gap, last = F.col("n") - 1, F.lit(most - 1)
    j = F.ceil(F.col("rn") * last / gap).cast("bigint")
    hit = F.floor(j * gap / last).cast("bigint") == F.col("rn")
    kept = rows.withColumn("pos", F.when(F.col("n") <= most, F.col("rn").cast("bigint")).otherwise(F.when(hit, j)))
    return kept.filter(F.col("pos").isNotNull()).drop("rn", "n")


def cells(pairs: DataFrame, samples: DataFrame, s: Settings, weights: DataFrame | None = None) -> DataFrame:
    """(a, b, i, j, ta, tb, sim, w): every frame of a against every frame of b."""
    cols = ["video_id", "pos", "ts", "embedding", *["rho", "idf"] * (weights is not None)]
    rows = samples.join(weights, "frame_id") if weights is not None else samples
    side = lambda v, i, t, e: rows.select(*[F.col(c).alias(n) for c, n in zip(cols, (v, i, t, e, f"rho_{v}", f"idf_{v}"))])
    both = pairs.select("a", "b").join(side("a", "i", "ta", "ea"), "a").join(side("b", "j", "tb", "eb"), "b")
    sim = round6(F.least(F.greatest(dot("ea", "eb"), F.lit(0.0)), F.lit(1.0)))
    out = both.select("a", "b", "i", "j", F.col("ta").cast("double").alias("ta"), F.col("tb").cast("double").alias("tb"), sim.alias("sim"), *[c for c in both.columns if c[:4] in ("rho_", "idf_")])
    w = clip_power("sim", s.smooth_p)
    if weights is not None:
        if s.use_idf:
            w = w * F.col("idf_a") * F.col("idf_b")
        if s.use_rho:
            w = w / (F.col("rho_a") * F.col("rho_b") + 1e-6)
    return out.select("a", "b", "i", "j", "ta", "tb", "sim", w.alias("w"))


def geometry(pairs: DataFrame, samples: DataFrame, s: Settings) -> DataFrame:
    """(a, b, beta_min, step, n_beta) of every pair with at least four frames on either side."""
    ends = samples.groupBy("video_id").agg(F.min("ts").cast("double").alias("lo"), F.max("ts").cast("double").alias("hi"), F.count("*").alias("n")).filter("n >= 4")
    a = ends.select(F.col("video_id").alias("a"), F.col("hi").alias("a_hi"))
    b = ends.select(F.col("video_id").alias("b"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    reach = s.slope_max if s.wide_beta else 1.0
    out = pairs.select("a", "b").join(a, "a").join(b, "b")
    out = out.withColumn("beta_min", F.col("b_lo") - reach * F.col("a_hi") - s.tau).withColumn("span", F.col("b_hi") + s.tau - F.col("beta_min"))
    out = out.withColumn("n_beta", F.greatest(F.lit(20), F.floor(F.greatest(F.col("span"), F.lit(4 * s.tau)) / s.tau)).cast("bigint"))
    return out.select("a", "b", "beta_min", (F.col("span") / F.col("n_beta")).alias("step"), "n_beta")


def _binned(cells: DataFrame, geometry: DataFrame, s: Settings, keys: list[str]) -> DataFrame:
    grid = F.posexplode(F.array(*[F.lit(x) for x in s.alphas()])).alias("alpha_idx", "alpha")
    rows = cells.join(geometry, ["a", "b"]).select("*", grid)
    beta = F.floor((F.col("tb") - F.col("alpha") * F.col("ta") - F.col("beta_min")) / F.col("step")).cast("bigint")
    rows = rows.withColumn("beta_idx", beta).filter((F.col("beta_idx") >= 0) & (F.col("beta_idx") < F.col("n_beta")))
    return rows.groupBy(*keys, "alpha_idx", "beta_idx").agg(F.sum("w").alias("votes"))


def line_votes(cells: DataFrame, geometry: DataFrame, s: Settings) -> DataFrame:
    """(a, b, alpha_idx, beta_idx, votes): the weight on every line bin that gets a vote."""
    return _binned(cells, geometry, s, ["a", "b"])


def permuted(pairs: DataFrame, samples: DataFrame, n_perm: int) -> DataFrame:
    """(a, b, perm, j, tb): the times of b dealt out anew in every trial, in the order of md5 of (seed of the pair, trial, j)."""
    b = samples.select(F.col("video_id").alias("b"), F.col("pos").alias("from_j"), F.col("ts").cast("double").alias("tb"))
    rows = pairs.select("a", "b").join(b, "b").select("*", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("perm"))
    seed = ((F.col("a").cast("bigint") + 1) * 0x7F4A7C15 + F.col("b")).bitwiseAND(F.lit(0xFFFFFFFF))  # pair_seed, in its low bits
    key = F.md5(F.concat_ws("|", seed, "perm", "from_j"))
    place = F.row_number().over(Window.partitionBy("a", "b", "perm").orderBy(key, "from_j")) - 1
    return rows.select("a", "b", "perm", place.cast("bigint").alias("j"), "tb")


def null_votes(cells: DataFrame, permuted: DataFrame, geometry: DataFrame, s: Settings) -> DataFrame:
    """(a, b, perm, alpha_idx, beta_idx, votes) under every permutation."""
    return _binned(cells.drop("tb").join(permuted, ["a", "b", "j"]), geometry, s, ["a", "b", "perm"])


def null_stats(null: DataFrame, geometry: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(a, b, alpha_idx, beta_idx, mean) of bins with votes, and (a, b, pooled_std) over all bins, empty ones too."""
    n = float(s.n_perm)
    bins = null.groupBy("a", "b", "alpha_idx", "beta_idx").agg(F.sum("votes").alias("sum"), F.sum(F.col("votes") * F.col("votes")).alias("squares"))
    var = (F.col("squares") - F.col("sum") * F.col("sum") / n) / (n - 1)
    pooled = bins.groupBy("a", "b").agg(F.sum(var).alias("var")).join(geometry, ["a", "b"]).select("a", "b", F.sqrt(F.greatest(F.col("var"), F.lit(0.0)) / (s.n_alpha * F.col("n_beta")) + 1e-12).alias("pooled_std"))
    return bins.select("a", "b", "alpha_idx", "beta_idx", (F.col("sum") / n).alias("mean")), pooled


def z_scores(votes: DataFrame, means: DataFrame, pooled: DataFrame) -> DataFrame:
    rows = votes.join(means, ["a", "b", "alpha_idx", "beta_idx"], "left").join(pooled, ["a", "b"])
    return rows.withColumn("z", (F.col("votes") - F.coalesce("mean", F.lit(0.0))) / F.col("pooled_std"))


def peak(rows: DataFrame, by: str) -> DataFrame:
    """The row with the largest value of every pair, compared at six decimals; ties go to the first bin."""
    first = F.struct(round6(F.col(by)).alias("x"), (-F.col("alpha_idx")).alias("p"), (-F.col("beta_idx")).alias("q"))
    return rows.groupBy("a", "b").agg(F.max_by(F.struct("alpha_idx", "beta_idx", by, *(["votes"] if by != "votes" else [])), first).alias("x")).select("a", "b", "x.*")


def significance(votes: DataFrame, null: DataFrame, geometry: DataFrame, s: Settings) -> DataFrame:
    """(a, b, alpha, beta, support, z_score, pvalue, null_max): the peak of every pair against the permutations' peaks."""
    means, pooled = null_stats(null, geometry, s)
    best = peak(z_scores(votes, means, pooled), "z").withColumnRenamed("z", "z_score")
    tops = z_scores(null, means, pooled).groupBy("a", "b", "perm").agg(F.max("z").alias("z"))
    joined = best.join(tops, ["a", "b"]).groupBy("a", "b", "alpha_idx", "beta_idx", "votes", "z_score").agg(F.sum((F.col("z") >= F.col("z_score")).cast("int")).alias("reach"), F.max("z").alias("null_max"))
    step = (s.slope_max - s.slope_min) / s.n_alpha
    return joined.join(geometry, ["a", "b"]).select("a", "b", (F.lit(s.slope_min) + (F.col("alpha_idx") + 0.5) * step).alias("alpha"), (F.col("beta_min") + (F.col("beta_idx") + 0.5) * F.col("step")).alias("beta"), F.col("votes").alias("support"), "z_score", ((F.col("reach") + 1.0) / (s.n_perm + 1.0)).alias("pvalue"), "null_max")
