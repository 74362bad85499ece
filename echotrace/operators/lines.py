"""Robust lines through match clouds: sampled consensus with peeling, and its exhaustive form."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings

#: Fixed value: the seed of the sampled pairs of points.
SEED = 0xC0FFEE


@lru_cache(maxsize=64)
def sampled_pairs(n: int, draws: int) -> np.ndarray:
    """That many pairs of different indices below n; the same for every cloud of n points.

    Draw t takes its indices from the first and second 32 bits of md5("SEED|t"), the
    second index as a distance from the first, so that SQL can state the draws too.
    """
    found = [hashlib.md5(f"{SEED}|{t}".encode()).digest() for t in range(draws)]
    x, y = (np.array([int.from_bytes(d[i : i + 4], "big") for d in found], np.int64) for i in (0, 4))
    return np.stack((x % n, (x % n + 1 + y % (n - 1)) % n), axis=1)


def consensus(points: np.ndarray, draws: int, tol: float, slope_min: float, slope_max: float) -> tuple[np.ndarray, float, float] | None:
    """(inliers, slope, offset) of the sampled line with most points within tol, at six decimals; the earliest of equals; None below four."""
    if len(points) < 4:
        return None
    x, y = points[:, 0], points[:, 1]
    first, second = sampled_pairs(len(points), draws).T
    run = x[second] - x[first]
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = (y[second] - y[first]) / run
        offset = y[first] - slope * x[first]
    fine = np.flatnonzero((np.abs(run) >= 1e-3) & (slope >= slope_min) & (slope <= slope_max))
    # each distinct sample once, at its earliest draw
    _, once = np.unique(first[fine] * len(points) + second[fine], return_index=True)
    fine = fine[np.sort(once)]
    best, most = -1, 3
    for lo in range(0, len(fine), 1024):
        part = fine[lo : lo + 1024]
        count = (np.round(np.abs(y - (slope[part, None] * x + offset[part, None])), 6) <= tol).sum(axis=1)
        top = int(count.argmax())
        if count[top] > most:
            best, most = int(part[top]), int(count[top])
    if best < 0:
        return None
    return np.round(np.abs(y - (slope[best] * x + offset[best])), 6) <= tol, float(slope[best]), float(offset[best])


def peel(points: np.ndarray, sims: np.ndarray, mirror: np.ndarray, s: Settings) -> list[tuple]:
    """Segments of a cloud: fit, take the inliers out, fit again; a line too short in time uses a round but is not kept."""
    found, left = [], np.arange(len(points))
    for _ in range(s.max_segments):
        if len(left) < s.min_inliers:
            break
        fit = consensus(points[left], s.ransac_iters, s.ransac_tol, s.slope_min, s.slope_max)
        if fit is None or fit[0].sum() < s.min_inliers:
            break
        mine, left = left[fit[0]], left[~fit[0]]
        (a_lo, b_lo), (a_hi, b_hi) = points[mine].min(axis=0), points[mine].max(axis=0)
        if a_hi - a_lo >= s.min_segment_seconds:
            found.append((float(a_lo), float(a_hi), float(b_lo), float(b_hi), fit[1], bool(mirror[mine].mean() > 0.5), len(mine), float(sims[mine].mean())))
    return sorted(found, key=lambda x: round(x[7] * (x[1] - x[0]), 6), reverse=True)


SEGMENTS = "a int, b int, nth int, a_start double, a_end double, b_start double, b_end double, speed_ratio double, mirrored boolean, inliers int, score double"


def per_cloud(cloud: DataFrame, pairs: DataFrame, result, schema: str) -> DataFrame:
    """result(a, b, points, sims, mirror) of each given pair's points, in the order (ta, tb, sim, mirror), so results do not depend on how the cloud was dealt out."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("ta", "tb", "sim", "mirror")])
        points = np.stack([table.column(c).to_numpy() for c in ("ta", "tb")], axis=1).astype(np.float64)
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        return result(a, b, points, table.column("sim").to_numpy().astype(np.float64), table.column("mirror").to_numpy().astype(bool))

    rows = cloud.join(pairs.select("a", "b"), ["a", "b"], "left_semi").select(F.col("a").cast("int"), F.col("b").cast("int"), F.col("ta").cast("double"), F.col("tb").cast("double"), "sim", "mirror")
    return rows.groupBy("a", "b").applyInArrow(run, schema)


def peeled_segments(cloud: DataFrame, pairs: DataFrame, s: Settings) -> DataFrame:
    """One row for each segment of the given pairs, in order of score times duration (nth)."""

    def segments(a, b, points, sims, mirror) -> pa.Table:
        found = peel(points, sims, mirror, s)
        names = ("a_start", "a_end", "b_start", "b_end", "speed_ratio", "mirrored", "inliers", "score")
        kinds = (pa.float64(),) * 5 + (pa.bool_(), pa.int32(), pa.float64())
        cols = {"a": pa.array([a] * len(found), pa.int32()), "b": pa.array([b] * len(found), pa.int32()), "nth": pa.array(range(len(found)), pa.int32())}
        return pa.table(cols | {n: pa.array([f[i] for f in found], k) for i, (n, k) in enumerate(zip(names, kinds))})

    return per_cloud(cloud, pairs, segments, SEGMENTS)


def consensus_lines(cloud: DataFrame, pairs: DataFrame, s: Settings) -> DataFrame:
    """(a, b, alpha, beta, inliers): the sampled line of each given pair that most of its points fit."""

    def line(a, b, points, sims, mirror) -> pa.Table:
        fit = consensus(points, s.ransac_iters, s.ransac_tol, s.slope_min, s.slope_max)
        rows = [(a, b, fit[1], fit[2], int(fit[0].sum()))] if fit else []
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64())
        return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(("a", "b", "alpha", "beta", "inliers"), kinds))})

    return per_cloud(cloud, pairs, line, "a int, b int, alpha double, beta double, inliers bigint")


#: Anchors times points of one task of the exhaustive search, and its least anchors, for which all points are sent.
CELL, LEAST_ANCHORS = 1 << 24, 256


def round6(v: np.ndarray) -> np.ndarray:
    """Six decimals as SQL rounds them: halves of the scaled value go away from zero."""
    scaled = np.abs(v * 1e6)
    whole = np.floor(scaled)
    return np.copysign(whole + (scaled - whole >= 0.5), v) / 1e6 + 0.0


def best_line(x: np.ndarray, y: np.ndarray, n: np.ndarray, anchors: np.ndarray, tol: float, slope_min: float, slope_max: float) -> tuple[float, float, int] | None:
    """(slope, offset, inliers) of the line with most points among those through an anchor and a later point; None below four.

    The points (x, y), each there n times, differ and ascend.  A point is within the tolerance of an
    anchor's line for an interval of slopes, so the sorted ends of the intervals count all of its lines
    at once.  The intervals are wider than what rounding can move; lines that could be the best by that
    count are counted again point by point.
    """
    wide = tol + 2e-6 + 2.0**-46 * (1 + max(abs(slope_min), abs(slope_max))) * max(np.abs(x).max(), np.abs(y).max())
    # equal weights, the usual case, need no order of their own
    steps = np.arange(len(x) + 1) * n[0] if (n == n[0]).all() else None

    def ends(v: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if steps is not None:
            return np.sort(v), steps
        order = np.argsort(v)
        return v[order], np.concatenate(([0], np.cumsum(weights[order])))

    best, most = None, 3
    for i in anchors:
        left, right = np.searchsorted(x, x[i], "left"), np.searchsorted(x, x[i], "right")
        run, rise = x - x[i], y - y[i]
        first = right + np.searchsorted(run[right:], 1e-3, "left")
        slopes = round6(rise[first:] / run[first:])
        # in order, for the searches below go fast through ordered values
        slopes = np.sort(slopes[(slopes >= slope_min) & (slopes <= slope_max)])
        if not len(slopes):
            continue
        run, rise, weights = (np.concatenate((v[:left], v[right:])) for v in (run, rise, n))
        with np.errstate(over="ignore"):
            middle, half = rise / run, wide / np.abs(run)
        lo, hi = middle - half, middle + half
        near = np.flatnonzero((hi >= slope_min) & (lo <= slope_max))
        (lo, begun), (hi, over) = ends(lo[near], weights[near]), ends(hi[near], weights[near])
        at_most = n[left:right][np.abs(y[left:right] - y[i]) <= wide].sum() + begun[np.searchsorted(lo, slopes, "right")] - over[np.searchsorted(hi, slopes, "left")]
        # the highest counts first, of equals the smaller slopes: what comes after a line that holds its count can't win a tie
        fine = np.flatnonzero(at_most >= max(most, 4))
        order = fine[np.lexsort((slopes[fine], -at_most[fine]))]
        for k in order:
            if at_most[k] < most or best and at_most[k] == most and slopes[k] > best[0]:
                continue
            slope = slopes[k]
            offset = round6(y[i] - slope * x[i])
            count = int(n[round6(np.abs(y - (slope * x + offset))) <= tol].sum())
            if count > most or best and count == most and (slope, offset) < best[:2]:
                best, most = (float(slope), float(offset), count), count
    return best


def exhaustive_lines(cloud: DataFrame, s: Settings) -> DataFrame:
    """(a, b, alpha, beta, inliers): of all lines through two points of a pair, the one with most points within the tolerance.

    Lines are compared at six decimals; ties go to the smaller slope, then offset.  A pair's distinct
    points are sent to as many tasks as their squared number needs; each takes its share of them as
    anchors, so no table of lines is made.
    """
    kinds = dict(cloud.dtypes)
    schema = f"a {kinds['a']}, b {kinds['b']}, alpha double, beta double, inliers bigint"

    def line(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("ta", "ascending"), ("tb", "ascending")])
        x, y, n = (table.column(c).to_numpy() for c in ("ta", "tb", "n"))
        anchors = np.arange(key[2].as_py(), len(x), table.column("parts")[0].as_py())
        found = best_line(x, y, n, anchors, s.ransac_tol, s.slope_min, s.slope_max)
        values = [[key[0].as_py(), key[1].as_py(), *found]] if found else []
        types = (table.schema.field("a").type, table.schema.field("b").type, pa.float64(), pa.float64(), pa.int64())
        return pa.table({c: pa.array([v[i] for v in values], t) for i, (c, t) in enumerate(zip(("a", "b", "alpha", "beta", "inliers"), types))})

    points = cloud.select("a", "b", F.col("ta").cast("double").alias("ta"), F.col("tb").cast("double").alias("tb")).dropna()
    counted = points.groupBy("a", "b", "ta", "tb").agg(F.count("*").alias("n"))
    size = F.count("*").over(Window.partitionBy("a", "b"))
    dealt = counted.withColumn("parts", F.ceil(size / F.greatest(F.lit(LEAST_ANCHORS).cast("double"), CELL / size)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # few bytes, much work: a fixed number of partitions, which are not joined by their size
    spread = dealt.repartition(4 * cloud.sparkSession.sparkContext.defaultParallelism, "a", "b", "part")
    best = F.max_by(F.struct("alpha", "beta", "inliers"), F.struct("inliers", -F.col("alpha"), -F.col("beta")))
    return spread.groupBy("a", "b", "part").applyInArrow(line, schema).groupBy("a", "b").agg(best.alias("x")).select("a", "b", "x.*")


def segment_summary(cloud: DataFrame, lines: DataFrame, s: Settings) -> DataFrame:
    """(a, b, a_start, a_end, b_start, b_end, speed_ratio, mirrored, inliers, score) of the points within the tolerance of each pair's line."""
    fits = F.round(F.abs(F.col("tb") - (F.col("alpha") * F.col("ta") + F.col("beta"))), 6) <= s.ransac_tol
    rows = cloud.join(lines.select("a", "b", "alpha", "beta"), ["a", "b"]).filter(fits)
    return rows.groupBy("a", "b", F.col("alpha").alias("speed_ratio")).agg(
        F.min("ta").alias("a_start"), F.max("ta").alias("a_end"), F.min("tb").alias("b_start"), F.max("tb").alias("b_end"), (F.avg("mirror") > 0.5).alias("mirrored"), F.count("*").alias("inliers"), F.avg("sim").alias("score")
    )
