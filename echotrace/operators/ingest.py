"""Catalog and ingest relations: resume filters, id assignment, status log, crops, batch counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SETTLED = ("complete", "rejected")


def latest_status(log: DataFrame) -> DataFrame:
    """(video_id, status): the last entry of the append-only status log (video_id, seq, status)."""
    return log.groupBy("video_id").agg(F.max_by("status", "seq").alias("status"))


def unsettled_by_path(incoming: DataFrame, videos: DataFrame) -> DataFrame:
    """Incoming paths that are not in the catalog as complete or rejected."""
    done = videos.filter(F.col("status").isin(*SETTLED)).select("path")
    return incoming.join(done, "path", "left_anti")


def unsettled(incoming: DataFrame, videos: DataFrame) -> DataFrame:
    """The same by path or content hash; two anti-joins, as a disjunction would be a nested loop."""
    done = videos.filter(F.col("status").isin(*SETTLED))
    return incoming.join(done.select("path"), "path", "left_anti").join(done.select("sha1").filter("sha1 IS NOT NULL"), "sha1", "left_anti")


def with_ids(incoming: DataFrame, videos: DataFrame) -> DataFrame:
    """incoming with a video_id: that of a complete catalog row of the same path, else a new one.

    New ids follow the largest known, in the order of paths.  Paths are numbered within
    range partitions and shifted by the rows of the partitions before, so no task sees all.
    """
    known = videos.filter("status = 'complete'").select("path", F.col("video_id").alias("known"))
    rows = incoming.dropDuplicates(["path"]).join(known, "path", "left")
    top = videos.agg(F.coalesce(F.max("video_id"), F.lit(0)).alias("top"))
    new = rows.filter("known IS NULL").drop("known").repartitionByRange("path").sortWithinPartitions("path")
    new = new.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    sizes = new.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    numbered = new.join(before, "part").join(F.broadcast(top)).select(*incoming.columns, (F.col("top") + F.col("before") + F.col("nth") + 1).cast("int").alias("video_id"))
    return numbered.unionByName(rows.filter("known IS NOT NULL").select(*incoming.columns, F.col("known").cast("int").alias("video_id")))


def frame_counts(frames: DataFrame) -> DataFrame:
    """(video_id, n_frames): frames that are not mirrored copies."""
    return frames.groupBy("video_id").agg(F.sum(1 - F.col("mirrored").cast("int")).alias("n_frames"))


def mirrored_rows(frames: DataFrame) -> DataFrame:
    """Every frame twice, flagged 0 and 1."""
    return frames.drop("mirrored").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("mirrored"))


def robust_crop(crops: DataFrame, least_area: float = 0.5) -> DataFrame:
    """(video_id, w, h, x, y): the median of each coordinate, cut to a whole number, over crops of at least half the source area."""
    fine = crops.filter((F.col("src_w") * F.col("src_h") > 0) & (F.col("w") * F.col("h") >= least_area * F.col("src_w") * F.col("src_h")))
    return fine.groupBy("video_id").agg(*[F.percentile(c, 0.5).cast("int").alias(c) for c in "whxy"])


def last_crop(crops: DataFrame, within: float = 30.0) -> DataFrame:
    """(video_id, w, h, x, y): the last detection in the first seconds."""
    return crops.filter(F.col("ts") <= within).groupBy("video_id").agg(F.max_by(F.struct("w", "h", "x", "y"), "seq").alias("c")).select("video_id", "c.*")


def contrasted(frames: DataFrame, least: float, values: str = "pixels") -> DataFrame:
    """Frames whose values spread by at least that (population standard deviation): no black, fades or plain colours."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double")) / n
    var = F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / n - mean * mean
    return frames.filter(F.round(F.sqrt(F.greatest(var, F.lit(0.0))), 6) >= least)


def batch_completion(batches: DataFrame, expected: DataFrame) -> DataFrame:
    """(video_id, expected, received, n_frames, failed, status) from batch results (video_id, mirror, n, ok) and batches expected.

    Frames count from successful batches that are not mirrored. Complete once all batches
    came and none failed; failed once all came and one did; else pending.
    """
    got = batches.groupBy("video_id").agg(F.count("*").alias("received"), F.sum(F.when(F.col("ok") & (F.col("mirror") == 0), F.col("n")).otherwise(0)).alias("n_frames"), F.bool_or(~F.col("ok")).alias("failed"))
    rows = expected.join(got, "video_id", "left").select("video_id", "expected", *[F.coalesce(c, F.lit(z)).alias(c) for c, z in (("received", 0), ("n_frames", 0), ("failed", False))])
    return rows.withColumn("status", F.when(F.col("received") < F.col("expected"), "pending").when(F.col("failed"), "failed").otherwise("complete"))
