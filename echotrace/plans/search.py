"""The three searches, as compositions of operators: no loop over pairs, nothing collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import extent, hough, knn, lines, voting, weights

SEGMENT_COLUMNS = hough.FIELDS


def frame_weights(frames: DataFrame, s: Settings) -> DataFrame:
    """(frame_id, rho, idf) of every frame."""
    n_videos = frames.select("video_id").distinct().count()
    near = knn.located(knn.topk(frames, frames, s.idf_k + 1, s.block_rows), frames)
    idf = weights.inverse_frequency(weights.document_frequency(frames, near, s.smooth_p), n_videos)
    return weights.self_redundancy(frames, s.smooth_p, s.block_rows).join(idf, "frame_id")


def smooth_segments(frames: DataFrame, s: Settings, neighbours: DataFrame | None = None) -> DataFrame:
    """(a, b, segment columns): pairs whose matrix holds a significant, long, similar and dense line.

    Weights are computed only if the settings use them.
    """
    near = knn.located(neighbours if neighbours is not None else knn.self_topk(frames, s), frames)
    pairs = knn.candidate_pairs(knn.foreign(near), s.min_kmatches)
    own = frame_weights(frames, s) if s.use_idf or s.use_rho else None
    return hough.aligned_segments(pairs, voting.sampled(frames, s.max_frames), s, own)


def gated_segments(pairs: DataFrame, samples: DataFrame, s: Settings) -> DataFrame:
    """The same, with the extents and gates as relations over the matrices' cells."""
    cells, tested = voting.cells(pairs, samples, s), hough.tested_lines(pairs, samples, s)
    return extent.gated(tested, extent.extent(extent.nearest_in_time(cells, tested, s.tau), s.min_tube_sim), s)


def cloud(frames: DataFrame, s: Settings, neighbours: DataFrame | None = None) -> DataFrame:
    """The match cloud: neighbours that are foreign, not generic, mutual and similar."""
    found = neighbours if neighbours is not None else knn.self_topk(frames, s)
    near = knn.foreign(knn.located(found, frames))
    clean = knn.without_generic(near, knn.generic_frames(near, s.generic_max_videos))
    if s.mutual_knn:
        clean = clean.join(knn.mutual(found).select("src", "tgt"), ["src", "tgt"], "left_semi")
    return knn.match_cloud(clean, s.min_match_sim)


def robust_segments(frames: DataFrame, s: Settings, neighbours: DataFrame | None = None) -> DataFrame:
    """(a, b, nth, segment columns): segments peeled off the match clouds by sampled consensus."""
    points = cloud(frames, s, neighbours)
    return extent.filtered_segments(lines.peeled_segments(points, knn.crowded(points, s.min_pair_matches), s), s)


def find_segments(query: DataFrame, frames: DataFrame, s: Settings) -> DataFrame:
    """(a = -1, b, nth, segment columns) of one query video's frames against the indexed frames.

    k neighbours, no similarity floor, no mutual or generic filter, and no exclusion of the
    query's own footage.
    """
    near = knn.topk(query, frames, s.knn, s.block_rows)
    src = query.select(F.col("frame_id").alias("src"), F.col("ts").cast("double").alias("ta"), F.col("mirrored").cast("int").alias("sm"))
    tgt = frames.select(F.col("frame_id").alias("tgt"), F.col("video_id").alias("b"), F.col("ts").cast("double").alias("tb"), F.col("mirrored").cast("int").alias("tm"))
    points = near.join(src, "src").join(tgt, "tgt").select(F.lit(-1).alias("a"), "b", "ta", "tb", "sim", F.col("sm").bitwiseXOR(F.col("tm")).alias("mirror"))
    return extent.filtered_segments(lines.peeled_segments(points, knn.crowded(points, s.min_pair_matches), s), s)


def complete_frames(frames: DataFrame, videos: DataFrame) -> DataFrame:
    """Frames of videos whose ingest is complete."""
    return frames.join(videos.filter("status = 'complete'").select("video_id"), "video_id", "left_semi")
