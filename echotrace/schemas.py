"""Schemas of the stored and derived relations."""

VIDEOS = "video_id int, path string, sha1 string, duration double, width int, height int, n_frames int, status string, added_at timestamp"
FRAMES = "frame_id bigint, video_id int, ts float, mirrored tinyint, embedding array<float>"
KNN = "src bigint, tgt bigint, sim double, rank int"
CLOUD = "a int, b int, ta double, tb double, sim double, mirror int"
SEGMENT = "a_start double, a_end double, b_start double, b_end double, speed_ratio double, mirrored boolean, inliers int, score double, pvalue double, weighted_support double, z_score double"
STATUSES = ("pending", "complete", "failed", "rejected")
