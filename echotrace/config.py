"""Settings of a search, and where its tables live."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace
from pathlib import Path

#: File suffixes that count as video.
VIDEO_SUFFIXES = ("mp4", "mkv", "avi", "mov", "webm", "flv", "wmv", "m4v", "mpg", "mpeg")


@dataclass(frozen=True)
class Settings:
    """Thresholds and sizes; the defaults suit two frames a second of real footage."""

    fps: float = 2.0
    frame_size: int = 224
    batch_size: int = 64
    mirror: bool = True
    min_frame_std: float = 18.0
    # neighbours
    knn: int = 10
    block_rows: int | None = None
    exclude_same_video: bool = False
    # match clouds and robust lines
    min_pair_matches: int = 20
    min_match_sim: float = 0.72
    mutual_knn: bool = True
    generic_max_videos: int = 8
    ransac_iters: int = 10_000
    ransac_tol: float = 1.0
    max_segments: int = 4
    slope_min: float = 0.5
    slope_max: float = 2.0
    min_segment_seconds: float = 4.0
    min_segment_score: float = 0.80
    min_inlier_density: float = 0.40
    # weighted line votes
    smooth_p: float = 4.0
    tau: float = 1.0
    n_alpha: int = 20
    n_perm: int = 50
    min_zscore: float = 6.0
    max_pvalue: float = 0.02
    max_frames: int = 350
    idf_k: int = 50
    min_kmatches: int = 5
    use_idf: bool = False
    use_rho: bool = False
    min_tube_sim: float = 0.70
    # corrections of known blind spots, off by default
    refine_slope: bool = False
    wide_beta: bool = False
    density_in_sampled_units: bool = False

    def with_(self, **changes) -> Settings:
        return replace(self, **changes)

    @property
    def min_inliers(self) -> int:
        return max(6, self.min_pair_matches // 2)

    def alphas(self) -> list[float]:
        """Centres of the slope bins."""
        step = (self.slope_max - self.slope_min) / self.n_alpha
        return [self.slope_min + (i + 0.5) * step for i in range(self.n_alpha)]


def data_dir(env: dict[str, str] | None = None, app: str = "echotrace") -> Path:
    """The store's folder: $ECHOTRACE_HOME, or a folder under $XDG_DATA_HOME, or under ~/.local/share."""
    env = os.environ if env is None else env
    if env.get("ECHOTRACE_HOME"):
        return Path(env["ECHOTRACE_HOME"]).expanduser()
    base = env.get("XDG_DATA_HOME")
    return (Path(base) if base else Path.home() / ".local" / "share") / app
