"""Ranked results, their paths, JSON and text, and the status report."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.scalar import time_text


def with_paths(pairs: DataFrame, videos: DataFrame, query_path: str | None = None) -> DataFrame:
    """pairs with a_path and b_path; '?' for unknown ids; a = -1 is the query."""
    side = lambda key: videos.select(F.col("video_id").alias(key), F.col("path").alias(f"{key}_path"))
    out = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    a_path = F.coalesce("a_path", F.lit("?"))
    if query_path is not None:
        a_path = F.when(F.col("a") == -1, F.lit(query_path)).otherwise(a_path)
    return out.withColumn("a_path", a_path).withColumn("b_path", F.coalesce("b_path", F.lit("?")))


def duration() -> F.Column:
    return F.col("a_end") - F.col("a_start")


def ranked(segments: DataFrame) -> DataFrame:
    """Segments with the rank of their pair.

    With z scores: by z, then duration. Without: by the pair's largest score times duration.
    Ties go to the smaller ids. Only pairs with a segment are ranked, so one list suffices.
    """
    value = F.col("score") * duration()
    pair = segments.groupBy("a", "b").agg(F.max("z_score").alias("z"), F.max(duration()).alias("dur"), F.max(value).alias("best")) if "z_score" in segments.columns else segments.groupBy("a", "b").agg(F.lit(None).cast("double").alias("z"), F.lit(0.0).alias("dur"), F.max(value).alias("best"))
    order = Window.orderBy(F.desc_nulls_last("z"), F.desc("dur"), F.desc("best"), "a", "b")
    return segments.drop("rank").join(pair.select("a", "b", F.row_number().over(order).alias("rank")), ["a", "b"])


def ordered_segments(segments: DataFrame) -> DataFrame:
    """(a, b, segments): each pair's segments as an array, by score times duration."""
    own = [c for c in segments.columns if c not in ("a", "b", "nth", "rank", "a_path", "b_path")]
    value = F.col("score") * duration()
    keyed = F.struct((-value).alias("__order"), *own)
    listed = segments.groupBy("a", "b").agg(F.sort_array(F.collect_list(keyed)).alias("x"))
    return listed.select("a", "b", F.transform("x", lambda s: F.struct(*[s[c].alias(c) for c in own])).alias("segments"))


def json_rows(segments: DataFrame) -> DataFrame:
    """(a, b, json): one JSON object for each pair, nulls kept."""
    opt = lambda c: F.col(c) if c in segments.columns else F.lit(None).cast("double")
    seg = F.struct(
        F.array("a_start", "a_end").alias("a_range"), F.array("b_start", "b_end").alias("b_range"), "speed_ratio", "mirrored", "score", "inliers", opt("pvalue").alias("pvalue"), opt("z_score").alias("z_score"), opt("weighted_support").alias("weighted_support")
    )
    value = F.struct((-F.col("score") * duration()).alias("o"), F.col("a_start").alias("p"), seg.alias("seg"))
    listed = segments.groupBy("a", "b", "a_path", "b_path").agg(F.transform(F.sort_array(F.collect_list(value)), lambda x: x["seg"]).alias("segments"))
    side = lambda k: F.struct(F.col(k).alias("id"), F.col(f"{k}_path").alias("path")).alias(k)
    return listed.select("a", "b", F.to_json(F.struct(side("a"), side("b"), "segments"), {"ignoreNullFields": "false"}).alias("json"))


def to_json(segments: DataFrame) -> str:
    """The ranked result as one JSON text; for results that a reader can take in."""
    order = ranked(segments).groupBy("a", "b").agg(F.min("rank").alias("rank"))
    rows = json_rows(segments).join(order, ["a", "b"]).orderBy("rank").toLocalIterator()
    return json.dumps([json.loads(r["json"]) for r in rows], indent=2, ensure_ascii=False)


def clock(seconds: float) -> str:
    whole = int(max(0.0, seconds))
    minutes, sec = divmod(whole, 60)
    return f"{minutes // 60}:{minutes % 60:02d}:{sec:02d}" if minutes >= 60 else f"{minutes}:{sec:02d}"


def render(rows: Iterable[Row]) -> str:
    """A text table of ranked segments; z and p only if any segment has them."""
    rows = [r.asDict() for r in rows]
    if not rows:
        return "Nothing in common."
    extra = [(c, f) for c, f in (("z_score", "{:.1f}"), ("pvalue", "{:.3f}")) if any(r.get(c) is not None for r in rows)]
    out, last = [], None
    for r in rows:
        if (r["a"], r["b"]) != last:
            last = (r["a"], r["b"])
            out.append(f"{r['a_path'].rsplit('/', 1)[-1]} <-> {r['b_path'].rsplit('/', 1)[-1]}")
        line = [f"{clock(r['a_start'])}-{clock(r['a_end'])}", f"{clock(r['b_start'])}-{clock(r['b_end'])}", f"x{r['speed_ratio']:.2f}", "yes" if r["mirrored"] else "—", f"{r['score']:.3f}", str(r["inliers"])]
        out.append("  " + "  ".join(line + ["—" if r.get(c) is None else f.format(r[c]) for c, f in extra]))
    return "\n".join(out)


def status(videos: DataFrame, frames: DataFrame) -> DataFrame:
    """(video_id, frames, duration, path) of every video; frames counts the originals."""
    count = frames.groupBy("video_id").agg(F.sum(1 - F.col("mirrored").cast("int")).alias("frames"))
    text = F.format_string("%d:%02d", F.floor(F.col("duration") / 60).cast("bigint"), F.floor(F.col("duration") % 60).cast("bigint"))
    return videos.join(count, "video_id", "left").select("video_id", F.coalesce("frames", F.lit(0)).alias("frames"), text.alias("duration"), "path")


def totals(videos: DataFrame, frames: DataFrame) -> DataFrame:
    """One row: videos and vectors."""
    return videos.agg(F.count("*").alias("videos")).join(frames.agg(F.count("*").alias("vectors")))


__all__ = ["clock", "json_rows", "ordered_segments", "ranked", "render", "status", "time_text", "to_json", "totals", "with_paths"]
