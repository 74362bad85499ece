import math

import pytest
from pyspark.sql import functions as F

from echotrace.config import Settings, data_dir
from echotrace.functions import scalar
from echotrace.plans.report import clock

TIMES = [(12, "0:12"), (107, "1:47"), (3661, "1:01:01"), (-5, "0:00"), (59.9, "0:59"), (3600, "1:00:00")]


def test_time_text(spark):
    rows = spark.createDataFrame([(float(s), t) for s, t in TIMES], "s double, t string").select(scalar.time_text("s").alias("got"), "t").collect()
    assert all(r["got"] == r["t"] for r in rows)


@pytest.mark.parametrize("s,t", TIMES)
def test_clock(s, t):
    assert clock(s) == t


def test_keyframe_budget(spark):
    rows = spark.createDataFrame([(0.0,), (20.0,), (1e9,), (-1.0,)], "d double").select(scalar.keyframe_budget("d").alias("n")).collect()
    assert [r["n"] for r in rows] == [648000, 200, 648000, 648000]


def test_unit_dot_clip(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "v array<float>, z array<float>").select(scalar.unit("v").alias("u"), scalar.unit("z").alias("z"), scalar.dot("v", "v").alias("d"), scalar.clip_power(F.lit(1.5), 4).alias("c"), scalar.clip_power(F.lit(-0.5), 4).alias("n")).first()
    assert row["u"] == pytest.approx([0.6, 0.8]) and row["z"] == [0.0, 0.0] and row["d"] == 25.0 and row["c"] == 1.0 and row["n"] == 0.0


def test_decoder_logs(spark):
    log = "x crop=640:360:0:60 pts_time: 1.5 crop=10:20:30:40 pts_time:-2e1"
    row = spark.createDataFrame([(log,)], "log string").select(scalar.crops_of("log").alias("c"), scalar.pts_of("log").alias("p")).first()
    assert [tuple(c) for c in row["c"]] == [(640, 360, 0, 60), (10, 20, 30, 40)] and row["p"] == [1.5, -20.0]


def test_settings_and_folder():
    s = Settings()
    assert s.min_inliers == 10 and len(s.alphas()) == 20 and math.isclose(s.alphas()[6], 0.9875)
    assert scalar.pair_seed(0, 1) == (0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFF
    assert str(data_dir({"XDG_DATA_HOME": "/x"})) == "/x/echotrace" and str(data_dir({"ECHOTRACE_HOME": "/y"})) == "/y"
