import numpy as np
import pytest
from pyspark.sql import functions as F

from echotrace.config import Settings
from echotrace.engine import Engine
from echotrace.sources import files, frames
from echotrace.sources.store import Store

FRAMES = "video_id int, ts double, mirrored int, embedding array<double>"
VIDEO = "path string, sha1 string, duration double, width int, height int"


def test_catalog_round_trip(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.videos().count() == 0 and store.n_vectors() == 0 and store.dim is None
    rows = store.add_videos(spark.createDataFrame([("/b", "h2", 2.0, 1, 1), ("/a", "h1", 1.0, 1, 1)], VIDEO))
    assert {(r["path"], r["video_id"], r["status"]) for r in rows.collect()} == {("/a", 1, "pending"), ("/b", 2, "pending")}
    store.add_frames(spark.createDataFrame([(1, 0.0, 0, [1.0, 0.0]), (1, 0.0, 1, [0.0, 1.0]), (2, 0.5, 0, [1.0, 0.0])], FRAMES))
    store.mark(spark.createDataFrame([(1,)], "video_id int"), "complete")
    store.mark(spark.createDataFrame([(2,)], "video_id int"), "failed")
    assert store.frames().count() == 2 and store.frames(complete=False).count() == 3
    assert {r["video_id"]: (r["status"], r["n_frames"]) for r in store.videos().collect()} == {1: ("complete", 1), 2: ("failed", 0)}
    again = store.add_videos(spark.createDataFrame([("/a", "h1", 1.0, 1, 1), ("/b", "h2", 2.0, 1, 1)], VIDEO))
    assert {r["path"]: (r["video_id"], r["status"]) for r in again.collect()} == {"/a": (1, "complete"), "/b": (3, "pending")}
    assert sorted(r["path"] for r in store.videos().collect()) == ["/a", "/b"]  # a retry replaces what failed
    assert {r["sha1"] for r in store.known_hashes().collect()} == {"h1", "h2"}
    assert store.vectors(spark.createDataFrame([(1 << 32,)], "frame_id bigint")).first()["embedding"] == [1.0, 0.0]
    with pytest.raises(Exception, match="components"):
        store.add_frames(spark.createDataFrame([(1, 9.0, 0, [1.0])], FRAMES))
    with pytest.raises(ValueError, match="components"):
        Store(spark, str(tmp_path / "s"), dim=7)
    store.reset()
    assert store.videos().count() == 0


def test_engine_indexes_scans_and_finds(spark, tmp_path):
    rng = np.random.default_rng(8)
    v, base = rng.standard_normal(32), []
    for _ in range(80):
        v = 0.95 * v + 0.31 * rng.standard_normal(32)
        base.append(v / np.linalg.norm(v))
    other = rng.standard_normal((80, 32))
    content = {"/v/a.mp4": base, "/v/b.mp4": base, "/v/c.mp4": other / np.linalg.norm(other, axis=1, keepdims=True), "/v/bad.mp4": None}

    def frames_of(rows):
        out = []
        for r in rows.collect():
            vs = content[r["path"]]
            out += [(r["video_id"], None, 0, None)] if vs is None else [(r["video_id"], i / 2, 0, [float(x) for x in e]) for i, e in enumerate(vs)]
        return spark.createDataFrame(out, FRAMES)

    engine = Engine(spark, str(tmp_path / "e"), Settings(ransac_iters=500))
    with pytest.raises(LookupError):
        engine.find(spark.createDataFrame([], "frame_id bigint, " + FRAMES), "/q")
    incoming = spark.createDataFrame([(p, p, 40.0, 10, 10) for p in content], VIDEO)
    status = {r["path"]: r["status"] for r in engine.index(incoming, frames_of).collect()}
    assert status == {"/v/a.mp4": "complete", "/v/b.mp4": "complete", "/v/c.mp4": "complete", "/v/bad.mp4": "failed"}
    pairs = {(r["a_path"], r["b_path"]) for r in engine.scan().collect()}
    assert pairs == {("/v/a.mp4", "/v/b.mp4")} == {(r["a_path"], r["b_path"]) for r in engine.scan(robust=True).collect()}
    query = engine.store.frames().filter("video_id = 1").select("frame_id", "video_id", "ts", "mirrored", "embedding")
    assert {r["b_path"] for r in engine.find(query, "/q").collect()} == {"/v/a.mp4", "/v/b.mp4"}
    assert engine.weights().count() == 240 == engine.weights().count()
    assert {r["path"]: r["frames"] for r in engine.status().collect()}["/v/a.mp4"] == 80
    # complete videos are skipped, failed ones tried again
    assert {r["path"] for r in engine.index(incoming, frames_of).collect()} == {"/v/bad.mp4"}


def test_discovery_and_digests(spark, tmp_path):
    (tmp_path / "d" / "x").mkdir(parents=True)
    for name, data in (("a.MP4", b"1"), ("x/b.mkv", b"22"), ("x/c.txt", b"3")):
        (tmp_path / "d" / name).write_bytes(data)
    found = files.discover(spark, [str(tmp_path / "d")])
    assert [r["path"].rsplit("/", 1)[1] for r in found.collect()] == ["a.MP4", "b.mkv"]
    import hashlib

    got = {r["path"][-5:]: (r["sha1"], r["error"]) for r in files.fingerprints(found.unionByName(spark.createDataFrame([("/no/such.mp4",)], "path string"), allowMissingColumns=True)).collect()}
    assert got["b.mkv"] == (hashlib.sha1(b"22").hexdigest(), None) and got["h.mp4"][0] is None and got["h.mp4"][1]


def test_probe_reports(spark):
    ok = '{"streams":[{"codec_type":"audio"},{"codec_type":"video","width":640,"height":360,"avg_frame_rate":"30000/1001"}],"format":{"duration":"12.5"}}'
    rows = {r["path"]: r for r in files.probed(spark.createDataFrame([("a", ok), ("b", '{"streams":[]}'), ("c", ok.replace("/1001", "/0"))], "path string, report string")).collect()}
    assert rows["a"]["duration"] == 12.5 and rows["a"]["fps"] == pytest.approx(29.97, abs=0.01) and rows["a"]["width"] == 640
    assert rows["b"]["error"] and rows["b"]["duration"] is None and rows["c"]["fps"] == 0.0


def test_drawn_footage_and_embedding(spark):
    drawn = frames.drawn(spark, videos=2, seconds=10, fps=2, size=8)
    assert drawn.count() == 36 and drawn.filter("ts = 0").count() == 0  # flat frames go, times stay
    keys = frames.drawn(spark, videos=1, seconds=10, fps=2, size=8, mode="keyframes")
    assert sorted(r["ts"] for r in keys.collect()) == [2.0, 4.0, 6.0, 8.0]
    out = frames.embedded(drawn, lambda: frames.ProjectionExtractor(8, 16), 8, batch=5)
    assert out.count() == 72 and out.groupBy("mirrored").count().count() == 2
    assert out.select(F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 4).alias("n")).distinct().collect()[0]["n"] == 1.0


def test_text_frames_find_copied_documents(spark):
    from echotrace.plans import search

    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(3000)]
    text = lambda: " ".join(rng.choice(words, 900))
    a = text()
    docs = spark.createDataFrame([(0, a), (1, a), (2, text()), (3, None), (4, "one")], "doc_id bigint, text string")
    tf = frames.text_frames(docs)
    assert {r["video_id"] for r in tf.select("video_id").distinct().collect()} == {0, 1, 2}
    rows = search.smooth_segments(tf, Settings()).collect()
    assert [(r["a"], r["b"]) for r in rows] == [(0, 1)]
