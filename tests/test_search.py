import json

import duckdb
import numpy as np
import pytest

from echotrace.config import Settings
from echotrace.operators import extent, hough, knn, lines, voting, weights
from echotrace.plans import report, search
from echotrace.queries import LINES, S

RNG = np.random.default_rng(4)
SCHEMA = "frame_id bigint, video_id int, ts double, mirrored int, embedding array<double>"


def walk(n, dim=64, keep=0.95, rng=RNG):
    """Unit vectors that change slowly."""
    v, out = rng.standard_normal(dim), []
    for _ in range(n):
        v = keep * v + np.sqrt(1 - keep**2) * rng.standard_normal(dim)
        out.append(v / np.linalg.norm(v))
    return np.array(out)


def rows_of(videos, step=0.5, mirrored=None):
    out, k = [], 0
    for vid, vectors in videos.items():
        for i, v in enumerate(vectors):
            out.append((k, vid, i * step, int((mirrored or {}).get(vid, 0)), [float(x) for x in v]))
            k += 1
    return out


@pytest.fixture(scope="module")
def planted(spark):
    a = walk(120)
    return spark.createDataFrame(rows_of({0: a, 1: a + 0.01 * RNG.standard_normal(a.shape), 2: walk(120), 3: walk(100)}), SCHEMA).persist()


def brute(rows, k):
    x = np.array([r[4] for r in rows])
    sims = np.round(x @ x.T, 6)
    return {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), -sims[i]))[:k]}


@pytest.mark.parametrize("block", [7, 50, 4096])
def test_topk_is_exact_in_any_blocks(spark, block):
    rows = rows_of({0: RNG.standard_normal((40, 8)), 1: RNG.standard_normal((35, 8))})
    rows += [(100 + i, 2, 0.0, 0, rows[0][4]) for i in range(5)]  # equal vectors: ties go to smaller ids
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["src"], r["tgt"]) for r in knn.topk(df, df, 6, block).collect()}
    assert got == brute(rows, 6)


def test_fewer_rows_than_k_and_none(spark):
    df = spark.createDataFrame(rows_of({0: RNG.standard_normal((5, 4))}), SCHEMA)
    assert knn.topk(df, df, 11).count() == 25
    assert knn.topk(df.filter("false"), df, 3).count() == 0 and knn.topk(df, df.filter("false"), 3).count() == 0


@pytest.mark.parametrize("n", [1, 15, 16, 17, 163, 2000])
@pytest.mark.parametrize("share", [None, 0.3, 1.0])
def test_best_rows_are_found_without_ordering_whole_rows(monkeypatch, n, share):
    """Ties, near ties, widths that no group divides, and barred pairs; only the groups' largest values are partitioned."""
    rng, k, seen = np.random.default_rng(n), 11, []
    partition = np.partition
    monkeypatch.setattr(np, "partition", lambda v, *a, **b: seen.append(v.size) or partition(v, *a, **b))
    for x in (rng.standard_normal((n, 8)), rng.integers(-1, 2, (n, 3)) * 1.0, 1 + 1e-6 * rng.standard_normal((n, 4))):
        y = np.concatenate([x[:20], rng.standard_normal((5, x.shape[1]))])
        barred = None if share is None else rng.random((len(y), n)) < share
        sims = np.round(np.einsum("id,jd->ijd", y, x).sum(axis=2), 6) + 0.0
        order = [[j for j in np.lexsort((np.arange(n), -sims[i])) if barred is None or not barred[i, j]][:k] for i in range(len(y))]
        row, col, found = knn.best(y, x, k, barred)
        assert [(i, j) for i, js in enumerate(order) for j in js] == list(zip(row.tolist(), col.tolist()))
        assert np.allclose(found, sims[row, col], atol=2e-6)
        assert not seen or max(seen) <= len(y) * -(-n // 8)


def test_excluding_the_own_video(spark):
    df = spark.createDataFrame(rows_of({0: RNG.standard_normal((6, 4)), 1: RNG.standard_normal((6, 4))}), SCHEMA)
    near = knn.located(knn.topk(df, df, 4, exclude_same_video=True), df)
    assert near.filter("sv = tv").count() == 0 and near.count() == 48


def test_mutual_drops_one_sided(spark):
    k = spark.createDataFrame([(0, 1, 0.9, 1), (1, 0, 0.9, 1), (1, 2, 0.5, 2), (3, 3, 1.0, 1)], "src bigint, tgt bigint, sim double, rank int")
    assert {(r["src"], r["tgt"]) for r in knn.mutual(k).collect()} == {(0, 1), (1, 0)}


def test_logo_frame_is_generic(spark):
    logo = RNG.standard_normal(16)
    df = spark.createDataFrame(rows_of({v: [logo + 1e-3 * RNG.standard_normal(16)] for v in range(10)}), SCHEMA)
    near = knn.foreign(knn.located(knn.topk(df, df, 11), df))
    assert knn.generic_frames(near, 8).count() == 10 and knn.generic_frames(near, 0).count() == 0
    assert knn.without_generic(near, knn.generic_frames(near, 8)).count() == 0


def test_redundancy_of_a_static_run(spark):
    v = RNG.standard_normal(16)
    v /= np.linalg.norm(v)
    df = spark.createDataFrame(rows_of({0: [v] * 9, 1: walk(5, 16)}), SCHEMA)
    for block in (2, 4096):
        rho = {r["frame_id"]: r["rho"] for r in weights.self_redundancy(df, 4.0, block).collect()}
        assert rho[0] == pytest.approx(9) and all(x >= 1 - 1e-9 for x in rho.values())


def test_even_sampling(spark):
    df = spark.createDataFrame(rows_of({0: RNG.standard_normal((53, 4)), 1: RNG.standard_normal((10, 4))}), SCHEMA)
    got = voting.sampled(df, 20).collect()
    assert sorted(r["ts"] * 2 for r in got if r["video_id"] == 0) == [j * 52 // 19 for j in range(20)]
    assert sorted(r["pos"] for r in got if r["video_id"] == 0) == list(range(20)) and sum(r["video_id"] == 1 for r in got) == 10


def test_array_votes_equal_relational_votes(spark, planted):
    s = Settings(max_frames=30, n_perm=4)
    pairs = spark.createDataFrame([(0, 1)], "a int, b int")
    samples = voting.sampled(planted, s.max_frames)
    cells = voting.cells(pairs, samples, s)
    shape = voting.geometry(pairs, samples, s)
    got = {(r["alpha_idx"], r["beta_idx"]): r["votes"] for r in voting.line_votes(cells, shape, s).collect()}
    a, b = ([r for r in samples.filter(f"video_id = {v}").orderBy("pos").collect()] for v in (0, 1))
    ta, tb = (np.array([r["ts"] for r in x]) for x in (a, b))
    w = np.clip(np.round(np.array([r["embedding"] for r in a]) @ np.array([r["embedding"] for r in b]).T, 6), 0, 1) ** 4
    g = shape.first()
    want = {}
    for k, alpha in enumerate(s.alphas()):
        at = np.floor((tb[None] - alpha * ta[:, None] - g["beta_min"]) / g["step"]).astype(int)
        for q in np.unique(at[(at >= 0) & (at < g["n_beta"])]):
            want[k, int(q)] = w[at == q].sum()
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    null = voting.null_votes(cells, voting.permuted(pairs, samples, s.n_perm), shape, s)
    relation = voting.significance(voting.line_votes(cells, shape, s), null, shape, s).first()
    array = hough.tested_lines(pairs, samples, s).first()
    assert all(array[c] == pytest.approx(relation[c], abs=1e-6) for c in ("a", "b", *hough.TESTED))


def test_array_deals_are_those_of_the_relation(spark, planted):
    samples = voting.sampled(planted, 12)
    rows = voting.permuted(spark.createDataFrame([(0, 1)], "a int, b int"), samples, 3).orderBy("perm", "j").collect()
    ts = {r["pos"]: r["ts"] for r in samples.filter("video_id = 1").collect()}
    assert [r["tb"] for r in rows] == [ts[p] for trial in hough.deals(0, 1, len(ts), 3) for p in trial]


def test_planted_copy_is_found_and_others_are_not(spark, planted):
    rows = search.smooth_segments(planted, Settings()).collect()
    assert [(r["a"], r["b"]) for r in rows] == [(0, 1)]
    r = rows[0]
    assert r["z_score"] > 6 and r["pvalue"] == pytest.approx(1 / 51) and r["speed_ratio"] == pytest.approx(0.9875) and not r["mirrored"]
    assert r["a_start"] <= 1 and r["a_end"] - r["a_start"] > 30


def test_refined_slope_reaches_one(spark, planted):
    r = search.smooth_segments(planted, Settings(refine_slope=True)).first()
    plain = search.smooth_segments(planted, Settings()).first()
    assert abs(r["speed_ratio"] - 1) <= abs(plain["speed_ratio"] - 1) + 0.002 and r["a_end"] - r["a_start"] > 30


def test_relational_search_agrees(spark, planted):
    s = Settings(max_frames=60, n_perm=50)
    pairs, samples = spark.createDataFrame([(0, 1)], "a int, b int"), voting.sampled(planted, s.max_frames)
    got = search.gated_segments(pairs, samples, s).collect()
    assert [(r["a"], r["b"]) for r in got] == [(0, 1)] and got[0]["speed_ratio"] == pytest.approx(0.9875)


def test_robust_search_two_segments_and_mirror(spark):
    a, b = walk(200), walk(200)
    b[20:70], b[120:180] = a[100:150], a[10:70]
    df = spark.createDataFrame(rows_of({0: a, 1: b, 2: walk(150)}, mirrored={1: 1}), SCHEMA)
    rows = search.robust_segments(df, Settings(ransac_iters=2000)).filter("a = 0 AND b = 1").orderBy("nth").collect()
    assert len(rows) >= 2 and all(r["mirrored"] for r in rows) and all(abs(r["speed_ratio"] - 1) < 0.1 for r in rows[:2])
    for lo, hi in ((10, 25), (55, 70)):  # both planted ranges, in seconds of a
        assert any(min(r["a_end"], hi) - max(r["a_start"], lo) > 10 for r in rows)
    assert rows[0]["score"] * (rows[0]["a_end"] - rows[0]["a_start"]) >= rows[1]["score"] * (rows[1]["a_end"] - rows[1]["a_start"])


def test_find_sees_own_footage(spark, planted):
    rows = search.find_segments(planted.filter("video_id = 0"), planted, Settings(ransac_iters=2000)).collect()
    assert {r["b"] for r in rows} >= {0, 1} and all(r["a"] == -1 for r in rows)


def test_consensus_and_peeling():
    t = np.arange(0, 30, 0.5)
    points = np.stack([t, 1.25 * t + 30], axis=1).astype(np.float32)
    noise = RNG.uniform(0, 60, (15, 2)).astype(np.float32)
    s = Settings(ransac_iters=500)
    cloud = np.concatenate([points, noise])
    found = lines.peel(cloud, np.ones(len(cloud), np.float32), np.zeros(len(cloud), bool), s)
    assert found[0][4] == pytest.approx(1.25, abs=0.05) and found[0][6] >= 60
    assert lines.consensus(points[:3], 10, 1.0, 0.5, 2.0) is None
    short = points[:7] * np.float32(0.2)  # under four seconds: uses a round, gives nothing
    assert lines.peel(short, np.ones(7, np.float32), np.zeros(7, bool), s.with_(min_pair_matches=4)) == []


def cloud_rows(kind, rng):
    """Match clouds (a, b, ta, tb, sim, mirror) of three pairs; points stand more than once."""
    out = []
    for b, n in ((1, 90), (2, 60), (3, 3)):
        if kind == "grid":  # equal times, and distances of just the tolerance
            points = rng.integers(0, 24, (n, 2)) * 0.5
        elif kind == "level":  # every line holds every point
            points = np.stack((rng.permutation(n) * 0.5, rng.integers(0, 2, n) * 0.5 + 7), axis=1) * [0.02, 1]
        else:
            points = rng.integers(0, 400, (n, 2)) * (0.5 if kind == "sparse" else 0.123)
        points = np.concatenate([points, points[: n // 3], points[: n // 3]])
        out += [(0, b, float(x), float(y), 0.5, int(x) % 2) for x, y in points]
    return out


CLOUD_SCHEMA = "a int, b int, ta double, tb double, sim double, mirror int"


@pytest.mark.parametrize("cell", [1 << 24, 500])
@pytest.mark.parametrize("kind", ["grid", "level", "sparse", "odd"])
def test_exhaustive_lines_are_those_of_sql(spark, monkeypatch, kind, cell):
    monkeypatch.setattr(lines, "CELL", cell)
    monkeypatch.setattr(lines, "LEAST_ANCHORS", 5)
    rows = cloud_rows(kind, np.random.default_rng(11))
    con = duckdb.connect()
    con.execute("CREATE TABLE cloud (a INTEGER, b INTEGER, ta DOUBLE, tb DOUBLE, sim DOUBLE, mirror INTEGER)")
    con.executemany("INSERT INTO cloud VALUES (?, ?, ?, ?, ?, ?)", rows)
    want = con.execute(f"WITH {LINES} SELECT a, b, alpha, beta + 0.0, inliers FROM fit ORDER BY a, b").fetchall()
    found = lines.exhaustive_lines(spark.createDataFrame(rows, CLOUD_SCHEMA), S)
    assert sorted(tuple(r) for r in found.collect()) == want and want


@pytest.fixture(scope="module")
def large_pair():
    """4,000 points, millions of lines, 200 points on one of them."""
    rng = np.random.default_rng(12)
    noise, x = rng.integers(0, 5000, (3800, 2)) * 0.5, rng.choice(np.arange(0, 1500), 200, replace=False) * 1.0
    return [(0, 1, float(a), float(b), 0.5, 0) for a, b in np.concatenate([noise, np.stack((x, 1.25 * x + 40), axis=1)])]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_summary_of_a_large_pair(spark, large_pair):
    """The points are joined with the best line only, not with all lines."""
    cloud = spark.createDataFrame(large_pair, CLOUD_SCHEMA)
    found = lines.segment_summary(cloud, lines.exhaustive_lines(cloud, S), S)
    assert plan_of(found).count("Join") == 1
    (r,) = found.collect()
    (line,) = lines.exhaustive_lines(cloud, S).collect()
    points = np.array([x[2:4] for x in large_pair])
    on = points[np.round(np.abs(points[:, 1] - (line.alpha * points[:, 0] + line.beta)), 6) <= S.ransac_tol]
    assert r.inliers == line.inliers == len(on) >= 200 and r.speed_ratio == line.alpha and not r.mirrored
    assert (r.a_start, r.b_start) == tuple(on.min(axis=0)) and (r.a_end, r.b_end) == tuple(on.max(axis=0))


def test_exhaustive_lines_of_a_large_pair(spark, large_pair):
    """No table of lines is made and joined with the points."""
    found = lines.exhaustive_lines(spark.createDataFrame(large_pair, CLOUD_SCHEMA), S)
    assert "Join" not in plan_of(found)
    ((_, _, alpha, beta, inliers),) = found.collect()
    points = np.array([r[2:4] for r in large_pair])
    assert inliers == (np.round(np.abs(points[:, 1] - (alpha * points[:, 0] + beta)), 6) <= S.ransac_tol).sum()
    assert inliers >= max((np.abs(points[:, 1] - (1.25 * points[:, 0] + o)) <= S.ransac_tol).sum() for o in np.unique(points[-200:, 1] - 1.25 * points[-200:, 0])) and abs(alpha - 1.25) < 0.01


def test_small_or_empty_matrices():
    s = Settings()
    assert hough.tested(0, 1, np.arange(3.0), np.arange(9.0), np.ones((3, 9)), s) is None
    assert hough.tested(0, 1, np.arange(9.0), np.arange(9.0), np.zeros((9, 9)), s) is None
    assert hough.follow(np.arange(9.0), np.arange(9.0) + 100, np.ones((9, 9)), 1.0, 0.0, 1.0, 0.5) is None


def test_extent_ties_take_the_lower_index(spark):
    cells = spark.createDataFrame([(0, 1, i, j, float(i), float(i) + (j - 0.5), 0.9 if j else 0.8, 1.0) for i in range(6) for j in range(2)], "a int, b int, i bigint, j bigint, ta double, tb double, sim double, w double")
    near = extent.nearest_in_time(cells, spark.createDataFrame([(0, 1, 1.0, 0.0)], "a int, b int, alpha double, beta double"), 1.0)
    assert {r["sim"] for r in near.collect()} == {0.8}


def test_reports(spark, planted):
    found = report.with_paths(report.ranked(search.smooth_segments(planted, Settings())), spark.createDataFrame([(0, "/v/ä.mp4")], "video_id int, path string"))
    data = json.loads(report.to_json(found))
    assert data[0]["a"] == {"id": 0, "path": "/v/ä.mp4"} and data[0]["b"]["path"] == "?" and set(data[0]["segments"][0]) == {"a_range", "b_range", "speed_ratio", "mirrored", "score", "inliers", "pvalue", "z_score", "weighted_support"}
    assert "ä.mp4 <-> ?" in report.render(found.collect()) and report.render([]) == "Nothing in common."
    listed = report.ordered_segments(found.drop("z")).first()
    assert len(listed["segments"]) == 1
    robust = found.drop("pvalue", "z_score", "weighted_support")
    assert json.loads(report.to_json(robust))[0]["segments"][0]["pvalue"] is None
