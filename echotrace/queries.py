"""One query for each operator over the shared test tables, with the SQL that states its result.

``embeddings`` stand for frames: label is the video, half a second apart in the order of
vec_id, every second one mirrored.  They are unstructured, so thresholds are low here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import Settings
from .functions import scalar
from .operators import extent, hough, ingest, knn, lines, voting, weights
from .plans import report, search

S = Settings(min_match_sim=0.2, min_pair_matches=10, generic_max_videos=6, min_kmatches=5, max_frames=40, n_perm=20, idf_k=10, ransac_tol=2.0, min_zscore=2.0, max_pvalue=0.5, min_tube_sim=0.0, min_segment_score=0.1, min_inlier_density=0.3)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


# views

def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), F.col("label").alias("video_id"), (nth * 0.5).alias("ts"), (F.col("vec_id") % 2).cast("int").alias("mirrored"), "embedding")


def videos(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").groupBy(F.col("label").alias("video_id")).agg((F.count("*") * 0.5).alias("duration"))
    status = F.element_at(F.array(*[F.lit(x) for x in ("complete", "rejected", "failed", "pending")]), F.col("video_id") % 4 + 1)
    return rows.select("video_id", F.concat(F.lit("/v/"), F.col("video_id").cast("string"), F.lit(".mp4")).alias("path"), F.sha1(F.col("video_id").cast("string").cast("binary")).alias("sha1"), "duration", status.alias("status"))


def near(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    f = frames(spark, sf)
    return f, knn.located(knn.self_topk(f, S), f)


_held: list[DataFrame] = []


def held(*tables: DataFrame) -> tuple[DataFrame, ...]:
    """The tables, kept for the branches of one query that read them; what an earlier query kept is let go."""
    while _held:
        _held.pop().unpersist()
    _held.extend(t.persist() for t in tables)
    return tables


def parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(frames, candidate pairs, samples, cells)."""
    f, n = near(spark, sf)
    pairs, samples = held(knn.candidate_pairs(knn.foreign(n), S.min_kmatches), voting.sampled(f, S.max_frames))
    return f, pairs, samples, voting.cells(pairs, samples, S)


R = scalar.round6


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: R(F.col(n)) + F.lit(0.0) for n in names})


# their SQL

FRAMES = "frames AS (SELECT vec_id AS frame_id, label AS video_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 0.5::DOUBLE AS ts, CAST(vec_id % 2 AS INTEGER) AS mirrored, embedding::DOUBLE[] AS e FROM embeddings)"


def knn_sql(k: int = 11, name: str = "knn") -> str:
    return f"""{name} AS (SELECT src, tgt, sim, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, tgt) AS rank FROM (
    SELECT q.frame_id AS src, t.frame_id AS tgt, round(list_inner_product(q.e, t.e), 6) + 0.0 AS sim FROM frames q, frames t)) WHERE rank <= {k})"""


NEAR = "near AS (SELECT k.*, s.video_id AS sv, s.ts AS sts, s.mirrored AS sm, t.video_id AS tv, t.ts AS tts, t.mirrored AS tm FROM knn k JOIN frames s ON k.src = s.frame_id JOIN frames t ON k.tgt = t.frame_id)"
FK = "fk AS (SELECT * FROM near WHERE src <> tgt AND sv <> tv)"
BASE = f"WITH {FRAMES}, {knn_sql()}, {NEAR}, {FK}"
PAIRS = f"pairs AS (SELECT least(sv, tv) AS a, greatest(sv, tv) AS b, count(*) AS n_matches FROM fk GROUP BY 1, 2 HAVING count(*) >= {S.min_kmatches})"
GENERIC = f"generic AS (SELECT src, count(DISTINCT tv) AS n_videos FROM fk GROUP BY src HAVING count(DISTINCT tv) > {S.generic_max_videos})"
CLEAN = "clean AS (SELECT * FROM fk WHERE src NOT IN (SELECT src FROM generic) AND tgt NOT IN (SELECT src FROM generic))"
MUTUAL = "mut AS (SELECT k.* FROM knn k JOIN knn r ON k.src = r.tgt AND k.tgt = r.src WHERE k.src <> k.tgt)"
CLOUD = f"""cloud AS (SELECT least(sv, tv) AS a, greatest(sv, tv) AS b, CASE WHEN sv < tv THEN sts ELSE tts END AS ta, CASE WHEN sv < tv THEN tts ELSE sts END AS tb, sim, xor(sm, tm) AS mirror
  FROM clean WHERE (src, tgt) IN (SELECT (src, tgt) FROM mut) AND sim >= {S.min_match_sim})"""
CLOUDS = f"{BASE}, {GENERIC}, {CLEAN}, {MUTUAL}, {CLOUD}"
C = S.max_frames
SAMPLES = f"""samples AS (SELECT * FROM (SELECT frame_id, video_id, ts, mirrored, e, CASE WHEN n <= {C} THEN rn WHEN CAST(floor(j * (n - 1) / {C - 1}) AS BIGINT) = rn THEN j END AS pos
  FROM (SELECT *, CAST(ceil(rn * {C - 1} / greatest(n - 1, 1)) AS BIGINT) AS j FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY mirrored, ts, frame_id) - 1 AS rn, count(*) OVER (PARTITION BY video_id) AS n FROM frames)))
  WHERE pos IS NOT NULL)"""
CELLS = f"""cells AS (SELECT *, pow(least(greatest(sim, 0.0), 1.0), {S.smooth_p}::DOUBLE) AS w FROM (
  SELECT p.a, p.b, x.pos AS i, y.pos AS j, x.ts AS ta, y.ts AS tb, round(least(greatest(list_inner_product(x.e, y.e), 0.0), 1.0), 6) AS sim
  FROM pairs p JOIN samples x ON x.video_id = p.a JOIN samples y ON y.video_id = p.b))"""
SHAPE = f"""shape AS (SELECT a, b, beta_min, span / n_beta AS step, n_beta FROM (SELECT *, CAST(greatest(20, floor(greatest(span, {4 * S.tau}::DOUBLE) / {S.tau}::DOUBLE)) AS BIGINT) AS n_beta FROM (
  SELECT *, b_hi + {S.tau}::DOUBLE - beta_min AS span FROM (SELECT p.a, p.b, y.lo - 1.0::DOUBLE * x.hi - {S.tau}::DOUBLE AS beta_min, y.hi AS b_hi
  FROM pairs p JOIN ends x ON x.video_id = p.a JOIN ends y ON y.video_id = p.b))))"""
ENDS = "ends AS (SELECT video_id, min(ts) AS lo, max(ts) AS hi FROM samples GROUP BY video_id HAVING count(*) >= 4)"
GRID = f"grid AS (SELECT CAST(i - 1 AS INTEGER) AS alpha_idx, g[i] AS alpha FROM (SELECT [{', '.join(f'{x!r}::DOUBLE' for x in S.alphas())}] AS g, unnest(range(1, {S.n_alpha + 1})) AS i))"
MATRIX = f"{BASE}, {PAIRS}, {SAMPLES}, {CELLS}, {ENDS}, {SHAPE}, {GRID}"


def votes_sql(name: str, cells: str, keys: str) -> str:
    return f"""{name} AS (SELECT {keys}, alpha_idx, beta_idx, sum(w) AS votes FROM (SELECT c.*, alpha_idx, n_beta, CAST(floor((tb - alpha * ta - beta_min) / step) AS BIGINT) AS beta_idx
  FROM {cells} c JOIN shape USING (a, b), grid) WHERE beta_idx >= 0 AND beta_idx < n_beta GROUP BY {keys}, alpha_idx, beta_idx)"""


VOTES = votes_sql("votes", "cells", "a, b")
PERMUTED = f"""perms AS (SELECT a, b, perm, row_number() OVER (PARTITION BY a, b, perm ORDER BY md5(concat_ws('|', ((a::BIGINT + 1) * {0x7F4A7C15} + b) & {0xFFFFFFFF}, perm, pos)), pos) - 1 AS j, ts AS tb
  FROM pairs p JOIN samples y ON y.video_id = p.b, (SELECT unnest(range(0, {S.n_perm})) AS perm))"""
NULLS = "shuffled AS (SELECT c.a, c.b, q.perm, c.i, c.j, c.ta, q.tb, c.w FROM cells c JOIN perms q ON c.a = q.a AND c.b = q.b AND c.j = q.j), " + votes_sql("nulls", "shuffled", "a, b, perm")
N = float(S.n_perm)
STATS = f"""bins AS (SELECT a, b, alpha_idx, beta_idx, sum(votes) AS s, sum(votes * votes) AS s2 FROM nulls GROUP BY 1, 2, 3, 4),
pooled AS (SELECT a, b, sqrt(greatest(v, 0.0) / ({S.n_alpha} * n_beta) + 1e-12) AS pooled_std FROM (SELECT a, b, sum((s2 - s * s / {N}) / ({N} - 1)) AS v FROM bins GROUP BY a, b) JOIN shape USING (a, b))"""
TESTED = f"""zreal AS (SELECT v.*, (v.votes - coalesce(m.s / {N}, 0.0)) / pooled_std AS z FROM votes v LEFT JOIN bins m USING (a, b, alpha_idx, beta_idx) JOIN pooled USING (a, b)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY round(z, 6) DESC, alpha_idx, beta_idx) AS o FROM zreal) WHERE o = 1),
tops AS (SELECT v.a, v.b, v.perm, max((v.votes - m.s / {N}) / pooled_std) AS z FROM nulls v JOIN bins m USING (a, b, alpha_idx, beta_idx) JOIN pooled USING (a, b) GROUP BY 1, 2, 3),
tested AS (SELECT r.a, r.b, {S.slope_min} + (r.alpha_idx + 0.5) * {(S.slope_max - S.slope_min) / S.n_alpha!r}::DOUBLE AS alpha, beta_min + (r.beta_idx + 0.5) * step AS beta, r.votes AS support, r.z AS z_score, (r.reach + 1.0::DOUBLE) / {N + 1}::DOUBLE AS pvalue, r.null_max
  FROM (SELECT b.a, b.b, b.alpha_idx, b.beta_idx, b.votes, b.z, sum(CASE WHEN t.z >= b.z THEN 1 ELSE 0 END) AS reach, max(t.z) AS null_max FROM best b JOIN tops t ON b.a = t.a AND b.b = t.b GROUP BY ALL) r JOIN shape h ON r.a = h.a AND r.b = h.b)"""
ALL = f"{MATRIX}, {VOTES}, {PERMUTED}, {NULLS}, {STATS}, {TESTED}"
ALONG = f"""along AS (SELECT a, b, i, ta, arg_min({{'tb': tb, 'sim': sim}}, {{'off': off, 'j': j}}) AS x FROM (SELECT c.*, abs(c.tb - (l.alpha * c.ta + l.beta)) AS off FROM cells c JOIN tested l ON c.a = l.a AND c.b = l.b) WHERE off <= {S.tau} GROUP BY a, b, i, ta),
mid AS (SELECT a, b, quantile_cont(x.sim, 0.5) AS median FROM along GROUP BY a, b HAVING count(*) >= 4),
ext AS (SELECT p.a, p.b, min(ta) AS a_start, max(ta) AS a_end, min(x.tb) AS b_start, max(x.tb) AS b_end, avg(x.sim) AS mean_sim, count(*) AS n_supporting FROM along p JOIN mid m ON p.a = m.a AND p.b = m.b WHERE x.sim >= greatest(median, {S.min_tube_sim}) GROUP BY p.a, p.b HAVING count(*) >= 4)"""
GATES = f"""seg AS (SELECT a, b, a_start, a_end, b_start, b_end, alpha AS speed_ratio, false AS mirrored, CAST(n_supporting AS INTEGER) AS inliers, mean_sim AS score, pvalue, support AS weighted_support, z_score FROM (
  SELECT *, greatest(a_end - a_start, b_end - b_start) AS span FROM tested JOIN ext USING (a, b) WHERE z_score >= {S.min_zscore} AND pvalue <= {S.max_pvalue})
  WHERE span >= {S.min_segment_seconds} AND mean_sim >= {S.min_segment_score} AND n_supporting / greatest(span, 1.0) >= {S.min_inlier_density})"""
VIDEOS = """videos AS (SELECT label AS video_id, '/v/' || label || '.mp4' AS path, sha1(CAST(label AS VARCHAR)) AS sha1, count(*) * 0.5::DOUBLE AS duration, (['complete', 'rejected', 'failed', 'pending'])[label % 4 + 1] AS status FROM embeddings GROUP BY label)"""
LINES = f"""two AS (SELECT DISTINCT p.a, p.b, round((q.tb - p.tb) / (q.ta - p.ta), 6) AS alpha, p.ta, p.tb FROM cloud p JOIN cloud q ON p.a = q.a AND p.b = q.b WHERE q.ta - p.ta >= 1e-3),
cand AS (SELECT DISTINCT a, b, alpha, round(tb - alpha * ta, 6) AS beta FROM two WHERE alpha BETWEEN {S.slope_min} AND {S.slope_max}),
counted AS (SELECT l.a, l.b, l.alpha, l.beta, count(*) AS inliers FROM cand l JOIN cloud p ON l.a = p.a AND l.b = p.b WHERE round(abs(p.tb - (l.alpha * p.ta + l.beta)), 6) <= {S.ransac_tol} GROUP BY ALL),
fit AS (SELECT a, b, alpha, beta, inliers FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY inliers DESC, alpha, beta) AS o FROM counted) WHERE o = 1 AND inliers >= 4)"""


# neighbours

@query("j1_exact_topk", f"WITH {FRAMES}, {knn_sql()} SELECT * FROM knn")
def j1(spark, sf):
    return knn.self_topk(frames(spark, sf), S)


@query("j2_query_topk", f"WITH {FRAMES}, k AS (SELECT q.frame_id AS src, t.frame_id AS tgt, round(list_inner_product(q.e, t.e), 6) + 0.0 AS sim FROM frames q, frames t WHERE q.mirrored = 1) SELECT src, tgt, sim, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, tgt) AS rank FROM k) WHERE rank <= 10")
def j2(spark, sf):
    f = frames(spark, sf)
    return knn.topk(f.filter("mirrored = 1"), f, S.knn, S.block_rows)


@query("j3_located_neighbours", f"{BASE} SELECT src, tgt, sim, rank, sv, sts, sm, tv, tts, tm FROM near")
def j3(spark, sf):
    return near(spark, sf)[1].select("src", "tgt", "sim", "rank", "sv", "sts", "sm", "tv", "tts", "tm")


@query("p3_foreign_neighbours", f"{BASE} SELECT src, tgt, sim, sv, tv FROM fk")
def p3(spark, sf):
    return knn.foreign(near(spark, sf)[1]).select("src", "tgt", "sim", "sv", "tv")


@query("a1_candidate_pairs", f"{BASE}, {PAIRS} SELECT * FROM pairs")
def a1(spark, sf):
    return knn.candidate_pairs(knn.foreign(near(spark, sf)[1]), S.min_kmatches)


@query("j10_pairs_with_paths", f"{BASE}, {PAIRS}, {VIDEOS} SELECT a, b, n_matches, coalesce(x.path, '?') AS a_path, coalesce(y.path, '?') AS b_path FROM pairs LEFT JOIN (SELECT * FROM videos WHERE status <> 'failed') x ON x.video_id = a LEFT JOIN (SELECT * FROM videos WHERE status <> 'failed') y ON y.video_id = b ORDER BY n_matches DESC, a, b")
def j10(spark, sf):
    return report.with_paths(a1(spark, sf), videos(spark, sf).filter("status <> 'failed'")).orderBy(F.desc("n_matches"), "a", "b")


@query("j4_mutual_knn", f"WITH {FRAMES}, {knn_sql()}, {MUTUAL} SELECT src, tgt, sim, rank FROM mut")
def j4(spark, sf):
    return knn.mutual(knn.self_topk(frames(spark, sf), S)).select("src", "tgt", "sim", "rank")


@query("a2_generic_frames", f"{BASE}, {GENERIC} SELECT * FROM generic")
def a2(spark, sf):
    return knn.generic_frames(knn.foreign(near(spark, sf)[1]), S.generic_max_videos)


@query("j5_generic_exclusion", f"{BASE}, {GENERIC}, {CLEAN} SELECT src, tgt, sim FROM clean")
def j5(spark, sf):
    fk = knn.foreign(near(spark, sf)[1])
    return knn.without_generic(fk, knn.generic_frames(fk, S.generic_max_videos)).select("src", "tgt", "sim")


@query("a10_match_cloud", f"{CLOUDS} SELECT a, b, ta, tb, sim, mirror FROM cloud")
def a10(spark, sf):
    return search.cloud(frames(spark, sf), S).select("a", "b", "ta", "tb", "sim", "mirror")


@query("p5_pair_having", f"{CLOUDS} SELECT a, b, count(*) AS n_points FROM cloud GROUP BY a, b HAVING count(*) >= {S.min_pair_matches}")
def p5(spark, sf):
    return knn.crowded(a10(spark, sf), S.min_pair_matches)


@query("f11_mirror_xor", f"{BASE} SELECT xor(sm, tm) AS mirror, count(*) AS n FROM fk GROUP BY 1")
def f11(spark, sf):
    return knn.foreign(near(spark, sf)[1]).groupBy(scalar.xor("sm", "tm").alias("mirror")).agg(F.count("*").alias("n"))


# weights

@query("a3_self_redundancy", f"WITH {FRAMES} SELECT x.frame_id, round(sum(pow(least(greatest(list_inner_product(x.e, y.e), 0.0), 1.0), 4.0)), 6) AS rho FROM frames x JOIN frames y ON x.video_id = y.video_id GROUP BY x.frame_id")
def a3(spark, sf):
    return rounded(weights.self_redundancy(frames(spark, sf), S.smooth_p), "rho")


DF = f"df AS (SELECT f.frame_id, coalesce(d.df, 0.0) AS df FROM frames f LEFT JOIN (SELECT src, sum(best) AS df FROM (SELECT src, tv, max(pow(least(greatest(sim, 0.0), 1.0), {S.smooth_p}::DOUBLE)) AS best FROM near WHERE sv <> tv GROUP BY src, tv) GROUP BY src) d ON d.src = f.frame_id)"


@query("a4_doc_frequency", f"{BASE}, {DF} SELECT frame_id, round(df, 6) + 0.0 AS df FROM df")
def a4(spark, sf):
    f, n = near(spark, sf)
    return rounded(weights.document_frequency(f, n, S.smooth_p), "df")


@query("a5_idf", f"{BASE}, {DF} SELECT frame_id, round(ln(((SELECT count(DISTINCT video_id) FROM frames) + 1.0::DOUBLE) / (df + 1.0)), 6) AS idf FROM df")
def a5(spark, sf):
    f, n = near(spark, sf)
    return rounded(weights.inverse_frequency(weights.document_frequency(f, n, S.smooth_p), f.select("video_id").distinct().count()), "idf")


RHO = "rho AS (SELECT x.frame_id, sum(pow(least(greatest(list_inner_product(x.e, y.e), 0.0), 1.0), 4.0)) AS rho FROM frames x JOIN frames y ON x.video_id = y.video_id GROUP BY x.frame_id)"


@query("a17_weight_summary", f"{BASE}, {DF}, {RHO}, w AS (SELECT frame_id, rho, ln(((SELECT count(DISTINCT video_id) FROM frames) + 1.0::DOUBLE) / (df + 1.0)) AS idf FROM rho JOIN df USING (frame_id)) SELECT count(*) AS frames, round(quantile_cont(rho, 0.5), 6) AS rho_median, round(max(rho), 6) AS rho_max, round(quantile_cont(idf, 0.5), 6) AS idf_median, round(max(idf), 6) AS idf_max FROM w")
def a17(spark, sf):
    return rounded(weights.weight_summary(search.frame_weights(frames(spark, sf), S)), "rho_median", "rho_max", "idf_median", "idf_max")


# matrices and votes

@query("w2_even_downsample", f"WITH {FRAMES}, {SAMPLES} SELECT video_id, frame_id, pos FROM samples")
def w2(spark, sf):
    return voting.sampled(frames(spark, sf), S.max_frames).select("video_id", "frame_id", "pos")


@query("j7_weight_matrix", f"{BASE}, {PAIRS}, {SAMPLES}, {CELLS} SELECT a, b, i, j, ta, tb, sim, round(w, 6) AS w FROM cells")
def j7(spark, sf):
    return rounded(parts(spark, sf)[3], "w")


@query("f9_reweighted_matrix", f"{BASE}, {PAIRS}, {SAMPLES}, {DF}, {RHO}, wt AS (SELECT frame_id, rho, ln(((SELECT count(DISTINCT video_id) FROM frames) + 1.0::DOUBLE) / (df + 1.0)) AS idf FROM rho JOIN df USING (frame_id)), s2 AS (SELECT * FROM samples JOIN wt USING (frame_id)) SELECT p.a, p.b, x.pos AS i, y.pos AS j, round(pow(round(least(greatest(list_inner_product(x.e, y.e), 0.0), 1.0), 6), 4.0) * x.idf * y.idf / (x.rho * y.rho + 1e-6), 6) AS w FROM pairs p JOIN s2 x ON x.video_id = p.a JOIN s2 y ON y.video_id = p.b")
def f9(spark, sf):
    f, pairs, samples, _ = parts(spark, sf)
    s = S.with_(use_idf=True, use_rho=True)
    return rounded(voting.cells(pairs, samples, s, search.frame_weights(f, s)).select("a", "b", "i", "j", "w"), "w")


@query("a6_line_votes", f"{MATRIX}, {VOTES} SELECT a, b, alpha_idx, beta_idx, round(votes, 6) AS votes FROM votes")
def a6(spark, sf):
    _, pairs, samples, cells = parts(spark, sf)
    return rounded(voting.line_votes(cells, voting.geometry(pairs, samples, S), S), "votes")


@query("a8_vote_peak", f"{MATRIX}, {VOTES} SELECT a, b, alpha_idx, beta_idx, round(votes, 6) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY round(votes, 6) DESC, alpha_idx, beta_idx) AS o FROM votes) WHERE o = 1")
def a8(spark, sf):
    _, pairs, samples, cells = parts(spark, sf)
    return rounded(voting.peak(voting.line_votes(cells, voting.geometry(pairs, samples, S), S), "votes"), "votes")


def _null(spark, sf):
    _, pairs, samples, cells = parts(spark, sf)
    shape = voting.geometry(pairs, samples, S)
    return cells, shape, voting.null_votes(cells, voting.permuted(pairs, samples, S.n_perm), shape, S)


@query("w3_permuted_times", f"{BASE}, {PAIRS}, {SAMPLES}, {PERMUTED} SELECT a, b, CAST(perm AS INTEGER) AS perm, j, tb FROM perms")
def w3(spark, sf):
    _, pairs, samples, _ = parts(spark, sf)
    return voting.permuted(pairs, samples, S.n_perm)


@query("a7_null_stats", f"{MATRIX}, {PERMUTED}, {NULLS}, {STATS} SELECT a, b, round(pooled_std, 6) AS pooled_std FROM pooled")
def a7(spark, sf):
    _, shape, null = _null(spark, sf)
    return rounded(voting.null_stats(null, shape, S)[1], "pooled_std")


def _tested(spark, sf):
    _, pairs, samples, cells = parts(spark, sf)
    return cells, hough.tested_lines(pairs, samples, S)


@query("a9_perm_pvalue", f"{ALL} SELECT a, b, round(alpha, 6) AS alpha, round(beta, 6) + 0.0 AS beta, round(support, 6) AS support, round(z_score, 6) AS z_score, round(pvalue, 6) AS pvalue, round(null_max, 6) AS null_max FROM tested")
def a9(spark, sf):
    return rounded(_tested(spark, sf)[1], "alpha", "beta", "support", "z_score", "pvalue", "null_max")


@query("j9_nearest_in_time", f"{ALL}, {ALONG} SELECT a, b, i, ta, x.tb AS tb, x.sim AS sim FROM along")
def j9(spark, sf):
    cells, tested = _tested(spark, sf)
    return extent.nearest_in_time(cells, tested, S.tau)


@query("m4_extent", f"{ALL}, {ALONG} SELECT a, b, a_start, a_end, b_start, b_end, round(mean_sim * n_supporting, 6) AS sim_sum, n_supporting FROM ext")
def m4(spark, sf):
    cells, tested = _tested(spark, sf)
    found = extent.extent(extent.nearest_in_time(cells, tested, S.tau), S.min_tube_sim)
    return rounded(found.withColumn("sim_sum", F.col("mean_sim") * F.col("n_supporting")).drop("mean_sim"), "sim_sum")


SEG = "a, b, a_start, a_end, b_start, b_end, round(speed_ratio, 6) AS speed_ratio, mirrored, inliers, round(score, 4) AS score, round(pvalue, 6) AS pvalue, round(weighted_support, 6) AS weighted_support, round(z_score, 6) AS z_score"
SEG_ROUNDED = ("speed_ratio", "pvalue", "weighted_support", "z_score")


@query("p9_segment_gates", f"{ALL}, {ALONG}, {GATES} SELECT {SEG} FROM seg")
def p9(spark, sf):
    _, pairs, samples, _ = parts(spark, sf)
    return rounded(search.gated_segments(pairs, samples, S), *SEG_ROUNDED).withColumn("score", F.round("score", 4))


@query("t4_ranked_pairs", f"{ALL}, {ALONG}, {GATES} SELECT a, b, CAST(row_number() OVER (ORDER BY round(z_score, 6) DESC, a_end - a_start DESC, a, b) AS INTEGER) AS rank, round(z_score, 6) AS z_score FROM seg")
def t4(spark, sf):
    return report.ranked(p9(spark, sf)).select("a", "b", "rank", "z_score")


@query("k12_json_export", f"""{ALL}, {ALONG}, {GATES}, {VIDEOS}, j AS (SELECT {SEG} FROM seg)
SELECT j.a, j.b, to_json({{'a': {{'id': j.a, 'path': x.path}}, 'b': {{'id': j.b, 'path': y.path}}, 'segments': [{{'a_range': [a_start, a_end], 'b_range': [b_start, b_end], 'speed_ratio': speed_ratio, 'mirrored': mirrored, 'score': score, 'inliers': inliers, 'pvalue': pvalue, 'z_score': z_score, 'weighted_support': weighted_support}}]}})::VARCHAR AS json
FROM j JOIN videos x ON x.video_id = j.a JOIN videos y ON y.video_id = j.b""")
def k12(spark, sf):
    return report.json_rows(report.with_paths(p9(spark, sf), videos(spark, sf)))


# robust lines

@query("x1_exhaustive_line", f"{CLOUDS}, {LINES} SELECT * FROM fit")
def x1(spark, sf):
    return lines.exhaustive_lines(search.cloud(frames(spark, sf), S), S)


@query("a11_segment_summary", f"{CLOUDS}, {LINES} SELECT c.a, c.b, alpha AS speed_ratio, min(ta) AS a_start, max(ta) AS a_end, min(tb) AS b_start, max(tb) AS b_end, avg(mirror) > 0.5 AS mirrored, count(*) AS inliers, round(sum(sim), 6) AS score_sum FROM cloud c JOIN fit l ON c.a = l.a AND c.b = l.b WHERE round(abs(tb - (alpha * ta + beta)), 6) <= {S.ransac_tol} GROUP BY c.a, c.b, alpha")
def a11(spark, sf):
    (points,) = held(search.cloud(frames(spark, sf), S))
    found = lines.segment_summary(points, lines.exhaustive_lines(points, S), S)
    return rounded(found.withColumn("score_sum", F.col("score") * F.col("inliers")).drop("score"), "score_sum")


def peel_sql(s: Settings) -> str:
    """Sampled consensus and peeling of a cloud's crowded pairs: the draws as a table, each round's lines, points that fit and points that are left."""
    ctes = [
        f"draws AS (SELECT t, ('0x' || substr(h, 1, 8))::BIGINT AS x, ('0x' || substr(h, 9, 8))::BIGINT AS y FROM (SELECT t, md5('{lines.SEED}|' || t) AS h FROM (SELECT unnest(range(0, {s.ransac_iters})) AS t)))",
        f"left0 AS (SELECT * FROM (SELECT a, b, ta, tb, sim, mirror, count(*) OVER (PARTITION BY a, b) AS n FROM cloud) WHERE n >= {s.min_pair_matches})",
    ]
    for r in range(1, s.max_segments + 1):
        least = 4 if r == 1 else s.min_inliers
        ctes += [
            f"p{r} AS (SELECT a, b, ta, tb, sim, mirror, row_number() OVER (PARTITION BY a, b ORDER BY ta, tb, sim, mirror) - 1 AS k, count(*) OVER (PARTITION BY a, b) AS n FROM left{r - 1})",
            f"d{r} AS (SELECT a, b, i, j, min(t) AS t FROM (SELECT a, b, t, x % n AS i, (x % n + 1 + y % (n - 1)) % n AS j FROM (SELECT DISTINCT a, b, n FROM p{r} WHERE n >= {least}), draws) GROUP BY a, b, i, j)",
            f"l{r} AS (SELECT a, b, t, slope, tb - slope * ta AS off FROM (SELECT d.a, d.b, t, p.ta, p.tb, (q.tb - p.tb) / (q.ta - p.ta) AS slope FROM d{r} d JOIN p{r} p ON p.a = d.a AND p.b = d.b AND p.k = i JOIN p{r} q ON q.a = d.a AND q.b = d.b AND q.k = j WHERE abs(q.ta - p.ta) >= 1e-3) WHERE slope BETWEEN {s.slope_min} AND {s.slope_max})",
            f"c{r} AS (SELECT l.a, l.b, t, slope, off, count(*) AS n FROM l{r} l JOIN p{r} p ON p.a = l.a AND p.b = l.b WHERE round(abs(p.tb - (slope * p.ta + off)), 6) <= {s.ransac_tol} GROUP BY ALL)",
            f"b{r} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY n DESC, t) AS o FROM c{r} WHERE n >= 4) WHERE o = 1)",
            f"u{r} AS (SELECT p.*, slope, round(abs(p.tb - (slope * p.ta + off)), 6) <= {s.ransac_tol} AS fits FROM p{r} p JOIN b{r} b ON p.a = b.a AND p.b = b.b WHERE b.n >= {s.min_inliers})",
            f"left{r} AS (SELECT a, b, ta, tb, sim, mirror FROM u{r} WHERE NOT fits)",
        ]
    each = " UNION ALL ".join(f"SELECT a, b, {r} AS r, min(ta) AS a_start, max(ta) AS a_end, min(tb) AS b_start, max(tb) AS b_end, any_value(slope) AS speed_ratio, avg(mirror) > 0.5 AS mirrored, CAST(count(*) AS INTEGER) AS inliers, avg(sim) AS score FROM u{r} WHERE fits GROUP BY a, b HAVING max(ta) - min(ta) >= {s.min_segment_seconds}" for r in range(1, s.max_segments + 1))
    ctes.append(f"peeled AS (SELECT *, CAST(row_number() OVER (PARTITION BY a, b ORDER BY round(score * (a_end - a_start), 6) DESC, r) - 1 AS INTEGER) AS nth FROM ({each}))")
    return ", ".join(ctes)


PEELED = "a, b, nth, a_start, a_end, b_start, b_end, round(speed_ratio, 6) AS speed_ratio, mirrored, inliers, round(score * inliers, 6) AS score_sum"
KEPT = f"kept AS (SELECT * FROM peeled WHERE score >= {S.min_segment_score} AND greatest(a_end - a_start, b_end - b_start) >= {S.min_segment_seconds} AND inliers / greatest(a_end - a_start, b_end - b_start, 1e-3) >= {S.min_inlier_density})"
QUERY_CLOUD = f"""cloud AS (SELECT -1 AS a, t.video_id AS b, q.ts AS ta, t.ts AS tb, sim, xor(q.mirrored, t.mirrored) AS mirror FROM (
  SELECT src, tgt, sim FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, tgt) AS rank FROM (
    SELECT q.frame_id AS src, t.frame_id AS tgt, round(list_inner_product(q.e, t.e), 6) + 0.0 AS sim FROM frames q, frames t WHERE q.video_id = 0)) WHERE rank <= {S.knn}) JOIN frames q ON q.frame_id = src JOIN frames t ON t.frame_id = tgt)"""


def _summed(segments: DataFrame) -> DataFrame:
    """Segments with the sum of their similarities instead of the mean."""
    return rounded(segments.withColumn("score_sum", F.col("score") * F.col("inliers")).drop("score"), "speed_ratio", "score_sum")


@query("m1_consensus_line", f"{CLOUDS}, {peel_sql(S)} SELECT a, b, round(slope, 6) AS alpha, round(off, 6) + 0.0 AS beta, n AS inliers FROM b1")
def m1(spark, sf):
    points = search.cloud(frames(spark, sf), S)
    return rounded(lines.consensus_lines(points, knn.crowded(points, S.min_pair_matches), S), "alpha", "beta")


@query("m2_ransac_peel", f"{CLOUDS}, {peel_sql(S)} SELECT {PEELED} FROM peeled")
def m2(spark, sf):
    points = search.cloud(frames(spark, sf), S)
    return _summed(lines.peeled_segments(points, knn.crowded(points, S.min_pair_matches), S))


@query("m3_hough_udf", f"{ALL}, {ALONG}, {GATES} SELECT {SEG} FROM seg")
def m3(spark, sf):
    _, pairs, samples, _ = parts(spark, sf)
    return rounded(hough.aligned_segments(pairs, samples, S), *SEG_ROUNDED).withColumn("score", F.round("score", 4))


@query("m5_smooth_search", f"{ALL}, {ALONG}, {GATES} SELECT {SEG}, CAST(row_number() OVER (ORDER BY seg.z_score DESC, a_end - a_start DESC, a, b) AS INTEGER) AS rank FROM seg")
def m5(spark, sf):
    return rounded(report.ranked(search.smooth_segments(frames(spark, sf), S)), *SEG_ROUNDED).withColumn("score", F.round("score", 4))


@query("m6_robust_search", f"{CLOUDS}, {peel_sql(S)}, {KEPT}, best AS (SELECT a, b, CAST(row_number() OVER (ORDER BY max(score * (a_end - a_start)) DESC, a, b) AS INTEGER) AS rank FROM kept GROUP BY a, b) SELECT {PEELED}, rank FROM kept JOIN best USING (a, b)")
def m6(spark, sf):
    return _summed(report.ranked(search.robust_segments(frames(spark, sf), S)))


@query("m7_find_query", f"WITH {FRAMES}, {QUERY_CLOUD}, {peel_sql(S)}, {KEPT} SELECT {PEELED} FROM kept")
def m7(spark, sf):
    f = frames(spark, sf)
    return _summed(search.find_segments(f.filter("video_id = 0"), f, S))


# scalars

@query("f1_unit_vectors", "SELECT vec_id, round(sqrt(list_sum([x * x FOR x IN u])), 6) AS norm, round(u[1], 6) + 0.0 AS first FROM (SELECT vec_id, [x / greatest(sqrt(list_sum([y * y FOR y IN v])), 1e-12) FOR x IN v] AS u FROM (SELECT vec_id, [x::DOUBLE * 3 FOR x IN embedding] AS v FROM embeddings))")
def f1(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("v")).select("vec_id", scalar.unit("v").alias("u"))
    return rows.select("vec_id", R(F.sqrt(scalar.dot("u", "u"))).alias("norm"), (R(F.element_at("u", 1)) + 0.0).alias("first"))


@query("f8_clip_power", "SELECT l_orderkey, l_linenumber, round(pow(least(greatest(l_discount * 20 - 0.5, 0.0), 1.0), 4.0), 6) AS w FROM lineitem")
def f8(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", R(scalar.clip_power(F.col("l_discount") * 20 - 0.5, 4.0)).alias("w"))


@query("f12_time_format", "SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS t FROM (SELECT o_orderkey, CAST(floor(greatest(o_totalprice / 50 - 500, 0.0)) AS BIGINT) AS s FROM orders)")
def f12(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", scalar.time_text(F.col("o_totalprice") / 50 - 500).alias("t"))


@query("f13_crop_extract", "SELECT event_id, CAST(len(m) AS INTEGER) AS n, m[-1] AS last FROM (SELECT event_id, regexp_extract_all('crop=' || user_id || ':2:3:4 noise crop=' || event_id || ':6:7:8', 'crop=(\\d+):\\d+:\\d+:\\d+', 1) AS m FROM events)")
def f13(spark, sf):
    log = F.concat(F.lit("crop="), F.col("user_id").cast("string"), F.lit(":2:3:4 noise crop="), F.col("event_id").cast("string"), F.lit(":6:7:8"))
    found = table(spark, sf, "events").select("event_id", scalar.crops_of(log).alias("m"))
    return found.select("event_id", F.size("m").alias("n"), F.element_at("m", -1)["w"].cast("string").alias("last"))


@query("f14_frame_budget", "SELECT o_orderkey, CAST(CASE WHEN d <= 0 THEN 648000 ELSE least(floor(d * 5) + 100, 648000) END AS BIGINT) AS budget FROM (SELECT o_orderkey, o_totalprice - 2000 AS d FROM orders)")
def f14(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", scalar.keyframe_budget(F.col("o_totalprice") - 2000).alias("budget"))


@query("f15_significant_crop", "SELECT p_partkey, (100 - p_size < 0.97 * 100 OR 100 - p_partkey % 5 < 0.97 * 100) AS significant FROM part")
def f15(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", (100 - F.col("p_size")).alias("w"), (100 - F.col("p_partkey") % 5).alias("h"), F.lit(100).alias("sw"), F.lit(100).alias("sh"))
    return rows.select("p_partkey", scalar.significant_crop("w", "h", "sw", "sh").alias("significant"))


@query("p1_contrast_filter", "SELECT vec_id FROM embeddings WHERE round(sqrt(greatest(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding]) / len(embedding) - pow(list_sum([x::DOUBLE FOR x IN embedding]) / len(embedding), 2), 0.0)), 6) >= 0.124")
def p1(spark, sf):
    return ingest.contrasted(table(spark, sf, "embeddings"), 0.124, "embedding").select("vec_id")


# catalog and ingest

@query("p10_resume_antijoin", f"WITH {VIDEOS}, incoming AS (SELECT '/v/' || n_nationkey || '.mp4' AS path FROM nation) SELECT path FROM incoming WHERE path NOT IN (SELECT path FROM videos WHERE status IN ('complete', 'rejected'))")
def p10(spark, sf):
    incoming = table(spark, sf, "nation").select(F.concat(F.lit("/v/"), F.col("n_nationkey").cast("string"), F.lit(".mp4")).alias("path"))
    return ingest.unsettled_by_path(incoming, videos(spark, sf))


INCOMING = "incoming AS (SELECT '/w/' || n_nationkey || '.mp4' AS path, sha1(CAST(n_nationkey AS VARCHAR)) AS sha1 FROM nation UNION ALL SELECT '/v/' || n_nationkey || '.mp4', sha1('x' || n_nationkey) FROM nation)"


def _incoming(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("k"))
    row = lambda p, s: n.select(F.concat(F.lit(p), "k", F.lit(".mp4")).alias("path"), F.sha1(F.concat(F.lit(s), "k").cast("binary")).alias("sha1"))
    return row("/w/", "").unionByName(row("/v/", "x"))


@query("p11_resume_path_or_hash", f"WITH {VIDEOS}, {INCOMING}, done AS (SELECT * FROM videos WHERE status IN ('complete', 'rejected')) SELECT path FROM incoming WHERE path NOT IN (SELECT path FROM done) AND sha1 NOT IN (SELECT sha1 FROM done)")
def p11(spark, sf):
    return ingest.unsettled(_incoming(spark, sf), videos(spark, sf)).select("path")


@query("k3_assign_ids", f"WITH {VIDEOS}, {INCOMING}, known AS (SELECT path, video_id FROM videos WHERE status = 'complete'), new AS (SELECT path, CAST((SELECT max(video_id) FROM videos) + row_number() OVER (ORDER BY path) AS INTEGER) AS video_id FROM incoming WHERE path NOT IN (SELECT path FROM known)) SELECT * FROM new UNION ALL SELECT path, CAST(video_id AS INTEGER) FROM known WHERE path IN (SELECT path FROM incoming)")
def k3(spark, sf):
    return ingest.with_ids(_incoming(spark, sf), videos(spark, sf)).select("path", "video_id")


@query("k4_latest_status", "SELECT user_id AS video_id, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def k4(spark, sf):
    return ingest.latest_status(table(spark, sf, "events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status")))


@query("k5_frame_counts", f"WITH {FRAMES} SELECT video_id, CAST(sum(1 - mirrored) AS BIGINT) AS n_frames FROM frames GROUP BY video_id")
def k5(spark, sf):
    return ingest.frame_counts(frames(spark, sf))


@query("k14_status_report", f"WITH {FRAMES}, {VIDEOS} SELECT v.video_id, CAST(sum(1 - f.mirrored) AS BIGINT) AS frames, printf('%d:%02d', CAST(floor(duration / 60) AS BIGINT), CAST(floor(duration % 60) AS BIGINT)) AS duration, path FROM videos v JOIN frames f USING (video_id) GROUP BY v.video_id, duration, path")
def k14(spark, sf):
    return report.status(videos(spark, sf), frames(spark, sf))


@query("s8_vector_gather", f"WITH {FRAMES} SELECT f.frame_id, round(e[1], 6) + 0.0 AS first FROM frames f JOIN (SELECT DISTINCT l_suppkey AS frame_id FROM lineitem) USING (frame_id)")
def s8(spark, sf):
    wanted = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("frame_id"))
    return frames(spark, sf).join(wanted, "frame_id", "left_semi").select("frame_id", (R(F.element_at("embedding", 1).cast("double")) + 0.0).alias("first"))


@query("s12_totals", f"WITH {FRAMES}, {VIDEOS} SELECT (SELECT count(*) FROM videos) AS videos, (SELECT count(*) FROM frames) AS vectors")
def s12(spark, sf):
    return report.totals(videos(spark, sf), frames(spark, sf))


@query("u4_mirrored_rows", "SELECT vec_id, m AS mirrored FROM embeddings, (SELECT unnest([0, 1]) AS m)")
def u4(spark, sf):
    return ingest.mirrored_rows(table(spark, sf, "embeddings")).select("vec_id", "mirrored")


CROPS = "crops AS (SELECT l_suppkey AS video_id, l_orderkey * 10 + l_linenumber AS seq, l_linenumber * 9.0::DOUBLE AS ts, CAST(240 - l_partkey % 120 AS INTEGER) AS w, CAST(180 - l_orderkey % 60 AS INTEGER) AS h, l_linenumber AS x, CAST(l_quantity AS INTEGER) AS y FROM lineitem)"


def _crops(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_suppkey").alias("video_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_linenumber") * 9.0).alias("ts"), (240 - F.col("l_partkey") % 120).cast("int").alias("w"), (180 - F.col("l_orderkey") % 60).cast("int").alias("h"), F.col("l_linenumber").alias("x"), F.col("l_quantity").cast("int").alias("y"), F.lit(240).alias("src_w"), F.lit(180).alias("src_h"))


@query("a14_robust_crop", f"WITH {CROPS} SELECT video_id, CAST(trunc(quantile_cont(w, 0.5)) AS INTEGER) AS w, CAST(trunc(quantile_cont(h, 0.5)) AS INTEGER) AS h, CAST(trunc(quantile_cont(x, 0.5)) AS INTEGER) AS x, CAST(trunc(quantile_cont(y, 0.5)) AS INTEGER) AS y FROM crops WHERE w * h >= 0.5 * 240 * 180 GROUP BY video_id")
def a14(spark, sf):
    return ingest.robust_crop(_crops(spark, sf))


@query("a15_last_crop", f"WITH {CROPS} SELECT video_id, c.w, c.h, c.x, c.y FROM (SELECT video_id, arg_max({{'w': w, 'h': h, 'x': x, 'y': y}}, seq) AS c FROM crops WHERE ts <= 30 GROUP BY video_id)")
def a15(spark, sf):
    return ingest.last_crop(_crops(spark, sf))


@query("i4_batch_completion", """WITH b AS (SELECT user_id AS video_id, CAST(event_id % 2 AS INTEGER) AS mirror, CAST(event_id % 64 AS BIGINT) AS n, event_type <> 'error' AND event_id % 97 <> 0 AS ok FROM events),
g AS (SELECT video_id, count(*) AS received, sum(CASE WHEN ok AND mirror = 0 THEN n ELSE 0 END) AS n_frames, bool_or(NOT ok) AS failed FROM b GROUP BY video_id),
e AS (SELECT DISTINCT user_id AS video_id, CAST(60 AS BIGINT) AS expected FROM events)
SELECT video_id, expected, received, CAST(n_frames AS BIGINT) AS n_frames, failed, CASE WHEN received < expected THEN 'pending' WHEN failed THEN 'failed' ELSE 'complete' END AS status FROM e JOIN g USING (video_id)""")
def i4(spark, sf):
    e = table(spark, sf, "events")
    batches = e.select(F.col("user_id").alias("video_id"), (F.col("event_id") % 2).cast("int").alias("mirror"), (F.col("event_id") % 64).cast("bigint").alias("n"), ((F.col("event_type") != "error") & (F.col("event_id") % 97 != 0)).alias("ok"))
    return ingest.batch_completion(batches, e.select(F.col("user_id").alias("video_id")).distinct().withColumn("expected", F.lit(60).cast("bigint")))
