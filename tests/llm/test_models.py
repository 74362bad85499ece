import numpy as np
import pytest
from pyspark.sql import functions as F

from echotrace.llm import ann, language_id, quality, token_counts
from echotrace.llm.textkit import Words, crc32_mod

from .helpers import DOCS, awkward, plain_language, plain_mixture, plain_model, prose

SF = "/root/testdata/sf0.01"


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable")
    return (rank[label == 1].sum() - (label == 1).sum() * ((label == 1).sum() - 1) / 2) / ((label == 1).sum() * (label == 0).sum())


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_id.op3_language_mixture(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (rows["lang_pred"] == rows["lang"]).mean() > 0.98 and rows["score"].between(0, 1).all()


def test_mixture_finds_proportions():
    """Words of two languages, 3 to 1, each far likelier in its own."""
    logs = np.full((3, 80), -20.0)
    logs[0, :60], logs[2, 60:] = -5.0, -5.0
    share = language_id.mixture(logs, np.array([80]))[:, 0]
    assert share == pytest.approx([0.75, 0.0, 0.25], abs=0.01)
    assert language_id.mixture(logs[:, :60], np.array([60]))[0, 0] == pytest.approx(1.0)


def test_mixture_equals_plain_em():
    """Texts of 1 to 60 words, and of up to nine languages at once."""
    rng = np.random.default_rng(4)
    count = np.array([1, 2, 7, 60, 33])
    logs = rng.uniform(-12, -4, (9, count.sum()))
    for i, n in enumerate(np.cumsum(count) - count):  # the last texts mix many languages
        for k in range(n, n + count[i]):
            logs[(k - n) % (i * 2 + 1), k] = -0.5
    share = language_id.mixture(logs, count)
    want = [plain_mixture(logs[:, a : a + n].T.tolist()) for a, n in zip(np.cumsum(count) - count, count)]
    assert share.T == pytest.approx(np.array(want), abs=1e-4)
    assert (share[:, 4] > 0.05).sum() == 9  # no bound on the languages of a text


def test_predictions_equal_plain_ones(spark):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = [r for r in sorted(rows) if len(r[1] or "") < 1500][:25] + [(900, "ja oui yes", None), (901, None, "en"), (902, "", "en"), (903, "12 !", "en"), (904, "é", None)]
    rows.append((905, " ".join(t for _, t, _ in rows[:12] if t), None))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = plain_model([r[1:] for r in rows])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(df, language_id.train(df)).collect()}
    for doc_id, text, _ in rows:
        lang, score, _ = plain_language(text, model)
        assert got[doc_id][0] == lang and got[doc_id][1] == pytest.approx(score, abs=2e-3), doc_id


def test_language_edge_cases(spark):
    rows = awkward()
    df = spark.createDataFrame(rows, DOCS)
    model = language_id.train(df)
    got = language_id.predict(df, model).collect()
    assert len(got) == len(rows)
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert {3, 4, 5, 10} <= und and all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    kept = language_id.keep_known(df, model)
    assert kept.columns == df.columns and not {3, 4, 5, 10} & {r["doc_id"] for r in kept.collect()} and 0 in {r["doc_id"] for r in kept.collect()}
    none = language_id.train(df.filter("false"))
    assert {r["lang_pred"] for r in language_id.predict(df, none).collect()} == {"und"} and language_id.predict(df.filter("false"), model).count() == 0


def test_held_out_quality(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.op8_quality_attention(spark, SF).join(labels, "doc_id").filter("held_out").toPandas()
    assert auc(rows["score"].to_numpy(), rows["quality"].to_numpy()) > 0.97 and ((rows["score"] >= 0.5) == (rows["predicted"] == 1)).all()


def test_quality_gradient():
    net, rng = quality.Network(), np.random.default_rng(0)
    x = rng.standard_normal((7, quality.CODE + quality.N_DENSE)).astype(np.float32)
    first, label = np.array([0, 3]), np.array([1.0, 0.0])
    loss = lambda: float(-(label * np.log(net.forward(x, first)["y"]) + (1 - label) * np.log(1 - net.forward(x, first)["y"])).mean()) + quality.DECAY / 2 * sum(float((p.astype(np.float64) ** 2).sum()) for p in net.p.values())
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    g = net.gradient(net.forward(x, first), first, label, np.ones(2))
    for k, v in net.p.items():
        at = tuple(rng.integers(0, n) for n in v.shape)
        v[at] += 1e-5
        up = loss()
        v[at] -= 2e-5
        down = loss()
        v[at] += 1e-5
        assert g[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def plain_quality(net, text):
    """A text's score, restated passage by passage."""
    import math
    import re

    raw = (text or "").encode()
    found = [(m.start(), m.end()) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
    n = max(1, (len(found) + quality.PASSAGE // 2) // quality.PASSAGE)
    groups = [found[i * quality.PASSAGE : (i + 1) * quality.PASSAGE if i < n - 1 else None] for i in range(n)]
    edges = [0] + [g[0][0] for g in groups[1:]] + [len(raw)]
    sets = [range(97, 123), range(65, 91), range(48, 58), b" ", b"\n", b".,;:", b"?!", b"#$%&@*", b"|<>{}[]=_", range(128, 256)]
    rows = []
    for g, a, b in zip(groups, edges, edges[1:]):
        words = [raw[x:y].decode("latin-1") for x, y in g]
        low = [w.translate({c: c + 32 for c in range(65, 91)}) for w in words]
        own = raw[a:b]
        shares = [sum(x in s for x in own) / max(len(own), 1) for s in sets]
        k = max(len(words), 1)
        dense = [1 - sum(shares) if own else 0.0, *shares, sum(map(len, words)) / k / 10, sum("A" <= w[0] <= "Z" and "A" <= w[-1] <= "Z" for w in words) / k]
        dense += [len(set(low)) / k, sum(x == y for x, y in zip(low, low[1:])) / k, min(len(words), quality.PASSAGE) / quality.PASSAGE, math.log1p(len(found)) / 10]
        code = np.zeros(quality.CODE)
        for w in low:
            bucket = int(Words(np.frombuffer(w.encode("latin-1"), np.uint8), np.array([0, len(w)])).hash[0] >> np.uint64(44)) % quality.FEATURES
            code += net.projection[bucket] / math.sqrt(len(words))
        rows.append((np.concatenate((code, dense)) - net.mean) / net.spread)
    p, weights, codes = net.p, [], []
    for x in rows:
        h = np.tanh(x @ p["W"] + p["b"])
        gate = 1 / (1 + np.exp(-(h @ p["U"])))
        weights.append(math.exp(float(((np.tanh(h @ p["V"]) * gate) @ p["a"])[0])))
        codes.append(h)
    z = sum(w * h for w, h in zip(weights, codes)) / sum(weights)
    return 1 / (1 + math.exp(-float((z @ p["o"])[0] + p["c"][0])))


def test_scores_equal_plain_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    net = quality.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    some = docs.orderBy("doc_id").limit(80).unionByName(spark.createDataFrame([(r[0], r[1]) for r in awkward() if r[0] != 12], "doc_id bigint, text string"))
    got = quality.score(some, net).collect()
    texts = [(r["doc_id"], r["text"]) for r in some.collect()]
    want = sorted((d is None, d or 0, plain_quality(net, t)) for d, t in texts)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["score"]) for r in got) == [(a, b, pytest.approx(c, abs=1e-3)) for a, b, c in want]


def test_training_reads_every_passage(spark):
    """Labels that show in one late passage of a long text only."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(160):
        words = prose(i, 4000).split()
        at = int(rng.integers(1500, 3500))
        words[at : at + 40] = ["zorp" if i % 2 else "quil"] * 40
        rows.append((i, " ".join(words), i % 2))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, y int")
    net = quality.train(df.filter("doc_id < 120"), df.select("doc_id", F.col("y").alias("quality")))
    got = {r["doc_id"]: r["score"] for r in quality.score(df.filter("doc_id >= 120"), net).collect()}
    assert np.mean([(s >= 0.5) == bool(d % 2) for d, s in got.items()]) >= 0.9


def test_quality_edge_cases(spark):
    df = spark.createDataFrame(awkward(), DOCS)
    labels = spark.createDataFrame([(0, 1), (1, 1), (6, 0), (7, 0), (99, 1), (None, 1), (8, None), (8, 1)], "doc_id bigint, quality int")
    got = quality.score(df, quality.train(df, labels)).collect()
    assert len(got) == len(awkward()) and all(0 <= r["score"] <= 1 for r in got)
    for some, want in ((labels.filter("false"), 0.5), (labels.filter("quality = 1"), 1.0)):
        assert {r["score"] for r in quality.score(df, quality.train(df, some)).collect()} == {want}


def test_folds(spark):
    import zlib

    rows = {r["i"]: r["m"] for r in spark.createDataFrame([(i,) for i in (0, 7, 123, -5)] + [(None,)], "i bigint").select("i", crc32_mod(F.col("i"), 4).alias("m")).collect()}
    assert all(m == (zlib.crc32(str(i).encode()) % 4 if i is not None else 0) for i, m in rows.items())


def test_token_histogram(spark):
    import tiktoken

    rows = awkward()
    df = spark.createDataFrame(rows, DOCS)
    from base64 import b64decode

    with open(token_counts.VOCABULARY, "rb") as f:
        ranks = {b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    n = np.array([len(enc.encode_ordinary(r[1])) if r[1] else 0 for r in rows])
    got = token_counts.suffix_sums(token_counts.histogram(df), span=16).collect()
    assert sum(r["n_docs"] for r in got) == len(rows) and {r["n_tokens"] for r in got} == set(n.tolist())
    for r in got:
        c = r["n_tokens"]
        assert (r["docs_at_least"], r["tokens_at_least"], r["truncated_tokens"]) == ((n >= c).sum(), n[n >= c].sum(), np.minimum(n, c).sum()) and r["quantile"] == pytest.approx((n <= c).mean())
    sums = token_counts.suffix_sums(token_counts.histogram(df))
    assert tuple(token_counts.truncated_total(sums, 50).first()) == (np.minimum(n, 50).sum(), (n > 50).sum())
    assert token_counts.quantile(sums, 0.5).first()[0] == np.sort(n)[int(np.ceil(0.5 * len(n))) - 1]
    assert token_counts.suffix_sums(token_counts.histogram(df.filter("false"))).count() == 0
    text = prose(1, 3000)
    assert sum(len(enc.encode_ordinary(p)) for p in token_counts.parts(text, 500)) == len(enc.encode_ordinary(text)) and "".join(token_counts.parts(text, 500)) == text
    lengths = token_counts.lengths(df.withColumn("n_tokens", F.lit("clash")))
    assert sorted(lengths.columns) == sorted([*df.columns, "n_tokens"]) and lengths.filter("doc_id = 0").first()["n_tokens"] == n[0]


def nearest(ids, x, q, k):
    out = {}
    for i in q:
        s = x @ x[np.flatnonzero(ids == i)[0]]
        s[ids == i] = -np.inf
        out[int(i)] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s))[:k] if s[j] > -np.inf]
    return out


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 24))
    x[200:600] = x[0] + 0.05 * rng.standard_normal((400, 24))  # a crowded region
    x[600:700] = x[1]  # equal vectors
    ids = rng.permutation(1500)
    df = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, x)], "vec_id bigint, embedding array<double>, rank int")
    got = ann.search(df, F.col("vec_id") % 20 == 0, cell=64).collect()
    want = nearest(ids, x, ids[ids % 20 == 0], 20)
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(by[r["query_id"]])
    assert by.keys() == want.keys() and all(len(v) == 20 for v in by.values())
    assert np.mean([len({i for i, _ in by[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    at = {int(i): v for i, v in zip(ids, x)}
    for q, rows in by.items():
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0])) and rows[0][1] == pytest.approx(at[q] @ at[rows[0][0]], rel=1e-12)


def test_neighbours_edge_cases(spark):
    schema = "vec_id bigint, embedding array<float>"
    bad = [(40, None), (60, [0.0, 0.0]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (120, [None, 1.0]), (140, [1.0]), (None, [1.0, 1.0])]
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (20, [0.0, 2.0]), (20, [1.0, 1.0])]
    got = ann.search(spark.createDataFrame(rows + bad, schema), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 20), (0, 1), (0, 2), (0, 2), (0, 20), (20, 1), (20, 2), (20, 2), (20, 0)]
    assert ann.search(spark.createDataFrame(bad[:2], schema), F.col("vec_id") % 20 == 0).count() == 0
