import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from echotrace.llm import components, line_dedup, minhash
from echotrace.llm.spans import keyed
from echotrace.llm.textkit import blocks

from .helpers import DOCS, WORDS, awkward, in_order, prose


def plain_lines(rows, m):
    """(doc_id, text) -> kept lines, or None for null."""
    first, out = {}, {}
    docs = [(d, t, t.split("\n") if t is not None else None) for d, t in in_order(rows)]
    for d, t, ls in docs:
        if ls is None:
            out[d, t] = None
            continue
        gone = set()
        for i in range(len(ls) - m + 1):
            key = tuple(ls[i : i + m])
            if first.setdefault(key, (d, t, i)) != (d, t, i):
                gone.update(range(i, i + m))
        out[d, t] = [x for i, x in enumerate(ls) if i not in gone]
    return out


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_line_runs_equal_brute_force(spark, m):
    block = [prose(200 + i, 5) for i in range(9)]
    rows = [r for r in awkward() if r[0] != 12] + [(30, "\n".join(block), "en", "s", 1, 1, "r"), (31, "\n".join(block[3:] + block[:4]), "en", "s", 1, 1, "r"), (32, "\n".join(["x"] * 7), "en", "s", 1, 1, "r"), (33, "\n\n\n", "en", "s", 1, 1, "r")]
    want = plain_lines(rows, m)
    got = line_dedup.dedup(spark.createDataFrame(rows, DOCS), m)
    assert got.columns == [c.split()[0] for c in DOCS.split(", ")]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=key) == sorted(((r[0], None if want[r[0], r[1]] is None else "\n".join(want[r[0], r[1]])) for r in rows), key=key)


@pytest.mark.parametrize("small", [line_dedup.SMALL, 0])
def test_runs_of_many_lines(spark, small, monkeypatch):
    """Runs of 1 to 40 lines, a line that stands everywhere, and a text of one line again and again."""
    monkeypatch.setattr(line_dedup, "SMALL", small)
    source = [prose(700 + i, 4) for i in range(60)]
    rows = [(0, "\n".join(source))]
    rows += [(n, "\n".join([f"own {n}", *source[n // 2 : n // 2 + n], "the common line", f"end {n}", "the common line"])) for n in range(1, 41)]
    rows += [(50, "\n".join(["again"] * 37)), (51, "\n".join(["again"] * 21))]
    rows = [(d, t, "en", "s", 1, 1, "r") for d, t in rows]
    want = plain_lines(rows, 2)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {d: "\n".join(kept) for (d, _), kept in want.items()}
    depths = [depth for depth, _ in line_dedup.suffix_array(keyed(spark.createDataFrame(rows, DOCS)))]
    assert depths == [1, 2, 4, 8, 16, 32]


def test_line_dedup_may_drop_emptied_texts(spark):
    rows = [(1, "a b\nc d"), (2, "a b\nc d"), (3, ""), (4, None)]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), 2, drop_emptied=True)
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == {(1, "a b\nc d"), (3, ""), (4, None)}
    assert line_dedup.dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_line_dedup_has_no_python_in_its_plan(spark):
    plan = line_dedup.dedup(spark.createDataFrame(awkward(), DOCS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("weight", [1.0, 2.5, 0.4])
def test_signatures_estimate_similarity(weight):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**44, 900).astype(np.uint64)
    b = np.concatenate((a[:800], rng.integers(0, 2**44, 100).astype(np.uint64)))
    s = minhash.signatures(np.repeat([0, 1], 900), np.concatenate((a, b)), np.full(1800, weight), 2, 1500)
    assert (s[0] == s[1]).mean() == pytest.approx(0.8, abs=0.05)


def test_weighted_similarity():
    """Weights 3 and 1 of one shared element: similarity 1/3."""
    e = np.array([7, 7], np.uint64)
    s = minhash.signatures(np.array([0, 1]), e, np.array([3.0, 1.0]), 2, 3000)
    assert (s[0] == s[1]).mean() == pytest.approx(1 / 3, abs=0.05)
    assert (minhash.signatures(np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0), 1, 4) == 2**64 - 1).all()


def shingles(text):
    import pyarrow as pa

    return [set(e[d == 0].tolist()) for _, _, data, off in blocks(pa.array([text], pa.large_string())) for d, e in [minhash.shingle_sets(data, off)]][0]


def exact_classes(rows):
    docs = [(d, t, shingles(t)) for d, t in in_order(rows)]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, x), (j, y) in itertools.combinations(enumerate(docs), 2):
        if x[2] and y[2] and len(x[2] & y[2]) >= 0.8 * len(x[2] | y[2]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {(d, t): docs[find(i)][0] for i, (d, t, _) in enumerate(docs)}


def corpus():
    rng = np.random.default_rng(3)
    rows, base = list(awkward()), prose(300, 160).split()
    for i in range(25):  # a group of near copies of one text, and some farther off
        w = list(base)
        for at in rng.choice(len(w), 2 if i < 18 else 12, replace=False):
            w[at] = str(rng.choice(WORDS))
        rows.append((100 + i, " ".join(w), "en", "s", 1, 1, "r"))
    rows += [(200 + i, prose(400 + i, 120), "en", "s", 1, 1, "r") for i in range(20)]
    return rows


def found_classes(spark, rows):
    """(doc_id, text) -> doc_id of the least document of its class, of rows without a doc_id that has two texts."""
    docs = keyed(spark.createDataFrame(rows, DOCS))
    by_id = {r["__id"]: (r["doc_id"], r["text"]) for r in docs.select("__id", "doc_id", "text").collect()}
    return {by_id[r["__id"]]: by_id[r["__class"]][0] for r in minhash.classes(docs).collect()}


def test_classes_equal_exact_comparison(spark):
    rows = [r for r in corpus() if r[0] != 12]
    assert found_classes(spark, rows) == exact_classes(rows)


def templated(seed: int, n: int = 150, words: int = 300, shared: int = 2, own: int = 3):
    """Pairs of texts of one template, each pair with shared and each text with own edits: most links are barely similar enough, and most texts of a bucket are no links."""
    rng = np.random.default_rng(seed)
    base, rows = prose(seed, words).split(), []
    for pair in range(n):
        both = list(base)
        for at in rng.choice(words, shared, replace=False):
            both[at] = f"pair{pair}x{at}"
        for side in range(2):
            w = list(both)
            for at in rng.choice(words, own, replace=False):
                w[at] = f"own{pair}y{side}z{at}"
            rows.append((2 * pair + side, " ".join(w), "en", "s", 1, 1, "r"))
    return rows


@pytest.mark.parametrize("own", [3, 4])
def test_no_link_of_templated_texts_is_lost(spark, own, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 64)  # several blocks and cells, and the rounds of large cells
    rows = templated(21, own=own)
    want = exact_classes(rows)
    assert 1 < len(set(want.values())) < len(rows)
    assert found_classes(spark, rows) == want


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2**44 - 1), min_size=1, max_size=300), st.sets(st.integers(0, 2**44 - 1), max_size=60))
def test_sketches_never_show_more_than_the_difference(a, change):
    b = a ^ change
    if b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
        n = np.array([len(a), len(b)])
        made = [minhash.sketch(np.array(sorted(x), np.uint64)) for x in (a, b)]
        rate = minhash.near(made, n, np.array([0]), np.array([1]), 0.8)[0]
        linked = len(a & b) >= 0.8 * len(a | b)
        assert rate * (n.sum() / 9 + 1e-6) <= len(change) + 1e-6 and (not linked or rate <= 1)


def test_dedup_keeps_one_of_each_class(spark):
    rows = corpus()
    kept = minhash.dedup(spark.createDataFrame(rows, DOCS))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    simple = [r for r in rows if r[0] != 12]
    assert kept.filter("doc_id IS NULL OR doc_id <> 12").count() == len(set(exact_classes(simple).values()))
    assert minhash.dedup(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("small", [components.SMALL, 0])
def test_components(spark, small, monkeypatch):
    monkeypatch.setattr(components, "SMALL", small)
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
