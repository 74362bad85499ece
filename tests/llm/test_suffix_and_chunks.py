import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from echotrace.llm import cdc_dedup, spans, suffix_dedup

from .helpers import DOCS, awkward, cut, prose, removed_windows


def by_doc(df):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def as_rows(rows, want):
    return sorted((d is not None, d or 0, *want[d, t]) for d, t, *_ in rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=24).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=7))
def test_transform_is_that_of_sorted_suffixes(strings):
    data, size = np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings])
    bwt, lcp = suffix_dedup.transform(data, np.cumsum(size) - size, size)
    every = sorted(((s[i:], n, i) for n, s in enumerate(strings) for i in range(len(s) + 1)), key=lambda x: [c + 1000 for c in x[0]] + [x[1]])
    assert bwt.tolist() == [strings[n][i - 1] + 1 if i else 0 for _, n, i in every]
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert lcp.tolist() == [0] + [common(a[0], b[0]) for a, b in zip(every, every[1:])]
    for who, length, row in zip(*suffix_dedup.places(bwt, size, 1)):
        assert every[row][1] == who and len(every[row][0]) == length


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 3])
def test_suffix_dedup_equals_brute_force(spark, hot):
    rows = awkward() + [(20 + i, prose(50 + i % 3, 20) + " shared boilerplate that stands in every single document of this kind, word for word " + prose(60 + i, 20), "en", "s", 1, 1, "r") for i in range(12)]
    df = spark.createDataFrame(rows, DOCS)
    want = removed_windows(in_key_order(spark, rows), 100)
    assert by_doc(suffix_dedup.dedup(df, hot=hot)) == as_rows(rows, want)
    assert by_doc(suffix_dedup.dedup(df, hot=hot, share=10**6)) == as_rows(rows, want)


def test_suffix_dedup_spans_and_texts(spark):
    a = prose(1, 60)
    r = suffix_dedup.dedup(spark.createDataFrame([(1, a), (2, "new start " + a + " new end")], "doc_id bigint, text string"), text=True).filter("doc_id = 2").first()
    assert len(r["spans"]) == 1 and len(r["kept"]) <= len("new start  new end") and r["n_removed"] == r["spans"][0]["end"] - r["spans"][0]["start"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert suffix_dedup.dedup(none).count() == 0 and cdc_dedup.dedup(none).count() == 0


def test_spans_sort_by_start():
    at = spans.pack([0, 5, 1 << 31], [100, 7, 9])
    assert (np.diff(at) > 0).all() and spans.start_of(at).tolist() == [0, 5, 1 << 31] and (at & spans.SPAN).tolist() == [100, 7, 9]


def in_key_order(spark, rows):
    """The distinct documents in the order of their keys: doc_id, then the hashes of the texts."""
    found = spans.keyed(spark.createDataFrame(rows, DOCS)).select("__id", "doc_id", "text").distinct().orderBy("__id").collect()
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    return [(r["doc_id"], r["text"]) for r in found]


@pytest.mark.parametrize("operator", [suffix_dedup.dedup, cdc_dedup.dedup])
def test_many_texts_without_an_id(spark, operator):
    """40,000 texts under one doc_id, or none, take seconds, and each its own result."""
    kept = prose(1, 60)
    texts = [f"{i} {prose(i % 500, 8)} {i * 7919}" for i in range(40_000)]
    texts[3], texts[39_000], texts[39_999] = kept, kept + " a", "b " + kept
    rows = spark.createDataFrame([(None if i % 2 else 5, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    out = operator(rows).collect()
    assert len(out) == len(texts) and sum(r["n_removed"] > 0 for r in out) == 2 and sum(r["doc_id"] is None for r in out) == 20_000


def chunk_ends(raw):
    out, last, h = [], 0, 0
    for i, x in enumerate(raw):
        h = ((h << 1) + int(cdc_dedup.GEAR[x])) & 0xFFFFFFFF
        n = i + 1 - last
        if n >= cdc_dedup.LEAST and (h >> (32 - cdc_dedup.BITS) == 0 or n >= cdc_dedup.MOST) and len(raw) - last > cdc_dedup.LEAST:
            out.append(i + 1)
            last = i + 1
    return out + [len(raw)] * (last < len(raw))


def test_chunk_dedup_equals_rolling_hash(spark):
    rows = awkward()
    seen, want = set(), {}
    for doc_id, text in in_key_order(spark, rows):
        raw, last = (text or "").encode(), 0
        covered = [False] * len(raw)
        for end in chunk_ends(raw):
            piece = raw[last:end]
            if len(piece) >= cdc_dedup.LEAST:
                if piece in seen:
                    covered[last:end] = [True] * len(piece)
                seen.add(piece)
            last = end
        want[doc_id, text] = cut(raw, covered)
    assert by_doc(cdc_dedup.dedup(spark.createDataFrame(rows, DOCS))) == as_rows(rows, want)


def test_chunks_resist_an_insertion():
    raw = prose(9, 2000).encode()
    moved = raw[:3000] + b"an insertion" + raw[3000:]
    pieces = lambda b: {b[a:e] for a, e in zip([0, *chunk_ends(b)], chunk_ends(b))}
    assert len(pieces(raw) - pieces(moved)) <= 4
