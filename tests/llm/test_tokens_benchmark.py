import re

import pytest

from echotrace.llm import decontaminate, sentencepiece_codec as sp

from .helpers import DOCS, awkward, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def patched(change):
    """The model file with other scores, as a unigram model for the public library."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    m = pb.ModelProto()
    m.ParseFromString(sp.model_bytes(sp.MODEL))
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        if p.type == sp.NORMAL:
            p.score = change(p.score)
    return m.SerializeToString()


def test_encoding_equals_the_library(spark):
    import sentencepiece

    model = patched(lambda s: max(s, -40_000.0))
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=model), sp.Codec(model)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for line in [x for t in texts for x in t.split("\n")] + ["", " ", "  a  b", "naïve ☃ 漢字 🙂", "tab\tand  spaces "]:
        assert codec.encode(line) == library.encode(line), line


def test_models_that_change_texts_are_refused():
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    for change in ({"precompiled_charsmap": b"x"}, {"remove_extra_whitespaces": True}, {"escape_whitespaces": False}):
        m = pb.ModelProto()
        m.ParseFromString(sp.model_bytes(sp.MODEL))
        for k, v in change.items():
            setattr(m.normalizer_spec, k, v)
        with pytest.raises(ValueError, match="white space"):
            sp.Codec(m.SerializeToString())


def best_score(codec, scores, chunk):
    best = [0.0] + [float("-inf")] * len(chunk)
    for j in range(1, len(chunk) + 1):
        for i in range(max(0, j - 16), j):
            if chunk[i:j] in scores:
                best[j] = max(best[j], best[i] + scores[chunk[i:j]])
        if chunk[j - 1] not in codec.single:
            best[j] = max(best[j], best[j - 1] + codec.worst)
    return best[-1]


def test_path_has_the_best_score():
    codec = sp.Codec(sp.model_bytes(sp.MODEL))
    scores = {p: codec.automaton.get(p)[1] for p in codec.pieces if codec.automaton.exists(p)}
    for w in prose(7, 80).split() + ["unbelievably", "Zukunft☃x", "aaaa"]:
        chunk = sp.SPACE + w
        path = [codec.pieces[i] for i in codec.best_path(chunk)]
        total, unknown = 0.0, sum(c not in codec.single for c in chunk)
        total = sum(scores[p] for p in path if p in scores) + unknown * codec.worst
        assert total == best_score(codec, scores, chunk)


def test_round_trip_and_edge_cases(spark):
    rows = awkward()
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("count", "ids")
    out = sp.encode(df, check=True)
    got = out.collect()
    assert len(got) == len(rows) and all(r["round_trip"] in (True, None) for r in got)
    assert all((r["ids"] is None) == (r["text"] is None) and r["n_tokens"] == len(r["ids"] or []) for r in got)
    assert all(r["decoded"] == r["text"] for r in sp.decode(out).collect())
    assert sp.encode(df.filter("false")).count() == 0


def plain_scan(docs, items, n=10):
    words = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t)) if t else []
    windows = {}
    for i, t in items:
        w = words(t)
        k = min(n, len(w))
        for a in range(len(w) - k + 1) if k else ():
            windows.setdefault(tuple(w[a : a + k]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                owners = windows.get(tuple(w[a : a + k]))
                if owners:
                    hit.update(range(a, a + k))
                    found |= owners
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


ITEMS = [(1, prose(70, 30)), (2, prose(71, 4)), (3, None), (4, ""), (5, "--- !!"), (6, prose(70, 30)), (7, "Éa naïve ☃")]
LEAKS = [(50, prose(72, 50) + " " + prose(70, 30).upper().replace(" ", ", ") + " " + prose(73, 50)), (51, prose(71, 4)), (52, "x " + " ".join(prose(70, 30).split()[3:15]) + " y"), (53, "naïve éa NAÏVE")]


@pytest.mark.parametrize("size", [decontaminate.MAX_BLOCK_BYTES, 60])
def test_scan_equals_brute_force(spark, size):
    rows = [(r[0], r[1]) for r in awkward()] + LEAKS
    docs, items = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = decontaminate.scan(spark, docs, items, max_block_bytes=size).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in got), key=repr) == plain_scan(rows, ITEMS)


def test_removal(spark):
    rows = [(r[0], r[1], *r[2:]) for r in awkward()] + [(d, t, "en", "s", 1, 1, "r") for d, t in LEAKS]
    docs, items = spark.createDataFrame(rows, DOCS), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate.remove(spark, docs, items).collect()}
    assert 51 not in got and 52 not in got and prose(70, 30).split()[5].upper() not in got[50] and got[50].startswith(prose(72, 50)) and got[50].endswith(prose(73, 50))
    assert got[0] == rows[0][1] and decontaminate.remove(spark, docs, items).columns == docs.columns
    whole = {r["doc_id"] for r in decontaminate.remove(spark, docs, items, mode="document").collect()}
    assert not {50, 51, 52} & whole and {0, 3, 53} <= whole
    none = items.filter("false")
    assert decontaminate.remove(spark, docs, none).count() == len(rows) and decontaminate.scan(spark, docs.filter("false"), items).count() == 0


@pytest.mark.parametrize("share", [0.5, 1.0])
def test_removal_does_not_depend_on_blocks(spark, share):
    """Two items that overlap in a document, and one whose hits only together pass the share."""
    a, b, x, y = (prose(80 + i, 12).split() for i in range(4))
    both = a + b
    items = [(1, " ".join(both[:12])), (2, " ".join(both[6:20])), (3, " ".join(x)), (4, " ".join(y))]
    rows = [(0, " ".join(both[:20] + prose(90, 60).split())), (1, " ".join(x + prose(91, 8).split() + y + prose(92, 8).split())), (2, " ".join(both[:15])), (3, None), (4, "")]
    docs, table = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string").coalesce(1)
    assert len(list(decontaminate.item_blocks(table, 40))) > 4
    got = [{r["doc_id"]: r["text"] for r in decontaminate.remove(spark, docs, table, max_hit_share=share, max_block_bytes=size).collect()} for size in (40, 1 << 25)]
    assert got[0] == got[1] and got[0][0].split() == prose(90, 60).split() and (1 in got[0]) == (share == 1.0)


def test_a_large_item_is_split_without_losing_a_window():
    text = prose(95, 500)
    parts = list(decontaminate.split_item(text, 300, 10))
    w = text.split()
    want = {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    assert len(parts) > 5 and {tuple(p.split()[i : i + 10]) for p in parts for i in range(len(p.split()) - 9)} == want


def test_items_without_an_id(spark):
    items = spark.createDataFrame([(None, prose(70, 30)), (4, prose(70, 30)), (None, prose(71, 12))], "item_id bigint, text string")
    got = decontaminate.scan(spark, spark.createDataFrame([(1, prose(70, 30)), (2, prose(71, 12))], "doc_id bigint, text string"), items).collect()
    assert {r["doc_id"]: (r["n_hit"], r["items"]) for r in got} == {1: (30, ["4", None]), 2: (12, [None])}


def test_window_set_is_about_four_times_its_text():
    text = " ".join(prose(i, 2000) for i in range(20))
    assert decontaminate.WindowSet([("1", text)], 10).nbytes < 5 * len(text)
