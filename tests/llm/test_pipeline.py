import math

import duckdb
import pytest

from echotrace.llm.registry import ORACLE_SQL, QUERIES

from .helpers import DOCS, awkward, plain_language, plain_model, prose
from .test_lines_minhash import exact_classes, plain_lines
from .test_tokens_benchmark import ITEMS, LEAKS, plain_scan

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name]).fetch_df()
    got = QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.to_numpy())) == sorted(map(tuple, want.to_numpy()))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_pipeline_equals_its_stages_restated(spark, tmp_path):
    import corpus_pipeline

    rows = [r for r in awkward() if r[0] not in (11, 12)] + [(d, t, "en", "s", 1, 1, "r") for d, t in LEAKS] + [(60 + i, prose(500 + i, 80) + "\n" + prose(900, 30) + "\n" + prose(901, 30), "de", "s", 1, 1, "r") for i in range(4)]
    rows = [r for r in rows if r[0] is not None]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    model = plain_model([(r[1], r[2]) for r in rows])
    docs = [(r[0], r[1]) for r in rows if plain_language(r[1], model)[2] > -16 * math.log(2)]
    assert len(docs) > 10
    kept = plain_lines(docs, 2)
    docs = [(d, "\n".join(kept[d, t])) for d, t in docs if kept[d, t]]
    classes = exact_classes(docs)
    docs = [(d, t) for d, t in docs if classes[d, t] == d]
    hits = {d: (n, h) for d, n, h, _ in plain_scan(docs, ITEMS)}
    docs = [(d, t) for d, t in docs if hits[d][1] <= 0.5 * hits[d][0]]
    assert got.keys() == {d for d, _ in docs}
    assert all(r["round_trip"] for r in got.values()) and all(r["n_tokens"] == len(r["ids"]) for r in got.values())


def test_stages_keep_the_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
