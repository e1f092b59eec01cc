import math

import pytest
from pyspark.sql import functions as F

from filigree.operators import lexical as L
from filigree.operators.dense import dense_top, hashed_top
from filigree.operators.ordering import places, row_numbers
from filigree.operators.search import rrf_fuse, search

DOCS = [("d0", "rocket engine test"), ("d1", "rocket engine neutron"), ("d2", "launch pad site")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "chunk_id string, text string").withColumn("ticker", F.lit("abc")).withColumn("form", F.lit("10-K"))


def asked(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "qid long, text string")


def test_bm25_by_hand(spark, docs):
    got = {(r.qid, r.doc): r.score for r in L.bm25_top(docs, asked(spark, "neutron", "rocket", "rocket rocket"), "chunk_id", "qid", 10).collect()}
    assert got[0, "d1"] == pytest.approx(math.log(8 / 3))
    assert got[1, "d0"] == pytest.approx(math.log(1.6)) == got[1, "d1"]
    assert got[2, "d0"] == pytest.approx(2 * math.log(1.6))
    assert (1, "d2") not in got


def test_filter_leaves_statistics_alone(spark, docs):
    only = docs.where("chunk_id = 'd0'").select(F.col("chunk_id").alias("doc"))
    got = L.bm25_top(docs, asked(spark, "rocket"), "chunk_id", "qid", 10, eligible=only).collect()
    assert [(r.doc, r.rank) for r in got] == [("d0", 1)] and got[0].score == pytest.approx(math.log(1.6))


def test_ties_go_by_document(spark, docs):
    got = L.bm25_top(docs, asked(spark, "rocket"), "chunk_id", "qid", 1).collect()
    assert got[0].doc == "d0"


def test_rrf_arithmetic(spark):
    one = spark.createDataFrame([(0, "10", 1, 9.0), (0, "20", 2, 8.0), (0, "30", 3, 7.0)], "qid long, doc string, rank int, score double")
    two = spark.createDataFrame([(0, "20", 1, 0.9), (0, "40", 2, 0.8)], "qid long, doc string, rank int, score double")
    got = {r.doc: r for r in rrf_fuse({"bm25": one, "embed": two}, 60).collect()}
    assert sorted(got, key=lambda d: (-got[d].fused, d)) == ["20", "10", "40", "30"]
    assert got["20"].fused == pytest.approx(1 / 62 + 1 / 61) and got["10"].embed_rank is None
    assert rrf_fuse({"bm25": one.limit(0), "embed": two}).count() == 2


def test_search_methods_and_filters(spark, docs):
    q = asked(spark, "rocket neutron", "  ", None)
    fused = search(docs, q, k=2).collect()
    assert {r.qid for r in fused} == {0} and min(fused, key=lambda r: r["rank"]).doc == "d1"
    single = search(docs, q, method="bm25").collect()
    assert all(r.score == r.bm25_score for r in single) and all(r.embed_rank for r in single)
    assert search(docs, q, filters={"ticker": "ABC"}).count() == 3
    assert search(docs, q, filters={"ticker": "nope"}).count() == 0
    with pytest.raises(ValueError):
        search(docs, q, method="other")
    with pytest.raises(ValueError):
        search(docs, q, k=0)


def test_dense_search(spark):
    rows = [(1, 7, [1.0, 0.0]), (2, 7, [2.0, 0.1]), (3, 8, [0.0, 1.0]), (4, 8, None), (5, 9, [0.0, 0.0]), (6, 9, [float("nan"), 1.0]), (3, 8, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, grp long, v array<float>")
    got = [(r.qid, r.doc, r["rank"]) for r in dense_top(df.where("id = 1"), df, "id", "id", "v", 5).orderBy("rank").collect()]
    assert got == [(1, 2, 1), (1, 3, 2)]
    pooled = dense_top(df.where("id = 1"), df, "id", "id", "v", 5, pool="grp").orderBy("rank").collect()
    assert [(r.doc, round(r.score, 3)) for r in pooled] == [(7, 0.999), (8, 0.0)]
    assert dense_top(df.limit(0), df, "id", "id", "v", 5).count() == 0
    assert dense_top(df, df.limit(0), "id", "id", "v", 5).count() == 0


def test_hashed_cosine(spark, docs):
    got = {r.doc: r.score for r in hashed_top(docs, asked(spark, "rocket engine"), "chunk_id", "qid", 5).collect()}
    assert got["d0"] == pytest.approx(2 / math.sqrt(6)) and got["d2"] == 0.0


def test_distributed_ranks(spark):
    rows = [("hot", float(i % 7), i) for i in range(200)] + [("cold", None, 1), ("cold", float("nan"), 2), ("cold", 5.0, 3), (None, 1.0, 4)]
    df = spark.createDataFrame(rows, "g string, v double, id long")
    numbered = row_numbers(df.where("g = 'hot'"), ["g"], [F.col("id").desc()], "n").collect()
    assert {r.id: r.n for r in numbered} == {i: 200 - i for i in range(200)}
    got = {(r.g, r.id): r.p for r in places(df, ["g"], "v", "p").collect()}
    for g, v, i in rows:
        same = [x for gg, x, _ in rows if gg == g]
        ok = [x for x in same if x is not None and x == x]
        want = 1 + (len(ok) if v is None or v != v else sum(x > v for x in ok))
        assert got[g, i] == want
    assert places(df.limit(0), ["g"], "v", "p").count() == 0
