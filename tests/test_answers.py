import pytest
from pyspark.sql import functions as F

from filigree.api import InvalidRequest, Service
from filigree.operators import answer as A
from filigree.operators import evaluate as E

CHUNKS = [
    ("c1", "ACM", "10-K", "Business", "item_1", "Acme builds small rockets for research. It sells them abroad.", "s1"),
    ("c2", "ACM", "10-Q", "Risk Factors", "item_1a", "Launch delays could hurt our results of operations badly.", "s1"),
    ("c3", "GLX", "10-K", "Business", "item_1", "Globex sells weather machines to many governments.", "s2"),
]
ENTITIES = [("ACM", "Acme Inc."), ("GLX", "Globex Corp"), ("NUL", None), ("EMP", "")]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id string, ticker string, form string, section_title string, section_key string, text string, source_sha256 string").withColumns({"char_start": F.lit(0), "char_end": F.lit(60)})


@pytest.fixture(scope="module")
def entities(spark):
    return spark.createDataFrame(ENTITIES, "ticker string, entity_name string")


def questions(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "qid long, text string")


def test_scope(spark, entities):
    q = questions(spark, "What does Acme build?", "Is GLX profitable?", "Compare Acme and Globex", "Tell me about rocketry", None, "")
    got = {r.qid: r.ticker for r in A.scope(q, entities).collect()}
    assert got == {0: "ACM", 1: "GLX", 2: None, 3: None, 4: None, 5: None}


def test_aliases_are_whole_names(spark):
    named = spark.createDataFrame([("BLB", "Bravo Lake Bank Co."), ("RKL", "Rocket Lab USA, Inc."), ("ZZ", "RKL Corp"), ("QQ", "The Co"), ("SA", "SA Inc")], "ticker string, entity_name string")
    got = {r.alias: r.ticker for r in A.aliases(named).collect()}
    assert got == {
        "blb": "BLB", "bravo lake bank": "BLB", "bravo lake bank co": "BLB", "rocket lab": "RKL", "rocket lab usa inc": "RKL", "rkl": "ZZ", "rkl corp": "ZZ",
        "zz": "ZZ", "qq": "QQ", "the": "QQ", "the co": "QQ", "sa": "SA",
    }
    q = questions(spark, "Is the lake frozen?", "What does Bravo Lake Bank lend?", "rocket-lab launches", "Lab results")
    got = {r.qid: r.ticker for r in A.scope(q, named.where("ticker <> 'QQ'")).collect()}
    assert got == {0: None, 1: "BLB", 2: "RKL", 3: None}


def test_prompt(spark):
    rows = [("q", 2, "c2", "A", None, "2024", "Risk", "two"), ("q", 1, "c1", "A", "10-K", "2024", "Business", "one")]
    retrieved = spark.createDataFrame(rows, "qid string, rank int, chunk_id string, ticker string, form string, filing_date string, section_title string, text string")
    asked = spark.createDataFrame([("q", "why?")], "qid string, text string")
    assert A.prompts(retrieved, asked).first().prompt == (
        "Question: why?\n\nChunks:\n\n[c1] A 10-K filed 2024 — Business\none\n\n---\n\n[c2] A  filed 2024 — Risk\ntwo"
    )


def test_answers_and_refusals(spark, chunks, entities):
    got = {r.qid: r for r in A.answer(questions(spark, "What does Acme build?", "weather machines"), chunks, entities, k=2).collect()}
    assert got[0].answered and got[0].ticker == "ACM" and {c.chunk_id for c in got[0].claims} == {"c1", "c2"}
    assert got[1].answered and got[1].ticker is None
    assert got[0].claims[0].source_sha256 == "s1" and got[0].claims[0].char_end == 60 and set(got[0].retrieved) == {"c1", "c2"}

    class Liar:
        model_id = "liar"

        def draft(self, retrieved):
            return retrieved.select("qid", F.lit(True).alias("answerable"), F.lit(None).cast("string").alias("refusal_reason"), F.lit("x").alias("statement"), "chunk_id", F.lit("a quote nobody ever wrote").alias("quote"))

    class Silent(Liar):
        def draft(self, retrieved):
            return super().draft(retrieved).withColumn("answerable", F.lit(False))

    liar = A.answer(questions(spark, "Acme?"), chunks, entities, Liar(), k=2).first()
    assert (liar.answered, liar.refusal_reason, liar.dropped_claims) == (False, "all_claims_unverified", 2)
    assert A.answer(questions(spark, "Acme?"), chunks, entities, Silent()).first().refusal_reason == "model_refusal"
    assert A.answer(questions(spark, "EMP?"), chunks, entities).first().refusal_reason == "retrieval_empty"


def test_claims_need_a_chunk_retrieved_for_the_question(spark, chunks):
    claims = spark.createDataFrame([(1, "q1", "c1", "Acme builds small rockets"), (2, "q1", "c3", "Globex sells weather machines"), (3, "q1", None, "x" * 20)], "claim_id long, qid string, chunk_id string, quote string")
    retrieved = spark.createDataFrame([("q1", "c1")], "qid string, chunk_id string")
    v = A.verify_claims(claims, chunks, retrieved)
    assert {r.claim_id: r.verdict for r in v.collect()} == {1: "verified", 2: "unknown_chunk", 3: "unknown_chunk"}
    g = A.group_claims(v).first()
    assert (g.n_claims, g.n_verified, g.dropped_claims, g.refusal_reason) == (3, 1, 2, None)


def test_metrics(spark):
    results = spark.createDataFrame([("fused", "q1", "a", 1), ("fused", "q2", "b", 7), ("bm25", "q1", "x", 1), ("bm25", "q2", "b", 2)], "method string, qid string, doc string, rank int")
    gold = spark.createDataFrame([("q1", "a"), ("q2", "b"), ("q3", "c")], "qid string, doc string")
    hits = E.first_hits(results, gold, ("fused", "bm25"))
    m = {r.method: r for r in E.retrieval_metrics(hits).collect()}
    assert m["fused"].recall_at_5 == pytest.approx(1 / 3) and m["fused"].recall_at_10 == pytest.approx(2 / 3)
    assert m["fused"].mrr == pytest.approx((1 + 1 / 7) / 3)
    assert {r.bar: r.passed for r in E.bars(E.retrieval_metrics(hits)).collect()} == {"recall_at_5": False, "recall_at_10": False, "fused_not_worse": True}
    assert tuple(E.rescues(hits).first()) == (1, 1)


def test_gold_set_end_to_end(spark, chunks, entities):
    from filigree.operators.search import search

    kind = "qid string, type string, query string, filters map<string,string>, acceptable array<string>"
    gold = spark.createDataFrame([("g1", "x", "small rockets", None, ["c1"]), ("g2", "x", "launch delays", {"form": "10-q"}, ["c2"]), ("g3", "x", "weather", {}, ["c3"])], kind)
    decoys = spark.createDataFrame([("d1", "off_corpus", "zebra", None, None)], kind)

    def ask(q, method, k, filters):
        return search(chunks, q, k=k, method=method, filters=filters, entities=entities)

    windows = spark.createDataFrame([("c1", [1.0, 0.0]), ("c2", [0.99, 0.1411]), ("c3", [0.0, 1.0])], "doc string, v array<double>")
    got = E.evaluate_retrieval(ask, gold, decoys, windows)
    assert got["same"] and got["passed"] and {r.recall_at_5 for r in got["metrics"].collect()} == {1.0}
    medians = {r.kind: r.median_score for r in got["medians"].collect()}
    assert set(medians) == {"gold", "decoy"} and medians["decoy"] < medians["gold"]
    assert tuple(got["crowded"].first()) == (3, 2)


def test_audit(spark, chunks):
    rows = [(1, "q", "c1", "Acme builds small rockets", "s1", 0, 9), (2, "q", "c1", "made up out of whole cloth", "zz", 9, 3), (3, "q", "none", None, None, None, None)]
    claims = spark.createDataFrame(rows, "claim_id long, qid string, chunk_id string, quote string, source_sha256 string, char_start int, char_end int")
    got = {r.claim_id: r for r in E.audit_citations(claims, chunks, spark.createDataFrame([("q", "c1")], "qid string, chunk_id string")).collect()}
    assert got[1].ok and not got[2].ok and got[2].was_retrieved and not (got[2].verbatim or got[2].sha_matches or got[2].offsets_sane)
    assert not got[3].chunk_known and not got[3].ok


def test_cases(spark):
    hits = spark.createDataFrame([("f1", "c1", "acm", "10-K", "item_1"), ("f2", "c2", "ACM", "10-Q", "item_1a")], "case_id string, chunk_id string, ticker string, form string, section_key string")
    cases = spark.createDataFrame([("f1", "ACM", "10-K", None), ("f2", "ACM", "10-K", None), ("f3", None, None, None)], "case_id string, expected_ticker string, expected_form string, expected_section_key string")
    assert {r.case_id: r.in_scope for r in E.filter_scope(hits, cases).collect()} == {"f1": True, "f2": False, "f3": False}
    answers = spark.createDataFrame([("r1", True), ("r1", True), ("r2", True), ("r2", False)], "case_id string, refused boolean")
    assert {r.case_id: (r.agree, r.all_answered) for r in E.paraphrase_agreement(answers).collect()} == {"r1": (True, False), "r2": (False, False)}
    lat = spark.createDataFrame([("a", float(x)) for x in (5, 1, 9, 7)] + [("b", None)], "g string, v double")
    assert [tuple(r) for r in E.upper_median(lat, "g", "v").collect()] == [("a", 7.0, 9.0)]


def test_service(chunks, entities):
    s = Service(chunks, entities)
    assert s.health() == {"status": "ok", "n_chunks": 3, "tickers": ["ACM", "GLX"]}
    assert s.search("rockets", k=1, ticker="acm").first().doc == "c1"
    assert s.ask("What does Globex sell?").first().answered
    assert s.chunk("c2")["ticker"] == "ACM" and s.chunk("zz") is None
    for bad in (("", 3), ("  ", 3), ("x", 0), ("x", 51), ("x" * 2001, 3)):
        with pytest.raises(InvalidRequest):
            s.search(*bad)


def test_suite(spark, chunks, entities):
    from filigree.operators import harness
    from filigree.sources.cases import CASE

    fields = [f.split()[0] for f in CASE.split(", ")]
    rows = [
        {"id": "c1", "type": "correctness", "question": "What does Acme build?", "expected_facts": ["small ROCKETS"]},
        {"id": "c2", "type": "correctness", "question": "What does Acme build?", "expected_facts": ["submarines"]},
        {"id": "r1", "type": "refusal", "question": "EMP?", "category": "x", "expected_reason": "retrieval_empty"},
        {"id": "b1", "type": "robustness", "questions": ["Acme rockets?", "rockets of Acme"], "expected_refused": False, "expected_facts": ["rockets"]},
        {"id": "b2", "type": "robustness", "questions": ["Acme rockets?", "rockets of Acme"], "expected_refused": False, "expected_facts": ["submarines"]},
        {"id": "f1", "type": "filter", "query": "launch", "expected_form": "10-Q"},
        {"id": "f2", "type": "filter", "query": "launch", "expected_form": "20-F"},
    ]
    cases = spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], CASE)
    out = harness.outcomes(cases, chunks, entities, k=3)
    passed = {r.case_id: r.ok for r in out.groupBy("case_id").agg(F.bool_and("ok").alias("ok")).collect()}
    assert passed == {"c1": True, "c2": False, "r1": True, "b1": True, "b2": False, "f1": True, "f2": False}
    assert {r.type: (r.n_cases, r.n_passed) for r in harness.report(out).collect()}["filter"] == (2, 1)


def test_service_over_an_index(spark, chunks, entities, tmp_path):
    from filigree import cli
    from filigree.api import respond
    from filigree.sources.index_store import build_index, load_index

    path = str(tmp_path / "ix")
    build_index(chunks, entities, chunks.selectExpr("chunk_id as path", "source_sha256 as sha256"), path)
    s = Service(None, None, index=load_index(spark, path))
    status, got = respond(s, "POST", "/search", b'{"query": "rockets", "k": 2, "ticker": "acm"}')
    assert status == 200 and got["hits"][0]["record"]["chunk_id"] == "c1" and got["hits"][0]["record"]["ticker"] == "ACM"
    bare = Service(chunks, entities).search("weather machines of governments", k=3).collect()
    assert [(r.doc, round(r.score, 9)) for r in s.search("weather machines of governments", k=3).collect()] == [(r.doc, round(r.score, 9)) for r in bare]
    status, got = respond(s, "POST", "/ask", b'{"question": "What does Globex sell?"}')
    assert status == 200 and not got["refused"] and got["ticker"] == "GLX" and got["claims"][0]["chunk_id"] == "c3"
    assert respond(s, "GET", "/health")[1]["embedding_model"] == "hashed-512"
    assert respond(s, "GET", "/chunks/c2")[1]["form"] == "10-Q"
    assert [respond(s, *r)[0] for r in (("GET", "/chunks/zz"), ("GET", "/x"), ("POST", "/search", b'{"query": " "}'), ("POST", "/ask", b"{}"), ("POST", "/ask", b"?"))] == [404, 404, 422, 422, 422]
    gold = tmp_path / "gold.jsonl"
    gold.write_text('{"qid": "a", "type": "x", "query": "small rockets", "acceptable": ["zz"]}\n\n{"qid": "d", "type": "off_corpus", "query": "zebra"}\n')
    assert cli.main(["gold", path, str(gold)]) == 1
