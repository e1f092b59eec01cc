"""The black-box suite: cases of four types run against the service's operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.functions.text import facts_present
from filigree.operators.answer import Drafter, answer
from filigree.operators.evaluate import audit_citations, filter_scope, paraphrase_agreement, run_cases
from filigree.operators.search import search
from filigree.session import cut

SCOPES = {"expected_ticker": "ticker", "expected_form": "form", "expected_section": "section_key"}


def _checks(df: DataFrame, **named) -> DataFrame:
    pairs = [F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("ok")) for n, c in named.items()]
    return df.select("case_id", "type", F.explode(F.array(*pairs)).alias("c")).select("case_id", "type", "c.check", "c.ok")


def outcomes(cases: DataFrame, chunks: DataFrame, entities: DataFrame, drafter: Drafter | None = None, k: int = 8) -> DataFrame:
    """``case_id, type, check, ok`` for ``cases`` as ``sources.cases.read_cases`` gives them.

    All questions of the suite are answered as one batch. A correctness case must
    be answered and show every expected fact; a refusal must refuse, for the
    expected reason if one is stated; phrasings of one question must agree with
    each other and with ``expected_refused``, and where they are answered each
    must show the facts; a filter must give results, all in scope. Every claim of
    every answer is audited apart from the verifier.
    """
    c = cases.withColumnRenamed("id", "case_id")
    phrasings = F.coalesce(F.col("questions"), F.array("question"))
    asked = c.where("type <> 'filter'").select("case_id", F.posexplode(phrasings).alias("n", "text"))
    questions = asked.select(F.concat_ws("#", "case_id", F.col("n").cast("string")).alias("qid"), "text", "case_id")
    got = cut(answer(questions.select("qid", "text"), chunks, entities, drafter, k).join(questions.select("qid", "case_id"), "qid"))
    said = F.array_join(F.flatten(F.transform("claims", lambda x: F.array(x["statement"], x["quote"]))), " ")
    judged = c.join(got.select("case_id", "answered", F.col("refusal_reason").alias("why"), F.coalesce(said, F.lit("")).alias("said")), "case_id")
    facts = F.coalesce(facts_present(F.coalesce("expected_facts", F.array().cast("array<string>")), F.col("said")), F.lit(False))
    right = _checks(judged.where("type = 'correctness'"), answered=F.col("answered"), facts=facts)
    refused = _checks(
        judged.where("type = 'refusal'"),
        refused=~F.col("answered"),
        reason=F.col("expected_reason").isNull() | (F.col("expected_reason") == F.col("why")),
    )
    phrased = judged.where("type = 'robustness'")
    shown = phrased.groupBy("case_id").agg(F.bool_and(~F.col("answered") | F.coalesce("expected_refused", F.lit(False)) | facts).alias("facts"))
    same = paraphrase_agreement(phrased.select("case_id", (~F.col("answered")).alias("refused")))
    robust = _checks(
        same.join(c.where("type = 'robustness'"), "case_id").join(shown, "case_id"),
        agree=F.col("agree"),
        expected=F.col("all_answered") == ~F.coalesce("expected_refused", F.lit(False)),
        facts=F.col("facts"),
    )
    claims = got.where("answered").select("qid", "case_id", F.posexplode("claims").alias("n", "x")).select(
        F.concat_ws("#", "qid", F.col("n").cast("string")).alias("claim_id"), "qid", "case_id", "x.*"
    )
    retrieved = got.select("qid", F.explode("retrieved").alias("chunk_id"))
    sealed = chunks if "source_sha256" in chunks.columns else chunks.withColumn("source_sha256", F.lit(None).cast("string"))
    audit = audit_citations(claims, sealed, retrieved).join(claims.select("claim_id", "case_id"), "claim_id").join(c.select("case_id", "type"), "case_id")
    audited = _checks(audit, citation=F.col("ok"))
    parts = [right, refused, robust, audited]
    # Filter cases are files read on the driver, each with a scope of its own.
    for row in c.where("type = 'filter'").collect():
        wanted = {SCOPES[f]: row[f] for f in SCOPES if row[f]}
        one = cases.sparkSession.createDataFrame([(row["case_id"], row["query"])], "qid string, text string")
        hits = search(chunks, one, k=row["k"] or k, filters=wanted, entities=entities).select(F.col("qid").alias("case_id"), F.col("doc").alias("chunk_id"))
        where = chunks.select("chunk_id", "ticker", "form", "section_key").dropDuplicates(["chunk_id"])
        case = cases.sparkSession.createDataFrame(
            [(row["case_id"], *[row[f] for f in SCOPES])], "case_id string, expected_ticker string, expected_form string, expected_section_key string"
        )
        scoped = filter_scope(hits.join(where, "chunk_id"), case).withColumn("type", F.lit("filter"))
        parts.append(_checks(scoped, in_scope=F.col("in_scope")))
    return reduce(DataFrame.unionByName, parts)


def report(outcome: DataFrame, path: str | None = None) -> DataFrame:
    """``type, n_cases, n_passed``; with ``path`` the outcomes are also written as JSON lines."""
    if path:
        outcome.write.mode("overwrite").json(path)
    return run_cases(outcome)
