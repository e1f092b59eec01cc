"""From questions to verified claims: scoping, drafting, quote verification and refusals."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.functions.text import quote_verdict
from filigree.functions.vectors import Encoder
from filigree.operators.search import index_search, search
from filigree.session import cut, stored
from filigree.sources.index_store import Index

# Corporate suffixes that name nobody, and the three refusals.
SUFFIXES = ("inc", "corp", "corporation", "ltd", "llc", "co", "usa", "plc", "sa")
REFUSALS = ("retrieval_empty", "model_refusal", "all_claims_unverified")


def plain_words(text):
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def aliases(entities: DataFrame) -> DataFrame:
    """``alias, ticker, n_words``: tickers, names without corporate suffixes, and full names.

    ``entities(ticker, entity_name)``; a company without a name goes by its
    ticker. Of several companies the last ticker in order has a ticker or a short
    name; a full name is only used where neither has it, by the first.
    """
    name = F.coalesce(F.nullif(F.max("entity_name"), F.lit("")), F.col("ticker"))
    e = entities.where("ticker is not null").groupBy("ticker").agg(name.alias("name")).select("ticker", plain_words(F.col("name")).alias("w"))
    short = F.array_join(F.filter("w", lambda x: ~x.isin(*SUFFIXES)), " ")
    own = F.array(
        F.struct(F.lower("ticker").alias("alias"), F.lit(True).alias("strong")),
        F.struct(short.alias("alias"), F.lit(True).alias("strong")),
        # A name that is nothing but suffixes names nobody.
        F.struct(F.when(F.length(short) > 0, F.array_join("w", " ")).alias("alias"), F.lit(False).alias("strong")),
    )
    each = e.select("ticker", F.inline(own)).where(F.length("alias") > 0)
    best = each.groupBy("alias").agg(F.coalesce(F.max(F.when(F.col("strong"), F.col("ticker"))), F.min("ticker")).alias("ticker"))
    return best.select("alias", "ticker", F.size(F.split("alias", " ")).alias("n_words"))


def scope(questions: DataFrame, entities: DataFrame, key: str = "qid", text: str = "text") -> DataFrame:
    """``key, ticker``: the one company a question names, null if none or several.

    Names are found as word sequences: a question's word n-grams, for the lengths
    that names have, join the aliases by equality instead of testing every pair.
    """
    known = aliases(entities)
    longest = known.agg(F.max("n_words")).first()[0] or 1
    w = questions.select(F.col(key).alias("k"), plain_words(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    runs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.lit(longest)),
            lambda n: F.when(
                F.size("w") >= n,
                F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " ")),
            ).otherwise(F.array().cast("array<string>")),
        )
    )
    named = w.select("k", F.explode(F.array_distinct(runs)).alias("alias")).join(known, "alias")
    one = named.groupBy("k").agg(F.min("ticker").alias("lo"), F.max("ticker").alias("hi"))
    found = one.select("k", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("ticker"))
    return w.select("k").distinct().join(found, "k", "left").select(F.col("k").alias(key), "ticker")


def verify_claims(claims: DataFrame, chunks: DataFrame, retrieved: DataFrame | None = None) -> DataFrame:
    """``claims`` with ``verdict``; a chunk must exist and, given ``retrieved(qid, chunk_id)``, be retrieved for the question."""
    # Only cited chunks bring their text.
    cited = chunks.join(claims.select("chunk_id").distinct(), "chunk_id", "left_semi")
    texts = cited.groupBy(F.col("chunk_id").alias("__c")).agg(F.min("text").alias("__t"))
    out = claims.join(texts, F.col("chunk_id") == F.col("__c"), "left")
    known = F.col("__c").isNotNull()
    if retrieved is not None:
        r = retrieved.select(F.col("qid").alias("__q"), F.col("chunk_id").alias("__r")).distinct()
        out = out.join(r, (F.col("qid") == F.col("__q")) & (F.col("chunk_id") == F.col("__r")), "left")
        known = known & F.col("__r").isNotNull()
    return out.select(
        *[F.col(c) for c in claims.columns], quote_verdict(F.col("quote"), F.col("__t"), known).alias("verdict")
    )


def group_claims(verified: DataFrame) -> DataFrame:
    """``qid, n_claims, n_verified, dropped_claims, refusal_reason``: what is left of each answer."""
    good = F.col("verdict") == "verified"
    return verified.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_claims"), F.count_if(good).alias("n_verified"), F.count_if(~good).alias("dropped_claims")
    ).withColumn("refusal_reason", F.when(F.col("n_verified") == 0, REFUSALS[2]))


class Drafter(Protocol):
    """Turns retrieved chunks into claims: ``qid, answerable, refusal_reason, statement, chunk_id, quote``."""

    model_id: str

    def draft(self, retrieved: DataFrame) -> DataFrame: ...


class ExtractiveDrafter:
    """Deterministic: quotes the first sentence of the best chunks, one claim each."""

    model_id = "extractive-first-sentence"

    def __init__(self, claims: int = 3) -> None:
        self.claims = claims

    def draft(self, retrieved: DataFrame) -> DataFrame:
        sentence = F.regexp_extract(F.col("text"), r"(?s)^.{1,400}?(?:[.!?](?=\s|$)|$)", 0)
        return retrieved.where(F.col("rank") <= self.claims).select(
            "qid",
            F.lit(True).alias("answerable"),
            F.lit(None).cast("string").alias("refusal_reason"),
            sentence.alias("statement"),
            "chunk_id",
            sentence.alias("quote"),
        )


def prompts(retrieved: DataFrame, questions: DataFrame) -> DataFrame:
    """``qid, prompt``: the question, then its chunks by rank, each under its header line; missing fields are empty.

    ``retrieved(qid, rank, chunk_id, ticker, form, filing_date, section_title,
    text)``, at most k rows a question; ``questions(qid, text)``.
    """
    part = lambda c: F.coalesce(c, F.lit(""))
    piece = F.format_string(
        "[%s] %s %s filed %s — %s\n%s", *[part(c) for c in ("chunk_id", "ticker", "form", "filing_date", "section_title", "text")]
    )
    listed = retrieved.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", piece.alias("p")))).alias("p"))
    blocks = F.array_join(F.transform("p", lambda x: x["p"]), "\n\n---\n\n")
    asked = questions.select("qid", part("text").alias("q"))
    return listed.join(asked, "qid").select("qid", F.concat(F.lit("Question: "), "q", F.lit("\n\nChunks:\n\n"), blocks).alias("prompt"))


RECORD = {
    "ticker": "string", "form": "string", "filing_date": "string", "accession_number": "string", "section_key": "string", "section_title": "string",
    "char_start": "int", "char_end": "int", "source_path": "string", "source_sha256": "string",
}


def answer(
    questions: DataFrame,
    chunks: DataFrame,
    entities: DataFrame,
    drafter: Drafter | None = None,
    k: int = 8,
    index: Index | None = None,
    encoder: Encoder | None = None,
) -> DataFrame:
    """``qid, ticker, answered, refusal_reason, n_verified, dropped_claims, retrieved, claims`` for a batch ``questions(qid, text)``.

    A question that names one company is searched within it, to the full depth.
    No claim survives whose quote is not in a chunk retrieved for that question;
    if none does, or nothing was retrieved, or the drafter declines, the answer is
    a refusal. ``claims`` carry the cited chunk's record; fields that ``chunks``
    lacks are null. With an ``index``, a loaded one, it is searched, with the
    ``encoder`` it was built with, and ``chunks`` only give the records.
    """
    drafter = drafter or ExtractiveDrafter()
    scoped = cut(scope(questions, entities))
    asked = questions.select("qid", "text").join(scoped, "qid")
    if index is not None:
        kept = index_search(index, asked, k=k, within="ticker", encoder=encoder)
    else:
        kept = search(chunks, asked, k=k, entities=entities, within="ticker", encoder=encoder)
    kept = cut(kept.select("qid", F.col("doc").alias("chunk_id"), "rank"))
    found = chunks.join(kept.select("chunk_id").distinct(), "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
    for c, kind in RECORD.items():
        if c not in found.columns:
            found = found.withColumn(c, F.lit(None).cast(kind))
    record = stored(found.select("chunk_id", "text", *[F.col(c).cast(kind).alias(c) for c, kind in RECORD.items()]))
    retrieved = kept.join(record, "chunk_id")
    drafted = drafter.draft(retrieved)
    declined = drafted.where(~F.coalesce("answerable", F.lit(False))).groupBy("qid").agg(
        F.coalesce(F.min("refusal_reason"), F.lit(REFUSALS[1])).alias("why")
    )
    checked = verify_claims(drafted.where("answerable").select("qid", "statement", "chunk_id", "quote"), record, retrieved)
    cited = checked.join(record.drop("text"), "chunk_id", "left")
    good = F.when(F.col("verdict") == "verified", F.struct("statement", "chunk_id", "quote", *RECORD))
    claims = cited.groupBy("qid").agg(
        F.array_sort(F.collect_list(good)).alias("claims"), F.count_if(F.col("verdict") != "verified").alias("dropped_claims")
    )
    listed = kept.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("r"))
    joined = scoped.join(listed, "qid", "left").join(declined, "qid", "left").join(claims, "qid", "left")
    n = F.coalesce(F.size("claims"), F.lit(0))
    reason = F.when(F.col("r").isNull(), REFUSALS[0]).when(F.col("why").isNotNull(), F.col("why")).when(n <= 0, REFUSALS[2])
    return joined.select(
        "qid",
        "ticker",
        reason.isNull().alias("answered"),
        reason.alias("refusal_reason"),
        F.greatest(n, F.lit(0)).alias("n_verified"),
        F.coalesce("dropped_claims", F.lit(0)).alias("dropped_claims"),
        F.transform("r", lambda x: x["chunk_id"]).alias("retrieved"),
        "claims",
    )
