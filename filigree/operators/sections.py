"""Section labels of filings: heading candidates, the best chain of them, and labels filled forward."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# The items of the two forms, in their canonical sequence.
ITEMS_10K = (
    ("1", "Business"),
    ("1A", "Risk Factors"),
    ("1B", "Unresolved Staff Comments"),
    ("1C", "Cybersecurity"),
    ("2", "Properties"),
    ("3", "Legal Proceedings"),
    ("4", "Mine Safety Disclosures"),
    ("5", "Market for Registrant's Common Equity, Related Stockholder Matters and Issuer Purchases of Equity Securities"),
    ("6", "Reserved"),
    ("7", "Management's Discussion and Analysis of Financial Condition and Results of Operations"),
    ("7A", "Quantitative and Qualitative Disclosures About Market Risk"),
    ("8", "Financial Statements and Supplementary Data"),
    ("9", "Changes in and Disagreements with Accountants on Accounting and Financial Disclosure"),
    ("9A", "Controls and Procedures"),
    ("9B", "Other Information"),
    ("9C", "Disclosure Regarding Foreign Jurisdictions that Prevent Inspections"),
    ("10", "Directors, Executive Officers and Corporate Governance"),
    ("11", "Executive Compensation"),
    ("12", "Security Ownership of Certain Beneficial Owners and Management and Related Stockholder Matters"),
    ("13", "Certain Relationships and Related Transactions, and Director Independence"),
    ("14", "Principal Accountant Fees and Services"),
    ("15", "Exhibits and Financial Statement Schedules"),
    ("16", "Form 10-K Summary"),
)
PART1_10Q = (
    ("1", "Financial Statements"),
    ("2", "Management's Discussion and Analysis of Financial Condition and Results of Operations"),
    ("3", "Quantitative and Qualitative Disclosures About Market Risk"),
    ("4", "Controls and Procedures"),
)
PART2_10Q = (
    ("1", "Legal Proceedings"),
    ("1A", "Risk Factors"),
    ("2", "Unregistered Sales of Equity Securities and Use of Proceeds"),
    ("3", "Defaults Upon Senior Securities"),
    ("4", "Mine Safety Disclosures"),
    ("5", "Other Information"),
    ("6", "Exhibits"),
)
PARTS_10Q = ("Part I — Financial Information", "Part II — Other Information")

# How headings look, how long a title may trail, and how much a matching title weighs.
ITEM_PATTERN = r"(?i)^item\s+(\d{1,2})\s*([a-c])?\s*[.:]?\s*(.*)$"
ITEM_PATTERN_STRICT = r"(?i)^item\s+(\d{1,2})\s*([a-c](?![a-z]))?\s*[.:]?\s*(.*)$"
PART_PATTERN = r"(?i)^part\s+(i{1,3}|iv)\b[\s.:—–-]*(.{0,80})$"
MAX_TRAILING = 120
ALIKE, ALIKE_BONUS = 0.55, 0.5
PREAMBLE = ("preamble", "Preamble")


def slot_rows() -> list[tuple[str, str, int, str, str, bool]]:
    """(form, token, seq, key, title, is_part): every place in a form's sequence."""
    rows = [("10-K", f"ITEM{c}", i, f"item_{c.lower()}", t, False) for i, (c, t) in enumerate(ITEMS_10K)]
    seq = 0
    for part, (items, title) in enumerate(zip((PART1_10Q, PART2_10Q), PARTS_10Q), start=1):
        rows.append(("10-Q", "PART" + "I" * part, seq, f"part{part}", title, True))
        seq += 1
        for code, name in items:
            rows.append(("10-Q", f"ITEM{code}", seq, f"part{part}_item{code.lower()}", name, False))
            seq += 1
    return rows


def section_slots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        slot_rows(), "form string, token string, seq_index int, key string, title string, is_part boolean"
    )


@F.pandas_udf(DoubleType())
def title_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Similarity of two titles regardless of case (matching-blocks ratio)."""
    for a, b in pairs:
        yield pd.Series(
            [difflib.SequenceMatcher(None, (x or "").casefold(), (y or "").casefold()).ratio() for x, y in zip(a, b)],
            dtype=float,
        )


def heading_candidates(blocks: DataFrame, strict: bool = False) -> DataFrame:
    """Blocks that may be headings, once per slot: ``doc, ord, char_start, seq_index, key, title, is_part, weight``.

    ``blocks(doc, ord, text, char_start, in_table, form)``; table blocks and other forms give none. An
    item whose title runs on too long is no candidate, not even as a part. With
    ``strict`` a letter suffix must not be the start of a word.
    """
    item = ITEM_PATTERN_STRICT if strict else ITEM_PATTERN
    t = F.col("text")
    is_item, is_part = t.rlike(item), t.rlike(PART_PATTERN)
    trailing = F.regexp_extract(t, item, 3)
    token = F.when(
        is_item, F.concat(F.lit("ITEM"), F.regexp_extract(t, item, 1), F.upper(F.regexp_extract(t, item, 2)))
    ).otherwise(F.concat(F.lit("PART"), F.upper(F.regexp_extract(t, PART_PATTERN, 1))))
    found = (
        blocks.where(~F.coalesce(F.col("in_table"), F.lit(False)) & (is_item | is_part))
        .where(~is_item | (F.length(trailing) <= MAX_TRAILING))
        .select("doc", "ord", "char_start", "form", token.alias("token"), F.when(is_item, trailing).otherwise("").alias("trailing"))
    )
    joined = found.join(F.broadcast(section_slots(blocks.sparkSession)), ["form", "token"])
    alike = (F.length("trailing") > 0) & (title_ratio(F.col("trailing"), F.col("title")) >= ALIKE)
    weight = F.when(F.col("is_part"), 1.5).otherwise(F.when(alike, 1 + ALIKE_BONUS).otherwise(1.0))
    return joined.select("doc", "ord", "char_start", "seq_index", "key", "title", "is_part", weight.alias("weight"))


def best_chain(order: np.ndarray, seq: np.ndarray, weight: np.ndarray) -> list[int]:
    """Positions of the heaviest chain increasing in both; the earliest among equals."""
    best = weight.astype(float).copy()
    back = np.full(len(best), -1)
    for i in range(1, len(best)):
        before = np.flatnonzero((order[:i] < order[i]) & (seq[:i] < seq[i]))
        if len(before):
            j = before[best[before].argmax()]
            best[i] += best[j]
            back[i] = j
    chain, at = [], int(best.argmax()) if len(best) else -1
    while at >= 0:
        chain.append(at)
        at = int(back[at])
    return chain[::-1]


def detect_headings(blocks: DataFrame, strict: bool = False) -> DataFrame:
    """``doc, ord, char_start, key, title, is_part``: each document's best chain of headings.

    Only candidates, a few dozen rows a document, go to the grouped kernel.
    """
    schema = "doc string, ord int, char_start int, key string, title string, is_part boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ord", "seq_index"], kind="stable").reset_index(drop=True)
        chain = best_chain(pdf["ord"].to_numpy(), pdf["seq_index"].to_numpy(), pdf["weight"].to_numpy())
        return pdf.loc[chain, ["doc", "ord", "char_start", "key", "title", "is_part"]]

    return heading_candidates(blocks, strict).groupBy("doc").applyInPandas(run, schema)


def fill_forward(value: Column, first: str, doc: str = "doc", order: str = "ord") -> Column:
    """The latest non-null ``value`` at or before each block of its document."""
    upto = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(value, ignorenulls=True).over(upto), F.lit(first))


def assign_sections(blocks: DataFrame, headings: DataFrame) -> DataFrame:
    """``blocks`` with ``section_key`` and ``section_title``: an as-of join as one window per document."""
    marks = headings.select(
        F.col("doc").alias("hd"), F.col("ord").alias("ho"), F.col("key").alias("hk"), F.col("title").alias("ht")
    )
    joined = blocks.join(marks, (F.col("doc") == F.col("hd")) & (F.col("ord") == F.col("ho")), "left")
    return joined.select(
        *[F.col(c) for c in blocks.columns],
        fill_forward(F.col("hk"), PREAMBLE[0]).alias("section_key"),
        fill_forward(F.col("ht"), PREAMBLE[1]).alias("section_title"),
    )
