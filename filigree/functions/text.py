"""Text functions as Column expressions; all but the NFKC form run inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What Python's str.split() takes as white space; Java's \s needs help with four controls.
_SPACE = r"(?U)[\s\x1c-\x1f]+"
#: Fixed value: letters and digits, with dots and hyphens kept inside ("10-k", "4.2").
TOKEN = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
#: Curly quotes, long dashes and the no-break space, and what they become.
_FOLD_FROM, _FOLD_TO = "’‘“”—– ", "''\"\"-- "
MIN_QUOTE_CHARS = 15
WINDOW_CHARS, WINDOW_STRIDE = 800, 600


def normalize(text: Column) -> Column:
    """Zero-width space and byte-order mark gone, white space runs one space, ends stripped."""
    return F.trim(F.regexp_replace(F.translate(text, "​﻿", ""), _SPACE, " "))


def decode_bytes(raw: Column) -> Column:
    """Struct (text, encoding): strict UTF-8, else Latin-1."""
    as_text = raw.cast("string")
    good = F.is_valid_utf8(as_text)
    return F.struct(
        F.when(good, as_text).otherwise(F.decode(raw, "ISO-8859-1")).alias("text"),
        F.when(raw.isNotNull(), F.when(good, F.lit("utf-8")).otherwise(F.lit("latin-1"))).alias("encoding"),
    )


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(normalize(text)), F.lit(TOKEN), F.lit(0))


def canonical(text: Column) -> Column:
    """Normalised, with punctuation in its plain shape; case counts."""
    return F.trim(F.regexp_replace(F.translate(normalize(text), _FOLD_FROM, _FOLD_TO), " +", " "))


@F.pandas_udf(StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def canonical_nfkc(text: Column) -> Column:
    """The auditor's own form: compatibility forms folded, punctuation plain, zero-width kept."""
    folded = F.translate(_nfkc(text), _FOLD_FROM, _FOLD_TO)
    return F.trim(F.regexp_replace(folded, _SPACE, " "))


def quote_verdict(quote: Column, chunk_text: Column, known: Column) -> Column:
    """'unknown_chunk', 'quote_too_short', 'quote_not_found' or 'verified', tried in this order."""
    q, t = canonical(quote), canonical(chunk_text)
    return (
        F.when(~F.coalesce(known, F.lit(False)), "unknown_chunk")
        .when(F.coalesce(F.length(normalize_ends(quote)), F.lit(0)) < MIN_QUOTE_CHARS, "quote_too_short")
        .when(~F.coalesce(F.contains(t, q), F.lit(False)), "quote_not_found")
        .otherwise("verified")
    )


def normalize_ends(text: Column) -> Column:
    """White space stripped at both ends only, as Python's str.strip() does."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def join_blocks(blocks: Column, include_tables: bool) -> Column:
    """Texts of an ARRAY<STRUCT<text, in_table, ...>> joined by a blank line."""
    kept = blocks if include_tables else F.filter(blocks, lambda b: ~b["in_table"])
    return F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")


def windows(text: Column, size: int = WINDOW_CHARS, stride: int = WINDOW_STRIDE) -> Column:
    """Overlapping slices of ``size`` at multiples of ``stride``; the last one reaches the end."""
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / F.lit(stride))).cast("int")
    slices = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * stride + 1, F.lit(size)))
    return F.when(text.isNotNull(), slices)


def enrich_header(ticker: Column, entity: Column, form: Column, filed: Column, period: Column, section: Column) -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (ticker, entity, form, filed, period, section)]
    return F.format_string("%s %s | %s filed %s period %s | %s", *parts)


def enriched(header: Column, text: Column) -> Column:
    return F.concat(header, F.lit(" | "), text)


def entity_name(facts_json: Column, ticker: Column) -> Column:
    return F.coalesce(F.nullif(F.get_json_object(facts_json, "$.entityName"), F.lit("")), ticker)


def pad_cik(cik: Column) -> Column:
    return F.lpad(cik.cast("bigint").cast("string"), 10, "0")


def chunk_id(accession: Column, order: Column) -> Column:
    return F.format_string("%s-%05d", F.replace(accession, F.lit("-"), F.lit("")), order.cast("int"))


def submissions_url(cik: Column) -> Column:
    return F.concat(F.lit("https://data.sec.gov/submissions/CIK"), pad_cik(cik), F.lit(".json"))


def facts_url(cik: Column) -> Column:
    return F.concat(F.lit("https://data.sec.gov/api/xbrl/companyfacts/CIK"), pad_cik(cik), F.lit(".json"))


def archive_url(cik: Column, accession: Column, document: Column) -> Column:
    """Archives take the unpadded number and the accession without dashes."""
    plain = F.replace(accession, F.lit("-"), F.lit(""))
    return F.concat_ws(
        "/", F.lit("https://www.sec.gov/Archives/edgar/data"), cik.cast("bigint").cast("string"), plain, document
    )


def _one_digit(n: Column, unit: int) -> Column:
    """``n / unit`` as a double, written with one digit after the point and rounded by its exact binary value."""
    x = n / F.lit(float(unit))
    below = F.floor(n / F.lit(unit // 10)).cast("long")  # whole tenths
    tenth = below % 10
    part = x - F.floor(x)
    # Each step is exact, or at least right in sign.
    over = (part * 8 - (tenth + 0.5)) + part * 2
    rounded = below + F.when((over > 0) | ((over == 0) & (tenth % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(rounded / 10).cast("string"), F.lit("."), (rounded % 10).cast("string"))


def human_size(n: Column) -> Column:
    """Decimal units, one digit after the point."""
    return (
        F.when(n >= 1_000_000, F.concat(_one_digit(n, 1_000_000), F.lit(" MB")))
        .when(n >= 1_000, F.concat(_one_digit(n, 1_000), F.lit(" KB")))
        .when(n.isNotNull(), F.concat(n.cast("string"), F.lit(" B")))
    )


def facts_present(patterns: Column, haystack: Column) -> Column:
    """Whether every regular expression is found, whatever the case."""
    return F.forall(patterns, lambda p: F.rlike(haystack, F.concat(F.lit("(?i)"), p)))


def offsets_sane(start: Column, end: Column) -> Column:
    return F.coalesce((start >= 0) & (end > start), F.lit(False))
