"""Packing of prose blocks into chunks: a run ends where the section changes or the target is passed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.functions.text import chunk_id

# Fixed values.
TARGET_CHARS, MAX_CHARS, JOINER = 3000, 4500, 2


def run_numbers(length: np.ndarray, key: np.ndarray, target: int = TARGET_CHARS) -> np.ndarray:
    """The chunk number of each block, in order."""
    out = np.empty(len(length), np.int32)
    chunk, held = 0, -1
    for i, n in enumerate(length.tolist()):
        if held >= 0 and (key[i] != key[i - 1] or held + JOINER + n > target):
            chunk, held = chunk + 1, -1
        held = n if held < 0 else held + JOINER + n
        out[i] = chunk
    return out


def pack_chunks(blocks: DataFrame, target: int = TARGET_CHARS, limit: int = MAX_CHARS) -> DataFrame:
    """``doc, chunk_order, n_blocks, oversized, char_start, char_end, section_key, section_title, text``.

    ``blocks(doc, ord, text, char_start, char_end, in_table, section_key,
    section_title)``. Every prose block lands in exactly one chunk; table blocks
    in none. Lengths alone go to the kernel; texts are joined in the JVM.
    """
    prose = blocks.where(~F.coalesce(F.col("in_table"), F.lit(False)) & F.col("text").isNotNull() & F.col("doc").isNotNull())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable")
        pdf["chunk_order"] = run_numbers(pdf["n"].to_numpy(), pdf["section_key"].fillna("").to_numpy(), target)
        return pdf[["doc", "ord", "chunk_order"]]

    numbered = (
        prose.select("doc", "ord", F.length("text").alias("n"), "section_key")
        .groupBy("doc")
        .applyInPandas(run, "doc string, ord int, chunk_order int")
        .select(F.col("doc").alias("d"), F.col("ord").alias("o"), "chunk_order")
    )
    placed = prose.join(numbered, (F.col("doc") == F.col("d")) & (F.col("ord") == F.col("o")))
    b = F.struct("ord", "text", "char_start", "char_end", "section_key", "section_title")
    packed = placed.groupBy("doc", "chunk_order").agg(F.array_sort(F.collect_list(b)).alias("b"))
    first, last = F.col("b")[0], F.element_at("b", -1)
    return packed.select(
        "doc",
        "chunk_order",
        F.size("b").alias("n_blocks"),
        ((F.size("b") == 1) & (F.length(first["text"]) > limit)).alias("oversized"),
        first["char_start"].alias("char_start"),
        last["char_end"].alias("char_end"),
        first["section_key"].alias("section_key"),
        first["section_title"].alias("section_title"),
        F.array_join(F.transform("b", lambda x: x["text"]), "\n\n").alias("text"),
    )


def with_chunk_ids(chunks: DataFrame, accession: str = "doc") -> DataFrame:
    return chunks.withColumn("chunk_id", chunk_id(F.col(accession), F.col("chunk_order")))
