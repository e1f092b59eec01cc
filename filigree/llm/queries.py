"""The training-data queries, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm import idealpoint, leakage, lookalike, mojibake, neardup, packing, repetition, split, vectors
from filigree.session import stored, table

SCORES = ["bm25_score", "embed_score", "score"]


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    # Deliveries of a chunk agree in its text; only long texts meet the shuffle.
    long = table(spark, d, "chunks").select("chunk_id", "text").where(F.length("text") > 4500)
    return split.split_oversized(long.groupBy("chunk_id").agg(F.min("text").alias("text")), ["chunk_id"])


def p1_covered(spark: SparkSession, d: str) -> DataFrame:
    """What has to hold of each oversized chunk's pieces: they reach from end to end, overlap as stated, and keep the limit."""
    p = p1_pieces(spark, d)
    per = p.groupBy("chunk_id").agg(
        F.max("char_end").alias("n_chars"),
        F.sum(F.length("piece_text") - F.col("overlap")).alias("fresh"),
        F.max(F.length("piece_text")).alias("longest"),
        F.min(F.when(F.col("piece_no") > 0, F.col("overlap")).otherwise(200)).alias("overlap"),
        (F.count(F.lit(1)) == F.max("n_pieces")).alias("whole"),
    )
    kept = (F.col("fresh") == F.col("n_chars")) & (F.col("longest") <= 4500) & (F.col("overlap") >= 200) & F.col("whole")
    return per.select("chunk_id", "n_chars", kept.alias("kept"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pieces(spark, d).select("chunk_id").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_pairs(table(spark, d, "chunks"), "chunk_id", "text", 3, 0.6, 40)


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, d, "chunks"), "chunk_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.similar_vectors(table(spark, d, "index_windows"), "window_id", "embedding")
    return near.select(
        F.least("id", "other").alias("window_id_a"), F.greatest("id", "other").alias("window_id_b")
    ).distinct()


def p3_traced(spark: SparkSession, d: str) -> DataFrame:
    """Every usable window's five most similar windows, however far, with the chunks both come from."""
    windows = table(spark, d, "index_windows")
    near = vectors.similar_vectors(windows, "window_id", "embedding", min_cosine=None, m=3)
    record = windows.where("window_id is not null").groupBy("window_id").agg(F.min("window_map").alias("record_no"))
    chunk = table(spark, d, "chunks").where("record_no is not null").groupBy("record_no").agg(F.min("chunk_id").alias("chunk_id"))
    origin = record.join(chunk, "record_no", "left").select("window_id", "chunk_id")
    return (
        near.join(origin.withColumnsRenamed({"window_id": "id", "chunk_id": "chunk_id_of"}), "id", "left")
        .join(origin.withColumnsRenamed({"window_id": "other", "chunk_id": "similar_chunk_id"}), "other", "left")
        .select(
            F.col("id").alias("window_id"),
            F.col("chunk_id_of").alias("chunk_id"),
            F.col("place").cast("int").alias("place"),
            F.col("other").alias("similar_window_id"),
            "similar_chunk_id",
            F.round("cosine", 2).alias("cosine"),
        )
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return idealpoint.leaders(table(spark, d, "retrieved_chunks"), "qid", "chunk_id", SCORES, **idealpoint.EQUAL_PLACES)


def p4_ranking(spark: SparkSession, d: str) -> DataFrame:
    ranked = idealpoint.ideal_point_ranking(table(spark, d, "retrieved_chunks"), "qid", "chunk_id", SCORES)
    return ranked.select("qid", "chunk_id", F.round("closeness", 6).alias("closeness"), "place")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.recognise(table(spark, d, "verified_claims"), table(spark, d, "chunks")).select("claim_id").distinct()


def p5_unified_chunks(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.unify(table(spark, d, "chunks").dropDuplicates(["chunk_id"]), "chunk_id")


def p5_unified_quotes(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "verified_claims").dropDuplicates(["claim_id"])
    return lookalike.unify(claims, "claim_id", "quote", "unified")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, "blocks"), ["doc", "ord"]).select("doc", "ord")


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, "blocks"), ["doc", "ord"])


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), "doc_id")


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """What has to hold of each text's pieces: in order from the first token, whole unless too large, in containers not overfull."""
    p = stored(p7_containers(spark, d))
    held = p.groupBy("container").agg(F.sum("n_tokens").alias("held"))
    per = p.join(held, "container").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pieces"),
        F.max("piece_no").alias("last"),
        F.sum("n_tokens").alias("tokens"),
        F.bool_and((F.col("held") == F.col("fill")) & (F.col("fill") <= packing.CAPACITY)).alias("fits"),
    )
    pieces = F.ceil(F.col("tokens") / packing.CAPACITY)
    kept = F.col("fits") & (F.col("pieces") == F.col("last") + 1) & (F.col("pieces") == pieces)
    return per.select("doc_id", kept.alias("kept"))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_spans(spark, d).select("doc_id", "item_id").distinct()


def p8_removal(spark: SparkSession, d: str) -> DataFrame:
    return leakage.removal_spans(p8_spans(spark, d))


def p9_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = repetition.line_first(table(spark, d, "documents"), "doc_id")
    return rows.withColumns({c: F.round(c, 9) for c in ("repeated_share", "lost_share")})


def p9_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Each document without its failing lines."""
    rows = repetition.line_first(table(spark, d, "documents"), "doc_id", keep=True)
    return rows.select("doc_id", "kept_text", "words_kept", "rejected")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents rejected for what removing boilerplate lines costs them; of these the exact share decides."""
    least = repetition.least_loss(0.30, 50)
    judged = repetition.line_first(table(spark, d, "documents"), "doc_id", max_loss=least - 1e-9, rules=("boilerplate",))
    exact = (F.col("n_words") >= 50) & (F.col("n_repeated") * 10 >= F.col("n_sequences") * 3)
    return judged.where(F.col("rejected") & exact).select("doc_id").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found,
        p1_pieces,
        p1_covered,
        p2_found,
        p2_groups,
        p3_found,
        p3_traced,
        p4_found,
        p4_ranking,
        p5_found,
        p5_unified_chunks,
        p5_unified_quotes,
        p6_found,
        p6_repaired,
        p7_containers,
        p7_kept,
        p8_found,
        p8_spans,
        p8_removal,
        p9_found,
        p9_lines,
        p9_cleaned,
    )
}
