"""Problem 1: cut oversized texts into overlapping pieces at natural boundaries.

One bounded-quantifier regular expression consumes a text from left to right.
Its alternatives are ordered by the strength of the boundary they end at; the
last takes bare characters, so every text is covered without gaps. Offsets are
prefix sums over the pieces' lengths, and a lookback from each piece's start
supplies the overlap. All of it is SQL array functions; no row leaves the JVM
and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How far beyond the stated overlap a piece may reach back to start at a word.
SLACK = 64


def boundary_pattern(budget: int) -> str:
    """Pieces of at most ``budget`` code points, the strongest boundary first."""
    half = max(1, budget // 2)
    far, near = f".{{{half},{budget}}}", f".{{1,{budget}}}"
    sentence = r"(?<=[.!?。！？…][\"'”’)\]]{0,2}\s)"
    return "(?s)" + "|".join(
        [
            near + r"\z",
            far + r"(?<=\n[ \t]{0,8}\n)",
            far + r"(?<=\n)",
            far + sentence,
            far + r"(?<=[;:]\s)",
            far + r"(?<=,\s)",
            far + r"(?<=\s)",
            near + sentence,
            near + r"(?<=\s)",
            far + r"(?![\p{M}‍️])(?<!‍)",
            near,
        ]
    )


def split_oversized(
    df: DataFrame,
    keys: list[str],
    text: str = "text",
    limit: int = 4500,
    overlap: int = 200,
) -> DataFrame:
    """Rows ``keys, piece_no, n_pieces, char_start, char_end, overlap, piece_text``.

    Only texts longer than ``limit`` code points are cut; ``char_start`` and
    ``char_end`` are code-point offsets into the text, and ``piece_text`` is
    exactly that slice, never longer than ``limit``. A piece shares at least
    ``overlap`` code points with the one before it, and up to 64 more where that
    lets it start at a word; the column ``overlap`` states how many (0 for the
    first). Null and empty texts and texts within the limit give no rows. Equal
    keys are cut once each as given: repeated rows give repeated pieces. Columns
    other than ``keys`` are not carried, so their names cannot clash.
    """
    budget = limit - overlap - SLACK
    if overlap < 0 or overlap + SLACK > budget // 2:
        raise ValueError("overlap must be far smaller than the limit")
    starts = F.aggregate(
        F.transform("__cores", lambda c: F.length(c)),
        F.array(F.lit(0)),
        lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)),
    )
    # Exploded from an array of one, each value is computed once a row; in a projection alone it might be, for each use.
    once = lambda value, name: F.explode(F.array(value)).alias(name)
    cut = (
        df.select(*keys, F.col(text).alias("__text"))
        .where(F.length("__text") > limit)
        .select(*keys, once(F.regexp_extract_all(F.col("__text"), F.lit(boundary_pattern(budget)), F.lit(0)), "__cores"))
        .select(*keys, "__cores", once(starts, "__starts"))
    )

    def piece(core, i):
        start = F.element_at("__starts", i + 1)
        # Of any two neighbouring cores one is long, so the two before hold all that a lookback can reach.
        held = F.concat(F.coalesce(F.get("__cores", i - 2), F.lit("")), F.coalesce(F.get("__cores", i - 1), F.lit("")))
        look = F.right(held, F.lit(overlap + SLACK))
        # Of the 64 characters before the stated overlap, what follows their last blank.
        before = F.substring(look, F.lit(1), F.greatest(F.length(look) - overlap, F.lit(0)))
        reach = F.when(before.rlike(r"\s\S*$"), F.length(F.regexp_extract(before, r"\s(\S*)$", 1))).otherwise(F.lit(0))
        back = F.when(i == 0, F.lit(0)).otherwise(F.least(F.lit(overlap), start) + reach)
        return F.struct(
            (start - back).alias("char_start"),
            (start + F.length(core)).alias("char_end"),
            back.alias("overlap"),
            F.concat(F.right(look, back), core).alias("piece_text"),
        )

    # Pieces are made of neighbouring cores: no offset into the whole text is sought, and the text is not copied beside them.
    pieces = F.transform("__cores", piece)
    made = cut.select(*keys, F.size("__cores").alias("n_pieces"), pieces.alias("__pieces"))
    return made.select(*keys, "n_pieces", F.posexplode("__pieces").alias("piece_no", "__p")).select(
        *keys, "piece_no", "n_pieces", "__p.char_start", "__p.char_end", "__p.overlap", "__p.piece_text"
    )
