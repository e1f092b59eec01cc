"""Problem 5: one consistent form for texts that look the same.

A text is cut into positioned segments: plain ASCII runs, which need nothing,
and clusters of one character with the marks that may combine with it, so there
are hardly more different ones than characters. Each *distinct* cluster is exploded into positioned code
points; a broadcast join with a Unicode table maps each code point to its
compatibility decomposition, folded to Latin look-alikes, plain quotes, dashes
and blanks, with characters without width gone. Combining marks are ordered by
class, pairs are recomposed, and the strings are rebuilt at their positions.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filigree.session import cut

# Letters of other scripts (and of phonetic Latin) that look like a
# Latin letter, each string beside the Latin letters it stands for.
LOOKALIKES = {
    # Cyrillic
    "АВЕЅІЈКМНОРСТУХЗӀҮԌԚԜһаеѕіјорсухԁԛԝӏүѵ": "ABESIJKMHOPCTYX3IYGQWhaesijopcyxdqwlyv",
    # Greek
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳοϲαινυρ": "ABEZHIKMNOPTYXCjocaivup",
    # Armenian
    "ՕՍօսոհցզ": "OUounhgq",
    # Latin letters of phonetic and other use
    "ɑɡıȷɩ": "agiji",
}
#: Quotation marks, apostrophes, hyphens and dashes, by the shape they are given.
QUOTES = {
    "'": "‘’‚‛′‵ʹʻʼʽˈˊˋ`´ꞌ＇‹›",
    '"': "“”„‟″‶«»〝〞〟＂ˮ",
    "-": "‐‑‒–—―−⁃⸺⸻﹘﹣－〜˗",
}
#: Characters without width besides Unicode's format class.
NO_WIDTH = "͏ᅟᅠ឴឵᠋᠌᠍᠎ㅤ"

# What may combine with, or vanish between, what stands before it: marks, format characters, fillers, kana voicing;
# and the letters of Hangul, which compose among themselves.
_EXTENDS = r"\p{M}\p{Cf}\uff9e\uff9f\u115f\u1160\u3164\uffa0"
_JAMO = r"\u1100-\u11ff\u3131-\u318e\ua960-\ua97f\ud7b0-\ud7ff\uffa0-\uffdc"
_CLUSTER = (
    rf"[\x00-\x7f]+(?![{_EXTENDS}])|[\x00-\x7f][{_EXTENDS}]+|[\uac00-\ud7a3{_JAMO}][{_JAMO}{_EXTENDS}]*|[^\x00-\x7f][{_EXTENDS}]*"
)


def _is_no_width(ch: str) -> bool:
    cp = ord(ch)
    return (
        unicodedata.category(ch) == "Cf"
        or ch in NO_WIDTH
        or 0xFE00 <= cp <= 0xFE0F
        or 0xE0100 <= cp <= 0xE01EF
    )


def _folds() -> dict[str, str]:
    pairs = {c: to for group, latin in LOOKALIKES.items() for c, to in zip(group, latin, strict=True)}
    return pairs | {c: to for to, group in QUOTES.items() for c in group}


def fold_char(ch: str, folds: dict[str, str]) -> str:
    """What one code point becomes before marks are ordered and recomposed."""
    if _is_no_width(ch):
        return ""
    if ch.isspace():
        return " "
    if ch in folds:
        return folds[ch]
    if 0xAC00 <= ord(ch) <= 0xD7A3:
        return ch  # Hangul syllables stay composed; jamo are composed below
    out = []
    for d in unicodedata.normalize("NFKD", ch):
        out.append("" if _is_no_width(d) else " " if d.isspace() else folds.get(d, d))
    return "".join(out)


@cache
def fold_rows() -> tuple[tuple[str, list[tuple[str, int]]], ...]:
    """(code point, [(mapped code point, combining class)]) where mapping or class says something.

    Its size is Unicode's, some 8,000 rows, whatever the data.
    """
    folds = _folds()
    rows = []
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3:
            continue
        ch = chr(cp)
        to = fold_char(ch, folds)
        if to != ch or unicodedata.combining(ch):
            rows.append((ch, [(c, unicodedata.combining(c)) for c in to]))
    return tuple(rows)


@cache
def compositions() -> dict[str, str]:
    """Every canonical pair that composes, by Unicode's own data (Hangul is arithmetic)."""
    pairs = {}
    for cp in range(0xC0, 0x30000):
        ch = chr(cp)
        d = unicodedata.decomposition(ch)
        if d and "<" not in d and " " in d and unicodedata.normalize("NFC", ch) == ch:
            pairs["".join(chr(int(x, 16)) for x in d.split())] = ch
    return pairs


def fold_python(text: str) -> str:
    """The same form computed directly; the tests' brute force."""
    folds = _folds()
    joined = "".join(fold_char(c, folds) for c in text)
    return " ".join(unicodedata.normalize("NFC", joined).split())


def _recompose(marks):
    """Fold ordered (starter no, class, i, j, ch) structs into a composed string."""
    pair = F.from_json(F.lit(json.dumps(compositions(), ensure_ascii=True)), "map<string,string>")
    start = F.struct(
        F.lit("").alias("done"), F.lit("").alias("starter"), F.lit("").alias("tail"), F.lit(0).alias("last")
    )

    def step(acc, m):
        a, b = F.ascii(acc["starter"]), F.ascii(m["ch"])
        # Leading and vowel jamo, and a syllable without a final with a final jamo.
        lv = (a >= 0x1100) & (a <= 0x1112) & (b >= 0x1161) & (b <= 0x1175)
        lvt = (a >= 0xAC00) & (a <= 0xD7A3) & ((a - 0xAC00) % 28 == 0) & (b >= 0x11A8) & (b <= 0x11C2)
        code = F.when(lv, ((a - 0x1100) * 21 + (b - 0x1161)) * 28 + 0xAC00).when(lvt, a + (b - 0x11A7))
        hangul = F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")
        composed = F.coalesce(hangul, F.element_at(pair, F.concat(acc["starter"], m["ch"])))
        free = (F.length(acc["starter"]) > 0) & ((F.length(acc["tail"]) == 0) | ((m["ccc"] > 0) & (acc["last"] < m["ccc"])))
        joins = free & composed.isNotNull()
        return (
            F.when(
                joins,
                F.struct(acc["done"].alias("done"), composed.alias("starter"), acc["tail"].alias("tail"), acc["last"].alias("last")),
            )
            .when(
                m["ccc"] == 0,
                F.struct(
                    F.concat(acc["done"], acc["starter"], acc["tail"]).alias("done"),
                    m["ch"].alias("starter"),
                    F.lit("").alias("tail"),
                    F.lit(0).alias("last"),
                ),
            )
            .otherwise(
                F.struct(
                    acc["done"].alias("done"),
                    acc["starter"].alias("starter"),
                    F.concat(acc["tail"], m["ch"]).alias("tail"),
                    m["ccc"].alias("last"),
                )
            )
        )

    return F.aggregate(marks, start, step, lambda a: F.concat(a["done"], a["starter"], a["tail"]))


def _clusters(spark: SparkSession, segments: DataFrame) -> DataFrame:
    """(seg, norm) for each distinct cluster of ``segments(seg)``."""
    table = spark.createDataFrame(
        [(c, [{"ch": x, "ccc": k} for x, k in to]) for c, to in fold_rows()],
        "c string, to array<struct<ch:string,ccc:int>>",
    )
    points = segments.groupBy("seg").agg(F.lit(1).alias("__one")).select(
        "seg", F.posexplode(F.split("seg", "")).alias("i", "c")
    ).where(F.length("c") > 0)
    mapped = points.join(F.broadcast(table), "c", "left").select(
        "seg",
        "i",
        F.posexplode_outer(
            F.coalesce("to", F.array(F.struct(F.col("c").alias("ch"), F.lit(0).alias("ccc"))))
        ).alias("j", "m"),
    )
    order = Window.partitionBy("seg").orderBy("i", "j").rowsBetween(Window.unboundedPreceding, 0)
    placed = mapped.withColumn(
        "k", F.sum(F.when(F.col("m.ccc") == 0, 1).otherwise(0)).over(order)
    )
    mark = F.struct("k", F.col("m.ccc").alias("ccc"), "i", "j", F.col("m.ch").alias("ch"))
    gathered = placed.groupBy("seg").agg(
        F.array_sort(F.collect_list(F.when(F.col("m").isNotNull(), mark))).alias("marks")
    )
    return gathered.select("seg", _recompose(F.col("marks")).alias("norm"))


def unify(df: DataFrame, key: str, text: str = "text", out: str = "unified") -> DataFrame:
    """Rows ``key, out``: each row's text in one consistent form.

    The form: Unicode compatibility decomposition, then canonical composition;
    letters that look Latin are Latin; quotation marks, apostrophes, hyphens and
    dashes have their ASCII shape; characters without width are gone; every run
    of blanks, line breaks included, is one space, and outer blanks are dropped.
    Case, accents, figures and words are kept. ``key`` must identify a text: one
    row comes out per distinct key and text. A null text stays null, an empty
    one stays empty. Columns other than ``key`` are not carried.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    plain = rows.where(F.col("t").isNull() | ~F.col("t").rlike(r"[^\x00-\x7f]")).select(
        "k", F.translate("t", "`", "'").alias("u")
    )
    special = rows.where(F.col("t").rlike(r"[^\x00-\x7f]"))
    clusters = special.select(
        "k", "t", F.posexplode(F.regexp_extract_all("t", F.lit(_CLUSTER), F.lit(0))).alias("pos", "seg")
    ).where(F.col("seg").rlike(r"[^\x00-\x7f]"))
    places = clusters.select("k", F.xxhash64("t").alias("h"), "pos", "seg")
    named = places.join(_clusters(spark, places.select("seg")).withColumnRenamed("seg", "s"), F.col("seg") == F.col("s"))
    mended = named.groupBy("k", "h").agg(F.collect_set(F.struct("pos", F.col("norm").alias("s"))).alias("mended"))
    whole = special.withColumn("h", F.xxhash64("t")).join(mended, ["k", "h"]).select(
        "k",
        F.regexp_extract_all("t", F.lit(_CLUSTER), F.lit(0)).alias("segs"),
        "mended",
    )
    kept = F.filter(
        F.transform("segs", lambda s, i: F.struct(i.alias("pos"), F.translate(s, "`", "'").alias("s"))),
        lambda x: ~x["s"].rlike(r"[^\x00-\x7f]"),
    )
    rebuilt = F.array_join(
        F.transform(F.array_sort(F.concat(kept, "mended")), lambda x: x["s"]), ""
    )
    joined = plain.unionByName(whole.select("k", rebuilt.alias("u")))
    blanks = F.trim(F.regexp_replace("u", r"[\t-\r\x1c-\x1f ]+", " "))
    return joined.select(F.col("k").alias(key), blanks.alias(out)).distinct()


def recognise(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """Claims whose quote is in its chunk only once unseen differences are set aside.

    ``claims(claim_id, chunk_id, quote)`` and ``chunks(chunk_id, text)`` give rows
    ``claim_id, chunk_id, quote_unified``. Repeated rows count once. Null quotes, unknown chunks and
    quotes that are nothing but blanks or characters without width are no case.
    """
    texts = chunks.select(F.col("chunk_id").alias("cid"), "text").dropDuplicates(["cid"])
    open_ = cut(
        claims.select("claim_id", "chunk_id", "quote")
        .where(F.col("quote").isNotNull() & F.col("chunk_id").isNotNull())
        .distinct()
        .join(texts, F.col("chunk_id") == F.col("cid"))
        .where(~F.contains("text", "quote"))
        .select("claim_id", "chunk_id", "quote", "text")
    )
    both = unify(
        open_.select(
            F.explode(
                F.array(
                    F.struct(F.concat(F.lit("q"), F.col("claim_id").cast("string")).alias("id"), F.col("quote").alias("t")),
                    F.struct(F.concat(F.lit("t"), F.col("chunk_id")).alias("id"), F.col("text").alias("t")),
                )
            ).alias("x")
        ).select("x.id", "x.t").distinct(),
        "id",
        "t",
        "u",
    )
    q = both.select(F.col("id").alias("qid"), F.col("u").alias("quote_unified"))
    t = both.select(F.col("id").alias("tid"), F.col("u").alias("text_unified"))
    return (
        open_.select("claim_id", "chunk_id")
        .join(q, F.concat(F.lit("q"), F.col("claim_id").cast("string")) == F.col("qid"))
        .join(t, F.concat(F.lit("t"), F.col("chunk_id")) == F.col("tid"))
        .where((F.length("quote_unified") > 0) & F.contains("text_unified", "quote_unified"))
        .select("claim_id", "chunk_id", "quote_unified")
    )
