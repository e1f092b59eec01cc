"""Problem 2: near-duplicate texts, by bottom-k sketches of one hash function.

1. A text becomes the set of its distinct word sequences, hashed once. Texts with
   the same set are one class; only classes take part below.
2. A class keeps the smallest hashes of its longer sequences (``listed_words``):
   texts alike at the threshold keep whole passages, while stock phrases that
   thousands of texts share stay shorter. Inverted lists of the retained values
   bring pairs together.
3. A list over ``HOT`` is a stock passage and is not paired. Its texts, and those
   too short to be sure of an unbroken passage, are listed under their rarest
   compared sequences instead: two sets at the threshold share one of these for
   certain, so no pair is lost. What is still long is cut into blocks, each a
   join key of its own.
4. Each class carries a bitmap of its whole set. Every bit in which two bitmaps
   differ stands for a sequence that only one of the sets has, so a pair with too
   many of them is a sure miss and goes where it meets, before it is written.
5. The full sets decide. They are cut again from the texts of the pairs left.

Chance meetings in lists grow as the square of the collection, true pairs do not;
hence nothing is stored or shuffled for a pair before 4. Lists and pairs are
worked off in slices that weigh about as much as the texts, and each slice's
shuffle files go when its pairs are written.

Everything is array functions and joins in the JVM.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.session import added, cut, remove, scratch

#: Hashes kept for the lists.
LIST_SKETCH = 96
#: Most words of a listed sequence.
LISTED = 8
#: Texts under SURE listed sequences' lengths may lack an unbroken passage; one under SHORT may have such a partner.
SURE, SHORT = 3, 8
#: Texts that share a retained value, above which it is a stock passage: there, comparing bitmaps costs a text more than listing its rarest sequences.
HOT = 20_000
#: Longest piece of an inverted list that one join key holds.
BLOCK = 1000
#: Words of 64 bits in a bitmap.
BITMAP = 16
#: Bytes on disk: a word of text, a listed value before and after bitmaps are brought to it, a member of a set.
WORD, VALUE, POSTING, MEMBER = 3, 16, 180, 8
#: Bytes that a slice's files may weigh besides what the texts weigh.
SLICE = 16_000_000


def words(text: Column) -> Column:
    """Maximal runs of Unicode letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def sequences(tokens: Column, n: int) -> Column:
    """Hashes of the ``n``-word sequences in order; empty below ``n`` words."""
    at = F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0)))
    hashed = F.transform(at, lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(n)]))
    return F.when(F.size(tokens) >= n, hashed).otherwise(F.array().cast("array<bigint>"))


def passages(hashed: Column, n: int, long: int) -> Column:
    """Hashes of the ``long``-word sequences, from those of the ``n``-word sequences that cover them."""
    steps = [*range(0, long - n, n), long - n]
    at = F.sequence(F.lit(0), F.greatest(F.size(hashed) - 1 - (long - n), F.lit(0)))
    made = F.transform(at, lambda i: F.xxhash64(*[F.get(hashed, i + j) for j in steps]))
    return F.when(F.size(hashed) > long - n, made).otherwise(F.array().cast("array<bigint>"))


def smallest(hashed: Column, k: int | None = None) -> Column:
    """The distinct values in order, or the first ``k`` of them."""
    ordered = F.sort_array(F.array_distinct(hashed))
    return ordered if k is None else F.slice(ordered, 1, k)


def listed_words(n: int, threshold: float) -> int:
    """Words of a listed sequence.

    At a similarity t of sets of ``n``-word sequences a share 2t / (1 + t) of them
    is whole, so evenly spread edits are n / (1 - share) words apart. A passage of
    three quarters of that leaves a quarter of the passages whole: a pair shares
    none of the retained values with a chance below 1e-6. Never under ``n``.
    """
    apart = n / (1 - 2 * threshold / (1 + threshold)) if threshold < 1 else float("inf")
    return max(n, min(LISTED, int(0.75 * apart + 1e-9) - 1))


def bitmap(grams: Column) -> Column:
    """Bits of a set's hashes by their highest bits, from ``grams`` with the least hash of each word but the first sorted in."""
    starts = [-(1 << 63) + k * ((1 << 64) // BITMAP) for k in range(1, BITMAP)]
    at = [F.lit(0), *[F.array_position(grams, F.lit(s)).cast("int") for s in starts], F.size(grams) + 1]
    shift = 64 - 6 - (BITMAP - 1).bit_length()
    bit = lambda g: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(g, shift).cast("int"))
    return F.array(
        *[
            F.aggregate(F.slice(grams, at[k] + 1, at[k + 1] - at[k] - 1), F.lit(0).cast("bigint"), lambda m, g: m.bitwiseOR(bit(g)))
            for k in range(BITMAP)
        ]
    )


def starts_in(grams: Column) -> Column:
    """``grams`` as ``bitmap`` reads them."""
    return F.sort_array(F.concat(grams, F.array(*[F.lit(-(1 << 63) + k * ((1 << 64) // BITMAP)) for k in range(1, BITMAP)])))


def digest(grams: Column) -> Column:
    """128 bits that stand for a whole set."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), grams)), 16, "0") for seed in (1, 2)]))


def _cut(rows: DataFrame, n: int, least: int) -> DataFrame:
    """``rows`` with words ``w`` for the text ``t``, where there are enough."""
    # Exploded, so that the filter stays above it and texts are cut into words once.
    return rows.select("*", F.explode(F.array(words(F.col("t")))).alias("w")).drop("t").where(F.size("w") >= least)


class Texts:
    """The texts of a table, their classes, and the folder that holds what is known of them.

    ``ids`` has ``id, cls`` per distinct key with enough words; ``reps`` has ``cls, row,
    id, n, short`` per class: its number, a key that has it, its set's size. ``cls``
    is a digest of the whole set: equal sets, and only they, share it. ``lists`` has
    ``row, listed, bits`` of every text, copies too; sets are not stored.
    """

    def __init__(self, df: DataFrame, key: str, text: str, n: int, threshold: float, min_words: int) -> None:
        self.spark, self.n, self.threshold, self.least = df.sparkSession, n, threshold, max(n, min_words)
        self.folder = scratch(self.spark, "neardup")
        self.rows = df.select(F.col(key).alias("id"), F.col(text).alias("t")).where("id is not null and t is not null")
        long = listed_words(n, threshold)
        short = (F.size("w") < SHORT * long) if min_words < SURE * long else F.lit(False)
        listed = smallest(passages(F.col("h"), n, long), LIST_SKETCH) if long > n else F.slice("grams", 1, LIST_SKETCH)
        sets = self.keep(
            "lists",
            _cut(self.rows, n, self.least)
            .select("id", short.alias("short"), sequences(F.col("w"), n).alias("h"))
            .select("id", "short", "h", smallest(F.col("h")).alias("grams"))
            .select("id", "short", F.size("grams").alias("n"), digest(F.col("grams")).alias("cls"), listed.alias("listed"), starts_in(F.col("grams")).alias("g"))
            .select("id", F.monotonically_increasing_id().alias("row"), "cls", "n", "short", "listed", bitmap(F.col("g")).alias("bits")),
        )
        first = sets.groupBy("cls").agg(F.min(F.struct("row", "id", "n", "short")).alias("first"))
        self.reps = self.keep("reps", first.select("cls", "first.*"))
        # Deliveries of a key agree in their text; if they did not, the least digest would stand.
        self.ids = self.keep("ids", sets.select("id", "cls").groupBy("id").agg(F.min("cls").alias("cls")))
        self.lists = sets.select("row", "listed", "bits")
        #: About what the texts weigh on disk, and so may a slice's files.
        self.weight = WORD * (self.reps.agg(F.sum("n")).first()[0] or 0) + SLICE

    def keep(self, name: str, df: DataFrame, *by: str) -> DataFrame:
        return added(df, f"{self.folder}/{name}", *by)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.folder}/{name}")

    def slices(self, weight: float) -> int:
        return max(1, math.ceil(weight / self.weight))

    def sets(self, rows: DataFrame) -> DataFrame:
        """``row, grams`` for the classes of ``rows(row)``, cut from their texts again."""
        named = self.reps.select("row", "id", "cls").join(rows, "row")
        again = (
            _cut(self.rows.join(named, "id"), self.n, self.least)
            .select("id", "row", "cls", smallest(sequences(F.col("w"), self.n)).alias("grams"))
            .where(digest(F.col("grams")) == F.col("cls"))
        )
        return again.groupBy("id", "row").agg(F.first("grams").alias("grams")).select("row", "grams")


def _rare(texts: Texts, flagged: DataFrame) -> DataFrame:
    """``row, v, df``: classes under their rarest sequences.

    Two sets of s and more at the threshold share a value among the s - t + 1 rarest, t = threshold * s.
    """
    few = texts.keep("few", texts.sets(flagged).select("row", F.size("grams").alias("n"), F.explode("grams").alias("v")))
    seen = few.groupBy("v").agg(F.count(F.lit(1)).alias("df"))
    first = F.col("n") - F.ceil(F.col("n") * texts.threshold - 1e-9).cast("int") + 1
    rare = (
        few.join(seen, "v")
        .groupBy("row", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("e"))
        .select("row", F.explode(F.slice("e", F.lit(1), first)).alias("e"))
        .select("row", "e.v", "e.df")
        .where("df > 1")
    )
    rare = texts.keep("rare", rare)
    texts.drop("few")
    return rare


def _meet(texts: Texts, name: str, postings: DataFrame, n: int) -> None:
    """Add to the table ``met`` the pairs of ``postings(row, v, df)``, ``n`` rows, that share a value and whose bitmaps don't rule them out."""
    t, slices = texts.threshold, texts.slices(POSTING * n)
    brought = texts.reps.select("row", "n").join(texts.lists.select("row", "bits"), "row")
    if slices > 1:
        postings = texts.keep(name, postings.select("row", "v", "df", F.pmod(F.xxhash64("v"), F.lit(slices)).cast("int").alias("slice")), "slice")
    for k in range(slices):
        chosen = postings.where(F.col("slice") == k) if slices > 1 else postings
        mapped = chosen.select("row", "v", "df").join(brought, "row").withColumn("blocks", F.ceil(F.col("df") / BLOCK).cast("int"))
        # Of a pair one stands in every block and the other in its own. Both sides are one plan, shuffled once; hence no condition on one side alone.
        spread = mapped.select(
            "row", "n", "bits", "v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"), F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("own")
        )
        x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
        here = x("own") + y("own") == x("own") + y("blk")
        size = F.least(x("n"), y("n")) >= F.lit(t) * F.greatest(x("n"), y("n")) - 1e-9
        apart = reduce(add, [F.bit_count(F.get(x("bits"), F.lit(i)).bitwiseXOR(F.get(y("bits"), F.lit(i)))) for i in range(BITMAP)])
        # Sets at the threshold differ in (1 - t) / (1 + t) of their sizes' sum at most.
        close = apart <= (x("n") + y("n")) * F.lit((1 - t) / (1 + t)) + 1e-6
        alike = (x("v") == y("v")) & (x("blk") == y("blk")) & (x("row") < y("row")) & here & size & close
        met = spread.alias("x").join(spread.alias("y"), alike)
        texts.keep("met", met.select(x("row").alias("a"), y("row").alias("b"), (x("n") + y("n")).alias("size")).distinct())
    texts.drop(name)


def candidates(texts: Texts) -> DataFrame:
    """``a, b, size`` (a < b): numbers of classes that meet in an inverted list and whose bitmaps leave it open whether they are alike."""
    by_passage = texts.lists.select("row", F.explode("listed").alias("v"))
    flagged, slices = texts.reps.where("short").select("row"), texts.slices(VALUE * (texts.lists.agg(F.sum(F.size("listed"))).first()[0] or 0))
    for k in range(slices):
        mine = by_passage.where(F.pmod("v", F.lit(slices)) == k)
        often = texts.keep(f"often-{k}", mine.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
        n, hot = often.agg(F.sum(F.when(F.col("df") <= HOT, F.col("df"))), F.max("df") > HOT).first()
        if hot:
            stock = mine.join(often.where(F.col("df") > HOT).select("v"), "v").select("row").distinct()
            flagged = flagged.unionByName(texts.keep(f"stock-{k}", stock))
        _meet(texts, f"postings-{k}", mine.join(often.where(F.col("df") <= HOT), "v"), n or 0)
        texts.drop(f"often-{k}")
    flagged = texts.keep("flagged", flagged.distinct())
    if not flagged.isEmpty():
        rare = _rare(texts, flagged)
        _meet(texts, "postings", rare, rare.count())
    met = texts.spark.read.parquet(f"{texts.folder}/met")
    pairs = texts.keep("pairs", met.distinct())
    texts.drop("flagged", "rare", "met", "lists", *[f"stock-{k}" for k in range(slices)])
    return pairs


def links(texts: Texts) -> DataFrame:
    """``a, b, similarity``: every pair of classes with exact Jaccard at the threshold."""
    pairs = candidates(texts)
    # A pair brings two sets, and one of them once more.
    slices = texts.slices(MEMBER * (pairs.agg(F.sum("size")).first()[0] or 0) / 2)
    name = texts.reps.select("row", "cls")
    for k in range(slices):
        mine = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(slices)) == k).select("a", "b")
        needed = mine.select(F.explode(F.array("a", "b")).alias("row")).distinct()
        sets = texts.keep(f"grams-{k}", texts.sets(needed))
        alike = (
            mine.join(sets.select(F.col("row").alias("a"), F.col("grams").alias("x")), "a")
            .join(sets.select(F.col("row").alias("b"), F.col("grams").alias("y")), "b")
            .withColumn("shared", F.size(F.array_intersect("x", "y")))
            .withColumn("union", F.size("x") + F.size("y") - F.col("shared"))
            .where(F.col("shared") >= F.col("union") * F.lit(texts.threshold) - 1e-9)
            .select("a", "b", (F.col("shared") / F.col("union")).alias("similarity"))
        )
        texts.keep("alike", alike)
        texts.drop(f"grams-{k}")
    numbered = texts.spark.read.schema(alike.schema).parquet(f"{texts.folder}/alike")
    linked = (
        numbered.withColumnsRenamed({"a": "i", "b": "j"})
        .join(name.withColumnsRenamed({"row": "i", "cls": "a"}), "i")
        .join(name.withColumnsRenamed({"row": "j", "cls": "b"}), "j")
        .select("a", "b", "similarity")
    )
    linked = texts.keep("links", linked)
    texts.drop("pairs", "alike")
    return linked


def near_duplicate_pairs(
    df: DataFrame, key: str, text: str = "text", n: int = 5, threshold: float = 0.8, min_words: int = 1
) -> DataFrame:
    """``key_a, key_b`` (a < b) for every two keys whose sets are alike, copies included.

    Rows that repeat a key count once; null keys and texts, and texts with fewer
    than ``max(n, min_words)`` words, take part in nothing. Expands classes into
    their members, so use ``near_duplicate_groups`` where copies abound.
    """
    texts = Texts(df, key, text, n, threshold, min_words)
    ids = texts.ids
    across = (
        links(texts)
        .join(ids.select(F.col("cls").alias("a"), F.col("id").alias("x")), "a")
        .join(ids.select(F.col("cls").alias("b"), F.col("id").alias("y")), "b")
        .select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))
    )
    # Of a class with many copies each block of them is a join key of its own.
    sizes = ids.groupBy("cls").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("c")).where("c > 1")
    copies = ids.join(sizes, "cls")
    left = copies.select("cls", F.col("id").alias(f"{key}_a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"))
    right = copies.select("cls", F.col("id").alias(f"{key}_b"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("blk"))
    same = left.join(right, ["cls", "blk"]).where(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b")
    return across.unionByName(same)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of ``edges(a, b)``: the least node each one reaches.

    Alternates large-star and small-star steps; each is one shuffle, written to
    the checkpoint folder, and the number of rounds grows with the logarithm of
    the longest chain. A star keeps a hot node's rows spread over its partners.
    """

    def digest(d: DataFrame):
        row = d.agg(F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return row["c"], row["h"]

    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    seen = digest(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a != b")
            .distinct()
        )
        now = cut(small)
        was, seen = seen, digest(now)
        if was == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _stubs(df: DataFrame, key: str, text: str, least: int, ids: DataFrame) -> DataFrame:
    """``id, root`` of the keys that have no class: one root per list of words, a null text's or empty list's own.

    A root is tagged, so that no digest of a set is taken for one.
    """
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("t")).where("id is not null")
    w = rows.select("id", words(F.col("t")).alias("w"))
    few = w.where(F.coalesce(F.size("w") < least, F.lit(True)))
    said = F.concat(F.lit("w"), F.sha2(F.array_join("w", " "), 256))
    alone = F.concat(F.lit("k"), F.col("id").cast("string"))
    named = few.select("id", F.when(F.coalesce(F.size("w") > 0, F.lit(False)), said).otherwise(alone).alias("root"))
    # Deliveries of a key that differ: words stand before none, the least digest first.
    one = named.groupBy("id").agg(F.min(F.when(F.col("root").startswith("w"), F.col("root"))).alias("w"), F.min("root").alias("k"))
    return one.join(ids, "id", "left_anti").select("id", F.encode(F.coalesce("w", "k"), "UTF-8").alias("root"))


def near_duplicate_groups(
    df: DataFrame, key: str, text: str = "text", n: int = 5, threshold: float = 0.8, min_words: int = 1
) -> DataFrame:
    """One row per distinct key: ``key, group_id, n_links, group_size``.

    ``group_id`` is the least key of the connected group (the key itself where
    nothing is alike); ``n_links`` counts the *different* texts linked to this
    one; copies of a text share its class and are not expanded into pairs. A
    text with fewer than ``max(n, min_words)`` words groups with those of the same
    words in the same order; a text without a word, or null, is a group of its
    own. Null keys have no row; rows that repeat a key count once.
    """
    texts = Texts(df, key, text, n, threshold, min_words)
    ids, linked = texts.ids, links(texts).select("a", "b")
    degree = (
        linked.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n_links"))
    )
    roots = components(linked).select(F.col("node").alias("cls"), "root")
    placed = ids.join(roots, "cls", "left").join(degree, "cls", "left").select(
        "id", F.coalesce("root", "cls").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    stubs = _stubs(df, key, text, max(n, min_words), ids)
    placed = placed.unionByName(stubs.withColumn("n_links", F.lit(0).cast("bigint")))
    groups = placed.groupBy("root").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("group_size"))
    return placed.join(groups, "root").select(F.col("id").alias(key), "group_id", "n_links", "group_size")
