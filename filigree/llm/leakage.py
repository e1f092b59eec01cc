"""Problem 8: wording of evaluation items inside a corpus, by an FM-index per shard.

The documents of an input partition go into shards of about ``SHARD_WORDS``
words, each indexed by the task that reads them; no text is shuffled. Words are
symbols, numbered per shard. Over a shard stand the Burrows-Wheeler transform of
its suffix array, a wavelet tree for ranks, and sampled suffix positions. The
index holds every word and knows nothing of the items, so it can be kept
(``build_index``) and asked again (``search_index``). Every phrase of the items
is searched backward, all of them at once; occurrences are located by walking to
a sampled position; and the spans of neighbouring phrases are merged.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

WORD = re.compile(r"[^\W_]+")
#: Words of one shard; a document is never cut, so one long document may pass it.
SHARD_WORDS = 1_000_000
#: Characters of item text that one broadcast holds; more items are searched in several passes.
ITEM_CHARS = 8_000_000
#: Phrases searched together.
AT_ONCE = 200_000
SAMPLED = 16


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Of a sequence whose zeros end its parts (the last symbol is one); a comparison ends with its part.

    Several symbols are sorted at once, then prefixes double among the suffixes not yet told apart.
    """
    n = len(s)
    ends = np.flatnonzero(s == 0)
    key = s.astype(np.int64) + len(ends)
    key[ends] = np.arange(len(ends))  # ends differ, by position
    bits = max(1, int(key.max()).bit_length()) if n else 1
    width = max(1, 62 // bits)
    packed = np.zeros(n, np.int64)
    for j in range(width):
        packed <<= bits
        packed[: max(n - j, 0)] |= key[j:]
    order = np.argsort(packed, kind="stable")
    new = np.r_[True, packed[order][1:] != packed[order][:-1]] if n else np.empty(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.empty(0, np.int64)
    rank = np.empty(n, np.int64)
    rank[order] = start
    alone = new & np.r_[new[1:], True] if n else new
    open_ = np.flatnonzero(~alone)
    step = width
    while len(open_):
        at = order[open_]
        both = rank[at] * n + rank[at + step]  # an open suffix has met no end, so it goes on
        by = np.argsort(both, kind="stable")
        at, both = at[by], both[by]
        order[open_] = at
        new = np.r_[True, both[1:] != both[:-1]]
        start = np.maximum.accumulate(np.where(new, open_, 0))
        rank[at] = start
        open_ = open_[~(new & np.r_[new[1:], True])]
        step *= 2
    return order


class WaveletTree:
    """Ranks of symbols in a sequence, by one bit vector per level of a balanced tree.

    Level by level the sequence is stably partitioned by the symbols' bits, the
    highest first, so that a node's part of a level is contiguous.
    """

    def __init__(self, s: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.n = len(s)
        self.ones: list[np.ndarray] = []
        # Sorting 16-bit numbers is a radix sort.
        now = s.astype(np.uint16 if bits <= 16 else np.int64)
        for level in range(bits):
            bit = (now >> (bits - 1 - level)) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            # stable order by the symbols' leading bits
            now = now[np.argsort(now >> (bits - 1 - level), kind="stable")]
        in_order = np.sort(s)
        self.starts = [np.searchsorted(in_order >> (bits - level), np.arange((1 << level) + 1)) for level in range(bits)]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``c`` occurs in the first ``i`` places, element by element."""
        i = i.copy()
        for level in range(self.bits):
            start = self.starts[level][c >> (self.bits - level)]
            ones = self.ones[level][start + i] - self.ones[level][start]
            i = np.where((c >> (self.bits - 1 - level)) & 1, ones, i - ones)
        return i

    def access(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at ``p``, its occurrences before ``p``)."""
        c, i = np.zeros_like(p), p.copy()
        for level in range(self.bits):
            start = self.starts[level][c]
            at = start + i
            before = self.ones[level][at] - self.ones[level][start]
            bit = self.ones[level][at + 1] - self.ones[level][at]
            i = np.where(bit, before, i - before)
            c = c * 2 + bit
        return c, i


class Shard:
    """The FM-index of some documents, given as word lists; symbol 0 ends each of them."""

    def __init__(self, docs: list[list[str]]) -> None:
        vocabulary: dict[str, int] = {}
        number = vocabulary.setdefault
        flat: list[int] = []
        for w in docs:
            flat += [number(x, len(vocabulary) + 1) for x in w]
            flat.append(0)
        s = np.asarray(flat, np.int64)
        self.words = list(vocabulary)
        self.doc_start = np.cumsum(np.r_[0, [len(w) + 1 for w in docs]]).astype(np.int64)
        self.bits = max(1, len(vocabulary).bit_length())
        sa = suffix_array(s)
        self.bwt = s[sa - 1]  # the first suffix is preceded by the last symbol, an end
        # Places after an end are sampled too, so that no walk has to cross one.
        self.marked = ((sa % SAMPLED == 0) | (self.bwt == 0)).astype(np.int8)
        self.sampled = sa[self.marked == 1]
        self._ready()

    def _ready(self) -> None:
        self.n = len(self.bwt)
        self.number = {w: i for i, w in enumerate(self.words, 1)}
        self.first = np.r_[0, np.cumsum(np.bincount(self.bwt, minlength=len(self.words) + 1))]
        self.tree = WaveletTree(self.bwt, self.bits)
        self.mark_rank = np.r_[0, np.cumsum(self.marked, dtype=np.int64)]

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(
            out, bwt=self.bwt.astype(np.int32), marked=np.packbits(self.marked), sampled=self.sampled.astype(np.int32),
            doc_start=self.doc_start, words=np.frombuffer("\n".join(self.words).encode("utf-8"), np.uint8),
        )
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Shard:
        kept = np.load(io.BytesIO(raw))
        self = cls.__new__(cls)
        self.bwt, self.doc_start, self.sampled = (kept[c].astype(np.int64) for c in ("bwt", "doc_start", "sampled"))
        self.marked = np.unpackbits(kept["marked"])[: len(self.bwt)].astype(np.int8)
        text = kept["words"].tobytes().decode("utf-8")
        self.words = text.split("\n") if text else []
        self.bits = max(1, len(self.words).bit_length())
        self._ready()
        return self

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [lo, hi) of each phrase, one phrase per row of the matrix."""
        n = len(phrases)
        lo, hi = np.zeros(n, np.int64), np.full(n, self.n, np.int64)
        live = np.arange(n)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            lo[live] = self.first[c] + self.tree.rank(c, lo[live])
            hi[live] = self.first[c] + self.tree.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        dead = np.ones(n, bool)
        dead[live] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes at ``rows``."""
        at, walked = rows.copy(), np.zeros_like(rows)
        out = np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            here = at[open_]
            done = self.marked[here] == 1
            out[open_[done]] = self.sampled[self.mark_rank[here[done]]] + walked[open_[done]]
            open_, here = open_[~done], here[~done]
            c, i = self.tree.access(here)
            at[open_] = self.first[c] + i
            walked[open_] += 1
        return out

    def spans(self, items: Items, n: int) -> tuple[np.ndarray, ...]:
        """(document's place, item's place, first word, last word) of the merged spans of ``n``-word phrases."""
        known = np.array([0, *(self.number.get(w, 0) for w in items.words)], np.int64)
        seq = known[items.sequence]
        found_at, found_item = [], []
        if len(seq) >= n and self.n:
            windows = np.lib.stride_tricks.sliding_window_view(seq, n)
            # A window across two items, or with a word the shard lacks, holds a zero.
            whole = np.flatnonzero(windows.min(axis=1) > 0)
            for k in range(0, len(whole), AT_ONCE):
                at = whole[k : k + AT_ONCE]
                lo, hi = self.search(windows[at])
                hit = np.flatnonzero(hi > lo)
                many = hi[hit] - lo[hit]
                rows = np.repeat(lo[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                found_at.append(self.locate(rows))
                found_item.append(np.repeat(items.owner[at[hit]], many))
        if not found_at:
            return (np.empty(0, np.int64),) * 4
        at, item = np.concatenate(found_at), np.concatenate(found_item)
        doc = np.searchsorted(self.doc_start, at, side="right") - 1
        order = np.lexsort((at, item, doc))
        at, item, doc = at[order], item[order], doc[order]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] > at[:-1] + n)] if len(at) else np.empty(0, bool)
        heads = np.flatnonzero(new)
        tails = np.r_[heads[1:], len(at)][: len(heads)] - 1
        start = self.doc_start[doc[heads]]
        return doc[heads], item[heads], at[heads] - start, at[tails] + n - 1 - start


class Items:
    """What is searched for: the items' words, numbered, as one sequence with a 0 after each item."""

    def __init__(self, items: list[tuple[object, str]]) -> None:
        vocabulary: dict[str, int] = {}
        flat: list[int] = []
        owner: list[int] = []
        self.ids = sorted({i for i, _ in items})
        place = {i: k for k, i in enumerate(self.ids)}
        for i, text in items:
            w = [vocabulary.setdefault(x, len(vocabulary) + 1) for x in WORD.findall(text.lower())]
            flat += [*w, 0]
            owner += [place[i]] * (len(w) + 1)
        self.words = list(vocabulary)
        self.sequence, self.owner = np.asarray(flat, np.int64), np.asarray(owner, np.int64)


def _passes(items: DataFrame, item_key: str, text: str) -> Iterator[Items]:
    """The items in blocks of at most ``ITEM_CHARS`` characters; an item that is longer has a block of its own."""
    wanted = items.select(F.col(item_key).alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").distinct()
    passes = max(1, -(-(wanted.agg(F.sum(F.length("t"))).first()[0] or 0) // ITEM_CHARS))
    while True:
        block = F.pmod(F.xxhash64("i", "t"), F.lit(passes)).alias("b")
        most = wanted.groupBy(block).agg(F.sum(F.length("t")).alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.max("c")).first()[0]
        if (most or 0) <= ITEM_CHARS:
            break
        passes *= 2
    for k in range(passes):
        rows = wanted.where(block == k).collect()
        if rows or passes == 1:
            yield Items([(r["i"], r["t"]) for r in rows])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str], Shard]]:
    """(ids, texts, index) of a partition's documents, some at a time."""
    ids, texts, words, size = [], [], [], 0
    for b in batches:
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            w = WORD.findall(t.lower())
            ids.append(d)
            texts.append(t)
            words.append(w)
            size += len(w)
            if size >= SHARD_WORDS:
                yield ids, texts, Shard(words)
                ids, texts, words, size = [], [], [], 0
    if ids:
        yield ids, texts, Shard(words)


def _documents(docs: DataFrame, doc_key: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_key).alias("d"), F.col(text).alias("t")).where("d is not null and t is not null")


def _result(docs: DataFrame, items: DataFrame, item_key: str, *more: str) -> tuple[str, pa.Schema]:
    """The result's schema, for Spark and for its batches."""
    kinds = dict(docs.dtypes)["d"], dict(items.select(F.col(item_key).alias("i")).dtypes)["i"]
    ddl = f"d {kinds[0]}, i {kinds[1]}, " + ", ".join(f"{m} int" for m in more)
    return ddl, to_arrow_schema(StructType.fromDDL(ddl))


def _batch(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _in_passes(rows: DataFrame, items: DataFrame, item_key: str, text: str, kernel: Callable, schema: str) -> DataFrame:
    result = None
    for block in _passes(items, item_key, text):
        found = rows.mapInArrow(kernel(rows.sparkSession.sparkContext.broadcast(block)), schema)
        result = found if result is None else result.unionByName(found)
    return result


def leaks(
    docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", n: int = 12
) -> DataFrame:
    """``doc_key, item_key, span_start, span_end, n_words``: where an item's wording stands.

    A span is a stretch of a document covered by phrases of ``n`` consecutive
    words of one item, in order and unbroken (what is no word between them is
    ignored); its ends are code-point offsets, the second exclusive. Words are
    runs of Unicode letters and digits in lower case. Null and short texts hold
    nothing. Repeated documents each report; a repeated item counts once.
    Keys may have any type; null keys take no part. Other columns are not carried.
    Items over ``ITEM_CHARS`` in all take several passes over the corpus.
    """
    rows = _documents(docs, doc_key, text)
    ddl, schema = _result(rows, items, item_key, "span_start", "span_end", "n_words")

    def kernel(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = shared.value
            for ids, texts, shard in _shards(batches):
                out: list[list] = [[], [], [], [], []]
                of, spans = None, []
                for doc, item, first, last in zip(*(x.tolist() for x in shard.spans(wanted, n))):
                    if doc != of:  # spans come document by document
                        of, spans = doc, [m.span() for m in WORD.finditer(texts[doc])]
                    # Lower case may have joined or cut a word; the ends stay inside the text.
                    first, last = min(first, len(spans) - 1), min(last, len(spans) - 1)
                    for column, value in zip(out, (ids[doc], wanted.ids[item], spans[first][0], spans[last][1], last - first + 1)):
                        column.append(value)
                yield _batch(out, schema)

        return run

    found = _in_passes(rows, items, item_key, text, kernel, ddl)
    return found.withColumnsRenamed({"d": doc_key, "i": item_key})


def build_index(docs: DataFrame, path: str, doc_key: str = "doc_id", text: str = "text") -> None:
    """Write the shards' indexes, one row each with its documents' keys, for any later test set."""
    rows = _documents(docs, doc_key, text)
    kind = dict(rows.dtypes)["d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, shard in _shards(batches):
            yield pa.RecordBatch.from_arrays([pa.array([ids]), pa.array([shard.to_bytes()], pa.binary())], names=["ids", "shard"])

    rows.mapInArrow(run, f"ids array<{kind}>, shard binary").write.mode("overwrite").parquet(path)


def search_index(spark: SparkSession, path: str, items: DataFrame, item_key: str = "item_id", text: str = "text", n: int = 12) -> DataFrame:
    """``doc, item, first_word, n_words`` of the spans that ``leaks`` finds, from a written index."""
    rows = spark.read.parquet(path)
    ddl, schema = _result(rows.select(F.explode("ids").alias("d")), items, item_key, "first_word", "n_words")

    def kernel(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = shared.value
            for b in batches:
                for at in range(b.num_rows):
                    ids, shard = b.column(0)[at].as_py(), Shard.from_bytes(b.column(1)[at].as_py())
                    doc, item, first, last = (x.tolist() for x in shard.spans(wanted, n))
                    sizes = [z - a + 1 for a, z in zip(first, last)]
                    yield _batch([[ids[x] for x in doc], [wanted.ids[x] for x in item], first, sizes], schema)

        return run

    found = _in_passes(rows, items, item_key, text, kernel, ddl)
    return found.withColumnsRenamed({"d": "doc", "i": "item"})


def removal_spans(found: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """``doc_key, span_start, span_end, n_items``: the spans of all items of a document, merged.

    Overlapping and touching spans become one. The spans of one document are
    bounded by its length.
    """
    spans = found.groupBy(doc_key).agg(
        F.array_sort(F.collect_set(F.struct("span_start", "span_end"))).alias("s"), F.count_distinct(item_key).alias("n_items")
    )
    empty = F.expr("CAST(array() AS array<struct<span_start:int,span_end:int>>)")

    def join(acc, x):
        last = F.element_at(acc, -1)
        wider = F.struct(last["span_start"].alias("span_start"), F.greatest(last["span_end"], x["span_end"]).alias("span_end"))
        return F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["span_end"] >= x["span_start"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(wider)),
        ).otherwise(F.concat(acc, F.array(x)))

    return spans.select(doc_key, "n_items", F.inline(F.aggregate("s", empty, join))).select(
        doc_key, "span_start", "span_end", "n_items"
    )
