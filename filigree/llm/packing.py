"""Problem 7: fill containers of one fixed capacity with whole texts, best-two-fit.

Sizes are tokens of a public tokenizer, counted by Arrow workers; texts never
leave their input partition, only (key, size) rows do. Those are dealt by hash
into shards of about ``SHARD`` pieces, each packed by one task: a container is filled
greedily with the largest item that fits; then its smallest item gives way to
two unpacked items that fit the widened gap more tightly, as long as any do.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level vocabulary expects text to be cut: fixed value, published with it.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CAPACITY = 4096
#: Pieces one task packs.
SHARD = 50_000


@cache
def tokenizer(path: str = TOKENIZER, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, key: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """``id, n_tokens`` of every row with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], names=["id", "n_tokens"])

    rows = df.select(F.col(key).alias("id"), F.col(text).alias("t")).where("t is not null")
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n_tokens int")


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each item; no size may exceed ``capacity``."""
    stacks: dict[int, list[int]] = {}
    for i in np.argsort(sizes, kind="stable")[::-1].tolist():
        stacks.setdefault(int(sizes[i]), []).append(i)
    kinds = sorted(stacks)  # the sizes that are still to be had
    bin_of = np.empty(len(sizes), np.int64)

    def take(size: int) -> int:
        i = stacks[size].pop()
        if not stacks[size]:
            del stacks[size]
            kinds.pop(bisect_right(kinds, size) - 1)
        return i

    def give(i: int) -> None:
        size = int(sizes[i])
        if size not in stacks:
            stacks[size] = []
            kinds.insert(bisect_right(kinds, size), size)
        stacks[size].append(i)

    def two(low: int, room: int) -> tuple[int, int] | None:
        """The largest pair of unpacked items above ``low`` and within ``room`` in sum."""
        k = np.asarray(kinds[: bisect_right(kinds, room)], np.int64)
        if not len(k):
            return None
        at = np.searchsorted(k, room - k, side="right") - 1
        ok = at >= 0
        x, y = k[ok], k[at[ok]]
        # Where an item would pair with itself there must be two of its size.
        for n in np.flatnonzero(x == y):
            if len(stacks[int(x[n])]) < 2:
                j = int(np.searchsorted(k, x[n])) - 1
                y[n] = k[j] if j >= 0 else -room
        total = x + y
        if not len(total):
            return None
        best = int(total.argmax())
        return (int(x[best]), int(y[best])) if total[best] > low else None

    b = 0
    while kinds:
        held, gap = [], capacity
        while kinds and (at := bisect_right(kinds, gap)):
            i = take(kinds[at - 1])
            held.append(i)
            gap -= int(sizes[i])
        while gap and held and kinds:
            small = min(held, key=lambda i: int(sizes[i]))
            size = int(sizes[small])
            pair = two(size, gap + size)
            if pair is None:
                break
            held.remove(small)
            held += [take(pair[0]), take(pair[1])]
            gap += size - sum(pair)
            give(small)
        bin_of[held] = b
        b += 1
    return bin_of


def pack(
    df: DataFrame, key: str, text: str = "text", capacity: int = CAPACITY, path: str = TOKENIZER, shard: int = SHARD
) -> DataFrame:
    """Rows ``key, piece_no, token_start, n_tokens, container, fill``.

    A text within the capacity is one piece. A larger one is cut after every
    ``capacity`` tokens; only its last piece may share a container. ``container``
    is unique over the whole result and ``fill`` is how many tokens it holds, at
    most ``capacity``. Each row counts for itself, rows with equal keys too; null
    and empty texts hold nothing and give no row. Columns other than ``key`` are
    not carried. Containers do not span shards, so up to one poorly filled
    container per ``shard`` items is the price of packing in parallel.
    """
    # Keys and sizes only, kept so that texts are tokenised once.
    counted = cut(count_tokens(df, key, text, path).where("n_tokens > 0"))
    pieces = counted.select(
        "id",
        F.xxhash64(F.monotonically_increasing_id()).alias("h"),
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.expr(f"(n_tokens - 1) div {capacity}").cast("int")),
                lambda i: F.least(F.lit(capacity), F.col("n_tokens") - i * capacity),
            )
        ).alias("piece_no", "size"),
    )
    n_pieces = counted.agg(F.sum(F.expr(f"(n_tokens - 1) div {capacity} + 1"))).first()[0] or 0
    n = max(1, -(-n_pieces // shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("h", "piece_no"), F.lit(n)).cast("int"))
    kind = dict(pieces.dtypes)["id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id", "piece_no"], kind="stable", na_position="last").reset_index(drop=True)
        size = pdf["size"].to_numpy()
        where = best_two_fit(size, capacity)
        fill = np.bincount(where, weights=size).astype(np.int32)
        return pd.DataFrame(
            {
                "id": pdf["id"],
                "piece_no": pdf["piece_no"],
                "n_tokens": size,
                "container": where + (pdf["shard"].to_numpy(np.int64) << 32),
                "fill": fill[where],
            }
        )

    packed = dealt.select("id", "piece_no", "size", "shard").groupBy("shard").applyInPandas(
        run, f"id {kind}, piece_no int, n_tokens int, container long, fill int"
    )
    return packed.select(
        F.col("id").alias(key), "piece_no", (F.col("piece_no") * capacity).alias("token_start"), "n_tokens", "container", "fill"
    )
