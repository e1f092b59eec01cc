"""Problem 3: the most similar vectors of every vector.

An inverted-file index with adaptive dimension scans. Vectors are normalised,
rotated at random and kept as 16-bit fixed-point columns (as floats where no least
cosine is asked); exact copies are one class. Each class enters its ``m`` nearest lists and is compared, inside each,
with the others there. A scan goes over column blocks: after each block a
hypothesis test on the partial distance (in rotated space it estimates the whole
one) abandons a candidate that would have to be improbably lucky; survivors get
their exact cosine. Without a least cosine there is no distance to abandon at: a list's
cosines are then computed whole, and each vector keeps its ``k`` best of each list.

Centroids are fitted on a uniform sample of about ``SAMPLE`` vectors, 2 % of
more than a million, at most ``MOST_SAMPLE``; every vector is indexed. Beyond
``FLAT`` lists they stand in two levels, dense regions getting more of them.
Lists hold about ``LIST_SIZE`` vectors up to 35 million vectors. Where a list is
longer than ``WHOLE``, its task fits lists inside it and compares within those,
so work still grows with the collection; a list that the sample shows to be
longer than ``TILE`` is cut into tiles that are compared pair by pair in
separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.session import cut

SAMPLE, MOST_SAMPLE = 20_000, 200_000
#: Lists that one level of centroids serves.
FLAT = 1024
LIST_SIZE = 700
#: The same where no least cosine is asked: far neighbours share a short list less often.
OPEN_LIST_SIZE = 2_000
WHOLE, TILE = 8_000, 50_000
#: Fixed point: one unit is 1/32,000 of the unit length.
UNIT = 32_000.0
#: How vectors travel: in fixed point where a least cosine decides, as floats where the order of far neighbours does.
FIXED, FLOAT = "<i2", "<f4"
#: Column blocks of the scan, and how many deviations a partial distance may lie off.
BLOCKS = (32, 64)
EPSILON = 2.1


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _dense(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, matrix) of the usable vectors: of the first usable's length, finite, not all zero."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(array.value_lengths().fill_null(0))
    flat = np.asarray(array.flatten().cast(pa.float64()).fill_null(np.nan))
    dims = np.unique(sizes[sizes > 0])
    if not len(dims):
        return np.empty(0, int), np.empty((0, 0))
    dim = int(np.bincount(sizes[sizes > 0]).argmax())
    starts = np.cumsum(sizes) - sizes
    rows = np.flatnonzero(sizes == dim)
    m = flat[starts[rows][:, None] + np.arange(dim)]
    big = np.abs(m).max(axis=1, initial=0)
    good = np.isfinite(big) & (big > 0)
    m = m[good] / big[good][:, None]
    return rows[good], m / np.linalg.norm(m, axis=1, keepdims=True)


def _digested(df: DataFrame, key: str, vector: str, with_vector: str | None) -> DataFrame:
    """``id, h`` or ``id, h, v``: digest and rotated unit vector, as numbers of kind ``with_vector``: fixed point, or floats.

    The digest is of the fixed-point form. Unusable vectors are left out. With the vector, an input partition gives each
    distinct vector once, under its least id there: however often a vector is
    copied, what is shuffled of it is bounded by the number of partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = None
        least: dict[bytes, int] = {}
        for b in batches:
            rows, m = _dense(b.column(1))
            if not len(rows):
                continue
            if turn is None or len(turn) != m.shape[1]:
                turn = rotation(m.shape[1])
            turned = m @ turn
            q = np.rint(turned * UNIT).astype(FIXED)
            raw = [r.tobytes() for r in q]
            digests = [blake2b(r, digest_size=16).digest() for r in raw]
            if with_vector == FLOAT:
                raw = [r.tobytes() for r in turned.astype(FLOAT)]
            ids = b.column(0).take(pa.array(rows))
            if not with_vector:
                yield pa.RecordBatch.from_arrays([ids, pa.array(digests, pa.binary())], names=["id", "h"])
                continue
            fresh = []
            for n, (h, i) in enumerate(zip(digests, ids.to_pylist())):
                if h not in least or i < least[h]:
                    least[h] = i
                    fresh.append(n)
            take = pa.array(fresh, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.take(take), pa.array(digests, pa.binary()).take(take), pa.array(raw, pa.binary()).take(take)],
                names=["id", "h", "v"],
            )

    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x"))
    return rows.where("id is not null and x is not null").mapInArrow(
        run, f"id {dict(rows.dtypes)['id']}, h binary" + ", v binary" * bool(with_vector)
    )


def _matrix(raw: list[bytes], kind: str) -> np.ndarray:
    m = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype("f4")
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        a = np.concatenate([(x[i : i + 8192] @ c.T).argmax(1) for i in range(0, len(x), 8192)])
        order = np.argsort(a, kind="stable")
        found, first = np.unique(a[order], return_index=True)
        c[found] = np.add.reduceat(x[order], first, axis=0)
        empty = np.setdiff1d(np.arange(k), found)
        c[empty] = x[rng.choice(len(x), len(empty))]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


class Lists:
    """Centroids, in two levels where there are many, and the nearest of them."""

    #: First-level cells whose lists are looked at.
    PROBED = 12

    def __init__(self, x: np.ndarray, k: int) -> None:
        if k <= FLAT:
            self.cells, self.lists, self.start = None, fit_centroids(x, k), None
            return
        self.cells = fit_centroids(x, int(np.ceil(np.sqrt(k))))
        cell = np.concatenate([(x[i : i + 8192] @ self.cells.T).argmax(1) for i in range(0, len(x), 8192)])
        made = []
        for n in range(len(self.cells)):
            own = x[cell == n]
            share = min(len(own), max(1, round(k * len(own) / len(x))))
            made.append(fit_centroids(own, share) if share > 1 else self.cells[n : n + 1])
        self.lists = np.concatenate(made)
        self.start = np.cumsum([0, *map(len, made)])

    def __len__(self) -> int:
        return len(self.lists)

    def nearest(self, x: np.ndarray, m: int) -> np.ndarray:
        """The ``m`` nearest lists of each vector."""
        if m >= len(self.lists):
            return np.tile(np.arange(len(self.lists)), (len(x), 1))
        if self.cells is None:
            return np.concatenate([np.argpartition(-(x[i : i + 4096] @ self.lists.T), m, axis=1)[:, :m] for i in range(0, len(x), 4096)])
        probed = min(self.PROBED, len(self.cells))
        cells = np.argpartition(-(x @ self.cells.T), probed - 1, axis=1)[:, :probed]
        best = np.full((len(x), m), -np.inf, "f4")
        which = np.zeros((len(x), m), np.int64)
        for n in np.unique(cells):
            rows = np.flatnonzero((cells == n).any(axis=1))
            s = x[rows] @ self.lists[self.start[n] : self.start[n + 1]].T
            scores = np.hstack([best[rows], s])
            names = np.hstack([which[rows], np.broadcast_to(np.arange(self.start[n], self.start[n + 1]), s.shape)])
            top = np.argpartition(-scores, m - 1, axis=1)[:, :m]
            best[rows] = np.take_along_axis(scores, top, 1)
            which[rows] = np.take_along_axis(names, top, 1)
        return which


def scan(x: np.ndarray, left: slice, right: slice, min_cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine) of pairs i < j, i in ``left`` and j in ``right``, at or above ``min_cosine``."""
    dim = x.shape[1]
    radius = 2 - 2 * min_cosine
    ends = [d for d in BLOCKS if d < dim] + [dim]
    d0 = ends[0]
    head = x[:, :d0]
    half = -0.5 * np.einsum("ij,ij->i", head, head)[:, None]
    one = np.ones_like(half)
    lhs, rhs = np.hstack([head, half, one]), np.hstack([head, one, half])

    def bound(d: int) -> float:
        return radius * d / dim * (1 + EPSILON / np.sqrt(d)) ** 2 if d < dim else radius + 1e-6

    out = []
    for lo in range(left.start, left.stop, 1024):
        hi = min(lo + 1024, left.stop)
        first = max(right.start, lo)
        if first >= right.stop:
            continue
        # minus half the partial squared distance, in one product
        i, j = np.nonzero(lhs[lo:hi] @ rhs[first : right.stop].T >= -0.5 * bound(d0))
        i, j = i + lo, j + first
        keep = i < j
        i, j = i[keep], j[keep]
        partial = None
        for start, stop in zip(ends, ends[1:]):
            if partial is None:
                partial = np.square(x[i, :start] - x[j, :start]).sum(1)
            partial = partial + np.square(x[i, start:stop] - x[j, start:stop]).sum(1)
            keep = partial <= bound(stop)
            i, j, partial = i[keep], j[keep], partial[keep]
        cosine = np.einsum("ij,ij->i", x[i].astype("f8"), x[j].astype("f8"))
        keep = cosine >= min_cosine
        out.append((i[keep], j[keep], cosine[keep]))
    if not out:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return tuple(np.concatenate(p) for p in zip(*out))  # type: ignore[return-value]


def nearest(x: np.ndarray, left: slice, right: slice, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine): the ``k`` nearest j in ``right`` of every i in ``left``, however far, and all that tie with the last."""
    out = []
    for lo in range(left.start, left.stop, 512):
        hi = min(lo + 512, left.stop)
        s = x[lo:hi] @ x[right].T
        own = np.arange(max(lo, right.start), min(hi, right.stop))
        s[own - lo, own - right.start] = -np.inf
        n = min(k, s.shape[1])
        if not n:
            continue
        least = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
        i, j = np.nonzero((s >= least[:, None] - 1e-5) & np.isfinite(s))
        i, j = i + lo, j + right.start
        out.append((i, j, np.einsum("ij,ij->i", x[i].astype("f8"), x[j].astype("f8"))))
    if not out:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return tuple(np.concatenate(p) for p in zip(*out))  # type: ignore[return-value]


def within(x: np.ndarray, split: int, k: int, min_cosine: float | None, m: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine), both ways, of one list's vectors: all with all, or with ``split`` those before it with those from it on.

    A long list is not compared whole but through lists fitted inside it.
    """

    def direct(x: np.ndarray, split: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        left, right = (slice(0, split), slice(split, len(x))) if split else (slice(0, len(x)), slice(0, len(x)))
        if min_cosine is not None:
            i, j, s = scan(x, left, right, min_cosine)
            return np.r_[i, j], np.r_[j, i], np.r_[s, s]
        if not split:
            return nearest(x, left, right, k)
        sides = [nearest(x, p, q, k) for p, q in ((left, right), (right, left))]
        return tuple(np.concatenate(p) for p in zip(*sides))  # type: ignore[return-value]

    if len(x) <= WHOLE:
        return direct(x, split)
    taken = np.random.default_rng(13).choice(len(x), min(len(x), SAMPLE), replace=False)
    inner = Lists(x[taken], max(2, min(len(x) // size, len(taken) // 4)))
    of = inner.nearest(x, m)
    order = np.argsort(of.ravel(), kind="stable")
    rows, ends = order // of.shape[1], np.cumsum(np.bincount(of.ravel(), minlength=len(inner)))
    out = []
    for lo, hi in zip(np.r_[0, ends[:-1]], ends):
        own = rows[lo:hi]  # in order, so those before the split come first
        first = int(np.searchsorted(own, split))
        if hi - lo < 2 or (split and first in (0, len(own))):
            continue
        i, j, s = direct(x[own], first if split else 0)
        i, j = own[i], own[j]
        keep = _best(i, j, s, k, j)  # bounds what is held
        out.append((i[keep], j[keep], s[keep]))
    if not out:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    i, j, s = (np.concatenate(p) for p in zip(*out))
    once = np.unique(i * len(x) + j, return_index=True)[1]
    return i[once], j[once], s[once]


def _best(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int, tie: np.ndarray) -> np.ndarray:
    """Places of each ``a``'s ``k`` best rows; equal scores go by ``tie``."""
    order = np.lexsort((tie, -np.round(s, 6), a))
    if not len(order):
        return order
    at = np.arange(len(a))
    first = np.r_[True, a[order][1:] != a[order][:-1]]
    return order[at - np.maximum.accumulate(np.where(first, at, 0)) < k]


def similar_classes(df: DataFrame, key: str, vector: str, k: int, min_cosine: float | None, m: int) -> DataFrame:
    """``a, b, cosine``: for each distinct vector, under its least id, its ``k`` nearest others."""
    size, form = (OPEN_LIST_SIZE, FLOAT) if min_cosine is None else (LIST_SIZE, FIXED)
    spark = df.sparkSession
    total = df.count()
    kind = dict(df.select(F.col(key).alias("id")).dtypes)["id"]
    sample = min(MOST_SAMPLE, max(SAMPLE, total // 50))
    # Each row is taken or not by chance, so the sample is uniform and its size known but for that.
    share = min(1.0, sample / max(total, 1))
    taken = _digested(df.sample(share, seed=5) if share < 1 else df, key, vector, form).select("v").collect()
    if not taken and share < 1:
        taken = _digested(df, key, vector, form).select("v").limit(SAMPLE).collect()
    schema = f"a {kind}, b {kind}, cosine double"
    if not taken:
        return spark.createDataFrame([], schema)
    x = _matrix(sorted({bytes(r["v"]) for r in taken}), form)
    lists = Lists(x, int(max(1, min(total // size, len(x) // 4))))
    m = min(m, len(lists))
    lengths = np.bincount(lists.nearest(x, m).ravel(), minlength=len(lists)) * (total / len(x))
    tiles = np.minimum(4096, np.maximum(1, np.ceil(lengths / TILE))).astype(int)
    shared = spark.sparkContext.broadcast((lists, tiles))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, tiles = shared.value
        for b in batches:
            raw = b.column(2).to_pylist()
            if not raw:
                continue
            near = lists.nearest(_matrix(raw, form), m)
            # Copies share a digest, so they share their tiles and meet again there.
            spread = np.array([int.from_bytes(h[:4], "little") for h in b.column(1).to_pylist()], np.int64)
            rows, keys, tile = [], [], []
            for column in near.T:
                many = tiles[column]
                own = spread % many
                # every pair of tiles that a row's tile is part of
                cut_up = np.flatnonzero(many > 1)
                n = many[cut_up]
                r, t = np.repeat(cut_up, n), np.repeat(own[cut_up], n)
                other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                rows.append(r)
                keys.append((column[r].astype("i8") << 24) | (np.minimum(t, other) << 12) | np.maximum(t, other))
                tile.append(t)
                single = np.flatnonzero(many == 1)
                rows.append(single)
                keys.append(column[single].astype("i8") << 24)
                tile.append(np.zeros(len(single), int))
            r = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys), pa.int64()), pa.array(np.concatenate(tile), pa.int32()), *[c.take(r) for c in b.columns]],
                names=["list", "tile", "id", "h", "v"],
            )

    def compare(group: pa.Table) -> pa.Table:
        key = group.column("list")[0].as_py()
        ids = group.column("id").combine_chunks()
        tile, code = np.asarray(group.column("tile")), np.asarray(pc.rank(ids, tiebreaker="dense"))
        # Input partitions that share a vector each sent it: the least id stands for it.
        digest = group.column("h").combine_chunks().dictionary_encode()
        digest = np.asarray((digest.combine_chunks() if isinstance(digest, pa.ChunkedArray) else digest).indices)
        order = np.lexsort((code, digest))
        order = order[np.r_[True, digest[order][1:] != digest[order][:-1]]]
        order = order[np.argsort(tile[order], kind="stable")]
        tile, code = tile[order], code[order].astype(np.int64)
        x = _matrix([v for v in group.column("v").take(pa.array(order)).to_pylist()], form)
        t1, t2 = (key >> 12) & 0xFFF, key & 0xFFF
        split = int((tile == t1).sum()) if t1 != t2 else 0
        if t1 != t2 and split in (0, len(tile)):  # a tile came alone
            i = j = np.empty(0, int)
            s = np.empty(0)
        else:
            i, j, s = within(x, split, k, min_cosine, m, size)
        keep = _best(i, j, s, k, code[j])
        a, b = (ids.take(pa.array(order[z[keep]])) for z in (i, j))
        return pa.table({"a": a, "b": b, "cosine": pa.array(s[keep], pa.float64())})

    placed = _digested(df, key, vector, form).mapInArrow(assign, f"list long, tile int, id {kind}, h binary, v binary")
    edges = placed.groupBy("list").applyInArrow(compare, schema)
    # At most m * k rows a group.
    entry = F.struct((-F.round("cosine", 6)).alias("c"), "b")
    best = edges.groupBy("a").agg(F.slice(F.array_sort(F.collect_set(entry)), 1, k).alias("e"))
    return best.select("a", F.explode("e").alias("e")).select("a", "e.b", (-F.col("e.c")).alias("cosine"))


def similar_vectors(
    df: DataFrame, key: str, vector: str, k: int = 5, min_cosine: float | None = 0.8, m: int = 4
) -> DataFrame:
    """``id, other, cosine, place``: each vector's ``k`` most similar others.

    Only others with a cosine of ``min_cosine`` or more come out; None asks for
    the ``k`` nearest however far they are. Null keys, and
    vectors that are null, all zero, not finite or of another length than most,
    take no part; a vector's length does not matter. Rows that repeat a key
    count once. Cosines that are equal to six decimals go by id. Vectors that are equal to a unit of
    1/32,000 are one class and near each other with cosine 1; each vector's own
    class comes first, by its least ``k + 1`` members. An empty table gives an
    empty result. ``m`` = 4 lists per vector found 0.9998 of the true neighbours
    at cosine 0.8 or more on 130,000 test vectors.
    """
    edges = similar_classes(df, key, vector, k, min_cosine, m)
    keys = _digested(df, key, vector, None)
    by_id = Window.partitionBy("h").orderBy("id")
    heads = keys.withColumn("r", F.dense_rank().over(by_id)).where(F.col("r") <= k + 1)
    # Classes of copies, each with its k + 1 least members.
    many = cut(
        heads.groupBy("h").agg(F.array_sort(F.collect_set("id")).alias("members")).where(F.size("members") > 1)
    )
    copies = keys.join(many, "h").select("id", F.element_at("members", 1).alias("cls"), "members").distinct()
    own = (
        copies.select("id", F.explode("members").alias("other"))
        .where(F.col("id") != F.col("other"))
        .withColumn("cosine", F.lit(1.0))
    )
    sources = edges.join(copies.select(F.col("id").alias("sid"), "cls"), F.col("a") == F.col("cls"), "left").select(
        F.coalesce("sid", "a").alias("id"), "b", "cosine"
    )
    targets = many.select(F.element_at("members", 1).alias("c"), "members")
    across = sources.join(targets, F.col("b") == F.col("c"), "left").select(
        "id", F.explode(F.coalesce("members", F.array("b"))).alias("other"), "cosine"
    )
    best = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "other")
    return (
        own.unionByName(across)
        .withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= k)
    )
