import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from filigree.llm import neardup as N
from filigree.llm import vectors as V


def corpus(seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, base = [], [[r.choice(vocabulary) for _ in range(r.randint(45, 160))] for _ in range(25)]
    for b, w in enumerate(base):
        rows.append((f"b{b}", " ".join(w)))
        for k in range(r.randint(0, 4)):
            edited = list(w)
            for _ in range(r.randint(0, max(1, len(w) // 14))):
                at = r.randrange(len(edited))
                r.choice([lambda: edited.insert(at, r.choice(vocabulary)), lambda: edited.pop(at), lambda: edited.__setitem__(at, r.choice(vocabulary))])()
            rows.append((f"b{b}-{k}", " ".join(edited)))
    stock = "the following stock phrase opens every text of this whole corpus here"
    rows += [(f"s{i}", stock + " " + " ".join(r.choice(vocabulary) for _ in range(60))) for i in range(60)]
    rows += [(f"copy{i}", "Same Text. " + rows[0][1]) for i in range(30)]
    return rows


def brute(rows, n, threshold, least):
    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\W_]+", t.lower())
        if len(w) >= max(n, least):
            sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("n,threshold,least,hot", [(3, 0.6, 40, 1000), (5, 0.8, 1, 20), (3, 0.6, 40, 2), (3, 0.4, 1, 20)])
def test_pairs_match_brute_force(spark, monkeypatch, n, threshold, least, hot):
    monkeypatch.setattr(N, "HOT", hot)
    monkeypatch.setattr(N, "BLOCK", 8)
    rows = corpus() + [("short1", "one two three four five six"), ("short2", "one two three four five six"), ("empty", "")]
    df = spark.createDataFrame(rows + [rows[0], (None, "x " * 50), ("null", None)], "id string, text string").withColumn("cls", F.lit(1))
    got = [tuple(r) for r in N.near_duplicate_pairs(df, "id", "text", n, threshold, least).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, n, threshold, least)


def test_evenly_spread_insertions_at_a_low_threshold(spark):
    w = [f"u{i}" for i in range(140)]
    edited = [x for i, y in enumerate(w) for x in ([y, f"new{i}"] if i % 7 == 6 else [y])]
    rows = [("a", " ".join(w)), ("b", " ".join(edited))]
    df = spark.createDataFrame(rows, "id string, text string")
    assert N.listed_words(3, 0.6) == 8 and N.listed_words(3, 0.5) == 5
    assert N.near_duplicate_pairs(df, "id", "text", 3, 0.5, 40).count() == len(brute(rows, 3, 0.5, 40)) == 1


def test_short_texts_are_not_missed(spark):
    rows = [("a", " ".join(f"x{i}" for i in range(16))), ("b", " ".join(f"x{i}" if i != 7 else "zz" for i in range(16)))]
    df = spark.createDataFrame(rows, "id string, text string")
    assert N.near_duplicate_pairs(df, "id", "text", 3, 0.6, 1).count() == len(brute(rows, 3, 0.6, 1)) == 1


def test_groups(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "id string, text string")
    parent = {k: k for k, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute(rows, 5, 0.8, 1):
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.id: r for r in N.near_duplicate_groups(df, "id").collect()}
    assert {k: r.group_id for k, r in got.items()} == {k: find(k) for k, _ in rows}
    assert got["copy1"].group_size >= 30 and got["copy1"].n_links < 30
    assert N.near_duplicate_groups(df.limit(0), "id").count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in N.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def cloud(seed=2):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((300, 24))
    near = base[rng.integers(0, 300, 500)] + 0.25 * rng.standard_normal((500, 24))
    return np.vstack([base, near]).astype("f4")


def want_pairs(x, ids, k, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u.astype("f8") @ u.T.astype("f8")
    np.fill_diagonal(s, -2)
    out = {}
    for i in range(len(s)):
        order = sorted((j for j in np.flatnonzero(s[i] >= least)), key=lambda j: (-round(s[i, j], 6), ids[j]))
        out[ids[i]] = [ids[j] for j in order[:k]]
    return out


def test_recall_against_brute_force(spark, monkeypatch):
    x = cloud()
    ids = list(range(len(x)))
    monkeypatch.setattr(V, "LIST_SIZE", 60)
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in zip(ids, x * 3)], "id long, v array<float>").repartition(4)
    got = {(r.id, r.other) for r in V.similar_vectors(df, "id", "v").collect()}
    want = {(a, b) for a, bs in want_pairs(x, ids, 5, 0.8).items() for b in bs}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


@pytest.mark.parametrize("tile", [12_000, 40])
def test_copies_and_unusable_vectors(spark, monkeypatch, tile):
    monkeypatch.setattr(V, "TILE", tile)
    x = cloud()[:120]
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[0][1]) for i in range(50)] + [rows[3], rows[3]]
    rows += [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [1.0, 2.0]), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "id long, v array<float>").withColumn("h", F.lit(1)).repartition(3)
    got = {}
    for r in V.similar_vectors(df, "id", "v", m=100).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append(r.other)
    assert got[0] == [1000, 1001, 1002, 1003, 1004] and got[1049] == [0, 1000, 1001, 1002, 1003]
    assert not {2000, 2001, 2002, 2003, None} & set(got)
    everything = np.vstack([x, np.tile(x[:1], (50, 1))])
    want = want_pairs(everything, [*range(120), *range(1000, 1050)], 5, 0.8)
    assert {k: v for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert V.similar_vectors(df.limit(0), "id", "v").count() == 0
