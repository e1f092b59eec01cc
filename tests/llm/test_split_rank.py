import math
import random

import pytest
from pyspark.sql import functions as F

from filigree.llm import idealpoint as I
from filigree.llm.split import SLACK, split_oversized

LIMIT, OVERLAP = 300, 30


def texts():
    r = random.Random(3)
    words = ["alpha", "beta", "é🛰", "gamma,", "delta;", "epsilon.", "zeta!\n", "eta.\n\n", "θ" * 40]
    yield "prose", " ".join(r.choice(words) for _ in range(900))
    yield "no_breaks", "x" * 2000
    yield "surrogates", "🛰a" * 700
    yield "paragraphs", "\n\n".join("sentence one. two " * 9 for _ in range(8))
    yield "one_over", "a" * (LIMIT + 1)


def test_pieces_cover_the_text_within_the_limit(spark):
    all_ = dict(texts())
    df = spark.createDataFrame([(k, v, 1) for k, v in all_.items()] + [("fits", "a" * LIMIT, 1), ("empty", "", 1), (None, None, 1)], "k string, text string, piece_no int")
    got = {}
    for r in split_oversized(df, ["k"], limit=LIMIT, overlap=OVERLAP).collect():
        got.setdefault(r.k, []).append(r)
    assert set(got) == set(all_)
    for k, rows in got.items():
        rows.sort(key=lambda r: r.piece_no)
        assert rows[0].char_start == 0 and rows[-1].char_end == len(all_[k]) and rows[0].n_pieces == len(rows)
        for r in rows:
            assert len(r.piece_text) <= LIMIT and r.piece_text == all_[k][r.char_start : r.char_end]
        for a, b in zip(rows, rows[1:]):
            assert a.char_end - b.char_start == b.overlap and OVERLAP <= b.overlap <= OVERLAP + SLACK
    assert all(r.piece_text.endswith("\n\n") for r in got["paragraphs"][:-1])
    assert all(r.piece_text[-1].isspace() for r in got["prose"][:-1])


def test_null_keys_and_bad_parameters(spark):
    df = spark.createDataFrame([(None, "a " * 400), (None, "a " * 400)], "k string, text string")
    assert split_oversized(df, ["k"], limit=LIMIT, overlap=OVERLAP).groupBy("piece_no").count().where("count <> 2").count() == 0
    assert split_oversized(df.limit(0), ["k"]).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, ["k"], limit=100, overlap=90)


ROWS = [
    ("q", "a", 10.0, 0.9, None), ("q", "b", 1000.0, 0.1, 3.0), ("q", "c", 20.0, float("nan"), 2.0), ("q", "a", 10.0, 0.9, None),
    ("one", "z", None, None, None), ("tie", "y", 1.0, 1.0, 1.0), ("tie", "x", 1.0, 1.0, 1.0), (None, "n", 1.0, 2.0, 3.0),
]
C = ["s1", "s2", "s3"]


def frame(spark):
    return spark.createDataFrame(ROWS, "qid string, item string, s1 double, s2 double, s3 double").withColumn("closeness", F.lit(9))


def test_places_order_by_their_sum(spark):
    got = {(r.qid, r.item): (r.p0, r.p1, r.p2, r.closeness) for r in I.closeness(frame(spark), "qid", "item", C, **I.EQUAL_PLACES).collect()}
    assert got["q", "a"][:3] == (3, 1, 3) and got["q", "b"][:3] == (1, 2, 1) and got["q", "c"][:3] == (2, 3, 2)
    assert {r.qid: r.item for r in I.leaders(frame(spark), "qid", "item", C, **I.EQUAL_PLACES).collect()} == {"q": "b", "one": "z", "tie": "x", None: "n"}


def test_equal_places_order_by_their_sum_in_every_group(spark):
    r = random.Random(3)
    rows = [(g, i, *[r.choice([None, float("nan"), float(r.randint(0, 30)), r.random() * 10**c]) for c in range(3)]) for g in range(4) for i in range(60)]
    df = spark.createDataFrame(rows, "qid long, item long, s1 double, s2 double, s3 double")
    got = I.ideal_point_ranking(df, "qid", "item", C, **I.EQUAL_PLACES).collect()
    for g in range(4):
        mine = sorted((x for x in got if x.qid == g), key=lambda x: x.place)
        sums = [x.p0 + x.p1 + x.p2 for x in mine]
        assert len(mine) == 60 and sums == sorted(sums)
        for k in range(3):
            values = {x[1]: x[2 + k] if x[2 + k] is not None and x[2 + k] == x[2 + k] else -1.0 for x in rows if x[0] == g}
            assert all(x[f"p{k}"] == 1 + sum(v > values[x.item] for v in values.values()) for x in mine)


def test_closeness_matches_the_formula(spark):
    got = {(r.qid, r.item): (r.closeness, r.place) for r in I.ideal_point_ranking(frame(spark), "qid", "item", C).collect()}
    assert len(got) == 7
    v = {"a": (10.0, 0.9, None), "b": (1000.0, 0.1, 3.0), "c": (20.0, None, 2.0)}
    near, far = dict.fromkeys(v, 0.0), dict.fromkeys(v, 0.0)
    for i in range(3):
        known = [x[i] for x in v.values() if x[i] is not None]
        norm = math.sqrt(sum(x * x for x in known))
        for k, x in v.items():
            y = min(known) if x[i] is None else x[i]
            near[k] += ((max(known) - y) / norm) ** 2
            far[k] += ((y - min(known)) / norm) ** 2
    for k in v:
        assert got["q", k][0] == pytest.approx(math.sqrt(far[k]) / (math.sqrt(far[k]) + math.sqrt(near[k])))
    assert got["tie", "x"] == (0.5, 1) and got["tie", "y"] == (0.5, 2) and got["one", "z"] == (0.5, 1)
    assert I.ideal_point_ranking(frame(spark).limit(0), "qid", "item", C).count() == 0


def test_outliers_do_not_rule(spark):
    rows = [("q", str(i), float(i), float(100 - i)) for i in range(40)] + [("q", "wild", 1e9, 0.0)]
    df = spark.createDataFrame(rows, "qid string, item string, a double, b double")
    wild = I.ideal_point_ranking(df, "qid", "item", ["a", "b"]).where("item = 'wild'").first()
    assert wild.place > 1
    with pytest.raises(ValueError):
        I.closeness(df, "qid", "item", ["a"], weights=[0.0])
