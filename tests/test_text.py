import pytest
from pyspark.sql import functions as F

from filigree.functions import text as X
from filigree.functions import vectors as V
from filigree.operators.extract import squeeze


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


def test_normalize_matches_python_white_space(spark):
    values = ["a​b", "a  b", " x\x1c\x1fy\x85z\t", "﻿", "", None, "a　b", "plain", "é\n\nf"]
    assert column(spark, values, X.normalize) == [None if v is None else squeeze(v) for v in values]


def test_tokenize_keeps_dots_and_hyphens_inside(spark):
    got = column(spark, ["Form 10-K, item 4.2 -x- BB6 café", "", None, "..."], X.tokenize)
    assert got == [["form", "10-k", "item", "4.2", "x", "bb6", "caf"], [], None, []]


def test_decode_falls_back_to_latin1(spark):
    df = spark.createDataFrame([(1, bytearray(b"caf\xc3\xa9")), (2, bytearray(b"caf\xe9")), (3, bytearray(b"")), (4, None)], "i int, b binary")
    got = {r.i: (r.d.text, r.d.encoding) for r in df.select("i", X.decode_bytes(F.col("b")).alias("d")).collect()}
    assert got == {1: ("café", "utf-8"), 2: ("café", "latin-1"), 3: ("", "utf-8"), 4: (None, None)}


def test_windows_reach_the_end(spark):
    texts = ["", "x" * 800, "x" * 801, "x" * 1400, "x" * 1401, None]
    got = column(spark, texts, X.windows)
    assert [None if g is None else [len(w) for w in g] for g in got] == [[0], [800], [800, 201], [800, 800], [800, 800, 201], None]


def test_quote_verdicts_in_order(spark):
    rows = [
        ("a quote that is long", "Here is a quote that is long.", True, "verified"),
        ("“curly” — it’s the same", 'So "curly" - it\'s the same text', True, "verified"),
        ("short", "short", True, "quote_too_short"),
        ("a quote that is long", "nothing here", True, "quote_not_found"),
        ("a quote that is long", None, False, "unknown_chunk"),
        (None, "text", True, "quote_too_short"),
        ("A Quote That Is Long", "a quote that is long", True, "quote_not_found"),
        ("          tiny          ", "tiny tiny tiny", True, "quote_too_short"),
    ]
    df = spark.createDataFrame(rows, "q string, t string, k boolean, want string")
    for r in df.withColumn("got", X.quote_verdict(F.col("q"), F.col("t"), F.col("k"))).collect():
        assert r.got == r.want, r


def test_nfkc_form(spark):
    assert column(spark, ["ﬁne ２０", "a​b", None, ""], X.canonical_nfkc) == ["fine 20", "a​b", None, ""]


def test_small_formats(spark):
    row = spark.range(1).select(
        X.pad_cik(F.lit("320193")).alias("a"),
        X.chunk_id(F.lit("0001-22-3"), F.lit(7)).alias("b"),
        X.archive_url(F.lit("0000320193"), F.lit("0001-22-3"), F.lit("d.htm")).alias("c"),
        X.human_size(F.lit(1536)).alias("d"),
        X.human_size(F.lit(12)).alias("e"),
        X.entity_name(F.lit('{"entityName": "Acme"}'), F.lit("A")).alias("f"),
        X.entity_name(F.lit("broken"), F.lit("A")).alias("g"),
        X.facts_present(F.array(F.lit("rev\\w+"), F.lit("12%")), F.lit("Revenue 12%")).alias("h"),
        X.offsets_sane(F.lit(3), F.lit(3)).alias("i"),
    ).first()
    assert tuple(row) == (
        "0000320193", "0001223-00007", "https://www.sec.gov/Archives/edgar/data/320193/0001223/d.htm", "1.5 KB", "12 B", "Acme", "A", True, False,
    )


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    got = [tuple(r) for r in df.select(V.dot(F.col("a"), F.col("b")), V.l2_normalize(F.col("a"))).collect()]
    assert got[0][0] == 3.0 and got[0][1] == pytest.approx([0.6, 0.8])
    assert got[1] == (0.0, [0.0, 0.0]) and got[2] == (None, None) and got[3][0] is None


def test_hashed_encoder_is_unit_and_total(spark):
    for v in column(spark, ["alpha beta alpha", "", "x"], V.hash_encode):
        assert len(v) == 512 and sum(x * x for x in v) == pytest.approx(1, abs=1e-6)


def test_sizes_round_as_binary_numbers_do(spark):
    sizes = [0, 999, 1000, 1050, 1150, 1250, 1350, 54150, 54149, 54151, 99950, 999949, 999950, 999999, 1_000_000, 1_050_000, 12_350_000, 7_450_001, *range(1000, 90_000, 50)]
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    want = {n: f"{n / 1_000_000:.1f} MB" if n >= 1_000_000 else f"{n / 1000:.1f} KB" if n >= 1000 else f"{n} B" for n in sizes}
    assert {r.n: r.s for r in df.select("n", X.human_size(F.col("n")).alias("s")).collect()} == want
