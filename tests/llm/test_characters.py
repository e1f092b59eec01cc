import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filigree.llm import lookalike as K
from filigree.llm import mojibake as M

SAMPLES = [
    "plain ASCII  text\n\n twice", "", "   ", "ＦＵＬＬ　ｗｉｄｔｈ １２", "café naïve", "Ǻx á̖ á̖", "zero​width﻿ so­ft",
    "nb sp thin　wide", "раураl ѕсоре", "“quoted” ‘it’s’ — – ‑", "ﬁne ™ … ½ ²", "한글 한 가", "🛰 𝜎 ϲ", "Ελληνικά Привет", "́lone mark",
    "é" * 50, "x̀" * 30 + "y", "̈́ क़ Å K", "`tick`", "\x1cctl\x85nel",
]


def test_unified_form_matches_brute_force(spark):
    df = spark.createDataFrame([(i, s, 1) for i, s in enumerate(SAMPLES)] + [(99, None, 1), (1, "", 1)], "id int, text string, pos int")
    rows = K.unify(df, "id").collect()
    got = {r.id: r.unified for r in rows}
    assert len(rows) == len(SAMPLES) + 1 and got.pop(99) is None
    assert got == {i: K.fold_python(s) for i, s in enumerate(SAMPLES)}


def test_unified_form_of_random_texts(spark):
    import random

    r = random.Random(5)
    pool = [chr(c) for c in range(0x20, 0x600)] + [chr(c) for c in range(0x1E00, 0x2100)] + [chr(c) for c in range(0x300, 0x370)] * 4 + list("가각ᄀ ᅡ ᆨ")
    texts = ["".join(r.choice(pool) for _ in range(40)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {x.id: x.unified for x in K.unify(df, "id").collect()}
    assert {i: t for i, t in got.items() if t != K.fold_python(texts[i])} == {}


def test_recognise(spark):
    chunks = spark.createDataFrame([("c", "The café said “no” twice."), ("c", "The café said “no” twice."), ("d", "plain"), (None, "x")], "chunk_id string, text string")
    quotes = [(1, 'café said "no"', "c"), (2, "café said “no”", "c"), (3, "Cafe said", "c"), (4, "рlаin", "d"), (5, None, "c"), (6, "plain", "zz"), (7, "​", "c"), (8, "plain", None), (4, "рlаin", "d"), (9, "TWICE", "c")]
    claims = spark.createDataFrame(quotes, "claim_id long, quote string, chunk_id string").withColumn("text", F.lit("clash"))
    assert sorted(r.claim_id for r in K.recognise(claims, chunks).collect()) == [1, 4]
    assert K.recognise(claims.limit(0), chunks).count() == 0


CLEAN = [
    "Société Brévelle’s café-style naïve façade", "(±5 °C, 40 µm) § 12 — €5 or £6…", "À Paris, l’été à 5 %", "Größhafen Åskär’s Møllby’s", "Český Łodzin’s", "Señorial ¿qué?",
    "Привет мир", "Ελληνικά", "さとゆき", "서진가나", "🛰 𝜎", "раураl ѕсоре", "Å­skär’s", "ＦＵＬＬ", "plain", "fixed–price “Terms” ‘x’", "GRÖSSE ÉTÉ", "ﬁne ﬂeet",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_are_left_alone(text):
    assert M.repair(text) == (False, text, "")


GARBLE = ["Société Brévelle’s café-style naïve façade — not ours — cost €684 or £684.", "Größhafen über abgelöst, Señorial compañía registró 40 µm.", "“Regional Testing” programme’s crème-grade…"]


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "cp1251", "cp437", "cp850", "mac_roman"])
@pytest.mark.parametrize("text", GARBLE)
@pytest.mark.parametrize("layers", [1, 2])
def test_utf8_read_as_something_else_is_restored(text, codec, layers):
    bad = text
    table = {b: ch for ch, b in M._TO_BYTES[codec].items()}
    for _ in range(layers):
        bad = "".join(chr(b) if b < 128 else table[b] for b in bad.encode("utf-8"))
    found, fixed, used = M.repair(f"A plain sentence. {bad} Another one.")
    assert found and fixed == f"A plain sentence. {text} Another one.", used


@pytest.mark.parametrize("wrong,right", [("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("latin-1", "cp1252")])
@pytest.mark.parametrize("text", GARBLE)
def test_single_byte_mixups_are_found(text, wrong, right):
    back = {b: ch for ch, b in M._TO_BYTES[wrong].items()}
    to = {ch: b for ch, b in M._table(right).items()}
    bad = "".join(ch if ch < "\x80" else back[to[ch]] for ch in text)
    if bad != text:
        assert M.repair(bad)[0]


def test_lost_characters_are_found_but_not_restored():
    assert M.repair("a na�ve model")[0] and M.repair("fee \x80684") == (True, "fee €684", "latin-1>cp1252")


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_repair_never_raises(text):
    M.repair(text)


def test_garbled_table(spark):
    rows = [("d", 1, "cafÃ©"), ("d", 1, "cafÃ©"), ("d", 2, "café"), ("d", 3, None), ("d", 4, ""), (None, 5, "na�ve"), ("d", 6, "x" * 50_000 + " Ã¼ber")]
    df = spark.createDataFrame(rows, "doc string, ord int, text string").withColumn("repaired", F.lit("clash"))
    got = {(r.doc, r.ord): (r.repaired[-5:], r.restored) for r in M.garbled(df, ["doc", "ord"]).collect()}
    assert got == {("d", 1): ("café", True), (None, 5): ("na�ve", False), ("d", 6): (" über", True)}
    assert M.garbled(df.limit(0), ["doc", "ord"]).count() == 0


def test_compositions_are_unicodes():
    assert K.compositions()["é"] == "é" and all(unicodedata.normalize("NFC", k) == v for k, v in K.compositions().items())


DOUBLE = {
    "cp932": "こんにちは世界、東京の会社です。", "euc_jp": "日本語のテキストをここに書きます。", "gb2312": "中文文本在这里说明公司的业务。", "big5": "中文公司說明業務。",
    "euc_kr": "한국어 텍스트를 여기에 씁니다.",
}


@pytest.mark.parametrize("right", sorted(DOUBLE))
@pytest.mark.parametrize("wrong", ["cp1252", "latin-1"])
def test_double_byte_passages_come_back(right, wrong):
    text = DOUBLE[right]
    back = {b: c for c, b in M._TO_BYTES[wrong].items()}
    garbled = "".join(chr(b) if b < 128 else back[b] for b in text.encode(right))
    found, repaired, steps = M.repair("The name is " + garbled + " in full.")
    assert found and repaired == "The name is " + text + " in full." and steps in (f"cp1252>{right}", f"latin-1>{right}")


@pytest.mark.parametrize("text", ["ÉTÉ À ÎLE ÔTÉ", "Äußerungen über Öl", "é è à ù", "naïveté «oui»", "ÄÖÜ", "Þórður Ægisson", "¿Qué año?", "100 µm ±5 °C", "½ £5", "ÆØÅ æøå"])
def test_western_words_are_not_read_as_double_bytes(text):
    assert M.repair(text)[0] is False


@pytest.mark.parametrize("word", ["не", "ω", "中国", "και"])
@pytest.mark.parametrize("codec", ["cp1251", "latin-1", "cp437"])
def test_short_foreign_words_come_back(word, codec):
    assert M.repair(f"It says {word.encode().decode(codec)} here.")[:2] == (True, f"It says {word} here.")
