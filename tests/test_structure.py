import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from filigree.operators.chunking import pack_chunks, run_numbers
from filigree.operators.extract import extract_blocks, html_blocks, round_trips
from filigree.operators.sections import assign_sections, best_chain, detect_headings
from filigree.sources.filings import parse_filings

PAGE = """<html><head><title>No</title><style>p{}</style></head><body>
<ix:header>machine</ix:header><p>One &amp; two&#160;three <b>bold</b>
 span<span>ned</span></p><div>outer<p>inner</p>tail</div>
<script>if (a < b) { "<p>no</p>" }</script><div style="Display : NONE">hidden</div>
<table><tr><td>cell 1</td><td>&nbsp;</td></tr></table>a<br>b<br/>c AT&T <!-- note --> end</body>"""


def test_blocks_and_spans():
    found = extract_blocks(PAGE)
    assert [b.text for b in found] == ["One & two three bold spanned", "outer", "inner", "tail", "cell 1", "a b c AT&T end"]
    assert [b.in_table for b in found] == [False] * 4 + [True, False]
    assert all(round_trips(PAGE, b.char_start, b.char_end, b.text, True) for b in found)


@pytest.mark.parametrize("text", ["", "<", "<p", "a < b", "</p>", "<p>x", "&", "&#", "&#x41;&bogus;", "<!-- open", "🛰<p>é</p>", "<p a='>'>q</p>", "<script>x"])
def test_malformed_markup_never_raises(text):
    for b in extract_blocks(text):
        assert round_trips(text, b.char_start, b.char_end, b.text, True)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<br>", "<table>", "</table>", "&amp;", "&nbsp;", " ", "x", "é y", "\n", "​"]), max_size=25))
def test_every_block_round_trips(parts):
    doc = "".join(parts)
    found = extract_blocks(doc)
    assert all(round_trips(doc, b.char_start, b.char_end, b.text, True) for b in found)
    assert all(a.char_end <= b.char_start for a, b in zip(found, found[1:]))


def test_html_blocks_table(spark):
    df = spark.createDataFrame([("a", PAGE, 1), ("b", None, 2), ("c", "", 3), (None, "<p>x</p>", 4)], "k string, html string, text int")
    rows = html_blocks(df, "k").collect()
    assert len(rows) == 7 and all(r.verified for r in rows) and {r.k for r in rows} == {"a", None}


def blocks(spark, texts, form="10-K", doc="d"):
    rows = [(doc, i, t, i * 100, i * 100 + len(t), table, form) for i, (t, table) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc string, ord int, text string, char_start int, char_end int, in_table boolean, form string")


def test_headings_take_the_best_chain(spark):
    texts = [("Item 7", True), ("Item 9", False), ("Item 1. Business", False), ("prose, see Item 7 below", False), ("ITEM 1A. Risk Factors", False),
             ("Item 7. " + "long " * 40, False), ("Item 2 Properties", False)]
    b = blocks(spark, texts)
    got = {r.ord: r.key for r in detect_headings(b).collect()}
    assert got == {2: "item_1", 4: "item_1a", 6: "item_2"}
    labels = {r.ord: r.section_key for r in assign_sections(b, detect_headings(b)).collect()}
    assert labels == {0: "preamble", 1: "preamble", 2: "item_1", 3: "item_1", 4: "item_1a", 5: "item_1a", 6: "item_2"}


def test_quarterly_items_are_told_apart_by_part(spark):
    texts = [("Part I", False), ("Item 1. Financial Statements", False), ("Part II - Other Information", False), ("Item 1. Legal Proceedings", False), ("Item 6. Exhibits", False)]
    got = [r.key for r in detect_headings(blocks(spark, texts, "10-Q")).orderBy("ord").collect()]
    assert got == ["part1", "part1_item1", "part2", "part2_item1", "part2_item6"]
    assert detect_headings(blocks(spark, texts, "8-K")).count() == 0


def test_strict_suffix(spark):
    b = blocks(spark, [("Item 1 Business", False)])
    assert detect_headings(b).count() == 0 or detect_headings(b).first().key == "item_1b"
    assert detect_headings(b, strict=True).first().key == "item_1"


def test_chain_ties_take_the_first():
    assert best_chain(np.array([0, 1, 2]), np.array([5, 1, 2]), np.array([2.0, 1.0, 1.0])) == [0]
    assert best_chain(np.array([]), np.array([]), np.array([])) == []


def test_packing(spark):
    assert run_numbers(np.array([400] * 5), np.array(["k"] * 5), 1000).tolist() == [0, 0, 1, 1, 2]
    assert run_numbers(np.array([10, 10, 10]), np.array(["a", "b", "b"]), 1000).tolist() == [0, 1, 1]
    texts = [("x" * 400, i in (7, 8, 21)) for i in range(50)] + [("y" * 5000, False)]
    b = blocks(spark, texts).selectExpr("*", "'k' AS section_key", "'K' AS section_title")
    packed = pack_chunks(b, 1000).orderBy("chunk_order").collect()
    assert sum(r.n_blocks for r in packed) == 48 and packed[-1].oversized and not packed[0].oversized
    assert packed[0].text == "x" * 400 + "\n\n" + "x" * 400
    assert pack_chunks(b.limit(0)).count() == 0


def test_parse_filings_checks_every_promise(spark):
    body = b"<p>Item 1. Business</p><p>We make things.</p><table><tr><td>9</td></tr></table><p>Item 1A. Risk Factors</p><p>Caf\xe9 risk.</p>"
    sha = hashlib.sha256(body).hexdigest()
    ids = [("1", "10-K", sha), ("2", "10-K", "0" * 64), ("3", "8-K", sha)]
    rows = [(f"00-{i}", "ABC", "1", form, "2024-01-01", None, bytearray(body), s, f"f{i}.htm") for i, form, s in ids]
    df = spark.createDataFrame(
        rows, "accession_number string, ticker string, cik string, form string, filing_date string, report_date string, content binary, sha256 string, stored_filename string"
    )
    records, manifest = parse_filings(df)
    assert {r.accession_number: r.status for r in manifest.collect()} == {"00-1": "ok", "00-2": "bytes_changed", "00-3": "unsupported_form"}
    got = records.orderBy("chunk_order").collect()
    assert [(r.chunk_id, r.section_key, r.encoding) for r in got] == [("001-00000", "item_1", "latin-1"), ("001-00001", "item_1a", "latin-1")]
    assert got[1].text.endswith("Café risk.")
