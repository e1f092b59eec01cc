"""Readable blocks of HTML documents, each with its exact span in the raw text.

One scan of the markup yields tags, references and literal text with their
positions; literal text and decoded references gather in a run that a block-level
tag closes. Trimming moves a span only across literal characters, so cutting the
raw text at a block's span and extracting again gives the block's text back.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags whose content a reader never sees, tags that end a block, and
# tags without an end tag.
HIDDEN = frozenset({"script", "style", "title", "ix:header", "ix:hidden"})
BLOCK = frozenset(
    "p div li ul ol table thead tbody tfoot tr td th caption h1 h2 h3 h4 h5 h6 blockquote hr section article".split()
)
VOID = frozenset("br img hr meta link input area base col embed source track wbr".split())

_MARKUP = re.compile(
    r"(?P<comment><!--(?:>|->|.*?--!?>|.*\Z))"
    r"|(?P<decl><[!?][^>]*>)"
    r"|(?P<close></(?P<ended>[a-zA-Z][^\s/>]*)[^>]*>)"
    r"|(?P<open><(?P<begun>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>)"
    r"|(?P<ref>&(?:\#[0-9]+|\#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);?)"
    r"|(?P<text>[^<&]+|[<&])",
    re.DOTALL,
)
_STYLE = re.compile(r"""\bstyle\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_RAW_TEXT = frozenset({"script", "style"})


class Block(NamedTuple):
    text: str
    char_start: int
    char_end: int
    in_table: bool


def squeeze(text: str) -> str:
    """The Python twin of ``functions.text.normalize``."""
    return " ".join(text.replace("​", "").replace("﻿", "").split())


def _closed(run: list[tuple[int, int, str, bool]], in_table: bool) -> list[Block]:
    """The block of a run of (start, end, decoded, literal) pieces, if it says anything."""
    first, last = 0, len(run)
    while first < last and run[first][3] and not run[first][2].strip():
        first += 1
    while last > first and run[last - 1][3] and not run[last - 1][2].strip():
        last -= 1
    if first == last:
        return []
    (start, _, head, head_literal), (_, end, tail, tail_literal) = run[first], run[last - 1]
    if head_literal:
        start += len(head) - len(head.lstrip())
    if tail_literal:
        end -= len(tail) - len(tail.rstrip())
    text = squeeze("".join(piece[2] for piece in run[first:last]))
    return [Block(text, start, end, in_table)] if text else []


def extract_blocks(doc: str) -> list[Block]:
    """Blocks in reading order. Malformed markup is text; nothing raises."""
    blocks: list[Block] = []
    run: list[tuple[int, int, str, bool]] = []
    open_tags: list[tuple[str, bool]] = []
    hidden = tables = at = 0
    size = len(doc)
    while at < size:
        m = _MARKUP.match(doc, at)
        kind = next(g for g in ("comment", "decl", "close", "open", "ref", "text") if m.group(g) is not None)
        start, at = m.span()
        if kind == "text":
            if not hidden:
                run.append((start, at, m.group(), True))
        elif kind == "ref":
            if not hidden:
                run.append((start, at, html.unescape(m.group()), False))
        elif kind == "open":
            tag, attrs = m["begun"].lower(), m["attrs"]
            if tag == "br":
                if not hidden:
                    run.append((start, at, " ", False))
                continue
            if tag in BLOCK:
                blocks += _closed(run, tables > 0)
                run = []
            if attrs.rstrip().endswith("/") or tag in VOID:
                continue
            tables += tag == "table"
            style = _STYLE.search(attrs)
            unseen = tag in HIDDEN or bool(style and _NOT_SHOWN.search(html.unescape(style[1])))
            open_tags.append((tag, unseen))
            hidden += unseen
            if tag in _RAW_TEXT:  # markup inside is not markup
                end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(doc, at)
                at = end.start() if end else size
        elif kind == "close":
            tag = m["ended"].lower()
            if tag in BLOCK:
                blocks += _closed(run, tables > 0)
                run = []
                tables -= tag == "table" and tables > 0
            if any(t == tag for t, _ in open_tags):
                while True:
                    t, unseen = open_tags.pop()
                    hidden -= unseen
                    if t == tag:
                        break
    return blocks + _closed(run, tables > 0)


def round_trips(doc: str, start: int, end: int, text: str, include_tables: bool) -> bool:
    found = extract_blocks(doc[start:end])
    return "\n\n".join(b.text for b in found if include_tables or not b.in_table) == text


def html_blocks(df: DataFrame, key: str, markup: str = "html") -> DataFrame:
    """``key, ord, text, char_start, char_end, in_table, verified``: a row per block.

    Offsets are code points into the decoded text. ``verified`` tells whether the
    block's span gives its text back. Null and empty documents give no rows;
    repeated rows each give theirs; columns other than ``key`` are not carried.
    """
    kind = dict(df.select(F.col(key).alias("k")).dtypes)["k"]
    names = ["k", "ord", "text", "char_start", "char_end", "in_table", "verified"]
    types = [None, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, doc in enumerate(b.column(1).to_pylist()):
                found = extract_blocks(doc)
                rows = [(n, *x, round_trips(doc, x.char_start, x.char_end, x.text, True)) for n, x in enumerate(found)]
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), types[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array([i] * len(rows))), *columns], names=names
                    )

    rows = df.select(F.col(key).alias("k"), F.col(markup).alias("t")).where(F.length(markup) > 0)
    out = rows.mapInArrow(
        run, f"k {kind}, ord int, text string, char_start int, char_end int, in_table boolean, verified boolean"
    )
    return out.withColumnRenamed("k", key)


def verify_spans(df: DataFrame, doc: str, start: str, end: str, text: str, include_tables: bool, name: str) -> DataFrame:
    """Add ``name``: whether the span of ``doc`` gives ``text`` back. Null inputs give false."""

    @F.pandas_udf("boolean")
    def check(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for d, s, e, t in batches:
            yield pd.Series(
                [
                    None not in (x, v) and a == a and z == z and round_trips(x, int(a), int(z), v, include_tables)
                    for x, a, z, v in zip(d, s, e, t)
                ],
                dtype=bool,
            )

    return df.withColumn(name, check(F.col(doc), F.col(start).cast("double"), F.col(end).cast("double"), F.col(text)))


def verify_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``doc, chunk_order, ok``: whether each chunk's span of ``docs(doc, html)`` gives its text back.

    A document's markup meets all its chunks at once, in one row.
    """
    spans = chunks.groupBy("doc").agg(F.collect_list(F.struct("chunk_order", "char_start", "char_end", "text")).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, order, ok = [], [], []
            for i, (html_text, found) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                for c in found:
                    at.append(i)
                    order.append(c["chunk_order"])
                    known = None not in (c["char_start"], c["char_end"])
                    ok.append(known and round_trips(html_text, c["char_start"], c["char_end"], c["text"], False))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(order, pa.int32()), pa.array(ok, pa.bool_())], names=["doc", "chunk_order", "ok"]
            )

    kind = dict(docs.select("doc").dtypes)["doc"]
    return docs.select("doc", "html").join(spans, "doc").mapInArrow(run, f"doc {kind}, chunk_order int, ok boolean")
