"""Problem 9: repetition inside a document, by line-first cleaning.

Each line is judged by rules, failing lines are removed, and a document that
loses too much of its text is rejected. The rules: a line of prose ends in
punctuation; navigation is short or mostly separators; boilerplate repeats what
the document already said. For the last rule each five-word sequence belongs to
the line in which it ends, and counts as repeated if the document has it before
that place; a line fails where ``LINE_SHARE`` of its sequences are repeated.

A document of which a share s is repeated loses, to that rule alone, at least
(s - LINE_SHARE) / (1 - LINE_SHARE) of its sequences: the lines that stay hold
fewer than LINE_SHARE repeated ones each. ``least_loss`` states this in words,
so rejecting by loss misses no document at or above a share.

One Arrow kernel per input partition; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
N = 5
#: Share of repeated sequences at which a line is boilerplate.
LINE_SHARE = 0.15
#: Characters that the kernel judges together.
AT_ONCE = 20_000_000
RULES = ("punctuation", "navigation", "boilerplate")
#: Endings of a prose line.
ENDINGS = tuple(".!?…。！？:;\"”’'»)]")
SEPARATORS = re.compile(r"[|»›>•·/\\]")

COLUMNS = {
    "n_words": pa.int32(), "n_sequences": pa.int32(), "n_repeated": pa.int32(), "n_lines": pa.int32(), "n_no_punctuation": pa.int32(),
    "n_navigation": pa.int32(), "n_boilerplate": pa.int32(), "words_kept": pa.int32(),
}


def least_loss(share: float, n_words: int) -> float:
    """The share of words that a document of ``n_words`` or more words, repeated to ``share``, loses at least."""
    return (share - LINE_SHARE) / (1 - LINE_SHARE) * (n_words - N + 1) / n_words


def _ends_badly(line: str) -> bool:
    return not line.rstrip().endswith(ENDINGS)


def _navigation(line: str, n_words: int) -> bool:
    return n_words < 3 or len(SEPARATORS.findall(line)) * 2 >= n_words


def judge(texts: list[str], rules: tuple[str, ...] = RULES, keep: bool = False) -> dict[str, np.ndarray | list[str]]:
    """The columns of ``COLUMNS`` for each text, computed for all of them at once, and with ``keep`` its ``kept_text``."""
    vocabulary: dict[str, int] = {}
    number = vocabulary.setdefault
    ids: list[int] = []
    line_words: list[int] = []  # words of each line
    line_doc: list[int] = []
    bad_end: list[bool] = []
    navigation: list[bool] = []
    lines: list[str] = []
    for d, text in enumerate(texts):
        for line in text.split("\n"):
            w = WORD.findall(line.lower())
            if w:
                ids += [number(x, len(vocabulary) + 1) for x in w]
                line_words.append(len(w))
                line_doc.append(d)
                bad_end.append(_ends_badly(line))
                navigation.append(_navigation(line, len(w)))
                if keep:
                    lines.append(line)
    n_docs, n_lines = len(texts), len(line_words)
    lw, ld = np.asarray(line_words, np.int64), np.asarray(line_doc, np.int64)
    doc_words = np.bincount(ld, weights=lw, minlength=n_docs).astype(np.int64)
    words = np.asarray(ids, np.uint64)
    line_of = np.repeat(np.arange(n_lines), lw)
    doc_of = ld[line_of] if n_lines else np.empty(0, np.int64)
    repeated = np.zeros(n_lines, np.int64)
    sequences = np.zeros(n_lines, np.int64)
    last = len(words) - N + 1
    if last > 0:
        whole = np.flatnonzero(doc_of[:last] == doc_of[N - 1 :])
        # A 64-bit mix of the document and five words stands for the sequence.
        key = doc_of[whole].astype(np.uint64)
        with np.errstate(over="ignore"):
            for j in range(N):
                key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words[whole + j] * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(32)
        order = np.argsort(key, kind="stable")
        same = np.r_[False, key[order][1:] == key[order][:-1]]
        again = np.empty(len(key), bool)
        again[order] = same  # the first occurrence in the document is not a repetition
        at = line_of[whole + N - 1]
        sequences = np.bincount(at, minlength=n_lines)
        repeated = np.bincount(at, weights=again, minlength=n_lines).astype(np.int64)
    verdicts = {
        "punctuation": np.asarray(bad_end, bool),
        "navigation": np.asarray(navigation, bool),
        "boilerplate": (repeated > 0) & (repeated >= LINE_SHARE * sequences - 1e-9),
    }
    fails = np.zeros(n_lines, bool)
    for r in rules:
        fails |= verdicts[r]

    def per_doc(x: np.ndarray) -> np.ndarray:
        return np.bincount(ld, weights=x, minlength=n_docs).astype(np.int32)

    out = {
        "n_words": doc_words.astype(np.int32),
        "n_sequences": per_doc(sequences),
        "n_repeated": per_doc(repeated),
        "n_lines": per_doc(np.ones(n_lines)),
        "n_no_punctuation": per_doc(verdicts["punctuation"].astype(float)),
        "n_navigation": per_doc(verdicts["navigation"].astype(float)),
        "n_boilerplate": per_doc(verdicts["boilerplate"].astype(float)),
        "words_kept": per_doc(np.where(fails, 0, lw)),
    }
    if keep:
        kept: list[list[str]] = [[] for _ in texts]
        for n in np.flatnonzero(~fails).tolist():
            kept[line_doc[n]].append(lines[n])
        out["kept_text"] = ["\n".join(k) for k in kept]
    return out


def line_first(
    df: DataFrame, key: str, text: str = "text", max_loss: float = 0.5, rules: tuple[str, ...] = RULES, keep: bool = False
) -> DataFrame:
    """One row per row with a text: ``key``, the counts of ``COLUMNS``, shares and the verdict.

    ``repeated_share`` is the share of five-word sequences that repeat an earlier
    one of the same text (0 below five words); ``lost_share`` the share of words
    in lines that failed one of ``rules``; ``rejected`` says that it reaches
    ``max_loss``. With ``keep`` the column ``kept_text`` holds the lines that
    passed, of rejected texts too; lines without a word go. A word is a run of
    Unicode letters and digits, in lower case. Null texts give no row; empty ones
    a row of zeros, not rejected. Repeated rows each count; other columns are not
    carried.
    """
    if unknown := set(rules) - set(RULES):
        raise ValueError(f"unknown rules {sorted(unknown)}")
    kind = dict(df.select(F.col(key).alias("id")).dtypes)["id"]
    types = {**COLUMNS, **({"kept_text": pa.string()} if keep else {})}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Very long texts: judge only so many characters at once.
            chars = np.cumsum(np.asarray(pc.utf8_length(b.column(1)), np.int64))
            cuts = [0, *(np.flatnonzero(np.diff(chars // AT_ONCE)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    got = judge(b.column(1).slice(lo, hi - lo).to_pylist(), rules, keep)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(lo, hi - lo), *[pa.array(got[c], t) for c, t in types.items()]], names=["id", *types]
                    )

    rows = df.select(F.col(key).alias("id"), F.col(text).alias("t")).where("t is not null")
    schema = f"id {kind}, " + ", ".join(f"{c} int" for c in COLUMNS) + ", kept_text string" * keep
    judged = rows.mapInArrow(run, schema)
    share = F.when(F.col("n_sequences") > 0, F.col("n_repeated") / F.col("n_sequences")).otherwise(F.lit(0.0))
    lost = F.when(F.col("n_words") > 0, (F.col("n_words") - F.col("words_kept")) / F.col("n_words")).otherwise(F.lit(0.0))
    return judged.select(
        F.col("id").alias(key),
        *types,
        share.alias("repeated_share"),
        lost.alias("lost_share"),
        ((lost >= max_loss) & (F.col("n_words") > 0)).alias("rejected"),
    )
