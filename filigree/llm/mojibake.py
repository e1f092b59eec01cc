"""Problem 6: find and restore text that was decoded with the wrong encoding.

Round-trip repair, token by token: the token is encoded again under a candidate
legacy encoding and strictly decoded as the intended one; the result stands if
a garbling cost drops, and the step repeats for nested layers. A garbled
passage seldom fills a whole text, so a token, not the text, is the unit; the
sentence around a token that gave an encoding away is then tried as well.

A JVM filter drops texts without a character beyond ASCII; what is left goes
through one Arrow kernel without a shuffle. Tokens repeat, so each worker
remembers the verdicts of recent ones.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (decoded wrongly as, really): fixed values, the pairs that are tried.
UTF8_AS = ("cp1252", "latin-1", "cp1251", "cp1250", "cp437", "cp850", "mac_roman", "koi8_r", "cp1254", "iso8859-15")
BYTE_AS = (("latin-1", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp850"))
#: Double-byte encodings read as a Western one, with the lead bytes of their everyday ideographs or syllables. Where all
#: of a passage is everyday Korean it is hardly anything else, kana tell Japanese, and so on down the list.
DOUBLE_AS = ("cp1252", "latin-1")
DOUBLE = {"euc_kr": (0xB0, 0xC8), "cp932": (0x88, 0x97), "euc_jp": (0xB0, 0xCF), "gb2312": (0xB0, 0xD7), "big5": (0xA4, 0xC6)}
#: Characters at least that a double-byte reading must give where no neighbour gave the encoding away.
DOUBLE_CHARS = 2
MAX_LAYERS = 4

_NO_WIDTH = "​‌‍⁠﻿"
_BLANKS_BEYOND_LATIN1 = "  -     　"
_TOKEN = re.compile(f"[^ \\t\\r\\n\\f{_BLANKS_BEYOND_LATIN1}]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z])|\n+")
_CONSONANTS = frozenset("bcdfghjklmnpqrstvwxz")
#: "í" as UTF-8 under a Western code page, after its second byte, a soft hyphen, was dropped.
_DROPPED = re.compile("(?<=[a-zà-ÿ])Ã(?=[a-zà-ÿ])")
_RUN = re.compile(f"[^\\x00-\\x7f{_NO_WIDTH}]+")
_SEQ = re.compile(
    rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}"
    rb"|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
)


def _table(codec: str) -> dict[str, int]:
    """char -> byte; bytes a code page leaves undefined stand for their C1 control."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    return out


_TO_BYTES = {c: _table(c) for c in {*UTF8_AS, *DOUBLE_AS, *(w for w, _ in BYTE_AS)}}
_FROM_BYTES = {c: {b: ch for ch, b in _table(c).items()} for c in {r for _, r in BYTE_AS}}


def _script(ch: str) -> str:
    cp = ord(ch)
    if cp < 0x250 or 0x1E00 <= cp <= 0x1EFF or 0x2C60 <= cp <= 0x2C7F or 0xA720 <= cp <= 0xA7FF or 0xFB00 <= cp <= 0xFB06:
        return "L"
    if 0x370 <= cp <= 0x3FF or 0x1F00 <= cp <= 0x1FFF:
        return "G"
    return "C" if 0x400 <= cp <= 0x52F else "O"


@lru_cache(maxsize=1 << 17)
def oddness(token: str) -> tuple[float, bool]:
    """(how unlikely the token's non-ASCII characters are in their places, whether scripts mix)."""
    cost, scripts = 0.0, set()
    plain = any(c.isascii() and c.isalpha() for c in token)
    n = len(token)
    for i, ch in enumerate(token):
        if ch < "\x80":
            continue
        left, right = token[i - 1] if i else "", token[i + 1] if i + 1 < n else ""
        la, ra = left.isalpha(), right.isalpha()
        kind = unicodedata.category(ch)
        if "\x80" <= ch <= "\x9f" or ch == "�" or kind in ("Co", "Cn", "Cs"):
            cost += 3
        elif kind in ("Zs", "Cf"):
            pass
        elif kind[0] == "L" and kind != "Lm" and ch not in "ªº":
            script = _script(ch)
            scripts.add(script)
            cost += 1
            if plain and script in "GC":
                cost += 2
            if kind == "Lu":
                inside = left.islower() or (la and right.islower())
                before_capital = right.isupper() and token[i + 2 : i + 3].islower()
                if inside or right.isdigit() or left.isdigit() or before_capital:
                    cost += 2
                elif script == "L" and not la and not ra and ch not in "ÀÁÉÓÅÖ":
                    cost += 2  # a letter that is no word in the languages that have it
                if ch in "ÃÂГВ" and right in ("\xa0", "\xad") and not la:
                    cost += 2
            elif right.isupper() and script == "L" and ch != "ß":
                cost += 2
            elif ch == "œ" and la and right == "n":
                cost += 2
            elif ch in "šž" and left in _CONSONANTS and right in _CONSONANTS:
                cost += 2
        elif ch in "’‘":
            cost += 0.5 if ch == "’" or not la else 1.5
        elif ch in "“”„‚«»‹›":
            cost += 2.5 if la and ra else 0.5
        elif ch in "–—…":
            cost += 0.5 if not ra or la else 1
        elif ch in "¡¿":
            cost += 0.5 if ra and not la and ("!" if ch == "¡" else "?") in token else 2
        elif ch in "°":
            cost += 0.5 if right in ("C", "F", "", ",", ")", ".") and not la else 3
        elif ch in "€£¥":
            cost += 2.5 if la else 0.5
        elif ch in "§±µ®©™¼½¾²³¹":
            cost += 3 if la and ra else 1
        elif kind[0] == "M":
            cost += 2
        elif kind == "So" and ord(ch) >= 0x1F000:
            cost += 1
        else:  # spacing accents, ordinals, box drawing, mathematics and other signs
            cost += 3.5 if la or ra else 1.5
    if plain:
        scripts.add("L")
    return cost, len(scripts & {"L", "G", "C"}) > 1 or ("O" in scripts and "L" in scripts and plain)


def _as_utf8(token: str, codec: str) -> tuple[str, int] | None:
    """The token with every high run decoded as UTF-8, and the number of sequences; None unless all decode."""
    table = _TO_BYTES[codec]
    out, at, found = [], 0, 0
    for m in _RUN.finditer(token):
        try:
            raw = bytes([table[c] for c in m.group()])
        except KeyError:
            return None
        piece, end = [], 0
        for s in _SEQ.finditer(raw):
            if raw[end : s.start()].strip(b"\xa0\xad"):
                return None
            piece += [m.group()[end : s.start()], s.group().decode("utf-8")]
            end, found = s.end(), found + 1
        if raw[end:].strip(b"\xa0\xad"):
            return None
        piece.append(m.group()[end:])
        out += [token[at : m.start()], *piece]
        at = m.end()
    return ("".join([*out, token[at:]]), found) if found else None


def _as_bytes(token: str, wrong: str, right: str) -> str | None:
    to, back = _TO_BYTES[wrong], _FROM_BYTES[right]
    out = []
    for ch in token:
        if ch < "\x80" or ch in _NO_WIDTH:
            out.append(ch)
        elif ch in to:
            out.append(back[to[ch]])
        else:
            return None
    return "".join(out)


def _everyday(ch: str, codec: str) -> bool | None:
    """Whether ``ch`` is in everyday use where ``codec`` is; None for punctuation and forms of any script."""
    if "\u3000" <= ch <= "\u303f" or "\uff00" <= ch <= "\uffef":
        return None
    if "\u3040" <= ch <= "\u30ff":
        return codec in ("cp932", "euc_jp")
    low, high = DOUBLE[codec]
    return ch.isalpha() and low <= ch.encode(codec)[0] <= high and (codec != "euc_kr" or "\uac00" <= ch <= "\ud7a3")


def _as_double(token: str, wrong: str, right: str, least: int = DOUBLE_CHARS) -> str | None:
    """The token read as double bytes, if seven in eight characters that come are everyday ones and none is left over."""
    to = _TO_BYTES[wrong]
    try:
        got = bytes([ord(c) if c < "\x80" else to[c] for c in token]).decode(right)
    except (KeyError, UnicodeDecodeError):
        return None
    new = [_everyday(c, right) for c in got if c >= "\x80"]
    if new.count(False) * 7 > new.count(True) or new.count(True) < least or any(c.isascii() and c.isalpha() for c in got):
        return None
    return got


@lru_cache(maxsize=1 << 17)
def _repair_once(token: str) -> tuple[str, tuple[str, ...]] | None:
    """The cheapest accepted repair: (text, its steps as 'wrong>right').

    Layers of one encoding are undone together, since what lies between two of
    them may look worse than either.
    """
    cost, _ = oddness(token)
    best = None
    for codec in UTF8_AS:
        layer, steps, sequences = token, (), 0
        while len(steps) < MAX_LAYERS and (got := _as_utf8(layer, codec)):
            layer, steps, sequences = got[0], (*steps, f"{codec}>utf-8"), got[1]
            new, mixed = oddness(layer)
            foreign = any(c.isalpha() and _script(c) != "L" for c in layer)
            if not mixed and new < cost and (not foreign or sequences >= 3 or 2 * new <= cost) and (best is None or new < best[0]):
                best = (new, layer, steps)
    if best:
        return best[1:]
    if sum(c >= "\x80" for c in token) >= DOUBLE_CHARS:
        # The first reading that is everyday writing throughout; Japanese with kana goes before what has none.
        read = [(got, wrong, right) for right in DOUBLE for wrong in DOUBLE_AS if (got := _as_double(token, wrong, right)) is not None]
        read.sort(key=lambda r: not any("\u3040" <= c <= "\u30ff" for c in r[0]))
        for got, wrong, right in read:
            if oddness(got)[0] < cost:
                return got, (f"{wrong}>{right}",)
    for wrong, right in BYTE_AS:
        got = _as_bytes(token, wrong, right)
        if got is not None and got != token:
            new, mixed = oddness(got)
            if not mixed and new <= cost - 2 and (best is None or new < best[0]):
                best = (new, got, (f"{wrong}>{right}",))
    return best[1:] if best else None


@lru_cache(maxsize=1 << 17)
def repair_token(token: str) -> tuple[str, tuple[str, ...]]:
    steps: list[str] = []
    while len(steps) < MAX_LAYERS and (got := _repair_once(token)):
        token, more = got
        steps += more
    return token, tuple(steps)


def _again(sentence: str, steps: tuple[str, ...]) -> str:
    """The other tokens of a sentence, under an encoding one of them gave away."""

    def one(m: re.Match) -> str:
        token = m.group()
        if token.isascii() or repair_token(token)[1]:
            return token
        for step in steps:
            wrong, _, right = step.partition(">")
            if right == "utf-8":
                got = (_as_utf8(token, wrong) or (None,))[0]
            else:
                got = _as_double(token, wrong, right, 1) if right in DOUBLE else _as_bytes(token, wrong, right)
            if got is not None and oddness(got)[0] <= oddness(token)[0] and not oddness(got)[1]:
                return got
        return token

    return _TOKEN.sub(one, sentence)


def repair(text: str) -> tuple[bool, str, str]:
    """(whether a passage is garbled, the text as far as restored, the encodings undone)."""
    used: dict[str, None] = {}
    out, at = [], 0
    for end in [*(m.end() for m in _SENTENCE.finditer(text)), len(text)]:
        part, at = text[at:end], end
        if not part.isascii():
            steps: dict[str, None] = {}
            for token in set(_TOKEN.findall(part)):
                if not token.isascii():
                    steps |= dict.fromkeys(repair_token(token)[1])
            if _DROPPED.search(part):
                part = _DROPPED.sub("í", part)
                used["cp1252>utf-8"] = None
            if steps:
                part = _again(part, tuple(steps))
                part = _TOKEN.sub(lambda m: m.group() if m.group().isascii() else repair_token(m.group())[0], part)
                used |= steps
        out.append(part)
    whole = "".join(out)
    lost = bool(re.search("[\x80-\x9f�]", text))
    return bool(used) or lost, whole, ",".join(used)


def _kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        got = [repair(t) for t in pdf["text"]]
        keep = [g[0] for g in got]
        hit = pdf[keep].copy()
        kept = [g for g in got if g[0]]
        hit["repaired"] = pd.Series([g[1] for g in kept], index=hit.index, dtype=object)
        hit["encodings"] = pd.Series([g[2] for g in kept], index=hit.index, dtype=object)
        hit["restored"] = pd.Series(
            [not re.search("[\x80-\x9f�]", g[1]) for g in kept], index=hit.index, dtype=bool
        )
        yield hit


def garbled(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Rows ``keys, text, repaired, encodings, restored`` of the texts with a garbled passage.

    ``repaired`` is the text with the passages restored that could be;
    ``encodings`` lists the steps undone as ``wrong>right``; ``restored`` is
    false where characters are lost for good (replacement characters, controls
    that fit no encoding). Null, empty and clean texts give no row. Rows that
    repeat a key count once, by the first text in order. Other columns are not carried, so their names
    cannot clash; ``keys`` may hold nulls.
    """
    rows = df.select(*keys, F.col(text).alias("text")).where(F.col("text").rlike(r"[^\x00-\x7f]"))
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", text string, repaired string, encodings string, restored boolean"
    hits = rows.mapInPandas(_kernel, schema)
    first = F.min(F.struct("text", "repaired", "encodings", "restored")).alias("m")
    return hits.groupBy(*keys).agg(first).select(*keys, "m.*")
