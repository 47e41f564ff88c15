"""Garbled text from wrong character encoding: find it and restore it (problem 3).

Method: best-first search. A state is a piece of text; an edge encodes it with the code page it
was wrongly read as and decodes the bytes with the one it was written in, or resolves character
references. Visited states are hashed; a character-plausibility cost plus the cost of the edges
orders the queue, and the cheapest reachable text wins if it beats the input by a margin.

The search runs per word of a field (words without a suspicious character are never searched),
so a passage inside an intact text is found, and the distinct words are memoised per task. It has no bound
on states or depth: every operation but the first single-byte one shortens the text, edges cost, and a
path that has paid as much as the best text is left, so it ends by itself.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Code pages that text is wrongly read with, and those it is written with.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "koi8-r")
SINGLE_READ = (("cp850", "cp1252"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "cp1251"), ("latin-1", "cp1251"),
               ("cp1252", "koi8-r"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"),
               ("cp1252", "cp1250"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp866"))
# Letters beyond ASCII of the nine languages en de fr es pt it nl pl ru, and usual signs.
LETTERS = set("äöüßàâæçèéêëîïôœùûÿáíñóúãõìòąćęłńśźżÄÖÜÀÂÆÇÈÉÊËÎÏÔŒÙÛŸÁÍÑÓÚÃÕÌÒĄĆĘŁŃŚŹŻåÅøØ")
# Small letters of other European languages: plausible by themselves, as capitals only where a capital stands.
FOREIGN = {chr(c) for c in [0xF0, 0xFD, 0xFE, *range(0x100, 0x180), 0x219, 0x21B] if chr(c).islower()} - {"ŉ", "ſ"}
SIGNS = set("–—‘’“”„…•€«»°№£§·±×²³¹½¼¾º¿¡−≈≥≤→µ©®™†\u00a0\u2009\u202f\u3000\u2007")
BOXES = re.compile("[\u2500-\u259f]")
WIDE = re.compile("[\u3400-\u9fff]")
SUSPECT = re.compile(r"[^\x00-\x7f]")
WORD = re.compile(r"[^ \t\n\r]+")
GATE = 0.9  # cheaper words are plausible as they stand
MARGIN = 0.3  # a restored word must be cheaper by this much, edges included
EDGE, EDGE_SINGLE, EDGE_WIDE = 0.4, 1.7, 0.8  # UTF-8 checks itself, single-byte pages decode anything
REFERENCE = re.compile(r"&(?:amp;)*(?!(?:amp|lt|gt|quot|apos|nbsp);)(?:[A-Za-z][A-Za-z0-9]{1,30}|#\d{3,7}|#[xX][0-9A-Fa-f]{2,6});")
BEYOND = re.compile(r"[^\x00-\x7f]+")


def _encode(text: str, page: str) -> bytes | None:
    """Bytes of text in a code page; C1 controls pass, as lenient decoders let them through."""
    try:
        return text.encode(page)
    except UnicodeEncodeError:
        if not page.startswith("cp125"):
            return None
    out = bytearray()
    for ch in text:
        try:
            out += ch.encode(page)
        except UnicodeEncodeError:
            if 0x80 <= ord(ch) <= 0x9F:
                out.append(ord(ch))
            else:
                return None
    return bytes(out)


def _script(ch: str) -> str:
    o = ord(ch)
    if o < 0x250:
        return "L"
    if 0x370 <= o < 0x400:
        return "G"
    if 0x400 <= o < 0x530:
        return "C"
    return "X"


def _capital(text: str, i: int) -> bool:
    """Whether a capital stands where one may: at the start of a word in small letters, or among capitals."""
    before, after = text[i - 1 : i], text[i + 1 : i + 2]
    if not before.isalpha():
        return after.isascii() and after.isalpha()
    return before.isascii() and before.isupper() and (not after.isalpha() or after.isupper())


def cost(text: str) -> float:
    """How implausible a piece of text is: 0 for plain words, more for signs that decoding errors leave."""
    total, prev, run = 0.0, "", 0
    seen: set[str] = set()
    n = len(text)
    loud = n > 3 and text.isalpha() and text.isupper() and any(c.isascii() for c in text)  # a word in capitals may hold any
    for i, ch in enumerate(text):
        o = ord(ch)
        if o < 128:
            if o < 32 and ch not in "\t\n\r":
                total += 6
            if ch.isalpha():
                seen.add("L")
        elif 0x80 <= o <= 0x9F:
            total += 6
        elif ch == "\ufffd":
            total += 8
        elif BOXES.match(ch):
            total += 2.5
        elif ch.isalpha() and ch not in "µªº":
            s = _script(ch)
            seen.add(s)
            if s == "L":
                total += 0.35 if ch in LETTERS or ch in FOREIGN or ch.lower() in FOREIGN and (loud or _capital(text, i)) else 1.8
                run += 1
                if run > 1:
                    total += 0.2 if run == 2 or loud else 1.5
                # a capital after a small letter, or an accented capital amid small ones
                if ch.isupper() and prev.islower():
                    total += 3.0
                elif ch.isupper() and i + 1 < n and text[i + 1].islower() and prev.isalpha():
                    total += 1.0
            elif s == "C":
                low = ch.lower()
                total += 2.2 if not ("а" <= low <= "я" or low == "ё") else 0.3 if low in "ъэщфцюхжш" else 0.1
                if ch.isupper() and prev.islower():
                    total += 3.0
            elif s == "G":
                total += 0.5
            else:
                total += 0.2 if o >= 0xFF00 else 3.0
        elif unicodedata.combining(ch):
            total += 0.5 if o < 0x370 and prev.isalpha() else 3.0
        elif ch == "’" and prev.isalpha() and i + 1 < n and text[i + 1].isalpha():
            total += 0.1
        elif ch in SIGNS:
            total += 0.7
            after = text[i + 1] if i + 1 < n else ""
            if ch not in "’‘–—…«»“”„\u00a0\u2009\u202f\u3000\u2007№·−" and prev.isalpha() and (after.isalpha() or after in "±³¹¼½¾£§©®" and after):
                total += 2.6
            if ch == "\u00a0" and prev and ord(prev) > 127 and prev.isalpha() and prev.isupper():
                total += 2.0
            if prev and ord(prev) > 127 and ch in "°±²³£§©®¼½¾µ™†¿¡" and not prev.isspace():
                total += 2.0
        else:
            c = unicodedata.category(ch)
            total += 0.2 if c in ("Cf", "Zs", "Mn") else 2.0 if o < 0x2000 else 1.6
            if prev.isalpha():
                total += 1.2
        if o < 128 or _script(ch) != "L" or not ch.isalpha():
            run = 0
        prev = ch
    if len(seen) > 1:
        total += 2.5 * (len(seen) - 1)
    return total


def _next(text: str, first: bool) -> Iterator[tuple[str, float, bool]]:
    """States one operation away, each with the cost of the edge and whether it decodes anew."""
    for page in READ_AS:
        raw = _encode(text, page)
        if raw is None:
            continue
        try:
            out = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if out != text:
            yield out, EDGE, True
    if first and re.search(r"[^\W\d_]", text):
        for page, wrote in SINGLE_READ:
            raw = _encode(text, page)
            if raw is None:
                continue
            try:
                out = raw.decode(wrote)
            except UnicodeDecodeError:
                continue
            if out != text and len(out) == len(text) and not BOXES.search(out) and len({_script(c) for c in out if c.isalpha() and c not in "µªº"}) < 2:
                # single-byte pages decode anything, so the evidence must be stronger
                yield out, EDGE_SINGLE, True
    if first and WIDE.search(text):
        for page in ("utf-16-le", "utf-16-be"):
            try:
                out = text.encode(page).decode("utf-8")
            except UnicodeError:
                continue
            yield out, EDGE_WIDE, True
    if "&" in text and ";" in text:
        out = html.unescape(text)
        if out != text and SUSPECT.search(out):
            yield out, EDGE + 0.5, False


def _search(word: str, start: float) -> tuple[str, float] | None:
    """The cheapest text that decoding anew reaches, and its cost with its edges; None if none is cheaper than the start."""
    queue = [(start, 0.0, 0, word, False)]
    seen = {word}  # compared by value too: Python hashes a UTF-16 string and its bytes alike
    best, best_cost = None, start
    while queue:
        _, paid, depth, text, anew = heapq.heappop(queue)
        for out, edge, decodes in _next(text, depth == 0):
            if out in seen or paid + edge >= best_cost:
                continue
            seen.add(out)
            full = paid + edge + cost(out)
            if full < best_cost and (anew or decodes):
                best, best_cost = out, full
            heapq.heappush(queue, (full, paid + edge, depth + 1, out, anew or decodes))
    return (best, best_cost) if best is not None else None


def _restore_word(word: str) -> tuple[str, bool, bool]:
    """(text, was garbled, restored) of one word; a lossy word is garbled and left as it is.

    Where the whole word can't be decoded anew, each run beyond ASCII in it is tried by itself.
    """
    if "\ufffd" in word:
        return word, True, False
    seen = html.unescape(word) if "&" in word and REFERENCE.search(word) else word
    start = max(cost(word), cost(seen))  # escaped garble looks innocent until it is resolved
    if start < GATE:
        return word, False, False
    found = _search(word, start)
    if found and start - found[1] >= MARGIN:
        return found[0], True, True
    if word.isascii() or BEYOND.fullmatch(word):
        return word, False, False
    runs = []

    def run(m: re.Match) -> str:
        piece = m.group()
        if len(piece) < 2 or (here := cost(piece)) < GATE:
            return piece
        got = _search(piece, here)
        if got and len(got[0]) < len(piece) and here - got[1] >= 2 * MARGIN:
            runs.append(piece)
            return got[0]
        return piece

    text = BEYOND.sub(run, word)
    return (text, True, True) if runs else (word, False, False)


_remembered = lru_cache(maxsize=200_000)(_restore_word)


def restore_word(word: str) -> tuple[str, bool, bool]:
    """As :func:`_restore_word`; short words are remembered, for they come again."""
    return _remembered(word) if len(word) <= 100 else _restore_word(word)


def restore(text: str | None) -> tuple[str | None, bool, bool]:
    """(restored text, holds a garbled passage, every garbled passage restored)."""
    if not text or not (SUSPECT.search(text) or REFERENCE.search(text)):
        return text, False, False
    bad = lost = False
    parts: list[str] = []
    at = 0
    for m in WORD.finditer(text):
        w = m.group()
        if w.isascii() and not ("&" in w and REFERENCE.search(w)):
            continue
        out, garbled, ok = restore_word(w)
        if garbled:
            bad = True
            lost |= not ok
            parts += (text[at : m.start()], out)
            at = m.end()
    if not bad:
        return text, False, False
    return "".join([*parts, text[at:]]), True, not lost


REPAIR = T.StructType([T.StructField("text", T.StringType()), T.StructField("garbled", T.BooleanType()), T.StructField("restored", T.BooleanType())])


@F.pandas_udf(REPAIR)
def restore_text(texts: pd.Series) -> pd.DataFrame:
    done = {t: restore(t) for t in texts.dropna().unique()}
    rows = [done.get(t, (None, False, False)) if isinstance(t, str) else (None, False, False) for t in texts]
    return pd.DataFrame(rows, columns=["text", "garbled", "restored"])


def suspicious(column: str) -> Column:
    """JVM-side filter: only values with a character beyond ASCII, written out or as a character reference, can be garbled."""
    return F.col(column).rlike(r"[^\x00-\x7F]") | F.col(column).rlike(REFERENCE.pattern)


def repair_encoding(df: DataFrame, *columns: str) -> DataFrame:
    """Add ``<column>_repair`` structs (text, garbled, restored) for each text column.

    NULL stays NULL and is not garbled, the empty text is not garbled, ASCII text never leaves
    the JVM's cheap path inside the function. Rows are neither added nor dropped, repeated rows
    get equal results, other columns pass through whatever their names.
    """
    for c in columns:
        df = df.withColumn(f"{c}_repair", restore_text(F.col(c)))
    return df
