"""Visually identical text with different characters: one consistent form, and pairs that look the same (problem 5).

Method: compatibility normalisation in composed form, full case folding, mapped white space and
removal of default-ignorable characters, done once per distinct value; letters of another script
with a Latin shape are mapped first. Two forms come out:

* ``clean``: the consistent text to keep. Nothing visible changes: case, accents, raised digits,
  dashes and quotation marks stay.
* ``key``: the comparison key of the method: full compatibility normalisation and case folding. It is wider
  than "looks the same" (case, raised digits and more fold away), so values are candidates by key
  and are then checked exactly on ``shape``, which keeps every visible difference.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.session import cut, spread

# Letters of Greek and Cyrillic with the shape of Latin ones.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҺԚԜасеѕіјорухһԛԝԁӏ", "ABESIJKMHOPCTYXhQWacesijopyxhqwdl"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳοϲνρ", "ABEZHIKMNOPTYXCjocvp"))
OTHER = dict(zip("ɑɡıⅼꞌˈʼʹ", "agil''''"))
# Characters of other kinds that render alike.
SAME = {"‐": "-", "‑": "-", "ʼ": "’", "⁄": "/", "∕": "/", "∶": ":", ";": ";", "·": "·",
        "Ω": "Ω", "K": "K", "Å": "Å", "µ": "μ", "Ϲ": "C", "ϲ": "c"}
# First and last code points of the default-ignorable ranges, and the kinds of space.
IGNORABLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
             (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF))
BLANKS = (0x9, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)
SPACES = re.compile(" {2,}")
LETTER = regex.compile(r"[\p{Greek}\p{Cyrillic}]")
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
MAP = str.maketrans(CYRILLIC | GREEK | OTHER)
TO_CYRILLIC = str.maketrans({b: a for a, b in CYRILLIC.items()})
TO_GREEK = str.maketrans({b: a for a, b in GREEK.items()})
FIXED_CYRILLIC = regex.compile(f"[\\p{{Cyrillic}}--[{''.join(CYRILLIC)}]]", regex.V1)
FIXED_GREEK = regex.compile(f"[\\p{{Greek}}--[{''.join(GREEK)}µΩμ]]", regex.V1)
FIXED_LATIN = regex.compile(f"[\\p{{Latin}}--[{''.join(set(CYRILLIC.values()) | set(GREEK.values()))}]]", regex.V1)


# Kinds of compatibility mapping that change width or form only, not what is seen; in ALIKE only letters and digits do so.
PLAIN_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
ALIKE_TAG = "<compat>"


def _table() -> dict[int, int | str | None]:
    """One pass over a text: invisibles go, blanks become the blank, and every compatibility character whose mapping keeps the look becomes its plain form."""
    out: dict[int, int | str | None] = {}
    for c in range(0x80, 0x10000):
        mapped = unicodedata.decomposition(chr(c))
        if not mapped.startswith("<"):
            continue
        tag, plain = mapped.split(" ", 1)[0], unicodedata.normalize("NFKC", chr(c))
        one, drawn = len(plain) == 1, chr(c).isalnum()
        # ligatures and numerals look like their letters, radicals like their signs; the old forms of Latin and Greek letters do not
        if tag in PLAIN_TAGS or tag == ALIKE_TAG and plain.isalnum() and (one and c >= 0x400 or not one and drawn):
            out[c] = plain
    out |= {c: " " for c in BLANKS} | {c: None for first, last in IGNORABLE for c in range(first, last + 1)}
    return out | {ord(k): v for k, v in SAME.items()}


SHAPE = _table()


def clean(text: str) -> str:
    """The consistent form that looks the same: width, spaces, composition, invisibles and look-alike letters.

    A word takes the script of its letters that have no look-alike (``rope`` with a Cyrillic o becomes
    Latin, a Russian word with a Latin o becomes Cyrillic); a word of look-alikes only takes the
    script of most other words of the text.
    """
    text = _base(text)
    if not LETTER.search(text):
        return text
    votes = {"L": 0, "C": 0, "G": 0}
    for w in WORD.findall(text):
        votes[_script(w) or "L"] += bool(_script(w))
    usual = max(votes, key=lambda k: (votes[k], k == "L"))

    def word(m: regex.Match) -> str:
        w = m.group()
        to = _script(w) or usual
        return w.translate(MAP) if to == "L" else w.translate(TO_CYRILLIC if to == "C" else TO_GREEK)

    return WORD.sub(word, text)


def _script(word: str) -> str:
    """The script of the letters that have no look-alike in another: L, C, G, or '' if there is none."""
    if FIXED_CYRILLIC.search(word):
        return "C"
    if FIXED_GREEK.search(word):
        return "G"
    return "L" if FIXED_LATIN.search(word) else ""


def _base(text: str) -> str:
    if text.isascii():
        out = text.replace("\t", " ")
    else:
        out = unicodedata.normalize("NFC", text.translate(SHAPE))
    return SPACES.sub(" ", out)


def shape(text: str) -> str:
    """What the text looks like: every look-alike letter Latin, whatever its word. Equal shapes look the same."""
    return _base(text).translate(MAP)


def key(text: str) -> str:
    """The method's key: look-alike letters mapped, then compatibility-composed, fully case-folded, white space mapped, default-ignorables gone.

    Composition comes before the look-alikes (an accented letter is one letter), and once more after the folding.
    """
    if text.isascii():
        return SPACES.sub(" ", text.replace("\t", " ")).lower().strip()
    folded = unicodedata.normalize("NFKC", text.translate(SHAPE)).translate(MAP).casefold()
    return SPACES.sub(" ", unicodedata.normalize("NFKC", folded).translate(SHAPE)).strip()


CLEAN = T.StructType([T.StructField("clean", T.StringType()), T.StructField("key", T.StringType())])
LOOK = T.StructType([T.StructField("shape", T.StringType()), T.StructField("key", T.StringType())])


def _each(values: pd.Series, one, columns: list[str]) -> pd.DataFrame:
    """Results of the values; each distinct value of a batch is worked on once."""
    done = {v: one(v) for v in values.dropna().unique()}
    none = (None,) * len(columns)
    return pd.DataFrame([done.get(v, none) if isinstance(v, str) else none for v in values], columns=columns)


@F.pandas_udf(CLEAN)
def clean_forms(values: pd.Series) -> pd.DataFrame:
    return _each(values, lambda v: (clean(v), key(v)), ["clean", "key"])


@F.pandas_udf(LOOK)
def look_forms(values: pd.Series) -> pd.DataFrame:
    return _each(values, lambda v: (shape(v), key(v)), ["shape", "key"])


def consistent(df: DataFrame, *columns: str) -> DataFrame:
    """Add ``<column>_clean`` and ``<column>_key``. NULL gives NULL, the empty text the empty text.

    No row is added or dropped; repeated rows get equal results; other columns pass unchanged.
    """
    for c in columns:
        df = df.withColumn("__forms", clean_forms(F.col(c))).withColumn(f"{c}_clean", F.col("__forms.clean")).withColumn(f"{c}_key", F.col("__forms.key")).drop("__forms")
    return df


SALTS = 16


def _values(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, h, k, s) of each record: hashes of its value, of the key and of the shape; empty and NULL values take no part.

    The forms are taken in the scan's own Arrow pass, each distinct value of a batch once, so texts are not shuffled
    to meet their copies; only hashes leave the task.
    """
    rows = df.select(F.col(id_column).alias("id"), F.col(column).alias("v")).where("id is not null and v <> ''")
    rows = spread(rows).withColumn("f", look_forms("v"))
    return cut(rows.select("id", F.unhex(F.sha1("v")).alias("h"), F.xxhash64("f.key").alias("k"), F.unhex(F.sha1("f.shape")).alias("s")))


def _alike(values: DataFrame) -> DataFrame:
    """(h, s, n_looks) of distinct values that share key and shape with a value of other code points.

    Values are candidates by key; a candidate stays if its shape, which holds all that is visible, occurs with several
    code-point sequences under that key. Most values have no such partner, so what is left is small beside the table.
    """
    distinct = values.select("k", "s", "h").distinct()
    candidates = distinct.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    met = distinct.join(candidates, "k", "left_semi")
    looks = met.groupBy("k", "s").agg(F.count("*").alias("n_looks")).where("n_looks > 1")
    return met.join(looks, ["k", "s"]).select("k", "h", "s", "n_looks")


def _salted(df: DataFrame) -> DataFrame:
    """Every row once for each salt."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _with_salt(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))


def look_classes(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """One row per record: id, class_id (equal for values that look the same) and n_looks, the number
    of different code-point sequences in the class. Records without a value have no row.

    A record knows its class by its own shape; only the classes of several looks are joined, salted by id.
    """
    rows = _values(df, id_column, column)
    several = _salted(_alike(rows).select(F.col("s").alias("s2"), "n_looks").distinct())
    joined = _with_salt(rows).join(several.withColumnRenamed("salt", "salt2"), (F.col("s") == F.col("s2")) & (F.col("salt") == F.col("salt2")), "left")
    return joined.select("id", F.hex("s").alias("class_id"), F.coalesce("n_looks", F.lit(1)).cast("bigint").alias("n_looks"))


def same_look(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """Pairs ``id_a < id_b`` whose values look the same but differ in code points.

    The work is on distinct values: equal texts are one row however many records hold them, so a
    title borne by a third of all pages is compared once. Values meet by the hash of their
    key, are checked by shape (visible differences such as case part them), and only
    then meet the records, salted by id so that a hot title is spread over tasks. Exact copies of a
    text are no pair and are never joined with each other. NULL and empty values pair with nothing.
    """
    rows = _values(df, id_column, column)
    alike = cut(_alike(rows).select("k", "s", "h"))
    a, b = alike.select("k", F.col("s").alias("s_a"), F.col("h").alias("h_a")), alike.select("k", F.col("s").alias("s_b"), F.col("h").alias("h_b"))
    pairs = _salted(a.join(b, "k").where("s_a = s_b and h_a < h_b").select("h_a", "h_b"))
    held = _with_salt(rows.select("id", "h").distinct())
    left = held.select(F.col("id").alias("x"), F.col("h").alias("h_a"), "salt")
    right = held.select(F.col("id").alias("y"), F.col("h").alias("h_b"), "salt")
    met = _salted(left.join(pairs, ["h_a", "salt"]).select("x", "h_b")).join(right, ["h_b", "salt"])
    return met.where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
