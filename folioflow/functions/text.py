"""Per-row text, path, time and identifier functions as Spark Columns (built-in, code-generated).

Patterns take Unicode classes with ``(?U)`` where letters of any script count. All functions map NULL
to NULL unless they say otherwise.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that end a Markdown link destination or read as an escape; `%` comes first.
LINK_ESCAPES = (("%", "%25"), (" ", "%20"), ("(", "%28"), (")", "%29"), ("<", "%3C"), (">", "%3E"), ("#", "%23"), ("?", "%3F"))
# Device names that no file may bear on some systems.
RESERVED = ("CON", "PRN", "AUX", "NUL", *[f"{p}{i}" for p in ("COM", "LPT") for i in range(1, 10)])
NUMBERED = r"(?i)^(\d+) - (.+)\.md$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Trim all Unicode white space, as far as a page's text goes (Spark's trim knows blanks only)."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def safe_name(c: str | Column, limit: int = 80) -> Column:
    """A title as a file name: illegal runs become a blank, trailing dots go, blanks collapse, cut to the limit. NULL and '' give 'Untitled'."""
    s = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[\\/:*?\"<>|\x00-\x1f]+", " ")
    s = F.regexp_replace(strip(s), r"\.+$", "")
    s = F.regexp_replace(s, r"(?U)\s+", " ")
    s = F.regexp_replace(F.substring(s, 1, limit), r"(?U)\s+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("Untitled"))


def md_path(c: str | Column) -> Column:
    """A relative path as a Markdown link destination."""
    out = col(c)
    for a, b in LINK_ESCAPES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def decode_path(c: str | Column) -> Column:
    """Percent-decoding that leaves `+` and malformed escapes as they are.

    A `%` that no two hex digits follow is escaped first, so one bad escape does not spoil the rest;
    bytes that are no UTF-8 leave the text undecoded.
    """
    safe = F.regexp_replace(F.replace(col(c), F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), col(c))


def dirname(c: str | Column) -> Column:
    """Everything before the last slash; '' for a name without folder."""
    return F.regexp_replace(F.regexp_replace(col(c), r"[^/]*$", ""), r"/$", "")


def basename(c: str | Column) -> Column:
    return F.element_at(F.split(col(c), "/"), -1)


def extension(c: str | Column) -> Column:
    """The last extension with its dot; '' if there is none. Leading dots start no extension."""
    return F.regexp_extract(basename(c), r"^\.*[^.].*?(\.[^.]*)$", 1)


def stem(c: str | Column) -> Column:
    """The name without its last extension."""
    name = basename(c)
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(c)))


def number(c: str | Column) -> Column:
    """The leading number of `NN - Title.md` as written, or NULL."""
    return F.nullif(F.regexp_extract(basename(c), NUMBERED, 1), F.lit(""))


def strip_number(c: str | Column) -> Column:
    """`NN - T.md` -> `T`, any other name without its extension."""
    return F.coalesce(F.nullif(F.regexp_extract(basename(c), NUMBERED, 2), F.lit("")), stem(c))


def page_title(title: str | Column, path: str | Column) -> Column:
    """The front-matter title if it says anything, else the title in the file name."""
    return F.coalesce(F.nullif(strip(title), F.lit("")), strip_number(path))


def level(c: str | Column) -> Column:
    """A page level as int, at least 1; what is no number counts as 1."""
    return F.greatest(F.lit(1), F.coalesce(F.try_to_number(col(c).cast("string"), F.lit("999999999")).cast("int"), F.lit(1)))


def iso(c: str | Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss UTC`, '' for NULL. The session's time zone must be UTC."""
    return F.coalesce(F.date_format(col(c), "yyyy-MM-dd HH:mm:ss 'UTC'"), F.lit(""))


def time32(c: str | Column) -> Column:
    """Seconds since 1980-01-01 UTC as timestamp; 0 is that very moment."""
    return F.timestamp_seconds(col(c) + 315_532_800)


def filetime(c: str | Column) -> Column:
    """Tenths of microseconds since 1601-01-01 UTC as timestamp; 0 means no time."""
    return F.when(col(c) != 0, F.timestamp_micros((F.floor(col(c) / 10) - F.lit(11_644_473_600_000_000)).cast("bigint")))


def filetime_exact(c: str | Column) -> Column:
    """As filetime, in integer arithmetic (no double is exact beyond 2**53)."""
    x = col(c).cast("decimal(20,0)")
    return F.when(x != 0, F.timestamp_micros(F.floor(x / F.lit(10).cast("decimal(20,0)")).cast("bigint") - F.lit(11_644_473_600_000_000)))


def norm(c: str | Column) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(col(c)), "[^0-9a-z]", "")


def mask(c: str | Column) -> Column:
    """A secret as a sample: up to four characters all hidden, else the first two and the length."""
    v = strip(c)
    return F.when(F.length(v) <= 4, F.repeat(F.lit("•"), F.length(v))).otherwise(F.concat(F.substring(v, 1, 2), F.lit("…("), F.length(v).cast("string"), F.lit(" chars)")))


def clean_inline(c: str | Column) -> Column:
    """A Markdown line as plain text: marks, links, emphasis and table bars go."""
    s = F.replace(col(c), F.lit("\u00a0"), F.lit(" "))
    for pattern, to in (
        (r"^\s*#+\s*", ""),
        (r"^\s*(?:[-*+]|\d+\.)\s+(?:\[[ xX]\]\s+)?", ""),
        (r"!\[[^\]]*\]\([^)]*\)", " "),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"<((?:https?|mailto):[^>]+)>", "$1"),
        (r"\*\*|__|~~|`", ""),
        (r"(?U)(?<!\w)[*_](?=\S)|(?<=\S)[*_](?!\w)", ""),
    ):
        s = F.regexp_replace(s, pattern, to)
    bare = strip(s)
    cells = F.filter(F.transform(F.split(F.regexp_replace(bare, r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    s = F.when(bare.startswith("|"), F.array_join(cells, " ")).otherwise(s)
    return strip(F.regexp_replace(s, r"(?U)\s+", " "))


# Small words of titles.
SMALL = ("a", "an", "and", "as", "at", "but", "by", "for", "from", "in", "into", "of", "on", "or", "the", "to", "vs", "via", "with")


def smart_case(c: str | Column) -> Column:
    """Title case that keeps words with a capital, and small words but for the first."""
    words = F.split(strip(F.regexp_replace(col(c), r"(?U)\s+", " ")), " ")
    shaped = F.transform(words, lambda w, i: F.when((F.lower(w) != w) | ((i > 0) & F.lower(w).isin(*SMALL)), w).otherwise(
        F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))))
    return F.array_join(shaped, " ")


@F.pandas_udf(T.StringType())
def path_key(paths: pd.Series) -> pd.Series:
    """The key by which two paths are one file: composed form and full case folding (no built-in has either)."""
    return paths.map(lambda p: unicodedata.normalize("NFC", p).casefold() if isinstance(p, str) else None)


def utf16(c: str | Column) -> Column:
    """UTF-16LE bytes as text: an odd byte is dropped, broken units are replaced, trailing NULs go; NULL gives ''."""
    return _utf16(col(c))


@F.pandas_udf(T.StringType())
def _utf16(values: pd.Series) -> pd.Series:
    def one(b: bytes | None) -> str:
        if b is None:
            return ""
        b = bytes(b)
        return b[: len(b) & ~1].decode("utf-16-le", "replace").rstrip("\0")

    return values.map(one)


def file_type(c: str | Column) -> Column:
    """The extension that the first bytes of a file ask for."""
    def head(n: int) -> Column:
        return F.hex(F.substring(col(c), 1, n))
    return (
        F.when(head(8) == "89504E470D0A1A0A", ".png").when(head(3) == "FFD8FF", ".jpg").when(head(6).isin("474946383761", "474946383961"), ".gif")
        .when(head(4) == "25504446", ".pdf").when(head(2) == "424D", ".bmp").when(head(4) == "52494646", ".webp").otherwise(".bin")
    )


def keep_leading_spaces(c: str | Column) -> Column:
    """Leading blanks (a tab is four) as no-break spaces, so that no code block starts."""
    lead = F.regexp_extract(col(c), r"^[ \t]*", 0)
    return F.concat(F.replace(F.replace(lead, F.lit("\t"), F.lit("    ")), F.lit(" "), F.lit("\u00a0")), F.substring(col(c), F.length(lead) + 1, F.length(col(c))))


def common_parts(a: Column, z: Column) -> Column:
    """The folder that two lists of path parts share from the top; '' for none."""
    same = F.transform(F.arrays_zip(a.alias("a"), z.alias("z")), lambda p: p["a"].eqNullSafe(p["z"]))
    first_off = F.array_position(same, F.lit(False))
    n = F.when(first_off == 0, F.size(same)).otherwise(first_off - 1).cast("int")
    return F.coalesce(F.array_join(F.slice(a, F.lit(1), n), "/"), F.lit(""))


def common_folder(folders: str | Column) -> Column:
    """The longest common folder of an array of folders, '' for none. As lists of parts, the smallest and the largest in order decide it."""
    lists = F.transform(col(folders), lambda f: F.split(f, "/"))
    return F.when(F.size(col(folders)) > 0, common_parts(F.array_min(lists), F.array_max(lists))).otherwise(F.lit(""))
