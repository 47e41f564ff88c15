"""Language of documents and of their segments, with a confidence (problem 8).

Method: hierarchical discrimination. Linear support vector machines on hashed character n-grams
first tell the families apart (Germanic, Romance, Slavic, one against one), then one-versus-one
machines tell the languages inside the family. They are trained on a bounded sample of labelled rows
(``SAMPLE`` documents a language) and applied to every sentence of every document.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAMILIES = {"germanic": ("en", "de", "nl"), "romance": ("fr", "es", "pt", "it"), "slavic": ("pl", "ru")}
LANGUAGES = tuple(x for v in FAMILIES.values() for x in v)
FAMILY_OF = {x: f for f, v in FAMILIES.items() for x in v}
# Names and codes of the languages as labels spell them; anything else names no language here.
LABELS = {
    "en": "en eng english englisch anglais inglés inglese inglês", "de": "de deu ger german deutsch allemand alemán tedesco alemão",
    "fr": "fr fra fre french français francais französisch francés francese", "es": "es spa spanish español espanol castellano spanisch espagnol spagnolo",
    "it": "it ita italian italiano italienisch italien", "pt": "pt por portuguese português portugues portugiesisch portugais",
    "nl": "nl nld dut dutch nederlands niederländisch néerlandais", "pl": "pl pol polish polski polnisch polonais",
    "ru": "ru rus russian русский russisch russe",
}
SPELLING = {w: code for code, words in LABELS.items() for w in words.split()}

SAMPLE = 300  # labelled documents a language, at most, that the machines are trained on
BITS = 16
ORDERS = (1, 2, 3, 4, 5)
EPOCHS = 6
CHUNK = 50_000  # characters that are scored at once
SCALE = 5.0  # steepness of the logistic that turns margins into confidence
SENTENCES = 5  # of each sampled document, for training
LONGEST = 2000  # characters of a sentence that is trained on, at most
LEAST_WORDS, LEAST_LETTERS = 3, 12  # a shorter piece is no whole sentence
OTHER, OTHER_SHORT, SHORT = 0.8, 0.93, 40  # a sentence in another language than the document's needs this confidence; one of fewer characters more

FRONT = re.compile(r"\A\ufeff?---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\Z)", re.S)
HEADING = re.compile(r"^\s{0,3}#{1,6}[ \t].*$", re.M)
NOISE = re.compile(r"```.*?```|`[^`\n]*`|<[^<>\n]{1,200}>|https?://\S+|\[\[|\]\]|[\w.+-]+@[\w.-]+|\([^()\n]{0,40}\)", re.S)
BROKEN = re.compile(r"(?<=[^\n.!?…:;|])[ \t]*\r?\n[> \t]*(?=[a-zß-öø-ÿąćęłńóśźżа-яё])")
OPENS = re.compile(r"^[\W\d_]*(?:(?:Re|Fwd|AW|Log|NB|PS)\s?:\s*)*[\W\d_]*(?![a-zß-öø-ÿąćęłńóśźżа-яё])[^\W_]")
CLOSES = re.compile(r"[.!?…][\"'”’»)*_]*$")
SPLIT = re.compile(r"(?<=[.!?…])[\"'”’»)]*\s+|\n+")
LETTERS = re.compile(r"[^\W\d_]+")


def normal_label(label: str | None) -> str | None:
    """The language that a label names, however spelt; None if it names none."""
    if not label:
        return None
    s = label.strip().lower()
    return SPELLING.get(s) or SPELLING.get(re.split(r"[-_ ]", s)[0])


def sentences(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, text, whole) of the pieces that look like sentences; front matter, headings and figures are none.

    ``whole`` tells a sentence from a fragment: it begins with a capital (after list, quote and reply
    marks) and ends with a sentence's sign. Lines broken inside a sentence are joined first.
    """
    front = FRONT.match(text)
    at = front.end() if front else 0
    body = HEADING.sub(_blank, text[at:])
    body = NOISE.sub(_blank, body)
    body = BROKEN.sub(lambda m: " " * len(m.group()), body)
    out = []
    start = 0
    for m in [*SPLIT.finditer(body), None]:
        end = m.start() if m else len(body)
        piece = body[start:end]
        words = LETTERS.findall(piece)
        if len(words) >= LEAST_WORDS and sum(map(len, words)) >= LEAST_LETTERS:
            whole = bool(OPENS.match(piece)) and bool(CLOSES.search(body[start : m.end() if m else end].rstrip()))
            out.append((at + start, at + end, piece, whole))
        start = m.end() if m else end
    return out


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m.group())


def _stream(text: str) -> np.ndarray:
    """Letters in small type, everything else one blank, as code points."""
    s = " ".join(["", *LETTERS.findall(text.lower()), ""])
    return np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of each n-gram of the texts, one pair of arrays an order, in order of the texts.

    All texts are hashed in one pass; an n-gram that crosses from one text into the next is left out.
    """
    streams = [_stream(t) for t in texts]
    if not streams:
        return []
    c = np.concatenate(streams)
    own = np.repeat(np.arange(len(streams), dtype=np.int32), [len(x) for x in streams])
    out = []
    h = np.zeros(len(c), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(c) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x100000001B3) + c[n - 1 :] + np.uint64(n)
        z = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        inside = own[:m] == own[n - 1 :]
        out.append(((z >> np.uint64(64 - BITS)).astype(np.int32)[inside], own[:m][inside]))
    return out


def fold(text: str) -> str:
    """The text typed without accents; the machines see both."""
    return "".join(ch for ch in unicodedata.normalize("NFKD", text.replace("ł", "l").replace("ß", "ss")) if not unicodedata.combining(ch))


@dataclass
class Machines:
    """Weight columns by level: ``family`` has one a pair of families, ``within`` one a pair of languages of each family."""

    family: np.ndarray
    within: dict[str, np.ndarray]

    def posteriors(self, texts: list[str]) -> np.ndarray:
        """Confidence of each language (columns as LANGUAGES).

        The families are told first; of each text only the machines of its likeliest family are run. The languages
        of the other families share their family's confidence equally.
        """
        out = np.zeros((len(texts), len(LANGUAGES)))
        start = 0
        while start < len(texts):  # chunks bound the memory, whatever the number of texts
            end, size = start + 1, len(texts[start])
            while end < len(texts) and size + len(texts[end]) <= CHUNK:
                size += len(texts[end])
                end += 1
            out[start:end] = self._chunk(texts[start:end])
            start = end
        return out

    def _chunk(self, texts: list[str]) -> np.ndarray:
        found = features(texts)
        n = np.maximum(sum(np.bincount(own, minlength=len(texts)) for _, own in found) if found else np.ones(len(texts)), 1)[:, None]
        fam = _couple(list(FAMILIES), _sums(self.family, found, len(texts)) / n, PAIRS_OF_FAMILIES)
        best = fam.argmax(axis=1)
        parts = []
        for i, (name, langs) in enumerate(FAMILIES.items()):
            share = np.repeat(fam[:, i : i + 1] / len(langs), len(langs), axis=1)
            mine = best == i
            if mine.any():
                at = np.cumsum(mine) - 1
                kept = [(idx[mine[own]], at[own[mine[own]]]) for idx, own in found]
                share[mine] = fam[mine, i : i + 1] * _couple(list(langs), _sums(self.within[name], kept, int(mine.sum())) / n[mine], list(combinations(langs, 2)))
            parts.append(share)
        return np.concatenate(parts, axis=1)


def _sums(weights: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Summed weights of the n-grams of each text."""
    out = np.zeros((n, weights.shape[1]))
    for idx, own in found:
        edges = np.searchsorted(own, np.arange(n + 1))
        some = np.diff(edges) > 0
        if some.any():
            out[some] += np.add.reduceat(weights[idx], edges[:-1][some], axis=0)
    return out


def _couple(names: list[str], margins: np.ndarray, pairs: list[tuple[str, str]]) -> np.ndarray:
    """Pairwise margins (a column a pair) as probabilities: soft votes of the logistic of each margin, normalised."""
    score = np.zeros((len(margins), len(names)))
    for k, (a, b) in enumerate(pairs):
        z = np.clip(SCALE * margins[:, k], -30, 30)
        score[:, names.index(a)] -= np.logaddexp(0, -z)
        score[:, names.index(b)] -= np.logaddexp(0, z)
    e = np.exp(score - score.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


PAIRS_OF_FAMILIES = list(combinations(FAMILIES, 2))
PAIRS = [*PAIRS_OF_FAMILIES, *[p for v in FAMILIES.values() for p in combinations(v, 2)]]


def _weighted(samples: list[tuple[str, str]]) -> Iterator[tuple[np.ndarray, np.ndarray, str]]:
    """(buckets, their shares, language) of each text that has n-grams; many texts are hashed at once."""
    for start in range(0, len(samples), 500):
        part = samples[start : start + 500]
        found = features([t for t, _ in part])
        if not found:
            continue
        keys, n = np.unique(np.concatenate([own.astype(np.int64) << BITS | idx for idx, own in found]), return_counts=True)
        edges = np.searchsorted(keys, np.arange(len(part) + 1, dtype=np.int64) << BITS)
        for i, (_, lang) in enumerate(part):
            here = slice(edges[i], edges[i + 1])
            if here.stop > here.start:
                yield (keys[here] & ((1 << BITS) - 1)).astype(np.int32), (n[here] / n[here].sum()).astype(np.float32), lang


def fit(samples: list[tuple[str, str]], seed: int = 7) -> Machines:
    """Hinge-loss machines of labelled texts by stochastic sub-gradient descent.

    After half of the epochs, texts whose own label all machines reject are left out: labels
    are wrong in places. Deterministic for the same samples in the same order.
    """
    data = list(_weighted([(t, lang) for text, lang in samples for t in dict.fromkeys((text, fold(text)))]))
    w = np.zeros((1 << BITS, len(PAIRS)), dtype=np.float32)
    sign = {x: np.array([1.0 if p[0] in (x, FAMILY_OF[x]) else -1.0 if p[1] in (x, FAMILY_OF[x]) else 0.0 for p in PAIRS], dtype=np.float32) for x in LANGUAGES}
    rng = np.random.default_rng(seed)
    kept = np.arange(len(data))
    for epoch in range(EPOCHS):
        rate = np.float32(40.0 / (1 + epoch))
        if epoch == EPOCHS // 2:
            kept = np.array([i for i in kept if ((sign[data[i][2]] * (data[i][1] @ w[data[i][0]]))[sign[data[i][2]] != 0] > 0).mean() > 0.5], dtype=int)
        for i in rng.permutation(kept):
            idx, x, lang = data[i]
            y = sign[lang]
            rows = w[idx]
            step = rate * y * (y * (x @ rows) < 1.0)
            if step.any():
                rows += x[:, None] * step
                w[idx] = rows
    first = len(PAIRS_OF_FAMILIES)
    within, at = {}, first
    for name, langs in FAMILIES.items():
        width = len(langs) * (len(langs) - 1) // 2
        within[name] = np.ascontiguousarray(w[:, at : at + width])
        at += width
    return Machines(np.ascontiguousarray(w[:, :first]), within)


def train(documents: DataFrame, sample: int = SAMPLE) -> Machines:
    """Machines of at most ``sample`` labelled documents a language, chosen by a hash of the id.

    The bound is the only thing that does not grow with the data: of 9 * ``sample`` texts at most ``SENTENCES``
    sentences of at most ``LONGEST`` characters each reach the driver. Documents whose label names no language are never drawn.
    """
    known = F.create_map(*[x for k, v in SPELLING.items() for x in (F.lit(k), F.lit(v))])
    low = F.lower(F.trim("lang"))
    code = F.coalesce(known[low], known[F.split(low, "[-_ ]")[0]])
    rows = documents.select("doc_id", "text", code.alias("code")).where("code is not null and length(trim(text)) >= 40")
    w = Window.partitionBy("code").orderBy(F.xxhash64("doc_id"), "doc_id")
    drawn = rows.select("doc_id", "code").withColumn("n", F.row_number().over(w)).where(F.col("n") <= sample).select("doc_id")
    # the few drawn ids (a bound, not a share) pick their texts from a second, filtered scan
    texts = rows.join(F.broadcast(drawn.distinct()), "doc_id", "left_semi").select("doc_id", "code", first_sentences("text").alias("s")).collect()
    return fit([(s, r["code"]) for r in sorted(texts, key=lambda r: (r["code"], r["doc_id"], r["s"])) for s in r["s"]])


@F.pandas_udf(T.ArrayType(T.StringType()))
def first_sentences(texts: pd.Series) -> pd.Series:
    """The first SENTENCES sentences of a text that are no longer than LONGEST."""
    return texts.map(lambda t: [s for _, _, s, _ in sentences(t) if len(s) <= LONGEST][:SENTENCES] if isinstance(t, str) else [])


def label_documents(rows: list[tuple[str | None, str | None]], machines: Machines) -> list[tuple]:
    """(lang, confidence, label_is, segments) of each (text, label).

    Segments are (lang, start, end, confidence, whole sentences). ``label_is`` is right, wrong, missing, or
    ``given`` where the text has no sentence that could be compared with the label.
    """
    parts = [sentences(t) if t else [] for t, _ in rows]
    every = machines.posteriors([x[2] for p in parts for x in p])
    out, at = [], 0
    for (_, label), p in zip(rows, parts):
        out.append(_decide(normal_label(label), p, every[at : at + len(p)]))
        at += len(p)
    return out


def _decide(given: str | None, parts: list, p: np.ndarray) -> tuple:
    if not parts:
        return None, 0.0, "missing" if given is None else "given", []
    sizes = np.array([e - s for s, e, _, _ in parts], dtype=float)
    total = (p * sizes[:, None]).sum(axis=0)
    main = int(total.argmax())
    segments: list[list] = []
    for (start, end, _, whole), row, best, size in zip(parts, p, p.argmax(axis=1), sizes):
        lang = int(best) if best == main or row[best] >= (OTHER if size >= SHORT else OTHER_SHORT) else main
        if segments and segments[-1][0] == lang:
            last = segments[-1]
            last[2] = end
            last[3] += row[lang] * size
            last[4] += size
            last[5] += whole
        else:
            segments.append([lang, start, end, row[lang] * size, size, int(whole)])
    segs = [(LANGUAGES[x], s, e, round(float(c / n), 4), w) for x, s, e, c, n, w in segments]
    name = LANGUAGES[main]
    state = "missing" if given is None else "right" if given == name else "wrong"
    return name, round(float(total[main] / sizes.sum()), 4), state, segs


LABELLED = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("label_is", T.StringType()),
    T.StructField("segments", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("confidence", T.DoubleType()), T.StructField("sentences", T.IntegerType())]))),
])


def identify(documents: DataFrame, machines: Machines) -> DataFrame:
    """Add ``found_lang``, ``confidence``, ``label_is`` (right, wrong, missing, given) and ``segments``.

    NULL, empty and figures-only texts get NULL, 0.0 and no segments. The machines travel as one
    broadcast of fixed size (2**16 rows of 13 floats). Texts are read whole.
    """
    shared = documents.sparkSession.sparkContext.broadcast(machines)

    @F.pandas_udf(LABELLED)
    def label(texts: pd.Series, labels: pd.Series) -> pd.DataFrame:
        m = shared.value
        pairs = [(t if isinstance(t, str) else None, x if isinstance(x, str) else None) for t, x in zip(texts, labels)]
        rows = [r for i in range(0, len(pairs), 200) for r in label_documents(pairs[i : i + 200], m)]
        segs = [[{"lang": a, "start": b, "end": c, "confidence": d, "sentences": n} for a, b, c, d, n in r[3]] for r in rows]
        return pd.DataFrame({"lang": [r[0] for r in rows], "confidence": [r[1] for r in rows], "label_is": [r[2] for r in rows], "segments": segs})

    return (
        documents.withColumn("__l", label("text", "lang"))
        .withColumn("found_lang", F.col("__l.lang")).withColumn("confidence", F.col("__l.confidence"))
        .withColumn("label_is", F.col("__l.label_is")).withColumn("segments", F.col("__l.segments")).drop("__l")
    )
