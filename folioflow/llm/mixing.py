"""Mix sources to target weights, sized in tokens of a public tokenizer (problem 7).

Method: soft-membership mixing. A classifier trained on the labelled table gives every document
without a source a posterior over the sources; documents with a source belong to it. Nonnegative
document rates, bounded by ``max_repeats``, are fitted by projected-gradient least squares so that the
expected tokens of each source meet its target. Rates become whole copies by systematic
rounding along the texts in order of size.

Documents with the same membership and bound get the same gradient once it is scaled by their size,
so they share one rate: the labelled documents are one group a source, aggregated in Spark. Only documents
without a source are rated one by one; an iteration is one aggregate job over them, and their
rates are recomputed from the short history of gradients, so no lineage grows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.session import cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SAMPLE = 200  # labelled documents a source, at most, that the classifier is trained on
BUCKETS = 4096
BUCKET_TEXTS = 5000
ITERATIONS = 60
TOLERANCE = 1e-4
SHORT = 0.01  # a share that falls short by more than this part of itself is missed
PART = 100_000  # characters that the encoder is given at once, at least
WORD = re.compile(r"[^\W\d_]+")
LONG_BLANK = re.compile(r"\s{10000,}")
BLANK_BEGINS = re.compile(r"\S(?=\s)")
# Fixed value: the split pattern of the byte-level vocabulary, as published with it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counter(vocabulary: Broadcast):
    """A pandas UDF that counts tokens; NULL and empty texts have none. The vocabulary file's bytes travel as a broadcast (one file of fixed size) and are read once a worker."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(vocabulary.value)
        for texts in batches:
            yield texts.map(lambda t: count_tokens(enc, t) if isinstance(t, str) and t else 0).astype("int64")

    return count


def encoder(raw: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(enc, text: str) -> int:
    """Tokens of a text, the same at every length.

    No token reaches over a place where blanks begin, so parts that end there count by themselves. A long
    run of blanks, which the pattern's matcher can't take, is one piece but for its last blank.
    """
    n, at = 0, 0
    for m in LONG_BLANK.finditer(text):
        n += _parts(enc, text[at : m.start()])
        at = m.end() if m.end() == len(text) else m.end() - 1
        n += len(enc._core_bpe.encode_single_piece(text[m.start() : at].encode("utf-8", "replace")))
    return n + _parts(enc, text[at:])


def _parts(enc, text: str) -> int:
    n, at = 0, 0
    while len(text) - at > PART:
        cut_at = BLANK_BEGINS.search(text, at + PART)
        if not cut_at:
            break
        n += len(enc.encode_ordinary(text[at : cut_at.start() + 1]))
        at = cut_at.start() + 1
    return n + len(enc.encode_ordinary(text[at:])) if at < len(text) else n


@dataclass
class Classifier:
    """Multinomial naive Bayes on hashed words."""

    sources: list[str]
    prior: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def posterior(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty((len(texts), len(self.sources)))
        for i, t in enumerate(texts):
            idx = _buckets(t)
            s = self.prior + (self.weights[idx].sum(axis=0) / max(1.0, len(idx) ** 0.5) if len(idx) else 0.0)
            e = np.exp(s - s.max())
            out[i] = e / e.sum()
        return out


def _buckets(text: str | None) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh32_intdigest(w.encode()) % BUCKETS for w in WORD.findall((text or "").lower())], dtype=np.int64)


def train(documents: DataFrame, sources: list[str], sizes: dict[str, int], sample: int = SAMPLE) -> Classifier:
    """A classifier of at most ``sample`` labelled documents a source (20,000 in all); the priors are the sources' sizes."""
    sample = max(1, min(sample, 20_000 // max(1, len(sources))))
    documents = documents.where(F.col("source").isin(sources)) if sources else documents.limit(0)
    w = Window.partitionBy("source").orderBy(F.xxhash64("doc_id"), "doc_id")
    drawn = documents.where("source is not null and text is not null").select("source", "doc_id").withColumn("n", F.row_number().over(w)).where(F.col("n") <= sample)
    rows = documents.select("doc_id", "text").join(F.broadcast(drawn.select("doc_id", "source")), "doc_id").select("doc_id", "source", "text").collect()
    index = {s: i for i, s in enumerate(sources)}
    counts = np.ones((BUCKETS, len(sources)))
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        if r["source"] in index:
            np.add.at(counts[:, index[r["source"]]], _buckets(r["text"]), 1.0)
    prior = np.log(np.array([1.0 + sizes.get(s, 0) for s in sources]))
    logs = np.log(counts / counts.sum(axis=0))
    return Classifier(sources, prior - prior.max(), logs - logs.mean(axis=1, keepdims=True))


@dataclass
class Mix:
    """A fitted mix: ``report`` has a row a source, ``copies`` a row a used text."""

    report: DataFrame
    copies: DataFrame


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> Mix:
    """Fit rates and give the mix that is as large in tokens as all rows of ``documents`` together.

    ``targets`` has source, target_weight and max_repeats, one row a source (a small table: its rows are
    collected, at most 10,000). NULL or nonpositive weights count as 0, NULL repeats as 1. Equal texts
    count as one text, at home in the source of their smallest doc_id, so no text is used
    more often than max_repeats whatever ids it has; a text without a source is copied into the source it most likely
    belongs to, within that source's bound. NULL and empty texts have no size and are not used. ``tokenizer`` is a path on the driver.

    A source is out of reach if the fitted rates leave its expected tokens short of its target and even all rates at
    their bounds (its capacity, soft members included) would. The mix is then smaller than asked: the report has a
    row's shortfall and the mix's size.
    """
    wanted = targets.groupBy("source").agg(F.max("target_weight").alias("w"), F.max("max_repeats").alias("r")).where("source is not null").limit(10_001).collect()
    if len(wanted) > 10_000:
        raise ValueError("mix targets must be a small table")
    wanted = sorted(wanted, key=lambda r: r["source"])
    names = [r["source"] for r in wanted]
    weight = np.array([max(0.0, float(r["w"] or 0.0)) for r in wanted])
    repeats = np.array([float(1 if r["r"] is None else max(0, r["r"])) for r in wanted])
    spark = documents.sparkSession

    docs = documents.select("doc_id", "text", "source").where("length(text) > 0").withColumn("h", F.unhex(F.sha1("text")))
    with open(tokenizer, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    # tokens are counted in the scan's own pass, so only texts without a source are shuffled to meet their copies
    counted = spread(docs).select("h", "doc_id", "source", token_counter(vocabulary)("text").alias("tokens"), F.when(F.col("source").isNull(), F.col("text")).alias("text"))
    first = F.min_by(F.struct("source", "text"), "doc_id")
    texts = counted.groupBy("h").agg(F.min("doc_id").alias("doc_id"), first.alias("m"), F.count("*").alias("rows"), F.first("tokens").alias("tokens"))
    known = F.col("source").isin(names) if names else F.lit(False)
    sized = cut(texts.select("doc_id", F.col("m.source").alias("source"), "rows", "tokens", F.col("m.text").alias("text")))
    total = float(sized.agg(F.sum(F.col("tokens") * F.col("rows"))).first()[0] or 0)
    goal = total * weight / weight.sum() if weight.sum() > 0 else np.zeros(len(names))

    groups = {r["source"]: r for r in sized.where(known).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()}
    own = np.array([float(groups[s]["tokens"]) if s in groups else 0.0 for s in names])
    model = train(documents, names, {s: int(groups[s]["n"]) for s in groups})
    loose = sized.where("source is null and tokens > 0")
    table = _soft(loose, model, repeats)

    history: list[np.ndarray] = []
    rate = np.minimum(1.0, repeats)
    scale = np.maximum(goal, max(total, 1.0) * 1e-9)
    for _ in range(ITERATIONS):
        mass = own * rate + _mass(table, history, len(names))
        grad = (mass - goal) / scale
        history.append(grad)
        lead = np.maximum(own / scale, 1e-9)
        step = np.clip(rate - grad / lead, 0.0, repeats)  # the exact minimiser along each labelled group
        moved = float(np.abs(step - rate).max()) if len(rate) else 0.0
        rate = step
        if moved < TOLERANCE:
            break
    mass = own * rate + _mass(table, history, len(names))
    capacity = own * repeats + _capacity(table, len(names))
    missed = (mass < goal * (1 - SHORT)) & (capacity < goal)
    return _result(spark, sized, known, table, names, history, rate, goal, total, mass, capacity, missed, weight, repeats)


def _soft(loose: DataFrame, model: Classifier, repeats: np.ndarray) -> DataFrame:
    """(doc_id, tokens, p, cap) of documents without a source; checkpointed, for it is read once an iteration."""
    shared = loose.sparkSession.sparkContext.broadcast((model, repeats))

    def soft(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, r = shared.value
        for b in batches:
            p = m.posterior(list(b["text"]))
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": b["tokens"], "p": list(p), "cap": r[p.argmax(axis=1)] if len(r) else 0.0})

    return cut(loose.select("doc_id", "tokens", "text").mapInPandas(soft, "doc_id bigint, tokens bigint, p array<double>, cap double"))


def _rates(p: np.ndarray, cap: np.ndarray, history: list[np.ndarray]) -> np.ndarray:
    """Rates after the projected steps along the gradients so far."""
    r = np.minimum(1.0, cap)
    for k, g in enumerate(history):
        r = np.clip(r - (p @ np.clip(g, -1.0, 1.0)) / (1.0 + 0.1 * k), 0.0, cap)
    return r


def _mass(table: DataFrame, history: list[np.ndarray], n: int) -> np.ndarray:
    """Expected tokens of each source from the soft members at their present rates: one row a task, then summed."""
    past = list(history)

    def mass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(n)
        for b in batches:
            if len(b):
                p = np.stack(list(b["p"]))
                out += (b["tokens"].to_numpy() * _rates(p, b["cap"].to_numpy(), past)) @ p
        yield pd.DataFrame({"s": np.arange(n), "x": out})

    got = table.mapInPandas(mass, "s int, x double").groupBy("s").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(n)
    for r in got:
        out[r["s"]] = r["x"]
    return out


def _capacity(table: DataFrame, n: int) -> np.ndarray:
    """Expected tokens of each source from the soft members if all stand at their bounds."""

    def most(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(n)
        for b in batches:
            if len(b):
                out += (b["tokens"].to_numpy() * b["cap"].to_numpy()) @ np.stack(list(b["p"]))
        yield pd.DataFrame({"s": np.arange(n), "x": out})

    out = np.zeros(n)
    for r in table.mapInPandas(most, "s int, x double").groupBy("s").agg(F.sum("x").alias("x")).collect():
        out[r["s"]] = r["x"]
    return out


def _result(spark, sized, known, table, names, history, fitted, goal, total, mass, capacity, missed, weight, repeats) -> Mix:
    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                p = np.stack(list(b["p"]))
                yield pd.DataFrame({"doc_id": b["doc_id"], "source": [names[i] for i in p.argmax(axis=1)], "tokens": b["tokens"], "rate": _rates(p, b["cap"].to_numpy(), history)})

    plan = "source string, rate_of double, target double, expected double, capacity double, share double, max_repeats int, out_of_reach boolean"
    fixed = spark.createDataFrame(
        [(s, float(fitted[i]), float(goal[i]), float(mass[i]), float(capacity[i]), float(weight[i] / weight.sum()) if weight.sum() else 0.0, int(repeats[i]), bool(missed[i])) for i, s in enumerate(names)], plan)
    hard = sized.where(known & (F.col("tokens") > 0)).join(F.broadcast(fixed.select("source", F.col("rate_of").alias("rate"))), "source").select("doc_id", "source", "tokens", "rate")
    rated = hard.unionByName(table.mapInPandas(rate, "doc_id bigint, source string, tokens bigint, rate double")) if names else hard
    # systematic rounding in order of size, in buckets of about BUCKET_TEXTS texts, so each source's tokens follow its rates closely
    n = sized.where(known).groupBy("source").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BUCKET_TEXTS)).alias("buckets"))  # a row a target, at most 10,000
    rated = rated.join(F.broadcast(n), "source", "left").withColumn("bucket", F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.coalesce("buckets", F.lit(1))))
    walk = Window.partitionBy("source", "bucket").orderBy("tokens", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = F.col("rate") - F.floor("rate")
    rated = rated.withColumn("upto", F.sum(rest).over(walk) + 0.5)
    copies = rated.withColumn("copies", (F.floor("rate") + F.floor("upto") - F.floor(F.col("upto") - rest)).cast("int")).where("copies > 0")
    reached = copies.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("texts"), F.max("copies").alias("most_copies"))
    # at most 10,000 rows, one a source
    report = fixed.join(reached, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    report = report.withColumn("mix_tokens", F.sum("tokens").over(Window.partitionBy()))
    report = report.select(
        "source", F.round("share", 6).alias("target_share"), F.round(F.when(F.col("mix_tokens") > 0, F.col("tokens") / F.col("mix_tokens")).otherwise(0.0), 6).alias("actual_share"),
        "tokens", F.round("target", 0).cast("bigint").alias("target_tokens"), F.greatest(F.lit(0), F.round("target", 0).cast("bigint") - F.col("tokens")).alias("shortfall_tokens"),
        "mix_tokens", F.lit(int(total)).cast("bigint").alias("wanted_mix_tokens"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        "max_repeats", F.round("rate_of", 6).alias("rate"), F.round("expected", 0).cast("bigint").alias("expected_tokens"), "out_of_reach")
    return Mix(report, copies.select("doc_id", "source", "tokens", "copies"))
