"""Text cut off by field limits or mid-transfer: cut records, and how often each source cuts (problem 2).

Method: a backward character n-gram model. For every context (the last 4 to 20 characters before a position) it
counts, over all pages' titles, how often a value ends there and how often it goes on. For each value
the final context's end and continuation likelihoods, backed off from long to short contexts and
with one occurrence of the value left out, give log-odds of having been cut. A prior per channel, length and ellipsis
(limits pile up cut values at one length) and an exact look at what the body or another
copy of the title says next are added; the sum is held against a threshold per language and column, fitted where the
errors expected over all values are fewest: values whose end another text shows tell how cut ones score.

Everything is built-in functions: the counts are one aggregate with map-side combine over hashed contexts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.session import cut, first_delivery, spread

ORDERS = (4, 6, 9, 13, 20)
PRIOR_END = 0.9  # chance that a value of unseen contexts is whole
STRENGTH = 2.0  # weight of a shorter context against the counts of a longer one
MOST_BASE = 0.15  # at lengths of which nothing is known, the channel's share of cut values counts up to this
CONFIDENT = 3.0
DEFAULT = 0.5  # the threshold that ties and empty cells fall back on
STEPS = 4  # thresholds tried per unit of log-odds, from -LIMIT to LIMIT
LIMIT = 3
MISS = 10  # whole titles called cut that weigh as much as one cut title missed
SHRINK = 40.0  # known values that the column as a whole counts for in each language
EVIDENCE = 4.0
START = "\u0002"

# Function words by which a title's language is told for the thresholds.
FUNCTION_WORDS = {
    "en": "the and of on in at for to our my needs notes", "de": "der die das den dem im am auf und bei vor nach hinter unter vom zum",
    "fr": "le la les du des dans sur sous près l’ et un une à au", "es": "el los las del en de la y junto sobre bajo tras nuestro nuestra",
    "it": "il lo gli della dell’ nel nella sul sullo ha accanto dietro dopo", "pt": "o os a do da no na em após nosso junto ao não",
    "nl": "het een op van bij naar onze mijn voor achter de tijdens", "pl": "na w i po za pod przed nasz mój obok koło przy",
    "ru": "в на за под у и с после перед наш мой",
}
# A catalogue code at the end is no language: the phrase before it had ended. Codes grow with the number of pages, so one with figures on both sides of its dash may have any length.
CODE = r"\s+(?:[0-9A-Z]{1,3}-[0-9A-Za-z]{2,5}|(?=\S*\p{N}\S*\p{Pd}\S*\p{N})[\p{Lu}\p{N}\p{Cf}]+\p{Pd}[\p{L}\p{N}\p{Cf}]+)(?:\s+\S{1,2})?$"
ELLIPSIS = r"[\s\u00a0]*(?:…|\.{3,})[\s\u00a0]*$"


def _language(text: Column) -> Column:
    """The language with most function words in the text, or 'und'."""
    tokens = F.split(F.lower(text), r"[\s,.;:!?()]+")
    scores = [F.struct(F.size(F.array_intersect(tokens, F.array(*map(F.lit, words.split())))).alias("n"), F.lit(code).alias("code")) for code, words in FUNCTION_WORDS.items()]
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["code"]).otherwise(F.lit("und"))


def _contexts(stem: Column, at: Column) -> Column:
    """Hashes of the contexts of each order that end at a position of START + stem."""
    padded = F.concat(F.lit(START), F.lower(stem))
    return F.array(*[F.when(at >= k, F.xxhash64(F.lit(k), F.substring(padded, at - (k - 1), F.lit(k)))) for k in ORDERS])


def train(values: DataFrame) -> DataFrame:
    """(context, n_end, n_all) over all pages' titles: the backward n-gram model.

    Equal titles are one row with their number before their contexts are taken, so a title borne by a third of
    all pages costs as much as any other. Old titles repeat page titles and are left out.
    """
    stems = values.where("tbl = 'page_out'").groupBy("phrase").agg(F.count("*").alias("n"))
    stems = spread(stems, scan=False)  # one title gives hundreds of contexts, so merged partitions would be too few
    places = stems.select("phrase", "n", F.explode(F.sequence(F.lit(2), F.length("phrase") + 1)).alias("at"), (F.length("phrase") + 1).alias("last"))
    seen = places.select("n", F.explode(_contexts(F.col("phrase"), F.col("at"))).alias("context"), F.when(F.col("at") == F.col("last"), F.col("n")).otherwise(0).alias("end"))
    return seen.where("context is not null").groupBy("context").agg(F.sum("end").alias("n_end"), F.sum("n").alias("n_all"))


def score(values: DataFrame, model: DataFrame) -> DataFrame:
    """(phrase, log_odds) of each distinct phrase: continuation against end at its final context."""
    stems = values.select("phrase").distinct()
    last = stems.select("phrase", F.posexplode(_contexts(F.col("phrase"), F.length("phrase") + 1)).alias("k", "context")).where("context is not null")
    met = last.join(model, "context").groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct("k", "n_end", "n_all"))).alias("counts"))
    # at most one entry an order; the value's own occurrence, an end, is left out
    p = F.aggregate("counts", F.lit(PRIOR_END), lambda acc, x: (F.greatest(x["n_end"] - 1, F.lit(0)) + STRENGTH * acc) / (F.greatest(x["n_all"] - 1, F.lit(0)) + STRENGTH))
    p = F.least(F.lit(1 - 1e-4), F.greatest(F.lit(1e-4), p))
    return met.select("phrase", F.log((1 - p) / p).alias("log_odds"))


def _follows(longer: Column, stem: Column) -> Column:
    """What a longer text that opens with the stem says next: 'inside' (the word goes on), 'cut' (another word follows), 'whole' (the sentence ends), or NULL if it doesn't open with it."""
    after = longer.substr(F.length(stem) + 1, F.lit(3))
    return F.when(longer.startswith(stem) & (F.length(longer) > F.length(stem)), F.when(after.rlike(r"^[.!?…](?:[\s\"”»’)]|$)"), "whole").when(after.rlike(r"^[\p{L}\p{M}\p{N}]"), "inside").otherwise("cut"))


def titles(pages: DataFrame, renames: DataFrame) -> DataFrame:
    """The values that are looked at: tbl, record_id, channel, value, stem, ellipsis, and what other texts say.

    A page counts once. NULL and empty titles are no values. ``body_says`` compares with the body's first line,
    ``copy_says`` an old title with the page's title and with the new title.
    """
    lines = pages.select("row_id", "page_id", "title", "origin", "path", F.substring_index(F.ltrim("body"), "\n", 1).alias("line"))
    page = first_delivery(lines, "title", "origin", "path", "line")
    own = page.select(F.lit("page_out").alias("tbl"), F.col("page_id").alias("record_id"), F.col("origin").alias("channel"), F.col("title").alias("value"), "line", F.lit(None).cast("string").alias("page_title"), F.lit(None).cast("string").alias("new_title"))
    by_path = page.groupBy("path").agg(F.first("title").alias("page_title"), F.first("line").alias("line"))
    old = renames.groupBy("rename_id").agg(*[F.first(c).alias(c) for c in ("path", "old_title", "new_title", "source")])
    old = old.join(by_path, "path", "left").select(F.lit("renames").alias("tbl"), F.col("rename_id").alias("record_id"), F.col("source").alias("channel"), F.col("old_title").alias("value"), "line", "page_title", "new_title")
    every = own.unionByName(old).where("length(trim(value)) > 0")
    every = every.withColumn("stem", F.rtrim(F.regexp_replace("value", ELLIPSIS, "")))
    every = every.withColumn("phrase", F.regexp_replace(F.regexp_replace("stem", CODE, ""), r"\d+", "0"))
    every = every.withColumn("ellipsis", F.when(F.col("value").rlike(r"…[\s\u00a0]*$"), "…").when(F.col("value").rlike(r"\.{3,}[\s\u00a0]*$"), "...").otherwise("")).where("stem <> ''")
    stem = F.col("stem")
    body = _follows(F.col("line"), stem)
    other = F.coalesce(
        F.when(_follows(F.rtrim(F.regexp_replace("page_title", ELLIPSIS, "")), stem).isin("cut", "inside"), "cut"),
        F.when(_follows(F.col("new_title"), stem).isin("cut", "inside"), "cut"),
    )
    return every.select("tbl", "record_id", "channel", "value", "stem", "phrase", "ellipsis", body.alias("body_says"), other.alias("copy_says"), _language(stem).alias("lang"))


def detect(values: DataFrame) -> DataFrame:
    """All values with log_odds of the model, prior, total, threshold and ``is_cut``.

    The cells of the prior (channel, length, ellipsis) and the thresholds (language, column) are small
    aggregates over all records. A value whose contexts were never seen elsewhere counts as whole.
    """
    values = cut(values)
    odds = score(values, train(values))
    rows = values.join(odds, "phrase", "left").withColumn("log_odds", F.coalesce("log_odds", F.lit(-2.0)))
    rows = cut(rows.withColumn("length", F.length("stem")).withColumn("band", F.floor(F.col("length") / 6)))
    sure = (F.col("log_odds") >= CONFIDENT) & ~F.coalesce(F.col("body_says") == "whole", F.lit(False)) | (F.coalesce(F.col("body_says").isin("cut", "inside"), F.lit(False)) & (F.col("log_odds") >= 0.5))
    whole = (F.col("log_odds") <= -0.5) & ~F.coalesce(F.col("body_says").isin("cut", "inside"), F.lit(False)) | F.coalesce(F.col("body_says") == "whole", F.lit(False))
    cell = ["tbl", "channel", "ellipsis"]
    counted = rows.groupBy(*cell, "band", "length").agg(F.sum(sure.cast("long")).alias("c"), F.sum(whole.cast("long")).alias("w"))
    by_cell, by_band = Window.partitionBy(*cell), Window.partitionBy(*cell, "band")
    counted = counted.withColumn("cc", F.sum("c").over(by_cell)).withColumn("wc", F.sum("w").over(by_cell)).withColumn("cb", F.sum("c").over(by_band)).withColumn("wb", F.sum("w").over(by_band))
    base = F.least(F.lit(MOST_BASE), (F.col("cc") + 0.5) / (F.col("cc") + F.col("wc") + 12))
    rough = (F.col("cb") + base) / (F.col("cb") + F.col("wb") + 1)
    prior = F.least(F.lit(0.97), F.greatest(F.lit(0.003), (F.col("c") + 2 * rough) / (F.col("c") + F.col("w") + 2)))
    # written, so that its size is known and the planner broadcasts it only if that is small
    priors = cut(counted.select(F.col("tbl").alias("t2"), F.col("channel").alias("ch2"), F.col("ellipsis").alias("e2"), F.col("length").alias("l2"), F.log(prior / (1 - prior)).alias("prior")))
    rows = rows.join(priors, (F.col("tbl") == F.col("t2")) & F.col("channel").eqNullSafe(F.col("ch2")) & (F.col("ellipsis") == F.col("e2")) & (F.col("length") == F.col("l2"))).drop("t2", "ch2", "e2", "l2")
    said = F.when(F.col("copy_says") == "cut", 2 * EVIDENCE).otherwise(0.0) + F.when(F.col("body_says") == "inside", 1.5 * EVIDENCE).when(F.col("body_says") == "cut", 0.4 * EVIDENCE).when(F.col("body_says") == "whole", -2 * EVIDENCE).otherwise(0.0)
    rows = rows.withColumn("model", F.col("log_odds") + F.col("prior")).withColumn("total", F.col("model") + said)
    rows = rows.join(F.broadcast(thresholds(rows)), ["tbl", "lang"], "left").withColumn("threshold", F.coalesce("threshold", F.lit(DEFAULT)))
    return rows.withColumn("is_cut", F.col("total") > F.col("threshold"))


def thresholds(rows: DataFrame) -> DataFrame:
    """(tbl, lang, threshold): where whole and cut values part at the least cost, a miss costing MISS false alarms.

    The cost is counted over all values that the threshold decides, those whose end no other text shows; the few whole ones that a body
    repeats are unlike the rest, and would not tell how many false alarms a threshold gives. How cut values spread over the scores is known from those whose word or
    title goes on elsewhere; how many there are among the undecided, from the values at LIMIT or more, which are as good as all cut.
    A language's spread and errors are added to those of its column, which counts as SHRINK known values, so a language with
    few known values leans on its column. A column without a known cut value at LIMIT or more has no row. At most one row a column and language: two columns, ten languages.
    """
    known = F.coalesce(F.col("copy_says") == "cut", F.lit(False)) | F.coalesce(F.col("body_says") == "inside", F.lit(False))
    undecided = F.coalesce(F.col("body_says") != "whole", F.lit(True)) & ~known
    score = F.floor(F.when(known, F.col("model")).otherwise(F.col("total")) * STEPS)
    step = F.least(F.lit(LIMIT * STEPS), F.greatest(F.lit(-LIMIT * STEPS - 1), score)).cast("int")
    counts = rows.where(known | undecided).groupBy("tbl", "lang", step.alias("b")).agg(F.count_if(known).alias("cut"), F.count_if(undecided).alias("undecided"))
    entry = F.collect_list(F.struct("b", "cut", "undecided"))
    cells = counts.groupBy("tbl", "lang").agg(entry.alias("own"))
    column = counts.groupBy("tbl").agg(entry.alias("all"), F.sum("cut").alias("n")).where(F.exists("all", lambda x: (x["b"] == LIMIT * STEPS) & (x["cut"] > 0)))

    def total(entries: Column, field: str) -> Column:
        return F.aggregate(entries, F.lit(0).cast("double"), lambda acc, x: acc + x[field])

    def at_step(entries: str, b: Column, field: str) -> Column:
        return total(F.filter(entries, lambda x: x["b"] == b), field)

    def by_step(cut_values, entries: str) -> Column:
        steps = F.sequence(F.lit(-LIMIT * STEPS - 1), F.lit(LIMIT * STEPS))
        return F.transform(steps, lambda b: F.struct(b.alias("b"), cut_values(b).alias("cut"), at_step(entries, b, "undecided").alias("undecided")))

    def expected(steps: str) -> Column:
        top = F.element_at(steps, -1)
        cut_here = lambda x: x["cut"] * top["undecided"] / top["cut"]
        return F.transform(steps, lambda x: F.struct(x["b"].alias("b"), cut_here(x).alias("cut"), F.greatest(F.lit(0.0), x["undecided"] - cut_here(x)).alias("whole")))

    def errors(steps: str, at: Column) -> Column:
        return MISS * total(F.filter(steps, lambda x: x["b"] < at), "cut") + total(F.filter(steps, lambda x: x["b"] >= at), "whole")

    bins = cells.join(column, "tbl").select("tbl", "lang", "n", by_step(lambda b: at_step("own", b, "cut") + SHRINK * at_step("all", b, "cut") / F.col("n"), "own").alias("own"), by_step(lambda b: at_step("all", b, "cut"), "all").alias("all"))
    bins = bins.select("tbl", "lang", "n", expected("own").alias("own"), expected("all").alias("all"))
    tried = F.transform(F.sequence(F.lit(-LIMIT * STEPS), F.lit(LIMIT * STEPS)), lambda at: F.struct(
        F.round(errors("own", at) + SHRINK * errors("all", at) / F.col("n"), 6).alias("errors"), F.abs(at / STEPS - DEFAULT).alias("far"), (at / STEPS).alias("threshold")))
    return bins.select("tbl", "lang", F.array_min(tried)["threshold"].alias("threshold"))


def shares(found: DataFrame) -> DataFrame:
    """Per column and source: n_values, n_cut and share."""
    return found.groupBy("tbl", F.col("channel").alias("source")).agg(
        F.count("*").alias("n_values"), F.sum(F.col("is_cut").cast("long")).alias("n_cut"), F.round(F.avg(F.col("is_cut").cast("double")), 6).alias("share"))
