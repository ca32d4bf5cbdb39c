"""URL filters in DataFrame functions only: host and path rules, and a ratio of character models.

Two variable-order Markov models over the characters of a URL, one for accepted and one for
rejected URLs, are counted from the URLs that the rules decide. The probability of a character after k
characters is (n(context, character) + LAMBDA * p(character after k-1)) / (n(context) + LAMBDA),
down to a uniform one, so a context not seen falls back to the next shorter one. The score is
the mean over the characters of log p(accepted) - log p(rejected). The threshold is set on URLs
that are held out of the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlgrain.llm.common import materialize, only

#: (host, path, verdict); the longest rule that fits decides.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
ORDER = 4
LAMBDA = 1.0
ALPHABET = 256.0
#: One of so many rule-decided URLs is held out for the threshold.
FOLDS = 5
#: Weights that are broadcast when URLs are scored: those of the commonest grams, which every URL begins with.
COMMON = 10_000
START, END = "\u0002", "\u0003"
URL = "^(?s).*?://([^/?#]*)([^?#]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first :// up to / ? # or end, A-Z lower-cased; then up to ? # or end. Empty for null or without ://."""
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, URL, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(text, URL, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path, nulls if none does."""
    rule = verdict = None
    for h, p, said in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def _grams(rows: DataFrame) -> DataFrame:
    """One row per character of url and its end: the ORDER characters before it and itself."""
    padded = F.concat(F.lit(START * ORDER), F.coalesce("url", F.lit("")), F.lit(END))
    windows = F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{ORDER + 1}}}))."), F.lit(1))
    return rows.withColumn("gram", F.explode(windows)).drop("url")


def _log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, weight) from counts (gram, accepted, rejected) of ORDER+1 characters."""
    known = None
    for k in range(ORDER + 1):
        level = counts.groupBy(F.substring("gram", ORDER + 1 - k, k + 1).alias("gram")).agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
        if k == 0:
            # the whole is one row per character: a window over at most as many rows as characters exist
            totals = level.agg(F.sum("accepted").alias("all_accepted"), F.sum("rejected").alias("all_rejected")).first()
            known = level.select(
                "gram", *(((F.col(c) + LAMBDA / ALPHABET) / (float(totals[f"all_{c}"] or 0) + LAMBDA)).alias(f"p_{c}") for c in ("accepted", "rejected"))
            )
            continue
        context = Window.partitionBy(F.substring("gram", 1, k))
        level = level.withColumn("n_accepted", F.sum("accepted").over(context)).withColumn("n_rejected", F.sum("rejected").over(context))
        shorter = known.withColumnRenamed("gram", "suffix")
        joined = level.withColumn("suffix", F.substring("gram", 2, k)).join(shorter, "suffix")
        known = joined.select("gram", *(((F.col(c) + LAMBDA * F.col(f"p_{c}")) / (F.col(f"n_{c}") + LAMBDA)).alias(f"p_{c}") for c in ("accepted", "rejected")))
    weights = known.select("gram", (F.log("p_accepted") - F.log("p_rejected")).alias("weight"))
    return weights.join(counts.select("gram", "seen"), "gram")


def fit_ratio(rows: DataFrame) -> DataFrame:
    """(gram, weight, seen) for every gram of rows (url, accepted, rejected: 0 or 1), counted where one is 1; seen: how often rows have it.

    Counts are summed before the shuffle; the table grows with the distinct grams of all URLs.
    """
    counts = _grams(rows.select("url", F.col("accepted").cast("long"), F.col("rejected").cast("long")))
    counts = materialize(counts.groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"), F.count("*").alias("seen")), "url-counts")
    return materialize(_log_ratios(counts), "url-weights")


def score(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """rows (key columns and url) with score instead of url: the mean weight of the URL's characters.

    The COMMON commonest grams meet their weights by broadcast and are summed up where they are; only the others are shuffled by gram.
    """
    keys = [c for c in rows.columns if c != "url"]
    common = F.broadcast(weights.orderBy(F.desc("seen"), "gram").limit(COMMON).select("gram", F.col("weight").alias("near")))  # COMMON rows
    grams = _grams(rows).join(common, "gram", "left")
    here = grams.where("near is not null").groupBy(*keys).agg(F.sum("near").alias("sum"), F.count("*").alias("n"))
    there = grams.where("near is null").join(weights.select("gram", "weight"), "gram").groupBy(*keys).agg(F.sum("weight").alias("sum"), F.count("*").alias("n"))
    both = here.unionByName(there).groupBy(*keys).agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))
    return both.select(*keys, (F.col("sum") / F.col("n")).alias("score"))


def calibrate(scored: DataFrame) -> float:
    """The threshold, a multiple of 0.01 from -10 to 10, with the least sum of the two error rates; 0 if there is nothing to go by.

    scored: score, accepted (0 or 1). Only 2001 counts reach the driver.
    """
    level = F.greatest(F.least(F.floor(F.col("score") * 100), F.lit(1000)), F.lit(-1000)).cast("int")
    rows = scored.groupBy(level.alias("level")).agg(F.sum("accepted").alias("a"), F.sum(1 - F.col("accepted")).alias("r")).orderBy("level").collect()
    accepted, rejected = sum(x["a"] for x in rows), sum(x["r"] for x in rows)
    if not accepted or not rejected:
        return 0.0
    lost, passed = 0, rejected
    best, ties = None, []
    for x in rows:  # allowed: levels from x on
        error = lost / accepted + passed / rejected
        if best is None or error < best - 1e-12:
            best, ties = error, [x["level"]]
        lost, passed = lost + x["a"], passed - x["r"]
    if lost / accepted + passed / rejected < best:
        ties = [rows[-1]["level"] + 1]
    return ties[0] / 100


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of pages.

    Rows that a rule decides have its verdict and no score. The others get 'allow' where the
    score reaches the threshold, else 'block'; a null or empty url is scored by its end alone.
    Without rule-decided rows every score is 0 and the verdict is allow. Rows with the same page_id
    and url share a score; repeated rows stay. Other columns are not read. A URL of any length is scored whole, one that holds
    U+0002 or U+0003 as if these were the marks of its start and end. An empty table gives an empty one.
    """
    rows = only(pages, page_id="long", url="string")
    host, path = split_url(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("said", verdict)
    held_out = F.pmod(F.xxhash64(F.coalesce("url", F.lit("")), F.lit(1)), F.lit(FOLDS)) == 0
    rows = materialize(rows.withColumn("held_out", held_out), "url-rows")
    counted = F.col("said").isNotNull() & ~F.col("held_out")
    weights = fit_ratio(
        rows.select("url", F.coalesce(counted & (F.col("said") == "allow"), F.lit(False)).cast("int").alias("accepted"), F.coalesce(counted & (F.col("said") == "block"), F.lit(False)).cast("int").alias("rejected"))
    )
    # distinct URLs are scored once; grams go by a digest, since a long URL has as many grams as characters
    known = rows.withColumn("key", F.sha2(F.coalesce("url", F.lit("")).cast("binary"), 256))
    sought = known.where("said is null or held_out").select("key", F.coalesce("url", F.lit("")).alias("url")).dropDuplicates(["key"])
    scored = materialize(score(sought, weights), "url-scores")
    judged = materialize(known.join(scored, "key", "left").drop("key"), "url-judged")
    least = calibrate(judged.where("said is not null and held_out").select("score", (F.col("said") == "allow").cast("int").alias("accepted")))
    by_score = F.when(F.coalesce("score", F.lit(0.0)) >= least, "allow").otherwise("block")
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("said", by_score).alias("verdict"), F.when(F.col("said").isNull(), F.coalesce("score", F.lit(0.0))).alias("score")
    )
