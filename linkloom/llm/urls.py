"""URL filter: list rules first, a character language-model ratio for what no rule decides.

Two variable-order Markov models, of URLs that the rules allow and of URLs that they block, give each character of a URL a
probability from the longest context seen, smoothed down to shorter ones (Witten-Bell). A URL's score is the mean over its
characters of log p(allowed) - log p(blocked); the threshold is set on rule-decided URLs held out of the counts.

Counts cover every URL outside the held-out share. They are a table of distinct character runs, summed inside each task
before they are shuffled; models are joined, not sent to the driver. Logarithms are rounded to whole millionths, so a sum
does not depend on its order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.tables import stored, with_fixed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START = "\x02"  # stands for the characters before the first one
ALPHABET = 256  # what an unseen character is one of
MICRO = 1_000_000


@dataclass(frozen=True)
class UrlRule:
    """``place`` is a host, with all its subdomains, and the start of a path."""

    place: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        at, _, rest = self.place.partition("/")
        return ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit("/" + rest))


def parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z in lower case, and path; both empty without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def by_rules(pages: DataFrame, rules: tuple[UrlRule, ...], key: str = "page_id", url: str = "url") -> DataFrame:
    """Columns row, page_id, url, host, path, rule (the longest that fits, or null), verdict (the rule's, or null)."""
    host, path = parts(F.col(url))
    rows = with_fixed(pages.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("page_id"),
                                   F.col(url).alias("url")), host=host, path=path)
    longest = sorted(rules, key=lambda r: (-len(r.place), r.place))
    choose = lambda value: F.coalesce(F.lit(None).cast("string"), *[
        F.when(r.fits(F.col("host"), F.col("path")), F.lit(value(r))) for r in longest])
    return with_fixed(rows, rule=choose(lambda r: r.place), verdict=choose(lambda r: r.verdict))


def _runs(rows: DataFrame, order: int) -> DataFrame:
    """One row for each character of host and path: the run of it and the ``order`` characters before it."""
    rows = with_fixed(rows, told=F.concat(F.lit(START * order), "host", "path"))
    ends = F.sequence(F.lit(1), F.length("told") - order)
    return rows.where(F.length("told") > order).select(
        "row", "class", F.explode(F.transform(ends, lambda i: F.substring("told", i, F.lit(order + 1)))).alias("run"))


def _model(runs: DataFrame, order: int) -> DataFrame:
    """The log ratio, in millionths, of every run: columns run, ratio."""
    count = lambda c: F.count_if(F.col("class") == c).alias(c)
    seen = stored(runs.groupBy("run").agg(count("allow"), count("block")))
    lower = None
    for n in range(order + 1):  # contexts of 0, 1, ... characters
        grams = seen.groupBy(F.expr(f"right(run, {n + 1})").alias("run")).agg(
            F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        grams = grams.withColumn("context", F.expr(f"left(run, {n})"))
        totals = grams.groupBy("context").agg(*[f(c) for c in ("allow", "block") for f in (
            lambda c: F.sum(c).alias(f"{c}_n"), lambda c: F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds"))])
        grams = grams.join(totals, "context")
        if lower is None:
            grams = grams.withColumns({f"{c}_low": F.lit(1.0 / ALPHABET) for c in ("allow", "block")})
        else:
            grams = grams.withColumn("shorter", F.expr(f"right(run, {n})")).join(lower, "shorter")

        def chance(c):
            weight = F.greatest(F.col(f"{c}_kinds"), F.lit(1)).cast("double")
            return (F.col(c) + weight * F.col(f"{c}_low")) / (F.col(f"{c}_n") + weight)

        grams = grams.select("run", chance("allow").alias("allow_low"), chance("block").alias("block_low"))
        lower = grams.withColumnRenamed("run", "shorter")
    return grams.select("run", F.round((F.log("allow_low") - F.log("block_low")) * MICRO).cast("long").alias("ratio"))


def _threshold(scores: DataFrame, bin_width: int) -> int:
    """The score from which a held-out URL is best taken as allowed: least sum of both classes' error rates.

    Scores are means of logarithms of counts, so the number of bins does not grow with the URLs beyond a few hundred.
    """
    bins = scores.groupBy(F.floor(F.col("score") / bin_width).alias("bin")).agg(*[
        F.count_if(F.col("class") == c).alias(c) for c in ("held_allow", "held_block")])
    rows = sorted(bins.collect())
    good, bad = sum(r["held_allow"] for r in rows), sum(r["held_block"] for r in rows)
    if not good or not bad:
        return 0
    best, cut, lost, passed = 1.0, rows[0]["bin"], 0, bad
    for row in rows:
        lost, passed = lost + row["held_allow"], passed - row["held_block"]
        if lost / good + passed / bad < best:
            best, cut = lost / good + passed / bad, row["bin"] + 1
    return int(cut * bin_width)


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...], key: str = "page_id", url: str = "url", order: int = 4,
               held: int = 2, bin_width: int = 20_000) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score (micronats per character, null without text).

    Of 16 rule-decided URLs, ``held`` (by the first digit of their md5) set the threshold and are left out of the counts.
    A null URL, or one without ``://``, has no host and path: no rule fits and, having no character to judge, it is
    allowed. Equal URLs get equal results; null keys are kept; an empty table gives an empty table. Without decided URLs
    of both kinds the threshold is 0.
    """
    rows = by_rules(pages, rules, key, url)
    rows = stored(rows.withColumn("class", F.when(F.md5("url") < f"{held:x}", F.concat(F.lit("held_"), "verdict")).otherwise(F.col("verdict"))))
    runs = _runs(rows, order)
    model = stored(_model(runs, order))
    scores = stored(runs.join(model, "run").groupBy("row", "class").agg(
        F.round(F.sum("ratio") / F.count(F.lit(1))).cast("long").alias("score")))
    cut = _threshold(scores, bin_width)
    judged = F.when(F.col("score") < cut, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(scores.drop("class"), "row", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", judged).alias("verdict"), "score")
