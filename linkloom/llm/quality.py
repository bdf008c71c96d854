"""Quality rules as a short-circuit cascade.

The base counts of a text are always computed. The rules of the cascade are yes-or-no tests; a text is kept if none
rejects it, so their order changes the cost only. On a bounded sample each rule's rejections are counted and its time
is taken, and the rules are chained by rejections per second: a text that one rule rejects is not shown to the next.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.tables import squeezed, with_fixed, words_of


@dataclass(frozen=True)
class Rule:
    """``rejects`` is an SQL condition over text, words, lines and the base counts."""

    name: str
    rejects: str


BLOCK_WORDS = 5000  # words of a block in which different words are counted
RULES = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    Rule("same_lines", "2 * n_dup_lines > size(lines)"),
    Rule("shouting", r"2 * regexp_count(text, '\\p{Lu}') > regexp_count(text, '\\p{L}')"),
    Rule("exclaiming", "length(text) - length(replace(text, '!', '')) > 0.3 * n_words"),
    Rule("few_letters", r"2 * regexp_count(text, '[\\p{L}\\p{M}]') < word_chars"),
    # the share of different words falls with the length of any text, so it is that of blocks which cover the text
    Rule("few_words", f"""aggregate(sequence(0, greatest(size(words) - 1, 0) div {BLOCK_WORDS}), 0, (n, i) -> n + size(array_distinct(
        slice(words, cast(i * {BLOCK_WORDS} + 1 as int), {BLOCK_WORDS})))) < 0.2 * n_words"""),
    Rule("dots", r"regexp_count(text, '\\.\\.\\.|…') > 0.3 * n_words"),
)
SAMPLE_ROWS = 500  # rows on which cost and rejections are estimated


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns doc (the whole input row), text (null: empty), words, lines, the five base counts and base_failed."""
    has_word = lambda line: F.length(squeezed(line)) > 0
    rows = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_fixed(rows, words=words_of(F.col("text")), lines=F.filter(F.split("text", "\n"), has_word))
    # windows of three words with their places, sorted: equal windows become neighbours
    rows = with_fixed(rows, windows="""sort_array(slice(
        arrays_zip(words, slice(words, 2, size(words)), slice(words, 3, size(words)), sequence(1, size(words))),
        1, greatest(size(words) - 2, 0)))""")
    rows = with_fixed(rows, places="""array_sort(transform(filter(windows, (w, i) ->
        (i > 0 AND w.`2` = windows[i - 1].`2` AND w.`1` = windows[i - 1].`1` AND w.words = windows[i - 1].words) OR
        (i + 1 < size(windows) AND w.`2` = windows[i + 1].`2` AND w.`1` = windows[i + 1].`1`
            AND w.words = windows[i + 1].words)), w -> w.`3`))""").drop("windows")
    rows = with_fixed(
        rows, n_words=F.size("words").cast("long"), word_chars=F.length(squeezed(F.col("text"))).cast("long"),
        n_symbols=F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        # a window covers three words; what the one before has covered is not counted again
        n_repeat_words="""aggregate(places, named_struct('at', -3, 'n', 0L),
            (s, p) -> named_struct('at', p, 'n', s.n + least(3, p - s.at)), s -> s.n)""").drop("places")
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text",
            sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by falling rejections per second on the first ``sample_rows`` rows that the base lets through."""
    sample = base_counts(docs.select(F.col(text).alias("text")).limit(sample_rows)).where("NOT base_failed").drop("doc").cache()
    sample.count()

    def worth(rule: Rule) -> float:
        start = time.perf_counter()
        rejected = sample.where(rule.rejects).count()
        return rejected / (time.perf_counter() - start)

    gains = {rule.name: worth(rule) for rule in rules}
    sample.unpersist()
    return sorted(rules, key=lambda rule: (-gains[rule.name], rule.name))


def _cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, else null; CASE stops at the first branch that holds."""
    found = F.when(F.col("base_failed"), F.lit("base"))
    for rule in rules:
        found = found.when(F.expr(rule.rejects), F.lit(rule.name))
    return found


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Columns of ``base_counts`` with rejected_by and kept.

    A null or empty text has no words and fails the base. Repeated rows are judged alike; an empty table gives an empty
    table; texts are read whole whatever their length. The input row is in ``doc``, so its column names clash with nothing.
    """
    return base_counts(docs, text).withColumn("rejected_by", _cascade(ordered(docs, rules, text))).withColumn(
        "kept", F.col("rejected_by").isNull())


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The input rows that are kept, with all their columns."""
    return judge(docs, rules, text).where("kept").select("doc.*")
