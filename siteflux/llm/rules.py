"""Quality rules as a short-circuit cascade: the rule that rejects most for its cost is asked first."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteflux.llm.common import keep, n_words, text_of

#: Rows that costs and selectivities are estimated on. The order of the rules depends on them, their verdict does not.
SAMPLE_ROWS = 500
#: Characters of a sampled text that are timed; a verdict always reads whole texts.
SAMPLE_CHARS = 20_000
#: Bits of a sort word that hold a window's place, for texts below 2**24 words and for all others.
PLACE_BITS, PLACE_BITS_LONG = 24, 31
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return F.transform(F.array(lines), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))[0]


def n_repeat_words(text: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Each window is one long: hash bits above, its place below. Sorted, equal windows are neighbours; the places of
    those are spread to three words each and counted once. Two different windows may share the shortened hash,
    so the whole hashes of the found windows are compared with their places' neighbours afterwards.
    """

    def named(value: Column, fn: Callable[[Column], Column]) -> Column:
        # a lambda over a one-element array names a value, so that it is computed once
        return F.transform(F.array(value), fn)[0]

    def windows(w: Column) -> Column:
        # a window's hash from its words' hashes, kept apart by order
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        )

    def repeated(h: Column, bits: int) -> Column:
        low = (1 << bits) - 1
        packed = F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))

        def neighbours(s: Column) -> Column:
            same = lambda x, y: F.shiftright(x, bits) == F.shiftright(y, bits)
            return F.filter(s, lambda x, i: F.coalesce(same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)), F.lit(False)))

        places = F.transform(named(F.sort_array(packed), neighbours), lambda x: x.bitwiseAND(F.lit(low)).cast("int"))

        def covered(p: Column) -> Column:
            spread = F.size(F.array_distinct(F.flatten(F.transform(p, lambda x: F.array(x, x + 1, x + 2)))))
            full = F.transform(p, lambda x: F.get(h, x))
            short = F.transform(full, lambda x: F.shiftright(x, bits))
            clean = F.size(F.array_distinct(full)) == F.size(F.array_distinct(short))
            exact = F.filter(p, lambda x: F.size(F.filter(full, lambda y: y == F.get(h, x))) > 1)
            spread_exact = F.size(F.array_distinct(F.flatten(F.transform(exact, lambda x: F.array(x, x + 1, x + 2)))))
            return F.when(F.size(p) == 0, 0).when(clean, spread).otherwise(spread_exact)

        return named(places, covered)

    counted = named(
        words_of(text),
        lambda w: F.when(F.size(w) < 4, 0)
        .when(F.size(w) < 1 << PLACE_BITS, named(windows(w), lambda h: repeated(h, PLACE_BITS)))
        .otherwise(named(windows(w), lambda h: repeated(h, PLACE_BITS_LONG)))
    )
    return counted.cast("long")


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps a function from a count's name to its column to a boolean.

    It is asked only where no earlier rule has rejected, and only then are the counts it names computed.
    """

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


def _alphabetic(text: Column) -> Column:
    """Characters that are no ASCII control, digit, space or punctuation."""
    return F.length(F.regexp_replace(text, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", ""))


COUNTS: dict[str, Callable[[Column], Column]] = {
    "n_words": n_words,
    "word_chars": word_chars,
    "n_symbols": n_symbols,
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words,
    "n_lines": lambda text: F.size(F.split(text, "\n")),
    "n_letters": _alphabetic,
    "n_capitals": lambda text: F.regexp_count(text, F.lit("[A-Z]")),
}
#: Rules of the base and the method's own. Thresholds are wide of ordinary prose in any language with spaces.
MIN_WORDS, REPEAT_PERCENT = 50, 50
RULES = (
    Rule("few_words", lambda c: c("n_words") < MIN_WORDS),
    Rule("repeated_words", lambda c: 100 * c("n_repeat_words") > REPEAT_PERCENT * c("n_words")),
    Rule("symbols", lambda c: 100 * c("n_symbols") > 25 * c("n_words")),
    Rule("repeated_lines", lambda c: 100 * c("n_dup_lines") > 50 * c("n_lines")),
    Rule("word_length", lambda c: (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 25 * c("n_words"))),
    Rule("not_letters", lambda c: 100 * (c("word_chars") - c("n_letters")) > 40 * c("word_chars")),
    Rule("shouting", lambda c: 100 * c("n_capitals") > 60 * c("n_letters")),
)


def _of_text(text: Column) -> Callable[[str], Column]:
    return lambda name: COUNTS[name](text)


def measured_order(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejected share per second, each timed on one cached sample of at most ``sample_rows`` rows.

    Ties and rules that reject nothing come in their given order, dearest last. The sample's rows are the first
    Spark finds; any sample gives the same verdicts.
    """
    sample = keep(docs.select(F.substring(text_of(), 1, SAMPLE_CHARS).alias("text")).limit(sample_rows), "sample").cache()
    rows = sample.count()
    if not rows:
        return list(rules)
    merits = []
    for place, rule in enumerate(rules):
        began = time.perf_counter()
        hits = sample.agg(F.sum(rule.rejects(_of_text(F.col("text"))).cast("int")).alias("n")).first()["n"] or 0
        seconds = max(time.perf_counter() - began, 1e-3)
        merits.append((-hits / rows / seconds, seconds if not hits else 0.0, place, rule))
    sample.unpersist()
    return [m[-1] for m in sorted(merits, key=lambda m: m[:3])]


def cascade(count: Callable[[str], Column], rules) -> Column:
    """The name of the first rule that rejects, null where none does. Later rules are not evaluated."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(F.coalesce(rule.rejects(count), F.lit(False)), F.lit(rule.name)).otherwise(out)
    return out


def quality_rules(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``rejected_by``, the rule that rejects a text, or null.

    Which of several rejecting rules is named depends on the measured order; whether one rejects does not. A null
    text has no words and so is rejected as too short. Every row is judged by itself: repeats get equal verdicts,
    and an empty table stays empty. An input column ``rejected_by`` is an error.
    """
    if "rejected_by" in docs.columns:
        raise ValueError("the input has a column rejected_by")
    return docs.withColumn("rejected_by", cascade(_of_text(text_of()), measured_order(docs, rules, sample_rows)))


def quality_counts(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The counts the base rules rest on, one row per input row, and the verdict of all rules.

    The counts that are returned are there for every row, so the cascade takes them from their columns; what only
    its other rules need is computed where they are asked.
    """
    given = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    order = measured_order(docs, rules, sample_rows)
    text = text_of()
    out = docs.select("doc_id", F.struct(text.alias("text"), *[COUNTS[c](text).alias(c) for c in given]).alias("row"))
    # a generator between keeps the counts from being written into every rule that names them
    out = out.select("doc_id", F.explode(F.array("row")).alias("row")).select("doc_id", "row.*")
    rejected = cascade(lambda c: F.col(c) if c in given else COUNTS[c](F.col("text")), order)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.select("doc_id", *given, failed.alias("base_failed"), (~failed & rejected.isNull()).alias("kept"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SPACES = r"[\x20\x09-\x0D]"

#: Python's and Spark's regular expressions agree with DuckDB's on these classes. `kept` adds the method's own rules.
OP10_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{_SPACES}+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '{_SPACES}', '', 'g')) > 0) AS lines,
    length(regexp_replace(t, '{_SPACES}', '', 'g')) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols
  FROM d),
g AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) > 3),
h AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM g),
r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM h) AS counted
  WHERE n > 1),
p AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS step(k) GROUP BY doc_id),
o AS (
  SELECT w.doc_id, len(words) AS n_words, word_chars, n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, t,
    len(string_split(t, chr(10))) AS n_lines,
    length(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS letters,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS capitals
  FROM w LEFT JOIN p ON p.doc_id = w.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 25 * n_words
    OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words OR word_chars > 25 * n_words
    OR 100 * (word_chars - letters) > 40 * word_chars OR 100 * capitals > 60 * letters) AS kept
FROM o
"""
