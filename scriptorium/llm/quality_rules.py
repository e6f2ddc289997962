"""Line-first cleaning with DataFrame functions only.

Every line is judged by three rules (punctuation, navigation, boilerplate); failing lines go, and a document that
loses too large a share of its words goes with them. Whole-document measures (symbols, repeated lines, words in
repeated three-word windows) stand beside it. Everything is computed inside the row: no shuffle, so neither a long
text nor a hot source can weigh on one task more than its own bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import BLANKS, n_words

#: Fixed values of the measures.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Fixed values of the line rules.
SENTENCE_END = r"[.!?\x{2026}\x{3002}]"
NAVIGATION = r"(?i)\b(home|login|log in|sign up|next page|previous page|site map|skip to content|back to top)\b.{0,40}$"
BOILERPLATE = r"(?i)\b(licensed under|released under|all rights reserved|copyright|cookies?|terms of (use|service)|privacy policy|javascript|subscribe|lorem ipsum|unsubscribe)\b"
#: Characters below which a line can be a menu by its words, a menu by its bars, or a boilerplate notice. Prose is longer.
MENU_CHARS, BARS_CHARS, NOTICE_CHARS = 80, 400, 200
#: A line fails as punctuation too if it has more than one symbol or doubled mark for so many words.
WORDS_PER_MARK = 4
#: A document goes if its failing lines hold more than this percentage of its words.
MAX_LOST_PERCENT = 40


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(_without(text, chars))


def _line_fails(line: Column) -> Column:
    n, bars = F.length(line), _count(line, "|")
    pairs = 2 * n - F.length(F.replace(line, F.lit("!!"), F.lit(""))) - F.length(F.replace(line, F.lit("??"), F.lit("")))  # twice the doubled marks
    punctuation = ~line.rlike(SENTENCE_END) | ((2 * _count(line, SYMBOLS) + pairs) * WORDS_PER_MARK > 2 * n_words(line))
    navigation = (n < MENU_CHARS) & line.rlike(NAVIGATION) | (bars >= 2) & (n < BARS_CHARS) | (bars * 3 > n_words(line))
    return punctuation | navigation | (n < NOTICE_CHARS) & line.rlike(BOILERPLATE)


def _repeat_words(words: Column, windows: Column) -> Column:
    """Words inside a three-word window that the text holds twice or more.

    `windows` has a 64-bit hash of each window in order. Sorted with their positions, equal windows are neighbours; in
    position order, each repeated window covers the words up to the next one, three at most.
    """
    by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(sorted_windows: Column) -> Column:
        same = lambda x, k, step: F.coalesce(F.get(sorted_windows, k + step)["h"] == x["h"], F.lit(False))
        marked = F.filter(sorted_windows, lambda x, k: same(x, k, F.lit(1)) | F.when(k > 0, same(x, k, F.lit(-1))).otherwise(False))
        return F.sort_array(F.transform(marked, lambda x: x["i"]))

    def length(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    one = F.transform(F.array(by_hash), covered)  # a lambda's argument is evaluated once, a repeated expression each time
    total = F.get(F.transform(one, length), F.lit(0))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), total).otherwise(F.lit(0)).cast("long")


def measure(docs: DataFrame, *, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS, max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """Key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, kept_words, base_failed, kept and clean_text.

    A null text has no words: base_failed is true, kept false, clean_text empty. Empty texts likewise. Ties do not
    arise, repeated rows are judged each by itself, an empty table gives an empty one, and other columns are dropped.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = docs.select(
        F.col(key),
        whole.alias("_text"),
        F.filter(F.split(whole, "\n", -1), lambda x: F.length(_without(x, BLANKS)) > 0).alias("_lines"),
        F.filter(F.split(whole, "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "").alias("_words"),
    )
    some = lines.select(
        key,
        "_text",
        "_lines",
        "_words",
        F.filter("_lines", lambda x: ~_line_fails(x)).alias("_good"),
        F.when(
            F.size("_words") >= 3,
            F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))),
        )
        .otherwise(F.array().cast("array<long>"))
        .alias("_windows"),
    )
    measured = some.select(
        key,
        F.size("_words").cast("long").alias("n_words"),
        F.length(_without(F.col("_text"), BLANKS)).cast("long").alias("word_chars"),
        _count(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_words"), F.col("_windows")).alias("n_repeat_words"),
        F.aggregate("_good", F.lit(0).cast("long"), lambda a, x: a + n_words(x)).alias("kept_words"),
        F.array_join("_good", "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    lost = 100 * (F.col("n_words") - F.col("kept_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & (lost <= max_lost_percent * F.col("n_words")))


def quality_rules(docs: DataFrame, **options) -> DataFrame:
    """measure() without the cleaned text."""
    return measure(docs, **options).drop("clean_text")


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT rid, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w,
  length(line) - length(translate(line, '{SYMBOLS}', '')) + len(regexp_extract_all(line, '!!|\?\?')) AS marks,
  length(line) AS n, len(regexp_extract_all(line, '\|')) AS bars
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines,
  coalesce(sum(w) FILTER (WHERE NOT (NOT regexp_matches(line, '{SENTENCE_END}') OR marks * {WORDS_PER_MARK} > w
    OR (regexp_matches(line, '{NAVIGATION}') AND n < {MENU_CHARS}) OR (bars >= 2 AND n < {BARS_CHARS}) OR bars * 3 > w
    OR (regexp_matches(line, '{BOILERPLATE}') AND n < {NOTICE_CHARS}))), 0) AS kept_words FROM lw GROUP BY rid),
ws AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
w AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM ws),
tri AS (SELECT rid, i, w AS a, lead(w) OVER p AS b, lead(w, 2) OVER p AS c FROM w WINDOW p AS (PARTITION BY rid ORDER BY i)),
rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM tri WHERE c IS NOT NULL),
cov AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) AS o(o) WHERE n > 1 GROUP BY rid),
m AS (SELECT d.doc_id, len(ws) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  CAST(coalesce(kept_words, 0) AS BIGINT) AS kept_words
  FROM d JOIN ws USING (rid) LEFT JOIN lines USING (rid) LEFT JOIN cov USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, kept_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
    AND 100 * (n_words - kept_words) <= {MAX_LOST_PERCENT} * n_words AS kept
FROM m
"""
