"""Text-quality measures as Column expressions, and the page aggregates built on them."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts are counted so many bytes at a time, a longer one by itself.
PART = 1 << 20
COUNTS = ("chars", "letters", "tokens", "singles", "broken")
HIGHER_IS_BETTER = {"chars_per_page": True, "alpha_ratio": True, "single_char_token_ratio": False, "broken_hyphen_rate": False}


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def rounded(x: Column, digits: int) -> Column:
    """A double rounded as SQL does, scaled and halves away from zero; `F.round` rounds its shortest decimal form instead."""
    return F.round(x * 10.0**digits) / 10.0**digits


def chars_per_page(text: Column) -> Column:
    return F.length(F.translate(text, " \t\n\x0b\f\r", ""))


def alpha_ratio(text: Column) -> Column:
    return share(F.length(F.regexp_replace(text, r"[^\p{L}]+", "")), chars_per_page(text))


def _of_tokens(text: Column, measure: Callable[[Column], Column]) -> Column:
    """A measure of the tokens, which are split once: as a lambda's argument, not as a repeated expression."""
    return F.get(F.transform(F.array(tokens(text)), measure), F.lit(0))


def single_char_token_ratio(text: Column) -> Column:
    return _of_tokens(text, lambda t: share(F.size(F.filter(t, lambda x: F.length(x) == 1)), F.size(t)))


def broken_hyphen_rate(text: Column) -> Column:
    """Tokens that end in a hyphen before one that starts in lower case, among all tokens."""

    def rate(t: Column) -> Column:
        broken = F.filter(t, lambda x, i: x.endswith("-") & (F.length(x) > 1) & F.coalesce(F.get(t, i + 1), F.lit("")).rlike(r"^\p{Ll}"))
        return share(F.size(broken), F.size(t))

    return _of_tokens(text, rate)


@cache
def _kinds() -> tuple[np.ndarray, ...]:
    """By byte: blank, first of a character that is none, size of the character; by code point: letter, lower-case letter."""
    byte = np.arange(256)
    blank = (byte == 32) | (byte >= 9) & (byte <= 13)
    size = np.select([byte < 0xC0, byte < 0xE0, byte < 0xF0], [1, 2, 3], 4)
    kind = [unicodedata.category(chr(i)) for i in range(0x110000)]
    return blank, ~blank & (byte & 0xC0 != 0x80), size, np.array([k[0] == "L" for k in kind]), np.array([k == "Ll" for k in kind])


def _code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the UTF-8 characters that start there."""
    a, b, c, d = (data[np.minimum(at + i, len(data) - 1)].astype(np.int64) & (255, 63, 63, 63)[i] for i in range(4))
    wide = [(a & 31) << 6 | b, (a & 15) << 12 | b << 6 | c]
    return np.minimum(np.select([a < 0xC0, a < 0xE0, a < 0xF0], [a, *wide], (a & 7) << 18 | b << 12 | c << 6 | d), 0x10FFFF)


def _count_part(data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """COUNTS of texts that lie end to end as UTF-8; `ends` has the 0 before the first one, too."""
    is_blank, is_char, size, is_letter, is_lower = _kinds()
    rows = np.flatnonzero(np.diff(ends))
    if not len(rows):
        return [np.zeros(len(ends) - 1, np.int64)] * len(COUNTS)

    def by_text(flags: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ends) - 1, np.int64)
        out[rows] = np.add.reduceat(flags, ends[rows], dtype=np.int64)
        return out

    def places(at: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(at, ends))

    blank, letters = is_blank[data], is_letter[:256][data] & (data < 0x80)
    far = np.flatnonzero(data >= 0xC0)
    letters[far] = is_letter[_code_points(data, far)]
    stop = np.append(blank, True)  # here a token has ended, if there was one
    first = ~blank
    first[1:] &= blank[:-1]
    at_start = ends[rows]
    first[at_start] = ~blank[at_start]
    stop[ends] = True
    at = np.flatnonzero(first)
    single = at[stop[np.minimum(at + size[data[at]], len(data))]]
    hyphens = np.flatnonzero(data == 45)
    hyphens = hyphens[stop[hyphens + 1] & ~first[hyphens]]
    after = np.append(at, len(data))[np.searchsorted(at, hyphens, "right")]
    within = after < ends[np.searchsorted(ends, hyphens, "right")]
    hyphens, after = hyphens[within], after[within]
    return [by_text(is_char[data]), by_text(letters), places(at), places(single), places(hyphens[is_lower[_code_points(data, after)]])]


def count_texts(texts: pa.Array) -> pa.StructArray:
    """COUNTS of each text: characters that are no blanks, letters, tokens, tokens of one character, hyphens that broken_hyphen_rate counts."""
    n, (_, offsets, data) = len(texts), texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(data or b"", np.uint8)
    found, i = [], 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + PART, "right")) - 1)
        found.append(_count_part(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]))
        i = j
    null = np.asarray(texts.is_null())
    columns = [np.concatenate(c) for c in zip(*found)] or [np.zeros(0, np.int64)] * len(COUNTS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int32(), mask=null) for c in columns], COUNTS)


@F.arrow_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in COUNTS]))
def _counted(texts: pa.Array) -> pa.Array:
    return count_texts(texts)


def score_page(text: Column) -> list[Column]:
    """All measures of a page, in one pass over its bytes."""
    n = _counted(text)
    measures = {chars_per_page: n.chars, alpha_ratio: share(n.letters, n.chars), single_char_token_ratio: share(n.singles, n.tokens), broken_hyphen_rate: share(n.broken, n.tokens)}
    return [c.alias(f.__name__) for f, c in measures.items()]


def repeated_line_ratio(pages: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(book, page_num, text) -> (book, ratio): line instances whose stripped line is on many of the book's pages.

    Lines are counted by (book, line) with partial aggregation, so a book's pages are never gathered.
    """
    lines = pages.select("book", "page_num", F.explode(F.split("text", "\n")).alias("raw")).select("book", "page_num", F.trim("raw").alias("line")).where("line != ''")
    counted = lines.groupBy("book", "line").agg(F.count("*").alias("n"), F.countDistinct("page_num").alias("on_pages"))
    sizes = pages.groupBy("book").agg(F.count("*").alias("n_pages"))
    often = F.col("on_pages") >= F.greatest(F.lit(2.0), threshold * F.col("n_pages"))
    return counted.join(sizes, "book").groupBy("book").agg((F.sum(F.when(often, F.col("n")).otherwise(0)) / F.sum("n")).alias("ratio"))


def sample_pages(sizes: DataFrame, k: int) -> DataFrame:
    """(book, n_pages) -> (book, page_num): k pages spread over the middle, the first k of it if it is shorter."""
    bounds = sizes.withColumn("lo", F.floor(F.col("n_pages") * 0.08)).withColumn("hi", F.floor(F.col("n_pages") * 0.95))
    step = F.when(F.col("hi") - F.col("lo") < k, F.lit(1)).otherwise(F.floor((F.col("hi") - F.col("lo")) / k))
    start = F.when(F.col("hi") - F.col("lo") < k, F.lit(0)).otherwise(F.col("lo"))
    picked = bounds.select("book", "n_pages", F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (start + i * step).cast("int"))).alias("page_num"))
    return picked.where("page_num < n_pages").select("book", "page_num")


def choose_parser(scores: DataFrame, weights: dict[str, float], dead_band: float = 0.02) -> DataFrame:
    """(parser, page, elapsed_ms, errors, measures) -> ranked parsers: per-page min-max scores, gated, weighted.

    Gates: no errors, 90 % of the page's best characters on average, alpha ratio of 0.55. Within 3 % the faster wins.
    """
    from pyspark.sql import Window

    page = Window.partitionBy("page")
    total = F.lit(0.0)
    for name, weight in weights.items():
        lo, hi = F.min(name).over(page), F.max(name).over(page)
        unit = F.when(hi - lo <= dead_band * F.greatest(F.abs(hi), F.lit(1e-12)), F.lit(1.0)).otherwise((F.col(name) - lo) / (hi - lo))
        total = total + weight * (unit if HIGHER_IS_BETTER[name] else F.when(hi - lo <= dead_band * F.greatest(F.abs(hi), F.lit(1e-12)), F.lit(1.0)).otherwise(1 - unit))
    scored = scores.withColumn("score", total).withColumn("full", F.col("chars_per_page") / F.greatest(F.max("chars_per_page").over(page), F.lit(1)))
    ranked = scored.groupBy("parser").agg(F.avg("score").alias("score"), F.avg("full").alias("full"), F.avg("alpha_ratio").alias("alpha"), F.sum("errors").alias("errors"), F.avg("elapsed_ms").alias("ms"))
    passed = ranked.where("errors = 0 and full >= 0.9 and alpha >= 0.55")
    best = F.max("score").over(Window.partitionBy())  # a row for each parser; a join would score all pages twice
    tied = passed.withColumn("tied", F.col("score") >= 0.97 * best)
    return tied.select("parser", "score", "tied", F.row_number().over(Window.orderBy(F.col("tied").desc(), F.when(F.col("tied"), F.col("ms")), F.col("score").desc(), "parser")).alias("place"))
