"""Question sets: keyword search for evidence, drafting plans, review, and summaries of judged answers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import parsing

#: Questions to draft by type, from one chunk or from two; types whose answer needs several passages.
SINGLE = {"factual": 14, "definition": 12, "explanation": 14, "numerical": 10, "specific_source": 10}
PAIRED = {"multi_hop": 8, "comparison": 6, "synthesis": 6}
MULTI = ("multi_hop", "comparison", "synthesis")
#: A pair's chunks are more than so many pages apart; a second chunk is drawn at most so many times after the first draw.
APART, TRIES = 5, 8
#: Over-credit of the judge's own family above another's by so much is self-preference.
SELF_GAP = 0.3


def keyword_search(chunks: DataFrame, pattern: str, *, regex: bool = False, whole_word: bool = False, books: list[str] | None = None, per_book: int = 3, context: int = 60) -> DataFrame:
    """(book, chunk_id, breadcrumb, text) -> book, hits of the book, place, chunk_id, snippet: the first of each book.

    Matches in either case, substrings unless `whole_word` or `regex`; only content sections are searched.
    """
    rx = "(?i)" + (pattern if regex else rf"\b{re.escape(pattern)}\b" if whole_word else re.escape(pattern))
    found = chunks.where(parsing.is_content_section(F.col("breadcrumb")) & F.col("text").rlike(rx))
    found = found.where(F.col("book").isin(books)) if books else found
    at = F.regexp_instr("text", F.lit(rx))
    start = F.greatest(at - context, F.lit(1))
    stop = at + F.length(F.regexp_extract("text", rx, 0)) + context
    place = F.row_number().over(Window.partitionBy("book").orderBy("chunk_id"))
    first = found.withColumn("place", place).where(F.col("place") <= per_book)
    hits = found.groupBy("book").agg(F.count("*").alias("hits"))
    return first.join(hits, "book").select("book", "hits", "place", "chunk_id", F.translate(F.substr("text", start, stop - start), "\n", " ").alias("snippet"))


def _jobs(quotas: dict[str, int], books: list[str], least: int) -> list[tuple[int, str, str, int]]:
    """(job, type, book, ordinal in its book): each type goes round the books."""
    jobs, seen = [], dict.fromkeys(books, 0)
    for kind, n in quotas.items():
        for i in range(n):
            book = books[i % len(books)]
            jobs.append((least + len(jobs), kind, book, seen[book]))
            seen[book] += 1
    return jobs


def draft_plan(pool: DataFrame, seed: int = 7, single: dict[str, int] = SINGLE, paired: dict[str, int] = PAIRED) -> DataFrame:
    """(book, chunk_id, breadcrumb, page_start) -> job, question_type, book, first, second (null for single ones).

    Books have equal shares, whatever their size. A book's chunks are drawn in order of md5(seed:chunk_id), from the
    start again when they run out. A pair's second chunk is the first of nine draws that has another breadcrumb and is
    over APART pages away, else the last. Books come to the driver, a chunk never.
    """
    spark = pool.sparkSession
    books = sorted(r.book for r in pool.select("book").distinct().collect())
    if not books:
        return spark.createDataFrame([], "job int, question_type string, book string, first string, second string")
    singles = _jobs(single, books, 1)
    pairs = _jobs(paired, books, len(singles) + 1)
    taken = {b: sum(j[2] == b for j in singles) for b in books}
    draws = [(j, kind, b, 0, i) for j, kind, b, i in singles]
    draws += [(j, kind, b, t, taken[b] + (TRIES + 2) * i + t) for j, kind, b, i in pairs for t in range(TRIES + 2)]
    most = max(d[4] for d in draws) + 1
    asked = spark.createDataFrame(draws, "job int, question_type string, book string, draw int, ordinal long")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("chunk_id").cast("string")).cast("binary"))
    ranked = pool.withColumn("place", F.row_number().over(Window.partitionBy("book").orderBy(order, "chunk_id"))).where(F.col("place") <= most)
    sizes = pool.groupBy("book").agg(F.least(F.count("*"), F.lit(most)).alias("n"))
    placed = asked.join(sizes, "book").withColumn("place", F.col("ordinal") % F.col("n") + 1)
    drawn = placed.join(ranked, ["book", "place"]).select("job", "question_type", "book", "draw", F.struct("draw", F.col("chunk_id").cast("string").alias("id"), F.col("breadcrumb").alias("crumb"), F.col("page_start").alias("page")).alias("c"))
    listed = drawn.groupBy("job", "question_type", "book").agg(F.sort_array(F.collect_list("c")).alias("c"))
    first = F.col("c")[0]
    others = F.slice("c", 2, TRIES + 1)
    far = F.filter(others, lambda x: ~x["crumb"].eqNullSafe(first["crumb"]) & (F.abs(x["page"] - first["page"]) > APART))
    return listed.select("job", "question_type", "book", first["id"].alias("first"), F.coalesce(F.get(far, F.lit(0)), F.get(F.reverse(others), F.lit(0)))["id"].alias("second"))


def review(candidates: DataFrame, question_type: str | None = None, undecided: bool = False) -> DataFrame:
    shown = candidates if question_type is None else candidates.where(F.col("question_type") == question_type)
    return shown.where("keep is null") if undecided else shown


def curation_stats(candidates: DataFrame, manual: DataFrame, types: list[str], most: int = 50) -> DataFrame:
    """One row: candidates by decision, manual items, the total, whether it may be promoted, types not covered."""
    decided = candidates.agg(F.count("*").alias("candidates"), F.count_if(F.col("keep")).alias("kept"), F.count_if(~F.col("keep")).alias("dropped"), F.count_if(F.col("keep").isNull()).alias("undecided"))
    golden = candidates.where("keep").select("question_type").unionByName(manual.select("question_type"))
    have = golden.agg(F.count("*").alias("total"), F.collect_set(F.when(F.col("question_type").isin(types), F.col("question_type"))).alias("_have"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, types)), "_have"))
    joined = decided.join(F.broadcast(have))  # one row each
    return joined.select("candidates", "kept", "dropped", "undecided", (F.col("total") - F.col("kept")).alias("manual"), "total", (F.col("total") <= most).alias("fits"), F.array_join(missing, ",").alias("missing"))


def judge_prompt(template: Column, question: Column, answer: Column, sources: Column) -> Column:
    """The judge's prompt, with only those sources (map of id to text) that the answer cites and that exist; else null."""
    cited = F.filter(F.array_distinct(parsing.citations(answer)), lambda s: F.map_contains_key(sources, s))
    block = F.array_join(F.transform(cited, lambda s: F.concat(F.lit("["), s, F.lit("] "), F.element_at(sources, s))), "\n\n")
    filled = F.replace(F.replace(F.replace(template, F.lit("{question}"), question), F.lit("{answer}"), answer), F.lit("{sources}"), block)
    return F.when(F.size(cited) > 0, filled)


def family(model: Column) -> Column:
    return F.split(F.split(model, ":")[0], "-")[0]


def judged_summary(judged: DataFrame, judge: str) -> DataFrame:
    """(config, should_refuse, refused, answer, asked, verdicts) -> faithfulness by generator.

    Refusals, empty answers and answers without a prompt (`asked` false) are not judged; null verdicts failed to parse.
    `same_family` warns of a judge from the generator's family.
    """
    rows = judged.where(~F.col("should_refuse") & ~F.col("refused") & (F.length("answer") > 0) & F.col("asked"))
    bad = F.exists("verdicts", lambda v: v["verdict"] == "unsupported")
    out = rows.groupBy("config").agg(
        F.count("*").alias("n_judged"),
        F.round(F.avg(parsing.faithfulness(F.col("verdicts"))), 4).alias("supported_rate"),
        F.count_if(F.col("verdicts").isNotNull() & bad).alias("with_unsupported"),
        F.count_if(F.col("verdicts").isNull()).alias("parse_failed"),
    )
    return judged.select("config").distinct().join(out, "config", "left").fillna(0, ["n_judged", "with_unsupported", "parse_failed"]).withColumn("same_family", family(F.col("config")) == family(F.lit(judge)))


def self_preference(over_credit: DataFrame, own: str, other: str) -> DataFrame:
    """(model, over_credit) -> gap and verdict on the judge's own family; unknown if one has no case."""
    rate = lambda m: F.max(F.when(F.col("model") == m, F.col("over_credit")))
    gap = over_credit.agg(F.round(rate(own) - rate(other), 6).alias("gap"))
    return gap.withColumn("verdict", F.when(F.col("gap").isNull(), "unknown").when(F.col("gap") >= SELF_GAP, "self_preference").otherwise("none_large"))


def ablation(rows: DataFrame, by: list[str]) -> DataFrame:
    """(…, type, usable, recall, wrong_refusal, n_docs, error) -> means over all and over multi-passage types.

    Items with an error are left out and counted; a null recall (nothing labelled) is in no mean.
    """
    ok, many = F.col("error").isNull(), F.col("type").isin(*MULTI)
    mean = lambda c, cond=F.lit(True): F.round(F.avg(F.when(ok & cond, F.col(c).cast("double"))), 4)
    return rows.groupBy(*by).agg(
        F.count_if(ok).alias("n"), F.count_if(~ok).alias("errors"), mean("usable").alias("usable"), mean("recall").alias("recall"), mean("usable", many).alias("usable_multi"), mean("recall", many).alias("recall_multi"),
        F.count_if(ok & F.col("wrong_refusal")).alias("wrong_refusals"), F.round(F.avg(F.when(ok, F.col("n_docs"))), 1).alias("mean_docs"),
    )
