"""Queries over metrics, agreement, significance, run history and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import evaluation, retrieval
from scriptorium.plans.registry import query
from scriptorium.plans.retrieval_queries import _BM25, _DENSE, _RRF, _WEIGHTED, docs_of, questions_of
from scriptorium.sources.tables import table

_RUN = f"""{_BM25}, ranked AS (SELECT qid, rank, source AS book, doc_id AS page_start, doc_id + 1 AS page_end FROM bm JOIN documents USING (doc_id) WHERE rank <= 20),
ctx AS (SELECT DISTINCT b.item_id AS qid, source AS book, doc_id - 1 AS page_start, doc_id + 1 AS page_end FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled ranges: the documents that hold a question's passage, a page to each side."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    held = evaluation.holding(docs, questions_of(spark, sf_dir))
    return held.select("qid", F.col("source").alias("book"), (F.col("doc_id") - 1).alias("page_start"), (F.col("doc_id") + 1).alias("page_end")).distinct()


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.bm25_search(docs_of(spark, sf_dir), questions_of(spark, sf_dir), 20)
    placed = found.join(table(spark, sf_dir, "documents", "doc_id", "source"), "doc_id")
    return placed.select("qid", "rank", F.col("source").alias("book"), F.col("doc_id").alias("page_start"), (F.col("doc_id") + 1).alias("page_end"))


_METRICS = f"""{_RUN}, fl AS (SELECT r.*, CAST(EXISTS (SELECT 1 FROM ctx c WHERE c.qid = r.qid AND c.book = r.book AND c.page_start <= r.page_end AND r.page_start <= c.page_end) AS INTEGER) AS rel FROM ranked r),
fi AS (SELECT c.qid, c.book, c.page_start, min(rank) AS pos FROM ctx c LEFT JOIN ranked r ON c.qid = r.qid AND c.book = r.book AND c.page_start <= r.page_end AND r.page_start <= c.page_end GROUP BY ALL),
re AS (SELECT qid, {", ".join(f"avg(CASE WHEN coalesce(pos, 99999) <= {k} THEN 1 ELSE 0 END) AS recall_{k}" for k in evaluation.K_VALUES)} FROM fi GROUP BY qid),
pr AS (SELECT qid, {", ".join(f"avg(CASE WHEN rank <= {k} THEN rel END) AS precision_{k}" for k in evaluation.K_VALUES)}, coalesce(1.0::DOUBLE / min(CASE WHEN rel = 1 THEN rank END), 0) AS mrr FROM fl GROUP BY qid),
nd AS (SELECT qid, sum(1 / log2(rank + 1)) / sum(1 / log2(ideal + 1)) AS ndcg_10 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS ideal FROM fl WHERE rank <= 10 AND rel = 1) GROUP BY qid),
me AS (SELECT re.*, {", ".join(f"precision_{k}" for k in evaluation.K_VALUES)}, mrr, coalesce(ndcg_10, 0) AS ndcg_10 FROM re LEFT JOIN pr USING (qid) LEFT JOIN nd USING (qid))"""
_NAMES = [f"{m}_{k}" for m in ("recall", "precision") for k in evaluation.K_VALUES] + ["mrr", "ndcg_10"]
_ROUNDED = ", ".join(f"round({n}, 6) AS {n}" for n in _NAMES)


@query(f"WITH {_METRICS} SELECT qid, {_ROUNDED} FROM me")
def met01_per_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MET-01..04, JN-01, FLT-04, FLT-07: BM25's 20 best against passages' pages."""
    found = evaluation.retrieval_metrics(_ranked(spark, sf_dir), _contexts(spark, sf_dir))
    return found.select("qid", *[F.round(n, 6).alias(n) for n in _NAMES])


@query(f"WITH {_METRICS} SELECT count(*) AS n_questions, {', '.join(f'round(avg({n}), 6) AS {n}' for n in _NAMES)} FROM me")
def met06_macro_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.retrieval_metrics(_ranked(spark, sf_dir), _contexts(spark, sf_dir))
    return found.agg(F.count("*").alias("n_questions"), *[F.round(F.avg(n), 6).alias(n) for n in _NAMES])


@query(f"""WITH ctx AS (SELECT DISTINCT b.item_id AS qid, source AS book, doc_id - 1 AS page_start, doc_id + 1 AS page_end FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
n AS (SELECT qid, count(DISTINCT doc_id) AS k FROM ctx JOIN documents d ON d.source = ctx.book AND ctx.page_start <= d.doc_id + 1 AND d.doc_id <= ctx.page_end GROUP BY qid)
SELECT qid, coalesce(k, 0) AS n_relevant, least(coalesce(k, 0), 5) / 5.0::DOUBLE AS ceiling FROM (SELECT DISTINCT qid FROM ctx) LEFT JOIN n USING (qid)""")
def met05_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MET-05, JN-02."""
    corpus = table(spark, sf_dir, "documents", "doc_id", "source").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("book"), F.col("doc_id").alias("page_start"), (F.col("doc_id") + 1).alias("page_end"))
    return evaluation.precision_ceiling(corpus, _contexts(spark, sf_dir), 5)


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, count(value) AS n FROM events GROUP BY event_type")
def met07_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.latency(table(spark, sf_dir, "events", "event_type", "value"), "event_type", "value")
    return found.withColumn("p50", F.round("p50", 6)).withColumn("p95", F.round("p95", 6))


@query(r"""WITH a AS (SELECT lang, doc_id % 5 = 0 AS refused, doc_id % 4 = 0 AS should, doc_id % 3 <> 0 AS grounded, doc_id % 7 = 0 AS leaked, len(regexp_extract_all(text, '\S+')) AS w FROM documents)
SELECT lang, count(*) AS n, round(avg(CASE WHEN (refused AND should) OR (NOT should AND NOT refused AND grounded AND NOT leaked AND w <= 250) THEN 1 ELSE 0 END), 6) AS usable,
  count(*) FILTER (WHERE refused AND should) AS correct_refusals, count(*) FILTER (WHERE refused AND NOT should) AS wrong_refusals, count(*) FILTER (WHERE NOT refused AND should) AS missed_refusals, round(avg(w), 6) AS words FROM a GROUP BY lang""")
def met08_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MET-08, MET-09: usable answers and the refusal confusion, by type."""
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents", "doc_id", "lang", "text").select("lang", (d % 5 == 0).alias("refused"), (d % 4 == 0).alias("should"), (d % 3 != 0).alias("grounded"), (d % 7 == 0).alias("leaked"), F.regexp_count("text", F.lit(r"\S+")).alias("w"))
    r, s = F.col("refused"), F.col("should")
    good = evaluation.usable(r, s, F.col("grounded"), F.col("leaked"), F.col("w"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(good.cast("int")), 6).alias("usable"), F.count_if(r & s).alias("correct_refusals"), F.count_if(r & ~s).alias("wrong_refusals"), F.count_if(~r & s).alias("missed_refusals"), F.round(F.avg("w"), 6).alias("words"))


@query("""WITH t AS (SELECT conv_id, turn, length(text) % 10 / 10.0::DOUBLE AS recall FROM conversations), p AS (SELECT a.conv_id, a.turn, a.recall AS recall_on, b.recall AS recall_off FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE b.recall >= 0.5)
SELECT count(*) AS n, round(avg(recall_off), 6) AS recall_off, round(avg(recall_on), 6) AS recall_on FROM p""")
def met10_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MET-10: follow-ups beside the turns they refer to."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") % 10 / 10).alias("recall"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("recall").alias("recall_off")).where("recall_off >= 0.5")
    both = turns.withColumnRenamed("recall", "recall_on").join(before, ["conv_id", "turn"])
    return both.agg(F.count("*").alias("n"), F.round(F.avg("recall_off"), 6).alias("recall_off"), F.round(F.avg("recall_on"), 6).alias("recall_on"))


@query("""WITH e(lang) AS (VALUES ('en'), ('fr'), ('de'), ('it')), c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT e.lang, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN n < 150 THEN 'thin' ELSE 'ok' END AS state FROM e LEFT JOIN c USING (lang)""")
def met11_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.coverage(table(spark, sf_dir, "documents", "lang"), "lang", ["en", "fr", "de", "it"], 150)


_PAIRED = """x AS (SELECT a.source AS comparison, a.doc_id, (a.doc_id * 7 % 13) / 13.0::DOUBLE AS a, (a.doc_id * 5 % 11) / 11.0::DOUBLE AS b FROM documents a)"""


@query(f"""WITH {_PAIRED}, w AS (SELECT comparison, count(*) FILTER (WHERE a > b) AS wins, count(*) FILTER (WHERE a < b) AS losses, count(*) FILTER (WHERE a = b) AS ties, round(avg(a - b), 9) AS diff FROM x GROUP BY ALL),
k AS (SELECT *, unnest(range(0, least(wins, losses) + 1)) AS i FROM w),
t AS (SELECT comparison, wins, losses, ties, diff, sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))) AS tail FROM k GROUP BY comparison, wins, losses, ties, diff)
SELECT comparison, wins, losses, ties, diff, CASE WHEN wins + losses = 0 THEN 1 ELSE round(least(1, 2 * tail), 6) END AS p FROM t""")
def sta02_sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-02, JN-06: wins and losses of two runs on shared questions, and the exact test."""
    pairs = _pairs(spark, sf_dir)
    counted = pairs.groupBy("comparison").agg(F.count_if(F.col("a") > F.col("b")).alias("wins"), F.count_if(F.col("a") < F.col("b")).alias("losses"), F.count_if(F.col("a") == F.col("b")).alias("ties"), F.round(F.avg(F.col("a") - F.col("b")), 9).alias("diff"))
    return counted.withColumn("p", F.round(evaluation.sign_test(F.col("wins"), F.col("losses")), 6))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source")
    run = lambda k, m: docs.select(F.col("source").alias("comparison"), F.col("doc_id").alias("qid"), (F.col("doc_id") * k % m / m).alias("v"))
    return run(7, 13).withColumnRenamed("v", "a").join(run(5, 11).withColumnRenamed("v", "b"), ["comparison", "qid"])


@query()
def sta01_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-01, STA-03, STA-04, JN-12: paired bootstrap and sign test of each comparison, corrected for their number."""
    return evaluation.significance(_pairs(spark, sf_dir))


_JUDGED = "p AS (SELECT l.quality AS human, CASE WHEN length(regexp_replace(text, '[^a-zA-Z ]', '', 'g')) / greatest(length(text), 1)::DOUBLE > 0.9 THEN 1 ELSE 0 END AS judge, lang FROM labels l JOIN documents USING (doc_id))"


@query(f"""WITH {_JUDGED}, c AS (SELECT count(*) AS n, avg(CASE WHEN human = judge THEN 1 ELSE 0 END) AS po, avg(human) * avg(judge) + (1 - avg(human)) * (1 - avg(judge)) AS pe FROM p)
SELECT n, round(po, 6) AS agreement, CASE WHEN pe = 1 THEN 1 ELSE round((po - pe) / (1 - pe), 3) END AS kappa FROM c""")
def sta05_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.kappa(_judged(spark, sf_dir), "human", "judge")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.length(F.regexp_replace("text", "[^a-zA-Z ]", "")) / F.greatest(F.length("text"), F.lit(1))
    both = table(spark, sf_dir, "labels", "doc_id", "quality").join(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), "doc_id")
    return both.select(F.col("quality").alias("human"), (share > 0.9).cast("int").alias("judge"), "lang")


@query(f"WITH {_JUDGED} SELECT lang, round(avg(CASE WHEN human = judge THEN 1 ELSE 0 END), 6) AS agreement, round(avg(CASE WHEN human = 0 THEN judge END), 6) AS over_credit, count(*) AS n FROM p GROUP BY lang")
def sta06_over_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-06, JN-07."""
    rows = _judged(spark, sf_dir)
    return rows.groupBy("lang").agg(F.round(F.avg((F.col("human") == F.col("judge")).cast("int")), 6).alias("agreement"), F.round(F.avg(F.when(F.col("human") == 0, F.col("judge"))), 6).alias("over_credit"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT event_type AS config, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS p FROM events), b AS (SELECT config, max(CASE WHEN p = 1 THEN value END) AS latest, max(CASE WHEN p = 2 THEN value END) AS previous FROM r WHERE p <= 2 GROUP BY config)
SELECT config, latest, previous, latest - previous AS delta, coalesce(latest - previous < -0.02, FALSE) AS regressed FROM b""")
def sta07_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events", "event_id", "event_type", "ts", "value").toDF("id", "config", "ts", "value")
    return evaluation.regressions(runs)


@query("""WITH d AS (SELECT doc_id, 'f' || doc_id AS filename, substr(sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END || doc_id), 1, 16) AS hash FROM documents WHERE doc_id % 10 <> 3),
m AS (SELECT doc_id, 'f' || doc_id AS filename, substr(sha256(text || doc_id), 1, 16) AS hash, CASE WHEN doc_id % 4 = 0 THEN 'v1' ELSE 'v2' END AS version FROM documents WHERE doc_id % 5 <> 1)
SELECT d.filename, CASE WHEN m.version = 'v2' THEN 'unchanged' WHEN m.version IS NOT NULL THEN 'stale' WHEN n.filename IS NOT NULL THEN 'changed' ELSE 'new' END AS status FROM d LEFT JOIN m USING (hash) LEFT JOIN m n ON n.filename = d.filename
UNION ALL SELECT filename, 'removed' FROM m WHERE hash NOT IN (SELECT hash FROM d) AND filename NOT IN (SELECT filename FROM d)""")
def jn08_ingest_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-08, DM-11, STA-10: what an incremental ingest has to do."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    name = F.concat(F.lit("f"), d).alias("filename")
    digest = lambda t: F.substring(F.sha2(F.concat(t, d), 256), 1, 16).alias("hash")
    disk = docs.where(d % 10 != 3).select(name, digest(F.when(d % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
    known = docs.where(d % 5 != 1).select(name, digest(F.col("text")), F.when(d % 4 == 0, "v1").otherwise("v2").alias("version"))
    return evaluation.plan_ingest(disk, known, "v2")


_SWEEP = f"""{_BM25}, {_DENSE}, {_RRF}, {_WEIGHTED},
ranked AS (SELECT mode, qid, rank, source AS book, doc_id AS page_start, doc_id + 1 AS page_end FROM (SELECT 'bm25' AS mode, qid, doc_id, rank FROM bm UNION ALL SELECT 'dense', qid, doc_id, rank FROM de
  UNION ALL SELECT 'hybrid_rrf', qid, doc_id, rank FROM hy UNION ALL SELECT 'hybrid_weighted', qid, doc_id, rank FROM hw) JOIN documents USING (doc_id) WHERE rank <= 20),
ctx AS (SELECT DISTINCT b.item_id AS qid, source AS book, doc_id - 1 AS page_start, doc_id + 1 AS page_end FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
mc AS (SELECT mode, ctx.* FROM ctx, (SELECT DISTINCT mode FROM ranked)),
fl AS (SELECT r.*, EXISTS (SELECT 1 FROM ctx c WHERE c.qid = r.qid AND c.book = r.book AND c.page_start <= r.page_end AND r.page_start <= c.page_end) AS rel FROM ranked r),
fi AS (SELECT c.mode, c.qid, c.book, c.page_start, min(rank) AS pos FROM mc c LEFT JOIN ranked r ON c.mode = r.mode AND c.qid = r.qid AND c.book = r.book AND c.page_start <= r.page_end AND r.page_start <= c.page_end GROUP BY ALL),
re AS (SELECT mode, qid, avg((coalesce(pos, 99999) <= 10)::INTEGER) AS recall_10 FROM fi GROUP BY ALL),
pr AS (SELECT mode, qid, coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE rel), 0) AS mrr FROM fl GROUP BY ALL),
nd AS (SELECT mode, qid, sum(1 / log2(rank + 1)) / sum(1 / log2(ideal + 1)) AS ndcg_10 FROM (SELECT *, row_number() OVER (PARTITION BY mode, qid ORDER BY rank) AS ideal FROM fl WHERE rank <= 10 AND rel) GROUP BY ALL)"""


@query(f"WITH {_SWEEP} SELECT mode, count(*) AS n_questions, round(avg(recall_10), 6) AS recall_10, round(avg(coalesce(mrr, 0)), 6) AS mrr, round(avg(coalesce(ndcg_10, 0)), 6) AS ndcg_10 FROM re LEFT JOIN pr USING (mode, qid) LEFT JOIN nd USING (mode, qid) GROUP BY mode")
def met12_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MET-12, RET-16: one row of macro means for each retrieval mode."""
    from scriptorium.operators import embedding
    from scriptorium.operators.runs import combine

    contexts, places = _contexts(spark, sf_dir), table(spark, sf_dir, "documents", "doc_id", "source")
    rows = []
    for mode in ("bm25", "dense", "hybrid_rrf", "hybrid_weighted"):
        found = retrieval.hybrid(docs_of(spark, sf_dir), questions_of(spark, sf_dir), embedding.document_vectors, 20, mode).join(places, "doc_id")
        ranked = found.select("qid", "rank", F.col("source").alias("book"), F.col("doc_id").alias("page_start"), (F.col("doc_id") + 1).alias("page_end"))
        scored = evaluation.retrieval_metrics(ranked, contexts)
        rows.append(scored.agg(F.count("*").alias("n_questions"), *[F.round(F.avg(n), 6).alias(n) for n in ("recall_10", "mrr", "ndcg_10")]).withColumn("mode", F.lit(mode)))
    return combine(rows)
