"""Queries over retrieval, fusion, context packing and conversations. Benchmark passages are the questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import parsing
from scriptorium.operators import ann, embedding, retrieval
from scriptorium.plans.registry import query
from scriptorium.plans.chunk_queries import _EMBED
from scriptorium.sources.tables import table


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def questions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark", "item_id", "text").withColumnRenamed("item_id", "qid")


def vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")


_TOK = "regexp_extract_all(lower(text), '[a-z0-9]+(?:-[a-z0-9]+)*')"
_BM25 = f"""dt AS (SELECT doc_id, unnest({_TOK}) AS term FROM documents), dl AS (SELECT doc_id, len({_TOK}) AS dl FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL), st AS (SELECT count(*) AS n, avg(dl) AS mean FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), ra AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, st),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM ra) ELSE raw END AS idf FROM ra),
qt AS (SELECT item_id AS qid, unnest({_TOK}) AS term FROM benchmark),
bs AS (SELECT qid, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS score FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
ba AS (SELECT b.item_id AS qid, d.doc_id, round(coalesce(score, 0), 6) AS score FROM benchmark b CROSS JOIN dl d LEFT JOIN bs ON bs.qid = b.item_id AND bs.doc_id = d.doc_id),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM ba) WHERE rank <= 60)"""
_DENSE = f"""{_EMBED.format(key="doc_id", text="text", rel="documents")},
{_EMBED.format(key="item_id", text="text", rel="benchmark").replace("t AS", "qt2 AS", 1).replace("FROM t GROUP", "FROM qt2 GROUP").replace("u AS", "qu AS").replace("nn AS", "qn AS").replace("FROM u GROUP", "FROM qu GROUP")},
ds AS (SELECT qu.item_id AS qid, u.doc_id, sum(qu.v / qn.nrm * u.v / nn.nrm) AS score FROM qu JOIN qn USING (item_id) JOIN u USING (k) JOIN nn USING (doc_id) GROUP BY ALL),
da AS (SELECT b.item_id AS qid, d.doc_id, round(coalesce(score, 0), 6) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN ds ON ds.qid = b.item_id AND ds.doc_id = d.doc_id),
de AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM da) WHERE rank <= 60)"""
_RRF = """rf AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT qid, doc_id, rank FROM bm UNION ALL SELECT qid, doc_id, rank FROM de) GROUP BY ALL),
hy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM rf) WHERE rank <= 20)"""

_WEIGHTED = """we AS (SELECT qid, doc_id, 0.5::DOUBLE * CASE WHEN hi - lo < 1e-12 THEN 1 ELSE (score - lo) / (hi - lo) END AS score FROM (SELECT *, min(score) OVER (PARTITION BY qid) AS lo, max(score) OVER (PARTITION BY qid) AS hi FROM bm)
UNION ALL SELECT qid, doc_id, 0.5::DOUBLE * CASE WHEN hi - lo < 1e-12 THEN 1 ELSE (score - lo) / (hi - lo) END FROM (SELECT *, min(score) OVER (PARTITION BY qid) AS lo, max(score) OVER (PARTITION BY qid) AS hi FROM de)),
wf AS (SELECT qid, doc_id, round(sum(score), 9) AS score FROM we GROUP BY ALL),
hw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM wf) WHERE rank <= 20)"""


@query(f"WITH {_BM25} SELECT qid, doc_id, score, rank FROM bm WHERE rank <= 10")
def ret02_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-01, RET-02."""
    return retrieval.bm25_search(docs_of(spark, sf_dir), questions_of(spark, sf_dir), 10)


@query("""WITH s AS (SELECT q.vec_id AS qid, d.vec_id AS doc_id, round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def ret03_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-03, RET-08, JN-11: every id divisible by 50 against all vectors."""
    vectors = vectors_of(spark, sf_dir)
    return retrieval.dense_search(vectors, vectors.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), "vector"), 10)


@query("SELECT vec_id AS doc_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 6) AS l1 FROM embeddings")
def ret04_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = embedding.l2_normalize(F.transform("vector", lambda x: x.cast("double") * 3))
    return vectors_of(spark, sf_dir).select("doc_id", F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + F.abs(x)), 6).alias("l1"))


def _ann(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        vectors = vectors_of(spark, sf_dir)
        asked = vectors.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), "vector")
        return ann.recall(ann.build_index(kind, vectors)(asked, 10), ann.build_index("flat", vectors)(asked, 10), 10)

    return run


@query()
def ret06_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-05, RET-06, RET-09, RET-10: recall of inverted lists against exact search."""
    return _ann("ivf")(spark, sf_dir)


@query()
def ret07_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ann("ivfpq")(spark, sf_dir)


@query(f"WITH {_BM25}, {_DENSE}, {_RRF} SELECT qid, doc_id, score, rank FROM hy")
def ret13_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-11, RET-13: 60 of each arm, fused to 20."""
    return retrieval.hybrid(docs_of(spark, sf_dir), questions_of(spark, sf_dir), embedding.document_vectors, 20)


@query(f"WITH {_BM25}, {_DENSE}, {_WEIGHTED} SELECT qid, doc_id, score, rank FROM hw")
def ret12_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hybrid(docs_of(spark, sf_dir), questions_of(spark, sf_dir), embedding.document_vectors, 20, "hybrid_weighted")


@query("""WITH s AS (SELECT q.vec_id AS qid, d.vec_id AS doc_id, round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 20),
z AS (SELECT qid, r.doc_id, rank, length(text) % 97 AS score FROM r JOIN documents d ON d.doc_id = r.doc_id)
SELECT qid, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS place FROM z) WHERE place <= 6""")
def ret14_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair scorer over the first stage's 20; a length rule stands for a cross-encoder."""
    vectors = vectors_of(spark, sf_dir)
    first = retrieval.dense_search(vectors, vectors.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), "vector"), 20)
    pairs = first.drop("score").join(docs_of(spark, sf_dir), "doc_id").withColumn("question", F.lit("q"))
    return retrieval.rerank(pairs, _length_score, 6).select("qid", "doc_id", "place")


def _length_score(question, text):
    return (text.str.len() % 97).astype("float64")


@query(f"WITH {_BM25}, q2 AS (SELECT qid // 4 AS qid, doc_id, rank FROM bm WHERE rank <= 30), f AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM q2 GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 20")
def ret15_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sub-queries a question, fused by document."""
    found = retrieval.bm25_search(docs_of(spark, sf_dir), questions_of(spark, sf_dir), 30)
    return retrieval.reciprocal_rank_fusion([found.withColumn("qid", F.floor(F.col("qid") / 4))], 60, 20)


@query(r"""WITH RECURSIVE r AS (SELECT source AS qid, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, len(regexp_extract_all(text, '\S+')) AS n, count(*) OVER (PARTITION BY source) AS total FROM documents),
f AS (SELECT qid, rank, total, CASE WHEN n <= 1500 THEN n ELSE 0 END AS used, CASE WHEN n <= 1500 THEN [doc_id] ELSE [] END AS kept FROM r WHERE rank = 1
UNION ALL SELECT f.qid, r.rank, f.total, CASE WHEN used + n <= 1500 THEN used + n ELSE used END, CASE WHEN used + n <= 1500 THEN list_append(kept, r.doc_id) ELSE kept END FROM f JOIN r ON r.qid = f.qid AND r.rank = f.rank + 1 WHERE r.rank <= 8)
SELECT qid, CAST(used AS BIGINT) AS n_tokens, array_to_string(list_transform(range(1, len(kept) + 1), lambda i: 'S' || i || '=' || kept[i]), ',') AS sources, total - len(kept) AS dropped FROM f WHERE rank = (SELECT max(g.rank) FROM f g WHERE g.qid = f.qid)""")
def ret18_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy packing of the first 8 of each list within 1,500 words."""
    docs = table(spark, sf_dir, "documents", "source", "doc_id", "text").select(F.col("source").alias("qid"), "doc_id", F.col("doc_id").alias("rank"), F.regexp_count("text", F.lit(r"\S+")).alias("n_tokens"))
    packed = retrieval.pack(docs, 8, 1500)
    shown = F.array_join(F.transform("sources", lambda s: F.concat_ws("=", s["sid"], s["doc_id"])), ",")
    return packed.select("qid", "n_tokens", shown.alias("sources"), "dropped")


@query("""WITH r AS (SELECT source AS qid, 'p' || (doc_id % 11) AS parent_id, doc_id AS rank FROM documents), b AS (SELECT qid, parent_id, min(rank) AS best FROM r WHERE parent_id <> 'p3' GROUP BY ALL)
SELECT qid, parent_id, row_number() OVER (PARTITION BY qid ORDER BY best, parent_id) AS rank FROM b""")
def jn05_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = table(spark, sf_dir, "documents", "source", "doc_id").select(F.col("source").alias("qid"), F.concat(F.lit("p"), F.col("doc_id") % 11).alias("parent_id"), F.col("doc_id").alias("rank"))
    parents = spark.range(11).where("id <> 3").select(F.concat(F.lit("p"), F.col("id")).alias("parent_id"))
    return retrieval.to_parents(ranked, F.broadcast(parents))


@query("""WITH m AS (SELECT q.vec_id AS qid, round(max(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[])), 6) AS scope FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id GROUP BY ALL)
SELECT qid, scope, CASE WHEN scope < 0.294 THEN 'out_of_scope' END AS blocked FROM m""")
def grd02_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRD-02: the largest similarity of a question to the corpus, itself left out."""
    vectors = vectors_of(spark, sf_dir)
    both = retrieval.dense_search(vectors, vectors.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), "vector"), 2)
    best = both.where("doc_id <> qid").groupBy("qid").agg(F.max("score").alias("score"))
    return best.select("qid", F.col("score").alias("scope"), parsing.gate(F.lit(None).cast("string"), F.col("score"), F.lit(True)).alias("blocked"))


@query("""WITH h AS (SELECT conv_id, turn, string_agg(role || ': ' || substr(text, 1, 600), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS history, text FROM conversations)
SELECT conv_id, turn, history IS NOT NULL AS condensed, sha256(coalesce(history, '') || '|' || text) AS prompt_hash FROM h""")
def gen03_condense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last six messages, 600 characters each, before every turn; a window a session."""
    from scriptorium.operators.flow import history

    turns = history(table(spark, sf_dir, "conversations"))
    return turns.select("conv_id", "turn", F.col("history").isNotNull().alias("condensed"), F.sha2(F.concat(F.coalesce("history", F.lit("")), F.lit("|"), F.col("text")), 256).alias("prompt_hash"))


@query("""WITH b AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM documents WHERE length(text) BETWEEN 400 AND 2400) SELECT doc_id, lang FROM b WHERE r <= 25""")
def gen13_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEN-12, GEN-13: the first 25 usable documents a language in hash order (a sampling operator)."""
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text").where(F.length("text").between(400, 2400)).select("doc_id", "lang")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id"))
    return docs.withColumn("r", place).where("r <= 25").drop("r")


@query("""WITH k AS (SELECT doc_id, quality FROM labels WHERE quality = 1 UNION ALL SELECT doc_id + 1000000, 1 FROM labels WHERE toxic = 1), r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM k)
SELECT doc_id, 'g-' || lpad(r::VARCHAR, 3, '0') AS qid FROM r WHERE r <= 50""")
def gen14_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept candidates and manual items, the first 50 renumbered (a report with a limit)."""
    labels = table(spark, sf_dir, "labels")
    both = labels.where("quality = 1").select("doc_id").union(labels.where("toxic = 1").select(F.col("doc_id") + 1000000))
    first = both.orderBy("doc_id").limit(50)
    return first.select("doc_id", F.format_string("g-%03d", F.row_number().over(Window.orderBy("doc_id"))).alias("qid"))
