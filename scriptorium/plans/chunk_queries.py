"""Queries over sentences, chunks and chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import parsing
from scriptorium.operators import chunking, embedding
from scriptorium.plans.registry import query
from scriptorium.sources.tables import ordinals, table

_SENTENCES = r"list_filter(string_split(regexp_replace(text, '([.!?])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x) <> '')"
#: The pattern consumes the next sentence's first letter, so a one-letter sentence needs a second pass.
_TWICE = _SENTENCES.replace("regexp_replace(text,", r"regexp_replace(regexp_replace(text, '([.!?])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'),")


@query(f"SELECT doc_id, len(s) AS n_sentences, sha256(array_to_string(s, chr(2))) AS digest FROM (SELECT doc_id, {_TWICE} AS s FROM documents)")
def chk02_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = chunking.sentences(F.col("text"))
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.size(s).alias("n_sentences"), F.sha2(F.array_join(s, "\x02"), 256).alias("digest"))


@query()
def chk05_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-03..05 with the word counter: chunks of 64 words, 8 of overlap."""
    return chunking.recursive_chunks(table(spark, sf_dir, "documents", "doc_id", "text"), 64, 8).select("doc_id", "seq", "start", "end", F.sha2("text", 256).alias("digest"))


@query()
def chk06_parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.parent_child_chunks(table(spark, sf_dir, "documents", "doc_id", "text"), 256, 32).drop("text")


_EMBED = """t AS (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+(?:-[a-z0-9]+)*')) AS tok FROM {rel}),
u AS (SELECT {key}, CAST(CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) % 64 AS INTEGER) AS k, sum(CASE WHEN CAST('0x' || substr(md5(tok), 9, 1) AS BIGINT) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v FROM t GROUP BY ALL),
nn AS (SELECT {key}, sqrt(sum(v * v)) AS nrm FROM u GROUP BY ALL)"""


@query(f"""WITH s AS (SELECT doc_id, unnest({_TWICE}) AS sentence, generate_subscripts({_TWICE}, 1) - 1 AS i FROM documents),
g AS (SELECT doc_id, i, sentence, string_agg(sentence, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS g FROM s),
{_EMBED.format(key="doc_id, i", text="g", rel="g")},
x AS (SELECT u.doc_id, u.i, u.k, CASE WHEN nrm = 0 THEN 0 ELSE v / nrm END AS v FROM u JOIN nn USING (doc_id, i)),
p AS (SELECT g.doc_id, g.i, round(1 - coalesce(sum(a.v * b.v), 0), 9) AS gap FROM g LEFT JOIN x a ON a.doc_id = g.doc_id AND a.i = g.i LEFT JOIN x b ON b.doc_id = g.doc_id AND b.i = g.i + 1 AND a.k = b.k WHERE EXISTS (SELECT 1 FROM g h WHERE h.doc_id = g.doc_id AND h.i = g.i + 1) GROUP BY ALL),
l AS (SELECT doc_id, quantile_cont(gap, 0.8) AS lim FROM p GROUP BY doc_id),
c AS (SELECT g.doc_id, g.i, g.sentence, sum(CASE WHEN p.gap > lim + 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY g.doc_id ORDER BY g.i) AS seq FROM g LEFT JOIN p ON p.doc_id = g.doc_id AND p.i = g.i - 1 LEFT JOIN l ON l.doc_id = g.doc_id)
SELECT doc_id, CAST(seq AS BIGINT) AS seq, sha256(string_agg(sentence, ' ' ORDER BY i)) AS digest FROM c GROUP BY doc_id, seq""")
def chk07_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-07..09: cuts at the 80th percentile of neighbour distances of hash embeddings."""
    return chunking.semantic_texts(table(spark, sf_dir, "documents", "doc_id", "text"), 80.0).select("doc_id", "seq", F.sha2("text", 256).alias("digest"))


@query("SELECT CAST(count(*) AS BIGINT) AS n_groups, count(DISTINCT line) AS n_unique, count(DISTINCT CASE WHEN length(line) % 7 = 0 THEN line END) AS n_missing FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)")
def chk12_offload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-12, SRC-12, JN-10: distinct groups by content hash, and which of them a store lacks."""
    lines = table(spark, sf_dir, "documents", "text").select(F.explode(F.split("text", "\n")).alias("line"))
    hashed = lines.select("line", F.sha2("line", 256).alias("hash"))
    unique = hashed.dropDuplicates(["hash"])
    store = unique.where(F.length("line") % 7 != 0).select("hash")
    missing = embedding.missing_vectors(unique, store)
    counts = lambda df, name: df.agg(F.count("*").alias(name))
    return counts(hashed, "n_groups").join(F.broadcast(counts(unique, "n_unique"))).join(F.broadcast(counts(missing, "n_missing")))


@query(r"SELECT source AS book, count(*) FILTER (WHERE n > 400) AS oversize, round(avg(n), 6) AS mean_words, max(n) AS most FROM (SELECT source, len(regexp_extract_all(text, '\S+')) AS n FROM documents) GROUP BY source")
def chk13_oversize(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents", "source", "text").select(F.col("source").alias("book"), F.regexp_count("text", F.lit(r"\S+")).alias("n"))
    return words.groupBy("book").agg(F.count_if(F.col("n") > 400).alias("oversize"), F.round(F.avg("n"), 6).alias("mean_words"), F.max("n").cast("long").alias("most"))


@query("SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS ordinal FROM documents WHERE lang = 'en'")
def src07_chunk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-07, SRC-08: one strategy's chunks (here, a language) in a stable order."""
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "source").where("lang = 'en'")
    return ordinals(docs, "source", "doc_id").select("doc_id", "ordinal")


@query("SELECT role AS model, count(*) AS n FROM conversations WHERE length(trim(text)) > 0 GROUP BY role")
def src14_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by model; the latest reply of a key counts, empty ones are never stored."""
    turns = table(spark, sf_dir, "conversations").where(F.length(F.trim("text")) > 0)
    return turns.groupBy(F.col("role").alias("model")).agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type, value FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 20")
def src16_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 20 runs of one configuration (a report with a limit)."""
    runs = table(spark, sf_dir, "events", "event_id", "event_type", "ts", "value").where("event_type = 'purchase'")
    return runs.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(20).select("event_id", "event_type", "value")


@query("SELECT min(doc_id) AS i, substr(sha256(text), 1, 16) AS k FROM documents GROUP BY text")
def src21_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", parsing.short_hash(F.col("text")).alias("k"))
    return docs.groupBy("k").agg(F.min("doc_id").alias("i"))


@query("""WITH v AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) AS n, len(embedding) AS d FROM embeddings)
SELECT count(*) AS n_vectors, count(*) FILTER (WHERE abs(n - 1) > 1e-3) AS not_unit, count(*) FILTER (WHERE isnan(n)) AS not_finite, count(DISTINCT d) AS n_dims, CAST((SELECT count(*) FROM documents) - (SELECT count(*) FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)) AS BIGINT) AS uncovered FROM v""")
def src22_verify_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-22, JN-13: what a verified import counts before it writes anything."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    norm = F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x * x))
    counted = vectors.select(norm.alias("n"), F.size("embedding").alias("d")).agg(F.count("*").alias("n_vectors"), F.count_if(F.abs(F.col("n") - 1) > 1e-3).alias("not_unit"), F.count_if(F.isnan("n")).alias("not_finite"), F.countDistinct("d").alias("n_dims"))
    missing = table(spark, sf_dir, "documents", "doc_id").join(vectors, F.col("doc_id") == F.col("vec_id"), "left_anti").agg(F.count("*").alias("uncovered"))
    return counted.join(F.broadcast(missing))
