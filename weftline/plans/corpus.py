"""Corpus filters, reports and decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import dedup, textquality
from weftline.plans.base import query, table

_LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 20)"
_FLAGS = rf"""
lines AS (SELECT doc_id, max(c) >= 5 AS repeated_lines FROM (
    SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, unnest({_LINES}) AS line FROM documents) GROUP BY ALL) GROUP BY doc_id),
windows AS (SELECT doc_id, max(c) >= 3 AS repeated_windows FROM (
    SELECT doc_id, w, count(*) AS c FROM (
        SELECT doc_id, substr(text, unnest(range(1, length(text) - 98, 10))::BIGINT, 100) AS w FROM documents WHERE length(text) >= 300) GROUP BY ALL) GROUP BY doc_id),
flags AS (SELECT d.doc_id, d.source, d.n_chars, d.text, coalesce(repeated_lines, false) AS repeated_lines, coalesce(repeated_windows, false) AS repeated_windows
    FROM documents d LEFT JOIN lines USING (doc_id) LEFT JOIN windows USING (doc_id))"""


@query(f"WITH {_FLAGS} SELECT doc_id, repeated_lines FROM flags")
def repeated_lines_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", textquality.repeated_lines(F.col("text")).alias("repeated_lines"))


@query(f"WITH {_FLAGS} SELECT doc_id, repeated_windows FROM flags")
def ngram_window_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", textquality.repeated_windows(F.col("text")).alias("repeated_windows"))


#: A block of 50 characters stands three times in a row where 100 characters in a row equal those 50 places on.
_BLOCKS = """
chars AS (SELECT doc_id, unnest(x) AS ch, unnest(range(len(x))) AS i FROM (SELECT doc_id, string_split(text, '') AS x FROM documents)),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, ch = lead(ch, 50) OVER (PARTITION BY doc_id ORDER BY i) AS same FROM chars) WHERE same),
runs AS (SELECT doc_id, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hits),
blocks AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, r FROM runs GROUP BY ALL HAVING count(*) >= 100))"""


@query(f"WITH {_BLOCKS} SELECT doc_id, CASE WHEN text IS NOT NULL THEN doc_id IN (SELECT doc_id FROM blocks) END AS consecutive_blocks FROM documents")
def consecutive_block_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", textquality.consecutive_blocks(F.col("text")).alias("consecutive_blocks"))


def _reason(text: F.Column) -> F.Column:
    """The cascade without consecutive blocks, which SQL without back-references cannot state."""
    return F.when(textquality.repeated_lines(text), "repeated_lines").when(textquality.repeated_windows(text), "ngram_repetition").otherwise("ok")


_REASON = "CASE WHEN repeated_lines THEN 'repeated_lines' WHEN repeated_windows THEN 'ngram_repetition' ELSE 'ok' END"


@query(f"WITH {_FLAGS} SELECT {_REASON} AS reason, count(*) AS n FROM flags GROUP BY 1")
def reject_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(_reason(F.col("text")).alias("reason")).agg(F.count("*").alias("n"))


_CASCADE = "WHEN repeated_lines THEN 'repeated_lines' WHEN repeated_windows THEN 'ngram_repetition' WHEN length(text) > 5000 AND doc_id IN (SELECT doc_id FROM blocks) THEN 'consecutive_repeat' ELSE 'ok' END"


@query(rf"WITH {_FLAGS}, {_BLOCKS} SELECT doc_id, CASE WHEN text IS NULL THEN 'empty' {_CASCADE} AS reason, CASE WHEN text IS NULL THEN 'empty' WHEN NOT contains(text, 'oxed') THEN 'no_marker' {_CASCADE} AS reason_with_marker FROM flags")
def reject_reason_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", textquality.reject_reason(F.col("text")).alias("reason"), textquality.reject_reason(F.col("text"), marker="\\boxed").alias("reason_with_marker"))


@query(
    f"""WITH {_FLAGS}
SELECT coalesce(source, 'ALL') AS source_name, count(*) AS n_rows, count(*) FILTER ({_REASON} = 'ok') AS n_kept,
       round(avg(CASE WHEN {_REASON} = 'ok' THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS kept_rate, round(avg(n_chars), 6) AS mean_chars,
       round(avg(quality::DOUBLE), 6) AS good_rate
FROM flags LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (source)"""
)
def corpus_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textquality.corpus_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), _reason(F.col("text")))


@query("SELECT doc_id, source FROM documents d WHERE source = 'src0' AND NOT EXISTS (SELECT 1 FROM documents o WHERE o.source <> 'src0' AND trim(o.text) = trim(d.text))")
def exact_dedup_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", dedup.question_key(F.col("text")).alias("key"))
    return dedup.exact_anti(docs.where("source = 'src0'"), docs.where("source <> 'src0'"), "key").select("doc_id", "source")


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_seen(table(spark, sf_dir, "documents"), F.col("text"), "doc_id").select("doc_id", "lang")


_UNIT = "SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings"
_TOP1 = f"""unit AS ({_UNIT}), pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS match_id, list_dot_product(q.v, c.v) AS cosine FROM unit q, unit c WHERE q.vec_id % 10 = 0 AND c.vec_id % 10 <> 0),
top AS (SELECT query_id, match_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 12) DESC, match_id) AS n FROM pairs) WHERE n = 1)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return e.where("id % 10 = 0"), e.where("id % 10 <> 0")


@query(f"WITH {_TOP1} SELECT query_id, match_id, round(cosine, 6) AS cosine FROM top")
def vector_top1_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.nearest_vectors(*_sides(spark, sf_dir)).withColumn("cosine", F.round("cosine", 6))


@query(
    f"""WITH {_TOP1}, x AS (SELECT vec_id, trim(text) AS k FROM embeddings JOIN documents ON doc_id = vec_id),
f AS (SELECT query_id, EXISTS (SELECT 1 FROM x q JOIN x c ON q.k = c.k WHERE q.vec_id = query_id AND c.vec_id % 10 <> 0) AS e, cosine >= 0.35 AS s FROM top)
SELECT count(*) AS n_rows, count(*) FILTER (e) AS n_exact, count(*) FILTER (s) AS n_near, count(*) FILTER (e AND s) AS n_both, count(*) FILTER (e OR s) AS n_removed, count(*) FILTER (NOT (e OR s)) AS n_kept FROM f"""
)
def combined_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's text is that of the document of its id: exact hits share it with a row of the corpus."""
    q, c = _sides(spark, sf_dir)
    keys = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), dedup.question_key(F.col("text")).alias("key"))
    of = lambda side: side.select("id").join(keys, "id")
    exact = of(q).join(of(c).select("key").distinct(), "key", "left_semi")
    return dedup.decontaminated(q, exact, dedup.nearest_vectors(q, c), threshold=0.35)


@query("SELECT d.doc_id, count(*) AS n_items, min(b.item_id) AS first_item FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY d.doc_id")
def decontaminate_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, wherever it begins."""
    held = dedup.containing(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return held.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.min("item_id").alias("first_item"))
