"""Exact and vector decontamination of one corpus against another."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.binding import let


def question_key(text: Column, suffix: str = "") -> Column:
    """The text without a fixed instruction at its end, trimmed: the key on which corpora are compared."""
    cut = F.when(F.endswith(text, F.lit(suffix)), F.substr(text, F.lit(1), F.length(text) - len(suffix))).otherwise(text) if suffix else text
    return F.trim(cut)


def exact_anti(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key is in no row of ``right``. Keys are compared as they are; nulls are kept."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def first_seen(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key in the order of a column."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def nearest_vectors(queries: DataFrame, corpus: DataFrame, block: int = 8192, rows: int = 512) -> DataFrame:
    """(query_id, match_id, cosine): for each (id, vec) of ``queries`` the nearest of ``corpus``, smallest id of equals.

    Every pair is compared, as the definition asks for, but in blocks: both sides are dealt into blocks of about
    ``block`` rows by a hash of the id, a pair of blocks is a matrix product of ``rows`` queries at a time, and the best
    per query are merged. Vectors travel once for each block of the other side, as they are, with their length; one of
    length 0 fails.
    """
    n_q = max(1, -(-queries.count() // block))
    n_c = max(1, -(-corpus.count() // block))
    norm = F.sqrt(F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    side = lambda df: df.select("id", "vec", let(norm, lambda n: F.when(n == 0, F.raise_error(F.lit("a vector of length 0"))).otherwise(n)).alias("norm"))
    q = side(queries).select(F.pmod(F.xxhash64("id"), F.lit(n_q)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("cb"), F.lit(True).alias("asks"), "id", "vec", "norm")
    c = side(corpus).select(F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"), F.pmod(F.xxhash64("id"), F.lit(n_c)).alias("cb"), F.lit(False).alias("asks"), "id", "vec", "norm")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["asks"]].sort_values("id"), pdf[~pdf["asks"]].sort_values("id")
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "match_id": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})
        x, y = (np.stack(v["vec"].to_list()).astype(np.float64) / v["norm"].to_numpy()[:, None] for v in (a, b))
        at, best = np.empty(len(x), dtype=np.int64), np.empty(len(x))
        for i in range(0, len(x), rows):
            s = x[i : i + rows] @ y.T
            at[i : i + rows] = s.argmax(axis=1)
            best[i : i + rows] = s[np.arange(len(s)), at[i : i + rows]]
        return pd.DataFrame({"query_id": a["id"].to_numpy(), "match_id": b["id"].to_numpy()[at], "cosine": best})

    best = q.unionByName(c.withColumn("cb", F.col("cb").cast("long")).withColumn("qb", F.col("qb").cast("long")), allowMissingColumns=True).groupBy("qb", "cb").applyInPandas(compare, "query_id long, match_id long, cosine double")
    top = best.groupBy("query_id").agg(F.max(F.struct("cosine", (-F.col("match_id")).alias("m"))).alias("t"))
    return top.select("query_id", (-F.col("t.m")).alias("match_id"), F.col("t.cosine").alias("cosine"))


def decontaminated(queries: DataFrame, exact: DataFrame, matches: DataFrame, threshold: float = 0.6) -> DataFrame:
    """One row of counts: rows, exact hits, near hits, both, removed, kept."""
    flagged = (
        queries.select(F.col("id"))
        .join(exact.select(F.col("id"), F.lit(True).alias("is_exact")), "id", "left")
        .join(matches.where(F.col("cosine") >= threshold).select(F.col("query_id").alias("id"), F.lit(True).alias("is_near")), "id", "left")
        .select(F.coalesce("is_exact", F.lit(False)).alias("e"), F.coalesce("is_near", F.lit(False)).alias("s"))
    )
    e, s = F.col("e"), F.col("s")
    return flagged.agg(F.count("*").alias("n_rows"), F.count_if(e).alias("n_exact"), F.count_if(s).alias("n_near"), F.count_if(e & s).alias("n_both"), F.count_if(e | s).alias("n_removed"), F.count_if(~(e | s)).alias("n_kept"))


#: Words of a passage's key, and characters of the key of a passage of one or two words.
KEY_WORDS, KEY_CHARS = 5, 8


def _words(text: Column) -> Column:
    return F.split(text, r"[ \n]", -1)


def _runs(words: Column, n: int) -> Column:
    """The hash of every run of ``n`` words, made of the hashes of its two runs of half as many, which may overlap."""
    if n == 1:
        return F.transform(words, lambda w: F.xxhash64(w))
    step = n // 2
    joined = lambda a, m: F.zip_with(F.slice(a, F.lit(1), m), F.slice(a, F.lit(step + 1), m), lambda x, y: F.xxhash64(x, y))
    return let(_runs(words, n - step), lambda a: joined(a, F.greatest(F.size(a) - step, F.lit(0))))


def _inside_keys(words: Column, n: int) -> Column:
    """The hash of every run of ``n`` characters inside a word, each once."""
    long_ = F.array_distinct(F.filter(words, lambda w: F.length(w) >= n))
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.xxhash64(F.substr(w, i, F.lit(n))))
    return F.array_distinct(F.flatten(F.transform(long_, runs)))


def containing(docs: DataFrame, doc_id: str, text: str, passages: DataFrame, item_id: str, passage: str) -> DataFrame:
    """(doc_id, item_id) of every document that holds a passage as a part of its text, wherever it begins. Ids are those
    of one row each.

    A passage is looked for where its key is found. The key of three words or more are the words between the first and
    the last, five at most, since those two may be parts of longer words in a document. A passage of one or two words
    has eight characters of its longer word, or all of them, as its key, which documents that ask for such a length
    hold inside a word. Only hashes of keys and ids travel; the texts are compared at the end, and decide. The passage
    of nothing is in every text; one of a single blank is asked of every text. Nulls are in none and hold none.
    """
    w = F.col("_w")
    b = passages.select(F.col(item_id).alias("_item"), F.col(passage).alias("_passage")).where(F.col("_passage").isNotNull()).withColumn("_w", _words(F.col("_passage")))
    inner = F.least(F.size(w) - 2, F.lit(KEY_WORDS))
    longest = F.when(F.length(w[0]) >= F.length(F.element_at(w, -1)), w[0]).otherwise(F.element_at(w, -1))
    short = let(longest, lambda x: F.struct(F.least(F.length(x), F.lit(KEY_CHARS)).alias("n"), F.xxhash64(F.substr(x, F.lit(1), F.lit(KEY_CHARS))).alias("k")))
    run = F.lit(None).cast("long")
    for n in range(1, KEY_WORDS + 1):
        run = F.when(inner == n, _runs(F.slice(w, F.lit(2), F.lit(n)), n)[0]).otherwise(run)
    long_ = F.struct(inner.alias("n"), run.alias("k"))
    keyed = b.select("_item", (F.size(w) > 2).alias("_long"), F.when(F.size(w) > 2, long_).otherwise(short).alias("_key")).select("_item", "_long", "_key.n", "_key.k")
    kinds = sorted((r[0], r[1]) for r in keyed.select("_long", "n").distinct().collect())  # KEY_WORDS + KEY_CHARS + 1 at most
    d = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())

    def keys(is_long: bool, n: int) -> Column:
        own = let(_words(F.col("_text")), lambda x: F.array_distinct(_runs(x, n)) if is_long else _inside_keys(x, n)) if n else F.array(F.xxhash64(F.lit("")))
        return F.struct(F.lit(is_long).alias("_long"), F.lit(n).alias("n"), own.alias("ks"))

    held = [keys(*kind) for kind in kinds]
    if not held:
        return d.join(b, F.lit(False)).select(F.col("_doc").alias(doc_id), F.col("_item").alias(item_id))
    grams = d.select("_doc", F.explode(F.array(*held)).alias("h")).select("_doc", "h._long", "h.n", F.explode("h.ks").alias("k"))
    pairs = grams.join(keyed, ["_long", "n", "k"]).select("_doc", "_item").distinct()
    near = pairs.join(b.select("_item", "_passage"), "_item").join(d, "_doc").where(F.contains("_text", "_passage"))
    return near.select(F.col("_doc").alias(doc_id), F.col("_item").alias(item_id))
