"""Evaluation aggregates, batch algebra, dataset mixing and distribution comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators import batch, evaluation, tabular, topk
from weftline.plans.base import query, table
from weftline.plans.rollouts import _KEY, KEY, TOKENS, tokens


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


@query(
    """WITH p AS (SELECT l_shipmode_ AS source, l_orderkey, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM (SELECT *, l_returnflag AS l_shipmode_ FROM lineitem) GROUP BY 1, 2)
SELECT source, round(avg(m), 5) AS mean_at_n, round(avg(s), 5) AS std_at_n, count(*) AS n_prompts FROM p GROUP BY 1"""
)
def validation_mean_std_at_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("source"), "l_orderkey", "l_quantity")
    return rounded(evaluation.mean_std_at_n(df, ["source"], "l_orderkey", "l_quantity"), 5)


@query(
    f"""WITH r AS (SELECT l_returnflag AS source, l_orderkey, l_quantity AS v, (row_number() OVER (PARTITION BY l_returnflag, l_orderkey ORDER BY l_quantity, {_KEY}))::DOUBLE AS i, (count(*) OVER (PARTITION BY l_returnflag, l_orderkey))::DOUBLE AS n FROM lineitem),
p AS (SELECT source, l_orderkey, sum(v * (pow(i / n, 4) - pow((i - 1) / n, 4))) AS b, sum(v * (pow((n - i + 1) / n, 4) - pow((n - i) / n, 4))) AS w FROM r GROUP BY 1, 2)
SELECT source, round(avg(b), 5) AS best, round(avg(w), 5) AS worst FROM p GROUP BY 1"""
)
def best_worst_at_n_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("source"), *KEY, "l_quantity")
    return rounded(evaluation.best_worst_expected(df, ["source"], "l_orderkey", "l_quantity", 4, KEY), 5)


@query()
def bootstrap_best_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.bootstrap(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", 4))


@query(
    f"""WITH v AS (SELECT l_orderkey, l_returnflag, count(*) AS votes, arg_min(l_quantity, rn) AS value, min(rn) AS rn FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) GROUP BY 1, 2)
SELECT l_orderkey, l_returnflag AS majority, votes, value FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY votes DESC, rn) AS n FROM v) WHERE n = 1"""
)
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.majority(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_quantity", KEY[1:])


@query(
    """WITH p AS (SELECT l_returnflag AS source, l_orderkey, avg(ok) AS m, max(ok) AS b, min(ok) AS w, sum(l_linenumber) AS len, count(*) AS n FROM (SELECT *, CASE WHEN l_quantity > 25 THEN 1.0::DOUBLE ELSE 0 END AS ok FROM lineitem) GROUP BY 1, 2)
SELECT source, round(avg(m), 6) AS mean_score, round(avg(b), 6) AS best_score, count(*) FILTER (b < 1) AS solve_none, count(*) FILTER (w >= 1) AS solve_all, round(sum(len)::DOUBLE / sum(n), 6) AS avg_length, count(*) AS n_prompts FROM p GROUP BY 1"""
)
def grading_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("source"), "l_orderkey", (F.col("l_quantity") > 25).cast("double").alias("ok"), "l_linenumber")
    return rounded(evaluation.grading(df, ["source"], "l_orderkey", "ok", "l_linenumber"))


@query(
    r"""WITH w AS (SELECT source, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT source, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM w WHERE len(w) >= 4)
SELECT source, round(count(DISTINCT g)::DOUBLE / count(*), 6) AS distinct_share FROM g GROUP BY 1"""
)
def distinct_4gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.distinct_ngrams(table(spark, sf_dir, "documents"), "source", "text"))


@query(
    """WITH b AS (SELECT (n_chars // 500) * 500 AS bucket, count(*) AS n FROM documents GROUP BY 1)
SELECT bucket, n, (sum(n) OVER (ORDER BY bucket))::BIGINT AS cumulative, round(100.0::DOUBLE * sum(n) OVER (ORDER BY bucket) / sum(n) OVER (), 6) AS percent FROM b"""
)
def length_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.length_cdf(table(spark, sf_dir, "documents"), "n_chars", 500))


_METRICS = "m AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'loss' WHEN 'error' THEN 'min_error' WHEN 'purchase' THEN 'max_reward' WHEN 'signup' THEN 'total_tokens' ELSE 'timing_avg' END AS name, event_id, value FROM events)"


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    name = F.when(kind == "click", "loss").when(kind == "error", "min_error").when(kind == "purchase", "max_reward").when(kind == "signup", "total_tokens").otherwise("timing_avg")
    return table(spark, sf_dir, "events").select("user_id", name.alias("name"), "event_id", "value")


@query(f"WITH {_METRICS} SELECT name, round(CASE WHEN name LIKE '%max%' THEN max(value) WHEN name LIKE '%min%' THEN min(value) ELSE avg(value) END, 4) AS value FROM m GROUP BY 1")
def reduce_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).groupBy("name").agg(F.round(evaluation.by_name(F.col("name"), F.col("value")), 4).alias("value"))


@query(
    f"""WITH {_METRICS} SELECT name, CASE name WHEN 'loss' THEN 'last' WHEN 'timing_avg' THEN 'avg' WHEN 'max_reward' THEN 'max' WHEN 'min_error' THEN 'min' ELSE 'sum' END AS rule,
round(CASE name WHEN 'loss' THEN arg_max(value, event_id) WHEN 'timing_avg' THEN avg(value) WHEN 'max_reward' THEN max(value) WHEN 'min_error' THEN min(value) ELSE sum(value) END, 4) AS value FROM m GROUP BY 1"""
)
def metric_aggregator_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.aggregate_steps(_metrics(spark, sf_dir), "name", "event_id", "value", "value", last=("loss",)), 4)


@query(
    """WITH d AS (SELECT *, l_quantity - 25 AS adv FROM lineitem)
SELECT count(*) FILTER (l_linenumber <= 0) AS n_aborted, round(avg(l_quantity), 4) AS l_quantity_mean, max(l_quantity) AS l_quantity_max, min(l_quantity) AS l_quantity_min, round(avg(l_tax), 4) AS l_tax_mean, max(l_tax) AS l_tax_max, min(l_tax) AS l_tax_min,
 round(avg(adv) FILTER (adv <> 0), 4) AS advantage_mean, round(stddev_samp(adv) FILTER (adv <> 0), 4) AS advantage_std, max(adv) AS advantage_max, min(adv) AS advantage_min, round(avg(abs(adv)), 4) AS advantage_abs_mean, count(*) FILTER (abs(adv) > 5) AS advantage_large,
 round(avg(l_linenumber), 4) AS length_mean, round(avg((l_linenumber = 7)::INT), 4) AS length_clip_ratio, round(1 - var_samp(l_quantity - l_discount) / (var_samp(l_quantity) + 1e-5), 4) AS explained_variance FROM d"""
)
def data_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").withColumn("adv", F.col("l_quantity") - 25)
    return rounded(evaluation.data_metrics(df, "l_quantity", "l_tax", "adv", "l_quantity", "l_discount", "l_linenumber", 7), 4)


@query("SELECT event_type, round(sum(value) / (count(DISTINCT user_id) * 7.3::DOUBLE), 4) AS throughput, round(avg(value) * 1000 / count(*), 4) AS ms_per_token FROM events GROUP BY 1")
def throughput_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.round(F.sum("value") / (F.count_distinct("user_id") * 7.3), 4).alias("throughput"), F.round(F.avg("value") * 1000 / F.count("*"), 4).alias("ms_per_token"))


_PRED = "SELECT (l_returnflag = 'R')::INT AS t, (l_quantity > 25)::INT AS p, round(l_quantity / 51.0::DOUBLE, 9) AS q FROM lineitem"


@query(
    f"""WITH x AS ({_PRED}), c AS (SELECT count(*) FILTER (t = 1 AND p = 1)::DOUBLE AS tp, count(*) FILTER (t = 0 AND p = 1)::DOUBLE AS fp, count(*) FILTER (t = 1 AND p = 0)::DOUBLE AS fn, count(*) FILTER (t = 0 AND p = 0)::DOUBLE AS tn, count(*)::DOUBLE AS n,
 avg(-CASE WHEN t = 1 THEN ln(q) ELSE ln(1 - q) END) AS ll, avg((t - p) * (t - p)) AS mse FROM x),
s AS (SELECT q, count(*) FILTER (t = 1) AS pos, count(*) FILTER (t = 0) AS neg FROM x GROUP BY 1), u AS (SELECT pos * (sum(neg) OVER (ORDER BY q) - neg / 2.0::DOUBLE) AS u, pos, neg FROM s)
SELECT round((tp + tn) / n, 6) AS accuracy, round((2 * tn / (2 * tn + fn + fp) * (tn + fp) + 2 * tp / (2 * tp + fp + fn) * (tp + fn)) / n, 6) AS f1_weighted, round(ll, 6) AS log_loss, round(mse, 6) AS mse, (SELECT round(sum(u) / (sum(pos) * sum(neg))::DOUBLE, 6) FROM u) AS auc FROM c"""
)
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    l_ = table(spark, sf_dir, "lineitem")
    df = l_.select((F.col("l_returnflag") == "R").cast("int").alias("t"), (F.col("l_quantity") > 25).cast("int").alias("p"), F.round(F.col("l_quantity") / 51.0, 9).alias("q"))
    return rounded(evaluation.classification(df, "t", "p", "q"))


@query(
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_KEY}) AS i FROM lineitem),
p AS (SELECT a.l_orderkey, abs(a.l_discount - b.l_discount) AS d, (a.l_quantity - b.l_quantity) * (a.l_discount - b.l_discount) > 0 AS hit FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.i < b.i)
SELECT l_orderkey, round(CASE WHEN sum(d) = 0 THEN 0.5 ELSE sum(CASE WHEN hit THEN d ELSE 0 END) / sum(d) END, 11) AS agreement FROM p GROUP BY 1"""
)
def pairwise_pref_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.pairwise_preference(table(spark, sf_dir, "lineitem"), "l_orderkey", KEY[1:], "l_quantity", "l_discount"), 11)


@query("SELECT round(avg((sign(l_quantity - 25) = sign(2 * (l_returnflag = 'R')::INT - 1))::INT), 6) AS accuracy FROM lineitem")
def absolute_pref_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.signum(F.col("l_quantity") - 25) == F.signum(2 * (F.col("l_returnflag") == "R").cast("int") - 1)
    return table(spark, sf_dir, "lineitem").agg(F.round(F.avg(hit.cast("double")), 6).alias("accuracy"))


@query(f"SELECT {_KEY}, round((SELECT avg(o.l_quantity) FROM lineitem o WHERE o.l_orderkey = l.l_orderkey AND o.l_linenumber < l.l_linenumber), 6) AS lower, round((SELECT avg(o.l_quantity) FROM lineitem o WHERE o.l_orderkey = l.l_orderkey AND o.l_linenumber > l.l_linenumber), 6) AS higher FROM lineitem l")
def contrastive_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = evaluation.contrastive("l_orderkey", "l_quantity", "l_linenumber")
    return table(spark, sf_dir, "lineitem").select(*KEY, F.round(low, 6).alias("lower"), F.round(high, 6).alias("higher"))


@query(f"SELECT {_KEY}, round(8 * pow(cume_dist() OVER (PARTITION BY l_orderkey ORDER BY l_quantity), 7), 6) AS weight FROM lineitem")
def best_of_n_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_quantity")
    return table(spark, sf_dir, "lineitem").select(*KEY, F.round(8 * F.pow(F.cume_dist().over(w), F.lit(7)), 6).alias("weight"))


@query("SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 4) AS mean, max(value) AS max, min(value) AS min FROM events")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    out = e.agg(F.round(F.avg("value"), 4).alias("mean"), F.max("value").alias("max"), F.min("value").alias("min"))
    q = tabular.quantiles(e, ["value"], [0.5, 0.95, 0.99])
    return q.crossJoin(out).select(*(F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))), "mean", "max", "min")


@query("SELECT count(*) FILTER (v <> 0) AS n_partial, round(avg((v <> 0)::INT), 6) AS ratio, max(v) AS longest FROM (SELECT event_id % 4 AS v FROM events)")
def partial_rollout_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("event_id") % 4
    return table(spark, sf_dir, "events").agg(F.count_if(v != 0).alias("n_partial"), F.round(F.avg((v != 0).cast("double")), 6).alias("ratio"), F.max(v).alias("longest"))


@query("SELECT round(avg(l_discount), 6) AS chosen, round(avg(l_tax), 6) AS rejected, round(avg((l_discount > l_tax)::INT), 6) AS accuracy, round(avg(l_discount - l_tax), 6) AS margin FROM lineitem")
def preference_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, r = F.col("l_discount"), F.col("l_tax")
    return table(spark, sf_dir, "lineitem").agg(F.round(F.avg(c), 6).alias("chosen"), F.round(F.avg(r), 6).alias("rejected"), F.round(F.avg((c > r).cast("double")), 6).alias("accuracy"), F.round(F.avg(c - r), 6).alias("margin"))


@query(
    f"""WITH g AS (SELECT *, avg((l_quantity > 25)::INT) OVER w AS acc, max(l_linenumber) OVER w AS longest, min(l_partkey) OVER w AS p FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))
SELECT {_KEY} FROM g ORDER BY (acc BETWEEN 0.2 AND 0.8 AND longest < 7)::INT DESC, l_orderkey, {_KEY} LIMIT (SELECT count(*) // 2 FROM lineitem)"""
)
def oversample_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of medium accuracy without an over-long row come first; half of all rows, by their place, stay."""
    w = Window.partitionBy("l_orderkey")
    l_ = table(spark, sf_dir, "lineitem")
    good = F.avg((F.col("l_quantity") > 25).cast("double")).over(w).between(0.2, 0.8) & (F.max("l_linenumber").over(w) < 7)
    placed = batch.with_position(l_.select(*KEY, (~good).alias("late")), ["late", *KEY])
    return placed.where(F.col("row_id") < l_.count() // 2).select(*KEY)


@query(
    f"SELECT {_KEY}, rn = 1 AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, i // 2 ORDER BY l_quantity DESC, i) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_KEY}) - 1 AS i FROM lineitem))"
)
def chosen_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*KEY)) - 1
    df = table(spark, sf_dir, "lineitem").withColumn("i", i).withColumn("pair", F.floor(F.col("i") / 2))
    best = F.row_number().over(Window.partitionBy("l_orderkey", "pair").orderBy(F.desc("l_quantity"), "i"))
    return df.select(*KEY, (best == 1).alias("chosen"))


# ---- batch algebra

_POS = "p AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders)"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.with_position(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"])


@query(f"WITH {_POS} SELECT o_orderkey, row_id FROM p WHERE row_id >= 10 AND row_id < 1000 AND (row_id - 10) % 3 = 0")
def batch_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.take(_rows(spark, sf_dir), "row_id", 10, 1000, 3).select("o_orderkey", "row_id")


@query(f"WITH {_POS} SELECT o_orderkey, (row_id * 7 + 3) % (SELECT count(*) FROM orders) AS row_id FROM p")
def batch_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    n = rows.count()
    order = rows.select("row_id", ((F.col("row_id") * 7 + 3) % n).alias("new"))
    return batch.reorder(rows, "row_id", order).select("o_orderkey", "row_id")


@query(f"WITH {_POS} SELECT o_orderkey, row_id * 3 + c AS new_id FROM p, range(3) t(c)")
def repeat_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.repeat_each(_rows(spark, sf_dir), "row_id", 3).select("o_orderkey", "new_id")


@query(f"WITH {_POS} SELECT o_orderkey, row_id + c * (SELECT count(*) FROM orders) AS new_id FROM p, range(3) t(c)")
def tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return batch.tile(rows, "row_id", 3, rows.count()).select("o_orderkey", "new_id")


@query("SELECT o_orderkey, (ntile(7) OVER (ORDER BY o_orderkey) - 1)::INT AS chunk FROM orders")
def chunk_ntile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return rows.select("o_orderkey", batch.chunk_of(F.col("row_id"), rows.count(), 7).alias("chunk"))


@query(f"WITH {_POS}, n AS (SELECT count(*) AS n FROM orders) SELECT o_orderkey, row_id, false AS is_pad FROM p UNION ALL SELECT o_orderkey, row_id + n, true FROM p, n WHERE row_id < (128 - n % 128) % 128")
def pad_to_divisor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return batch.pad_to_divisor(rows, "row_id", rows.count(), 128).select("o_orderkey", "row_id", "is_pad")


@query(f"WITH {_POS} SELECT row_id, o_orderkey, o_custkey, o_totalprice FROM p")
def union_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return batch.union_columns(rows.select("row_id", "o_orderkey", "o_custkey"), rows.select("row_id", "o_orderkey", "o_totalprice"), "row_id").select("row_id", "o_orderkey", "o_custkey", "o_totalprice")


@query(f"WITH {_POS} SELECT row_id // 4 AS row_id, string_agg(o_orderkey::VARCHAR, ',' ORDER BY row_id) AS keys FROM p GROUP BY 1")
def fold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.fold(_rows(spark, sf_dir), "row_id", 4, ["o_orderkey"]).select("row_id", F.array_join(F.col("o_orderkey").cast("array<string>"), ",").alias("keys"))


_SRC = "s AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS turn, count(*) OVER (PARTITION BY lang) AS n FROM documents), m AS (SELECT min(n) AS lo, max(n) AS hi FROM s)"
_LANGUAGES = ["en", "de", "fr", "es"]
_IDX = "CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END AS source"


def _mixed(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return batch.interleave([docs.where(F.col("lang") == x) for x in _LANGUAGES], ["doc_id"], strategy).select("doc_id", "turn", "source")


@query(f"WITH {_SRC} SELECT doc_id, turn, {_IDX} FROM s, m WHERE turn < lo")
def interleave_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir, "under")


@query(f"WITH {_SRC} SELECT doc_id, turn + r * n AS turn, {_IDX} FROM s, m, range(1000) t(r) WHERE turn + r * n < hi")
def interleave_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir, "over")


@query(f"WITH {_SRC} SELECT doc_id, turn, {_IDX} FROM s")
def interleave_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir, "once")


_HASH = "(('0x' || substr(md5(doc_id::VARCHAR || '{}'), 1, 8))::BIGINT::DOUBLE / 4294967296)"


@query(f"SELECT doc_id, CASE WHEN {_HASH.format('s1')} < 0.1 THEN 'validation' ELSE 'train' END AS part FROM documents")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, val = batch.split(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), 0.1, "s1")
    return train.withColumn("part", F.lit("train")).unionByName(val.withColumn("part", F.lit("validation")))


@query("SELECT doc_id, (row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR), doc_id) - 1) % 5 AS fold FROM labels")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.stratified_fold(table(spark, sf_dir, "labels"), "quality", "doc_id", 5).select("doc_id", F.col("fold").cast("long").alias("fold"))


@query("SELECT item_id, c::INT AS copy FROM benchmark, range(1, 5) t(c) WHERE item_id % 2 = 0 UNION ALL SELECT item_id, 1 FROM benchmark WHERE item_id % 2 = 1")
def replicate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id")
    return batch.replicate([(b.where("item_id % 2 = 0"), 4), (b.where("item_id % 2 = 1"), 1)])


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 100")
def bounded_queue_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.newest(table(spark, sf_dir, "events").select("event_id"), "event_id", 100)


@query(f"SELECT doc_id, copies FROM (SELECT doc_id, (floor(e) + ({_HASH.format('r')} < e - floor(e))::INT)::INT AS copies FROM (SELECT doc_id, n_chars::DOUBLE / (SELECT sum(n_chars::DOUBLE) FROM documents) * 500 AS e FROM documents)) WHERE copies > 0")
def importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return batch.draws(d, F.col("n_chars").cast("double"), F.col("doc_id"), 500, "r").select("doc_id", "copies")


@query("SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) % 8 AS worker FROM events")
def round_robin_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.with_position(table(spark, sf_dir, "events").select("event_id"), ["event_id"]).select("event_id", (F.col("row_id") % 8).alias("worker"))


@query("SELECT s.event_id, a.attempt::INT AS attempt FROM events s, range(1, 4) a(attempt) WHERE NOT EXISTS (SELECT 1 FROM events c WHERE c.event_id = s.event_id AND c.event_id % 3 + 1 = a.attempt)")
def resume_missing_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots (row, attempt) that are asked for but not done."""
    e = table(spark, sf_dir, "events").select("event_id")
    wanted = e.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(3))))
    done = e.withColumn("attempt", (F.col("event_id") % 3 + 1).cast("int"))
    return wanted.join(done, ["event_id", "attempt"], "left_anti")


# ---- distributions: a token is an event; its candidates have ids and log-probabilities made of its number

_S = "list_transform(range(5), lambda i: {{'id': (event_id * 3 + i) % 9, 'student': -0.3 * (i + 1) - (event_id % 5) / 10.0::DOUBLE, 'teacher': -0.2 * (i + 1) - (event_id % 7) / 10.0::DOUBLE}})".replace("{{", "{").replace("}}", "}")
_T = "list_transform(range(5), lambda i: {'id': (event_id * 3 + 2 * i + 1) % 9, 'student': -0.5 * (i + 1) - (event_id % 3) / 10.0::DOUBLE, 'teacher': -0.1 * (i + 1) - (event_id % 4) / 10.0::DOUBLE})"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r = F.col("event_id"), F.sequence(F.lit(0), F.lit(4))
    entry = lambda i, a, b, x, m, y, n: F.struct(i.alias("id"), a.alias("student"), b.alias("teacher"))
    s = F.transform(r, lambda i: entry((e * 3 + i) % 9, -0.3 * (i + 1) - (e % 5) / 10.0, -0.2 * (i + 1) - (e % 7) / 10.0, 0, 0, 0, 0))
    t = F.transform(r, lambda i: entry((e * 3 + 2 * i + 1) % 9, -0.5 * (i + 1) - (e % 3) / 10.0, -0.1 * (i + 1) - (e % 4) / 10.0, 0, 0, 0, 0))
    return table(spark, sf_dir, "events").select("event_id", s.alias("s"), t.alias("t"))


_ENT = f"tk AS (SELECT event_id, {_S} AS s, {_T} AS t FROM events)"


@query(f"WITH {_ENT} SELECT event_id, len(list_intersect(list_transform(s, lambda x: x.id), list_transform(t, lambda x: x.id)))::INT AS n_shared FROM tk")
def topk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("event_id", topk.overlap(F.col("s"), F.col("t")).alias("n_shared"))


@query(f"WITH {_ENT} SELECT event_id // 100 AS chunk, round(sum(len(list_intersect(list_transform(s, lambda x: x.id), list_transform(t, lambda x: x.id))))::DOUBLE / sum(5), 6) AS overlap_ratio FROM tk GROUP BY 1")
def topk_overlap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = topk.overlap(F.col("s"), F.col("t"))
    return _candidates(spark, sf_dir).groupBy(F.floor(F.col("event_id") / 100).alias("chunk")).agg(F.round(F.sum(n) / F.sum(F.size("s")), 6).alias("overlap_ratio"))


_CHOSEN = {
    "only_stu": "s",
    "only_tch": "t",
    "intersection": "list_filter(s, lambda x: list_contains(list_transform(t, lambda y: y.id), x.id))",
    "union": "list_concat(s, list_filter(t, lambda x: NOT list_contains(list_transform(s, lambda y: y.id), x.id)))",
    "union_intersection": "list_concat(list_filter(s, lambda x: NOT list_contains(list_transform(t, lambda y: y.id), x.id)), list_filter(t, lambda x: NOT list_contains(list_transform(s, lambda y: y.id), x.id)))",
}


def _reward(strategy: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = _candidates(spark, sf_dir)
        return c.select("event_id", *(F.round(topk.weighted_reward(F.col("s"), F.col("t"), strategy, w), 6).alias(f"reward_{w}") for w in ("student_p", "teacher_p", "none")))

    run.__name__ = f"topk_reward_{strategy}"
    norm = "1" if strategy == "union_intersection" else "list_sum(list_transform(x, lambda e: exp({0})))"
    one = lambda w, n: f"round(coalesce(CASE WHEN len(x) > 0 THEN -list_sum(list_transform(x, lambda e: (e.student - e.teacher) * exp({w}))) / {norm.format(w)} END, 0), 6) AS {n}"
    query(f"WITH {_ENT}, c AS (SELECT event_id, {_CHOSEN[strategy]} AS x FROM tk) SELECT event_id, {one('e.student', 'reward_student_p')}, {one('e.teacher', 'reward_teacher_p')}, {one('0 * e.student', 'reward_none')} FROM c")(run)


for _name in topk.STRATEGIES:
    _reward(_name)


@query(
    f"""WITH {_ENT}, u AS (SELECT event_id, unnest(s).id AS k, unnest(s).student AS a, NULL AS b FROM tk UNION ALL SELECT event_id, unnest(t).id, NULL, unnest(t).teacher FROM tk),
k AS (SELECT event_id, k, max(a) AS a, max(b) AS b FROM u GROUP BY 1, 2), f AS (SELECT event_id, min(a) - 20 AS fa, min(b) - 20 AS fb FROM k GROUP BY 1),
e AS (SELECT event_id, exp(coalesce(a, fa)) AS p, exp(coalesce(b, fb)) AS q FROM k JOIN f USING (event_id)), z AS (SELECT event_id, p / sum(p) OVER w AS p, q / sum(q) OVER w AS q FROM e WINDOW w AS (PARTITION BY event_id))
SELECT event_id, round(greatest(sum(q * ln(q / greatest(p, 1e-12))), 0), 6) AS kl, round(least(0.5 * sum(abs(q - p)), 1), 6) AS tv FROM z GROUP BY 1"""
)
def kl_tv_from_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    m = lambda x, f: F.map_from_entries(F.transform(x, lambda e: F.struct(e["id"], e[f])))
    maps = c.select("event_id", m("s", "student").alias("a"), m("t", "teacher").alias("b"))
    both = maps.select("event_id", topk.kl_tv(F.col("a"), F.col("b")).alias("x"))
    return both.select("event_id", F.round("x.kl", 6).alias("kl"), F.round("x.tv", 6).alias("tv"))


@query(
    f"""WITH {TOKENS}, a AS (SELECT user_id, 'style' AS aspect, (event_id % 3)::DOUBLE AS w, new - old AS kl, r * 0.7310585::DOUBLE AS nll FROM tok UNION ALL SELECT user_id, 'logic', (event_id % 2)::DOUBLE, new - old, r * 0.7310585::DOUBLE FROM tok)
SELECT user_id, aspect, round(CASE WHEN sum(w) > 0 THEN sum(kl * w) / sum(w) ELSE 0 END, 6) AS kl, round(CASE WHEN sum(w) > 0 THEN sum(nll * w) / sum(w) ELSE 0 END, 4) AS nll, sum(w) AS weight FROM a GROUP BY 1, 2"""
)
def aspect_weighted_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.create_map(F.lit("style"), (F.col("event_id") % 3).cast("double"), F.lit("logic"), (F.col("event_id") % 2).cast("double"))
    df = tokens(spark, sf_dir).select("user_id", w.alias("w"), (F.col("new") - F.col("old")).alias("kl"), (F.col("r") * 0.7310585).alias("nll"))
    return topk.by_aspect(df, "user_id", "w", ["kl", "nll"]).withColumns({"kl": F.round("kl", 6), "nll": F.round("nll", 4)})
