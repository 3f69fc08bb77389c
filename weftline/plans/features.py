"""Queries of generated features, exact quantiles and of losses with a random subset or a running mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import expressions, groupstats, policy, tabular
from weftline.plans.base import query, table
from weftline.plans.rollouts import TOKENS, tokens

_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
#: A feature text of four lines, of which the last two use columns made before.
_TEXT = """df['unit'] = df['l_extendedprice'] / (df['l_quantity'] + 1)
df['gap'] = np.where((df.l_discount > df.l_tax) & (df.l_quantity >= 10), df.l_discount - df.l_tax, 0)
df['level'] = np.log1p(df.unit) * df.gap
df['standard'] = (df.unit - df.unit.mean()) / df.unit.std()
"""


@query(
    f"""WITH u AS (SELECT *, l_extendedprice / (l_quantity + 1) AS unit, CASE WHEN l_discount > l_tax AND l_quantity >= 10 THEN l_discount - l_tax ELSE 0 END AS gap FROM lineitem)
SELECT {_KEY}, round(unit, 9) AS unit, round(gap, 6) AS gap, round(ln(1 + unit) * gap, 6) AS level, round((unit - avg(unit) OVER ()) / stddev_samp(unit) OVER (), 6) AS standard FROM u"""
)
def generated_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    made = lines.withColumns(expressions.features(lines, _TEXT))
    return made.select(*_KEY.split(", "), F.round("unit", 9).alias("unit"), *(F.round(c, 6).alias(c) for c in ("gap", "level", "standard")))


#: Feature texts, and the SQL of what gates count of each: values that are null, infinite, and whether they vary.
_TEXTS = {
    "ratio": ("df['f'] = df.l_tax / df.l_discount", "CASE WHEN l_discount <> 0 THEN l_tax / l_discount WHEN l_tax > 0 THEN 'Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END"),
    "constant": ("df['f'] = df.l_tax * 0 + 1", "l_tax * 0 + 1"),
    "log": ("df['f'] = np.log(df.l_quantity * df.l_linenumber)", "ln(l_quantity * l_linenumber)"),
    "copy": ("df['f'] = df.l_tax + 0", "l_tax"),
}


@query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS name, count(*) FILTER (isinf(f)) AS n_infinite, count(*) FILTER (isnan(f)) AS n_nan, bool_and(f = l_tax) AS is_old, count(*) FILTER (isinf(f) OR isnan(f)) = 0 AND min(f) < max(f) AND NOT bool_and(f = l_tax) AS passes FROM (SELECT l_tax, {sql} AS f FROM lineitem)"
        for name, (_, sql) in _TEXTS.items()
    )
)
def generated_feature_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each feature text: what the gates count over the whole table."""
    lines, out = table(spark, sf_dir, "lineitem"), None
    for name, (text, _) in _TEXTS.items():
        g = tabular.gates(lines, expressions.features(lines, text)["f"], ["l_tax"]).select(F.lit(name).alias("name"), "n_infinite", "n_nan", (F.col("n_equal") > 0).alias("is_old"), "passes")
        out = g if out is None else out.unionByName(g)
    return out


_SHARES = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
_COLUMNS = ["l_quantity", "l_discount", "l_extendedprice"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n, unnest({_SHARES}) AS share, round(unnest(quantile_cont({c}, {_SHARES})), 6) AS value FROM lineitem" for c in _COLUMNS))
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = tabular.quantiles(table(spark, sf_dir, "lineitem"), _COLUMNS, _SHARES)
    return q.select("name", "n", F.posexplode("q").alias("i", "v")).select("name", "n", F.array(*map(F.lit, _SHARES))[F.col("i")].alias("share"), F.round("v", 6).alias("value"))


@query(
    f"""WITH {TOKENS}, s AS (SELECT avg(adv) FILTER (mask) AS a, avg(new) FILTER (mask) AS l, greatest(1, floor(count(*) FILTER (mask) * 0.02)) AS k FROM tok),
c AS (SELECT *, -adv * exp(new - old) AS l1, -adv * greatest(least(exp(new - old), 1.1), 0.9) AS l2, round((adv - a) * (new - l), 9) AS cov FROM tok, s),
b AS (SELECT event_id, row_number() OVER (ORDER BY md5('7:' || event_id), event_id) AS n FROM c WHERE mask AND l2 <= l1 AND cov > 0.1 AND cov < 1.5)
SELECT event_id, coalesce(n <= k, false) AS dropped, CASE WHEN mask THEN round(CASE WHEN n <= k THEN 0 ELSE greatest(l1, l2) END, 6) END AS loss FROM c LEFT JOIN b USING (event_id)"""
)
def clip_cov_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = policy.clip_cov(tokens(spark, sf_dir), ("event_id",), "new", "old", "adv", "mask", 0.02, 0.1, 1.5, 0.1, 0.1, seed=7)
    return out.select("event_id", "dropped", F.round("loss", 6).alias("loss"))


@query(
    f"""WITH p AS (SELECT {_KEY}, l_orderkey // 50 AS batch, 0.5 * (l_tax - l_discount) AS good, 0.5 * (l_quantity / 50 - 1) AS bad FROM lineitem),
m AS (SELECT batch, avg(avg((good + bad) / 2)) OVER (ORDER BY batch) AS baseline FROM p GROUP BY 1)
SELECT {_KEY}, round(baseline, 6) AS baseline, round(ln(1 + exp(-(good - baseline))) + ln(1 + exp(bad - baseline)), 6) AS loss FROM p JOIN m USING (batch)"""
)
def bco_running_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(*_KEY.split(", "), F.expr("l_orderkey div 50").alias("batch"), "l_tax", "l_discount", (F.col("l_quantity") / 50).alias("bad"), F.lit(1.0).alias("one"))
    out = policy.bco_loss(pairs, "batch", "l_tax", "bad", "l_discount", "one", 0.5)
    return out.select(*_KEY.split(", "), F.round("baseline", 6).alias("baseline"), F.round("loss", 6).alias("loss"))


@query(f"WITH {TOKENS} SELECT event_id, round(CASE WHEN mask THEN adv ELSE 0 END, 6) AS direct FROM tok")
def token_reward_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groupstats.token_direct(tokens(spark, sf_dir), "adv", "mask").select("event_id", F.round("direct", 6).alias("direct"))


@query(
    f"""WITH {TOKENS}, q AS (SELECT user_id, user_id % 50 AS uid, sum(r) AS s FROM tok GROUP BY 1, 2), g AS (SELECT user_id, CASE WHEN count(*) OVER w = 1 THEN s / (1 + 1e-6) ELSE (s - avg(s) OVER w) / (stddev_samp(s) OVER w + 1e-6) END AS z FROM q WINDOW w AS (PARTITION BY uid))
SELECT event_id, round(CASE WHEN mask THEN adv ELSE 0 END, 6) AS direct, round(CASE WHEN mask THEN adv + 0.5 * z ELSE 0 END, 5) AS advantage FROM tok JOIN g USING (user_id)"""
)
def token_reward_direct_plus_grpo(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tokens(spark, sf_dir).withColumn("uid", F.col("user_id") % 50)
    out = groupstats.token_direct_plus_group(df, "uid", ("user_id",), "adv", "mask", "r", 0.5)
    return out.select("event_id", F.round("direct", 6).alias("direct"), F.round("advantage", 5).alias("advantage"))


@query(
    f"""WITH {TOKENS}, w AS (SELECT *, sum(CASE WHEN mask THEN new - rollout ELSE 0 END) OVER (PARTITION BY user_id) / greatest(count(*) FILTER (mask) OVER (PARTITION BY user_id), 1) AS g FROM tok)
SELECT event_id, kept, CASE WHEN kept THEN round(-adv * new * least(exp(new - rollout), 1.1), 6) END AS loss FROM (SELECT *, mask AND exp(g) BETWEEN 0.98 AND 1.02 AS kept FROM w)"""
)
def rollout_corrected_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy gradient with token weights, of the rows whose geometric ratio stays near one."""
    out = policy.corrected_loss(tokens(spark, sf_dir), ("user_id",), "new", "rollout", "adv", "mask", 1.1, "token", 1.02, 0.98, "geometric")
    return out.select("event_id", "kept", F.round("loss", 6).alias("loss"))


@query(
    """WITH l AS (SELECT event_id, unnest(range(6)) AS i, value, user_id FROM events), x AS (SELECT event_id, value / 50 * ((i * 7 + user_id) % 5) / 5 AS z FROM l), e AS (SELECT event_id, sum(exp(z)) AS t, sum(exp(z) * z) AS m FROM x GROUP BY 1)
SELECT event_id, round(ln(t) - m / t, 6) AS entropy FROM e"""
)
def entropy_from_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.col("value") / 50 * ((i * 7 + F.col("user_id")) % 5) / 5)
    return table(spark, sf_dir, "events").select("event_id", F.round(policy.entropy(logits), 6).alias("entropy"))
