"""Group-relative advantages, token sequences and losses, bound to ``lineitem`` and ``events``.

A scored row is a lineitem: its group is the order, its score the quantity, its length the line number. A token is an
event: its row is the user, its place the event's rank in time, its reward the value, masked out if it is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators import batch, groupstats, policy
from weftline.plans.base import query, table

KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
_KEY = ", ".join(KEY)
_RN = f"row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, {_KEY})"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*KEY, F.col("l_quantity").alias("score"), F.col("l_linenumber").cast("double").alias("length"))


def _advantage(column) -> DataFrame:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scored(spark, sf_dir).select(*KEY, F.round(column(), 6).alias("advantage"))

    return run


def _register(name: str, column, expression: str) -> None:
    run = _advantage(column)
    run.__name__ = name
    query(f"SELECT {_KEY}, round({expression}, 6) AS advantage FROM (SELECT *, l_quantity AS s, count(*) OVER w AS n, avg(l_quantity) OVER w AS m, stddev_samp(l_quantity) OVER w AS sd, sum(l_quantity) OVER w AS t, sum(l_linenumber * l_quantity) OVER w AS lt, sum(l_linenumber)::DOUBLE OVER w AS ln, {_RN} AS rn, max(l_quantity) OVER w AS best FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))".replace("sum(l_linenumber)::DOUBLE OVER w", "(sum(l_linenumber) OVER w)::DOUBLE"))(run)


E_ = groupstats.ESTIMATORS
_register("grpo_advantage", lambda: E_["grpo"]("l_orderkey", "score"), "CASE WHEN n = 1 THEN s / (1 + 1e-6) ELSE (s - m) / (sd + 1e-6) END")
_register("grpo_no_std", lambda: groupstats.grpo("l_orderkey", "score", scale=False), "CASE WHEN n = 1 THEN s ELSE s - m END")
_register("grpo_floored_advantage", lambda: E_["grpo_vectorized"]("l_orderkey", "score"), "CASE WHEN n = 1 THEN s ELSE (s - m) / (sqrt(greatest(sd * sd, 1e-6)) + 1e-6) END")
_register("rloo_advantage", lambda: E_["rloo"]("l_orderkey", "score"), "CASE WHEN n = 1 THEN s ELSE s - (t - s) / (n - 1) END")
_register("rloo_vectorized_advantage", lambda: E_["rloo_vectorized"]("l_orderkey", "score"), "CASE WHEN n = 1 THEN 0 ELSE s - (t - s) / (n - 1) END")
_register("opo_advantage", lambda: E_["opo"]("l_orderkey", "score", "length"), "s - CASE WHEN n = 1 THEN 0 ELSE lt / ln END")
_register("rpp_baseline_raw", lambda: E_["baseline"]("l_orderkey", "score"), "CASE WHEN n = 1 THEN s ELSE s - m END")


@query(
    f"""SELECT {_KEY}, round(CASE WHEN n < 2 THEN NULL WHEN rn = 1 THEN (s - second) / (sd + 1e-6) ELSE 0 END, 6) AS advantage FROM (
SELECT {_KEY}, l_quantity AS s, count(*) OVER w AS n, stddev_samp(l_quantity) OVER w AS sd, {_RN} AS rn,
 nth_value(l_quantity, 2) OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, {_KEY} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))"""
)
def passk_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select(*KEY, F.round(groupstats.passk("l_orderkey", "score", order=KEY), 6).alias("advantage"))


@query(
    f"""SELECT {_KEY}, round((SELECT count(*)::DOUBLE FROM lineitem) / (SELECT greatest(count(*) FILTER (l_linestatus = 'O'), 1) FROM lineitem) * (s - CASE WHEN n = 1 THEN 0 ELSE m END), 6) AS advantage
FROM (SELECT *, CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END AS s, count(*) OVER w AS n, avg(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) OVER w AS m FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))"""
)
def gpg_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(*KEY, F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0.0).alias("score"))
    return groupstats.gpg(df, "l_orderkey", "score").select(*KEY, F.round("advantage", 6).alias("advantage"))


@query(
    f"""WITH b AS (SELECT *, CASE WHEN n = 1 THEN l_quantity ELSE l_quantity - m END AS v FROM (SELECT *, count(*) OVER w AS n, avg(l_quantity) OVER w AS m FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)))
SELECT {_KEY}, round((v - (SELECT avg(v) FROM b)) / sqrt((SELECT var_samp(v) FROM b) + 1e-8), 4) AS advantage FROM b"""
)
def rpp_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir).withColumn("v", E_["baseline"]("l_orderkey", "score")).withColumn("mask", F.lit(True))
    return groupstats.whiten(df, "v", "mask").select(*KEY, F.round("whitened", 4).alias("advantage"))


@query("SELECT l_orderkey, round(CASE WHEN count(*) = 1 THEN 0 ELSE avg(l_quantity) END, 6) AS mean, round(CASE WHEN count(*) = 1 THEN 1 ELSE sqrt(greatest(var_samp(l_quantity), 1e-6)) END, 6) AS std, count(*) AS n FROM lineitem GROUP BY 1")
def group_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groupstats.group_stats(scored(spark, sf_dir), "l_orderkey", "score").select("l_orderkey", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query(f"SELECT {_KEY} FROM (SELECT *, stddev_pop(l_tax) OVER w AS sd, count(*) OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)) WHERE sd > 0 OR n = 1")
def dynamic_group_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(*KEY, "l_tax").withColumn("keep", groupstats.varied_groups("l_orderkey", "l_tax"))
    return df.where("keep").select(*KEY)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, t (from 0), r, mask, eos and three log-probabilities made of the value."""
    e = table(spark, sf_dir, "events")
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    v = F.col("value")
    return e.select(
        "event_id", "user_id", t.alias("t"), v.alias("r"), (F.col("event_type") != "error").alias("mask"), (F.col("event_type") == "purchase").alias("eos"),
        (-v / 100.0).alias("old"), (-v / 100.0 + (F.col("event_id") % 7 - 3) / 20.0).alias("new"), (-v / 100.0 + (F.col("event_id") % 5 - 2) / 10.0).alias("rollout"),
        ((F.col("event_id") % 11 - 5) / 5.0).alias("adv"),
    )


TOKENS = """tok AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS r, event_type <> 'error' AS mask, event_type = 'purchase' AS eos,
 -value / 100 AS old, -value / 100 + (event_id % 7 - 3)::DOUBLE / 20 AS new, -value / 100 + (event_id % 5 - 2)::DOUBLE / 10 AS rollout, (event_id % 11 - 5)::DOUBLE / 5 AS adv FROM events)"""


@query(f"WITH {TOKENS} SELECT event_id, round(sum(CASE WHEN mask THEN r ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - CASE WHEN mask THEN (user_id % 10)::DOUBLE ELSE 0 END, 4) AS advantage FROM tok")
def remax_reverse_cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tokens(spark, sf_dir)
    total = groupstats.to_end(("user_id",), "t", F.when(F.col("mask"), F.col("r")).otherwise(0.0))
    return df.select("event_id", F.round(total - F.when(F.col("mask"), (F.col("user_id") % 10).cast("double")).otherwise(0.0), 4).alias("advantage"))


@query(
    f"""WITH {TOKENS}, s AS (SELECT *, user_id % 50 AS uid FROM tok),
n AS (SELECT *, CASE WHEN mask THEN (r - avg(r) FILTER (mask) OVER w) / (stddev_samp(r) FILTER (mask) OVER w + 1e-6) ELSE 0 END AS z FROM s WINDOW w AS (PARTITION BY uid))
SELECT event_id, round(sum(z) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS advantage FROM n"""
)
def token_grpo(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tokens(spark, sf_dir).withColumn("uid", F.col("user_id") % 50)
    df = df.withColumn("z", groupstats.token_group("uid", ("user_id",), "t", "r", "mask"))
    return df.select("event_id", F.round(groupstats.to_end(("user_id",), "t", F.col("z")), 4).alias("advantage"))


@query(f"WITH {TOKENS} SELECT event_id, coalesce(sum(eos::INT) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS in_response FROM tok")
def response_mask_eos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir).select("event_id", groupstats.before_first(("user_id",), "t", F.col("eos")).alias("in_response"))


@query(f"WITH {TOKENS}, s AS (SELECT avg(r) FILTER (mask) AS m, var_samp(r) FILTER (mask) AS v FROM tok) SELECT event_id, round((r - m) / sqrt(v + 1e-8), 4) AS whitened FROM tok, s")
def masked_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groupstats.whiten(tokens(spark, sf_dir), "r", "mask").select("event_id", F.round("whitened", 4).alias("whitened"))


@query(
    f"""WITH {TOKENS}, rows_ AS (SELECT user_id, sum(CASE WHEN mask THEN r ELSE 0 END) AS s, sum(mask::INT)::DOUBLE AS n FROM tok GROUP BY 1)
SELECT round(sum(s) / sum(n), 4) AS token_mean, round(avg(s), 4) AS seq_mean_token_sum, round(avg(s / (n + 1e-8)), 4) AS seq_mean_token_mean, round(sum(s) / 512, 4) AS seq_mean_token_sum_norm FROM rows_"""
)
def agg_loss_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = groupstats.loss_modes(tokens(spark, sf_dir), ("user_id",), "r", "mask", 512.0)
    return out.select(*(F.round(c, 4).alias(c) for c in out.columns))


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a user: rewards, values and masks in the order of t."""
    rows = tokens(spark, sf_dir).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("t", "r", "mask", "event_id"))).alias("x"))
    pick = lambda f: F.transform("x", f)
    return rows.select("user_id", pick(lambda x: x["event_id"]).alias("ids"), pick(lambda x: x["r"]).alias("r"), pick(lambda x: x["r"] * 0.5).alias("v"), pick(lambda x: x["mask"].cast("double")).alias("m"))


_SEQ = f"""{TOKENS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC) AS k FROM tok)"""


@query(
    f"""WITH RECURSIVE {_SEQ}, g AS (
 SELECT user_id, event_id, k, CASE WHEN mask THEN r * 0.5 ELSE 0 END AS nxt, CASE WHEN mask THEN r - r * 0.5 ELSE 0 END AS last FROM o WHERE k = 1
 UNION ALL SELECT o.user_id, o.event_id, o.k, CASE WHEN o.mask THEN o.r * 0.5 ELSE g.nxt END, CASE WHEN o.mask THEN o.r + 0.99 * g.nxt - o.r * 0.5 + 0.99 * 0.95 * g.last ELSE g.last END
 FROM g JOIN o ON o.user_id = g.user_id AND o.k = g.k + 1)
SELECT event_id, round(last, 4) AS advantage FROM g"""
)
def gae_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _arrays(spark, sf_dir).withColumn("a", groupstats.gae(F.col("r"), F.col("v"), F.col("m"), 0.99, 0.95))
    return a.select(F.explode(F.arrays_zip("ids", "a")).alias("x")).select(F.col("x.ids").alias("event_id"), F.round("x.a", 4).alias("advantage"))


@query(
    f"""WITH RECURSIVE {_SEQ}, g AS (
 SELECT user_id, event_id, k, r AS ret, CASE WHEN mask THEN r ELSE 0 END AS run FROM o WHERE k = 1
 UNION ALL SELECT o.user_id, o.event_id, o.k, o.r + 0.91734563 * g.run, CASE WHEN o.mask THEN o.r + 0.91734563 * g.run ELSE 0 END FROM g JOIN o ON o.user_id = g.user_id AND o.k = g.k + 1)
SELECT event_id, round(ret, 6) AS returns FROM g"""
)
def discounted_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _arrays(spark, sf_dir).withColumn("a", groupstats.discounted(F.col("r"), F.col("m"), 0.91734563))
    return a.select(F.explode(F.arrays_zip("ids", "a")).alias("x")).select(F.col("x.ids").alias("event_id"), F.round("x.a", 6).alias("returns"))


_K3 = "greatest(least(exp(greatest(least(old - new, 20), -20)) - greatest(least(old - new, 20), -20) - 1, 10), -10)"


@query(f"WITH {TOKENS} SELECT event_id, round(new - old, 6) AS k1, round(abs(new - old), 6) AS abs_kl, round(0.5 * (new - old) * (new - old), 6) AS k2, round({_K3}, 6) AS k3 FROM tok")
def kl_penalty_k1_k2_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = F.col("new"), F.col("old")
    return tokens(spark, sf_dir).select("event_id", *(F.round(policy.kl_penalty(new, old, k), 6).alias(n) for k, n in (("k1", "k1"), ("abs", "abs_kl"), ("k2", "k2"), ("k3", "k3"))))


@query(f"WITH {TOKENS} SELECT event_id, round(CASE WHEN mask THEN r - 0.05 * (old - rollout) ELSE 0 END, 6) AS reward FROM tok")
def reverse_kl_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    reward = F.when(F.col("mask"), F.col("r") - 0.05 * policy.kl_penalty(F.col("old"), F.col("rollout"), "kl")).otherwise(0.0)
    return tokens(spark, sf_dir).select("event_id", F.round(reward, 6).alias("reward"))


_L = "greatest(-adv * exp(new - old), -adv * greatest(least(exp(new - old), 1.1), 0.9))"


@query(f"WITH {TOKENS} SELECT event_id, round(CASE WHEN adv < 0 THEN least(-adv * 3, {_L}) ELSE {_L} END, 6) AS loss, -adv * greatest(least(exp(new - old), 1.1), 0.9) > -adv * exp(new - old) AS clipped FROM tok")
def ppo_dual_clip_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("new"), F.col("old"), F.col("adv"), 0.1, 0.1)
    return tokens(spark, sf_dir).select("event_id", F.round(policy.dual_clip_loss(*x), 6).alias("loss"), policy.clip_share(*x).alias("clipped"))


@query(
    f"""WITH {TOKENS}, s AS (SELECT user_id, exp(least(sum(new - old) FILTER (mask) / greatest(count(*) FILTER (mask), 1), 10)) AS ratio FROM tok GROUP BY 1)
SELECT user_id, round(coalesce(sum(greatest(-adv * ratio, -adv * greatest(least(ratio, 1.01), 0.99))) FILTER (mask), 0) / (count(*) FILTER (mask) + 1e-8), 6) AS loss FROM tok JOIN s USING (user_id) GROUP BY 1"""
)
def gspo_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.sequence_ratio_loss(tokens(spark, sf_dir), ("user_id",), "new", "old", "adv", "mask", 0.01, 0.01).withColumn("loss", F.round("loss", 6))


@query(
    f"""WITH {TOKENS}, d AS (SELECT *, sign(adv) * (new - old) AS mv FROM tok)
SELECT user_id, round(-(coalesce(sum(adv) FILTER (mask), 0) / (count(*) FILTER (mask) + 1e-8)) * exp(coalesce(sum(least(mv, greatest(least(mv, 0.1), -0.1)) * sign(adv)) FILTER (mask), 0) / (count(*) FILTER (mask) + 1e-8)), 6) AS loss FROM d GROUP BY 1"""
)
def gmpo_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.geometric_loss(tokens(spark, sf_dir), ("user_id",), "new", "old", "adv", "mask", 0.1, 0.1).withColumn("loss", F.round("loss", 6))


@query(f"WITH {TOKENS} SELECT event_id, round(-new * adv, 6) AS loss FROM tok")
def gpg_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir).select("event_id", F.round(-F.col("new") * F.col("adv"), 6).alias("loss"))


@query(
    f"""WITH {TOKENS}, s AS (SELECT avg(adv) FILTER (mask) AS a, avg(new) FILTER (mask) AS l FROM tok), c AS (SELECT event_id, adv, new, old, round((adv - a) * (new - l), 9) AS cov FROM tok, s WHERE mask),
k AS (SELECT *, row_number() OVER (ORDER BY cov DESC, event_id) AS n FROM c)
SELECT event_id, round(-adv * exp(new - old) + CASE WHEN n <= greatest(1, (SELECT floor(count(*) * 0.02) FROM c)) THEN abs(new - old) ELSE 0 END, 6) AS loss FROM k"""
)
def kl_cov_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of the largest covariances pay a penalty. Ranks are counted range by range, in no single task."""
    c = policy.covariance(tokens(spark, sf_dir).where("mask"), "new", "adv", "mask").withColumn("cov", F.round("cov", 9))
    k = max(1, int(c.count() * 0.02))
    out = batch.with_position(c.withColumn("low", -F.col("cov")), ["low", "event_id"])
    return out.select("event_id", F.round(-F.col("adv") * F.exp(F.col("new") - F.col("old")) + F.when(F.col("row_id") < k, F.abs(F.col("new") - F.col("old"))).otherwise(0.0), 6).alias("loss"))


@query(f"WITH {TOKENS} SELECT event_id, round(0.5 * greatest((new - r) * (new - r), (greatest(least(new, old + 0.05), old - 0.05) - r) * (greatest(least(new, old + 0.05), old - 0.05) - r)), 10) AS loss FROM tok")
def value_loss_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir).select("event_id", F.round(policy.value_loss(F.col("new"), F.col("old"), F.col("r"), 0.05), 10).alias("loss"))


_SUM = "sum(CASE WHEN mask THEN old - rollout ELSE 0 END) OVER (PARTITION BY user_id)"
_CL = "greatest(least({}, 20), -20)"


@query(f"WITH {TOKENS} SELECT event_id, round(CASE WHEN mask THEN least(exp({_CL.format('old - rollout')}), 1.15) ELSE 0 END, 6) AS token_weight, round(CASE WHEN mask THEN least(exp({_CL.format(_SUM)}), 2.0) ELSE 0 END, 6) AS sequence_weight FROM tok")
def rollout_is_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = policy.rollout_weights(tokens(spark, sf_dir), ("user_id",), "old", "rollout", "mask", 1.15, "token").withColumnRenamed("weight", "token_weight")
    b = policy.rollout_weights(a, ("user_id",), "old", "rollout", "mask", 2.0, "sequence")
    return b.select("event_id", F.round("token_weight", 6).alias("token_weight"), F.round("weight", 6).alias("sequence_weight"))


def _rejection(level: str, ratio: str, veto: str = "") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return policy.rejection(tokens(spark, sf_dir), ("user_id",), "old", "rollout", "mask", 1.12, level=level, veto=0.83 if veto else None).select("event_id", "kept")

    run.__name__ = f"rejection_mask_{level}{'_veto' if veto else ''}"
    v = f" AND NOT coalesce(bool_or(mask AND exp(old - rollout) < 0.83) OVER (PARTITION BY user_id), false)" if veto else ""  # noqa: F541
    query(f"WITH {TOKENS} SELECT event_id, mask AND {ratio} BETWEEN 1 / 1.12::DOUBLE AND 1.12{v} AS kept FROM tok")(run)


_rejection("token", f"exp({_CL.format('old - rollout')})")
_rejection("sequence", f"exp({_CL.format(_SUM)})")
_rejection("geometric", f"exp({_CL.format(_SUM + ' / greatest(sum(mask::INT) OVER (PARTITION BY user_id), 1)')})")
_rejection("token", f"exp({_CL.format('old - rollout')})", veto="yes")


@query(
    f"""WITH {TOKENS}, q AS (SELECT user_id, coalesce(sum(old) FILTER (mask), 0) / (count(*) FILTER (mask) + 1e-8) AS o, coalesce(sum(rollout) FILTER (mask), 0) / (count(*) FILTER (mask) + 1e-8) AS r, coalesce(sum(old - rollout) FILTER (mask), 0) AS s,
 coalesce(sum(exp(old - rollout) - (old - rollout) - 1) FILTER (mask), 0) AS k3, coalesce(sum(exp(2 * {_CL.format('old - rollout')})) FILTER (mask), 0) AS c2, count(*) FILTER (mask) AS n FROM tok GROUP BY 1)
SELECT round(avg(exp(-o)), 5) AS training_ppl, round(avg(exp(-r)), 5) AS rollout_ppl, round(-sum(s) / (sum(n) + 1e-8), 5) AS kl, round(sum(k3) / (sum(n) + 1e-8), 5) AS k3_kl, round(avg(r - o), 5) AS log_ppl_diff, round(avg(abs(r - o)), 5) AS log_ppl_abs_diff,
 round(max(r - o), 5) AS log_ppl_diff_max, round(min(r - o), 5) AS log_ppl_diff_min, round(avg(exp(r - o)), 5) AS ppl_ratio, round(sum(c2) / (sum(n) + 1e-8) - 1, 5) AS chi2_token, round(avg(exp(2 * {_CL.format('s')})) - 1, 5) AS chi2_seq FROM q"""
)
def offpolicy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = policy.off_policy_report(tokens(spark, sf_dir), ("user_id",), "old", "rollout", "mask")
    return out.select(*(F.round(c, 5).alias(c) for c in out.columns))


@query(
    f"""WITH {TOKENS}, w AS (SELECT mask, exp(old - rollout) AS w, greatest(least(exp(old - rollout), 1.15), 1 / 1.15::DOUBLE) AS c FROM tok), a AS (SELECT count(*) FILTER (mask) + 1e-8 AS n, sum(w) FILTER (mask) AS s, min(w) FILTER (mask) AS lo, max(w) FILTER (mask) AS hi, count(*) FILTER (mask AND w > 1.15) AS h, count(*) FILTER (mask AND w < 1 / 1.15::DOUBLE) AS l, sum(c) FILTER (mask) AS c1, sum(c * c) FILTER (mask) AS c2 FROM w)
SELECT round(s / n, 6) AS mean, round(lo, 6) AS min, round(hi, 6) AS max, round(h / n, 6) AS share_high, round(l / n, 6) AS share_low, round(sqrt(greatest(c2 / n - (c1 / n) * (c1 / n), 0)), 6) AS std, round(1 / (c2 / n / ((c1 / n + 1e-8) * (c1 / n + 1e-8))), 6) AS effective_share FROM a"""
)
def is_weight_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tokens(spark, sf_dir).withColumn("w", F.exp(F.col("old") - F.col("rollout")))
    out = policy.weight_report(df, "w", "mask", 1.15)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query(
    f"""WITH {TOKENS}, k AS (SELECT user_id, mask, mask AND exp(old - rollout) BETWEEN 1 / 1.12::DOUBLE AND 1.12 AS kept FROM tok), r AS (SELECT user_id, bool_and(NOT kept) AS gone FROM k WHERE mask GROUP BY 1)
SELECT round(1 - (SELECT count(*) FILTER (kept)::DOUBLE / count(*) FILTER (mask) FROM k), 6) AS masked_token_share, round((SELECT avg(gone::INT) FROM r), 6) AS masked_row_share"""
)
def rejection_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = policy.rejection(tokens(spark, sf_dir), ("user_id",), "old", "rollout", "mask", 1.12).where("mask")
    rows = kept.groupBy("user_id").agg(F.count_if("kept").alias("k"), F.count("*").alias("n"))
    return rows.agg(F.round(1 - F.sum("k") / F.sum("n"), 6).alias("masked_token_share"), F.round(F.avg(F.when(F.col("k") == 0, 1.0).otherwise(0.0)), 6).alias("masked_row_share"))


@query(f"SELECT {_KEY}, round(least(-(l_quantity - (50 - 10)) / 10.0::DOUBLE * 1.5, 0), 6) AS penalty, round(l_tax + least(-(l_quantity - (50 - 10)) / 10.0::DOUBLE * 1.5, 0), 6) AS score FROM lineitem")
def overlong_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = policy.overlong_penalty(F.col("l_quantity"), 50, 10, 1.5)
    return table(spark, sf_dir, "lineitem").select(*KEY, F.round(p, 6).alias("penalty"), F.round(F.col("l_tax") + p, 6).alias("score"))


_PAIR = "(-1 - l_discount) AS c, (-1 - l_tax) AS j"


@query(
    f"""SELECT {_KEY}, round(-c + 0.1 * ln(1 + exp(-((c - j) - (ln(1 - exp(c)) - ln(1 - exp(j)))))), 6) AS orpo, round(ln(1 + exp(-(2.0 * (c - j - 0.5 / 2.0::DOUBLE)))), 6) AS simpo FROM (SELECT {_KEY}, {_PAIR} FROM lineitem)"""
)
def orpo_simpo_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, j = -1.0 - F.col("l_discount"), -1.0 - F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select(*KEY, F.round(policy.orpo_loss(c, j, 0.1), 6).alias("orpo"), F.round(policy.simpo_loss(c, j, 2.0, 0.5), 6).alias("simpo"))


@query(f"WITH {TOKENS}, q AS (SELECT user_id, sum(new - old) FILTER (mask) AS s, max(adv) AS r FROM tok GROUP BY 1 HAVING count(*) FILTER (mask) > 0) SELECT round(avg((s - 0.5 * r) * (s - 0.5 * r)), 5) AS loss FROM q")
def sppo_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.squared_ratio_loss(tokens(spark, sf_dir), ("user_id",), "new", "old", "mask", "adv", 0.5).select(F.round("loss", 5).alias("loss"))
