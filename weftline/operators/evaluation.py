"""Aggregates over scored responses: per-prompt statistics, votes, grading, text diversity, lengths, classification."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.batch import before


def mean_std_at_n(df: DataFrame, keys: list[str], uid: str, value: str) -> DataFrame:
    """Per prompt mean and population deviation of its responses, averaged over the prompts of each key."""
    per = df.groupBy(*keys, uid).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.count(value).alias("n"))
    return per.groupBy(*keys).agg(F.avg("m").alias("mean_at_n"), F.avg("s").alias("std_at_n"), F.count("*").alias("n_prompts"))


def best_worst_expected(df: DataFrame, keys: list[str], uid: str, value: str, n: int, order: tuple[str, ...] = ()) -> DataFrame:
    """Per prompt the expected largest and smallest of ``n`` draws with replacement, averaged over the prompts.

    With N sorted values the i-th is the largest of n draws with probability (i/N)^n - ((i-1)/N)^n.
    """
    w = Window.partitionBy(*keys, uid)
    i, size = F.row_number().over(w.orderBy(value, *order)), F.count(value).over(w)
    up = F.pow(i / size, F.lit(n)) - F.pow((i - 1) / size, F.lit(n))
    down = F.pow((size - i + 1) / size, F.lit(n)) - F.pow((size - i) / size, F.lit(n))
    weighted = df.select(*keys, uid, (F.col(value) * up).alias("b"), (F.col(value) * down).alias("w"))
    per = weighted.groupBy(*keys, uid).agg(F.sum("b").alias("b"), F.sum("w").alias("w"))
    return per.groupBy(*keys).agg(F.avg("b").alias("best"), F.avg("w").alias("worst"))


def bootstrap(df: DataFrame, uid: str, value: str, n: int, draws: int = 1000, seed: int = 42) -> DataFrame:
    """Per prompt mean and deviation, over ``draws`` resamples of n values with replacement, of their largest and
    smallest. The seed begins anew for each prompt, so prompts of one size share their draws; values are taken in
    ascending order, so the result is stable. How often a place is the largest or smallest of a draw depends on a
    prompt's size alone, so prompts of one size in a batch are a product of matrices; one that holds values that are
    not finite is resampled by itself."""

    def run(batches):
        drawn = lru_cache(maxsize=64)(lambda size: np.random.default_rng(seed).integers(0, size, size=(draws, n)))
        shares = lru_cache(maxsize=64)(lambda size: [np.bincount(edge(drawn(size), axis=1), minlength=size) / draws for edge in (np.max, np.min)])
        for b in batches:
            lists = b.column(1)
            flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            starts = np.cumsum(sizes) - sizes
            out = np.empty((4, len(sizes)))
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                values = np.sort(flat[starts[at][:, None] + np.arange(size)], axis=1)
                finite = np.isfinite(values).all(axis=1)
                plain = values[finite]
                gaps = plain - plain[:, :1]
                for k, share in enumerate(shares(size)):
                    mean = gaps @ share
                    out[2 * k, at[finite]] = plain[:, 0] + mean
                    out[2 * k + 1, at[finite]] = np.sqrt((gaps - mean[:, None]) ** 2 @ share)
                for i in np.flatnonzero(~finite).tolist():
                    pick = values[i][drawn(size)]
                    hi, lo = pick.max(axis=1), pick.min(axis=1)
                    out[:, at[i]] = hi.mean(), hi.std(), lo.mean(), lo.std()
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out)], [uid, "best_mean", "best_std", "worst_mean", "worst_std"])

    kind = dict(df.dtypes)[uid]
    values = F.collect_list(F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))).alias("_v")
    return df.groupBy(uid).agg(values).mapInArrow(run, f"{uid} {kind}, best_mean double, best_std double, worst_mean double, worst_std double")


def majority(df: DataFrame, uid: str, answer: str, value: str, order: tuple[str, ...]) -> DataFrame:
    """Per prompt the most frequent answer, the one seen first among equals, and the value of its first response."""
    first = F.min(F.struct(*order, F.col(value).alias("_v")))
    votes = df.groupBy(uid, answer).agg(F.count("*").alias("votes"), first.alias("f"))
    w = Window.partitionBy(uid).orderBy(F.desc("votes"), *(f"f.{c}" for c in order))
    return votes.withColumn("n", F.row_number().over(w)).where("n = 1").select(uid, F.col(answer).alias("majority"), "votes", F.col("f._v").alias("value"))


def grading(df: DataFrame, keys: list[str], uid: str, score: str, length: str, full: float = 1.0) -> DataFrame:
    """Per key: mean of prompts' mean and best scores, prompts none or all of whose responses are right, mean length."""
    per = df.groupBy(*keys, uid).agg(F.avg(score).alias("m"), F.max(score).alias("b"), F.min(score).alias("w"), F.sum(length).alias("len"), F.count("*").alias("n"))
    return per.groupBy(*keys).agg(
        F.avg("m").alias("mean_score"), F.avg("b").alias("best_score"), F.count_if(F.col("b") < full).alias("solve_none"), F.count_if(F.col("w") >= full).alias("solve_all"),
        (F.sum("len") / F.sum("n")).alias("avg_length"), F.count("*").alias("n_prompts"),
    )


def distinct_ngrams(df: DataFrame, key: str, text: str, n: int = 4) -> DataFrame:
    """Per key the distinct share of all word n-grams of its texts; 0 where there are none.

    A gram travels as two 64-bit hashes of its words' hashes. Grams are counted per key and gram first, so a frequent
    gram is one row of the second step.
    """
    words = F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    # shifted arrays side by side, so that what is done for each gram is compiled
    shifted = F.arrays_zip(*(F.slice("w", F.lit(k + 1), F.size("w") - n + 1).alias(f"w{k}") for k in range(n)))
    at = [F.col(f"g.w{k}") for k in range(n)]
    grams = df.select(key, words.alias("w")).where(F.size("w") >= n).select(key, F.explode(shifted).alias("g")).select(key, F.xxhash64(*at).alias("a"), F.xxhash64(F.lit(n), *reversed(at)).alias("b"))
    counts = grams.groupBy(key, "a", "b").agg(F.count("*").alias("c")).groupBy(key).agg((F.count("*") / F.sum("c")).alias("distinct_share"))
    return df.select(key).distinct().join(counts, key, "left").select(key, F.coalesce("distinct_share", F.lit(0.0)).alias("distinct_share"))


def length_cdf(df: DataFrame, length: str, interval: int) -> DataFrame:
    """Rows per length bucket with the running count and share. The window runs over buckets, not over rows."""
    buckets = df.groupBy((F.floor(F.col(length) / interval) * interval).alias("bucket")).agg(F.count("*").alias("n"))
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    return buckets.select("bucket", "n", F.sum("n").over(w).alias("cumulative"), (100.0 * F.sum("n").over(w) / F.sum("n").over(everything)).alias("percent"))


def by_name(name: Column, value: Column) -> Column:
    """Aggregate of a metric by words in its name: max, min, else mean."""
    return F.when(F.max(F.contains(name, F.lit("max"))), F.max(value)).when(F.max(F.contains(name, F.lit("min"))), F.min(value)).otherwise(F.avg(value))


def aggregate_steps(df: DataFrame, name: str, step: str, value: str, weight: str, last: tuple[str, ...] = (), total: tuple[str, ...] = ()) -> DataFrame:
    """Per metric one number over steps: listed names are the last value or the sum; otherwise the first word found in
    the name decides among avg, max, min, sum and weighted_avg (never reached, as it holds avg); else the mean."""
    n, v = F.col(name), F.col(value)
    has = lambda word: F.contains(n, F.lit(word))
    rule = F.when(n.isin(*last), "last").when(n.isin(*total), "sum").when(has("avg") | has("mean"), "avg").when(has("max"), "max").when(has("min"), "min").when(has("sum") | has("total"), "sum").otherwise("avg")
    g = df.withColumn("rule", rule).groupBy(name, "rule").agg(F.avg(v).alias("a"), F.max(v).alias("x"), F.min(v).alias("i"), F.sum(v).alias("s"), F.max_by(v, step).alias("l"))
    return g.select(name, "rule", F.when(F.col("rule") == "last", F.col("l")).when(F.col("rule") == "sum", F.col("s")).when(F.col("rule") == "max", F.col("x")).when(F.col("rule") == "min", F.col("i")).otherwise(F.col("a")).alias("value"))


def data_metrics(df: DataFrame, score: str, reward: str, advantage: str, returns: str, value: str, length: str, longest: float) -> DataFrame:
    """One row: extremes and means of the batch, share of clipped lengths, aborted rows, explained variance.

    Rows of no length are aborted and take no part in score and reward. Means of advantages leave zeros out.
    """
    ok, a = F.col(length) > 0, F.col(advantage)
    gap = F.col(returns) - F.col(value)
    out = [F.count_if(~ok).alias("n_aborted")]
    for c in (score, reward):
        x = F.when(ok, F.col(c))
        out += [F.avg(x).alias(f"{c}_mean"), F.max(x).alias(f"{c}_max"), F.min(x).alias(f"{c}_min")]
    out += [F.avg(F.when(a != 0, a)).alias("advantage_mean"), F.stddev_samp(F.when(a != 0, a)).alias("advantage_std"), F.max(a).alias("advantage_max"), F.min(a).alias("advantage_min"), F.avg(F.abs(a)).alias("advantage_abs_mean"), F.count_if(F.abs(a) > 5).alias("advantage_large")]
    out += [F.avg(length).alias("length_mean"), F.avg(F.when(F.col(length) == longest, 1.0).otherwise(0.0)).alias("length_clip_ratio"), (1.0 - F.var_samp(gap) / (F.var_samp(returns) + 1e-5)).alias("explained_variance")]
    return df.agg(*out)


def classification(df: DataFrame, truth: str, predicted: str, probability: str) -> DataFrame:
    """One row: accuracy, weighted F1 (0 where undefined), log-loss, AUC by ranks and squared error of a binary task.

    Ranks come from counts per distinct probability, summed up range by range, as there may be as many as rows.
    """
    cells = df.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    t, p, n = F.col(truth), F.col(predicted), F.col("n")
    per = []
    for k in (0, 1):
        tp, fp, fn = F.sum(F.when((t == k) & (p == k), n).otherwise(0)), F.sum(F.when((t != k) & (p == k), n).otherwise(0)), F.sum(F.when((t == k) & (p != k), n).otherwise(0))
        f1 = F.when(2 * tp + fp + fn == 0, 0.0).otherwise(2.0 * tp / (2 * tp + fp + fn))
        per.append(f1 * (tp + fn))
    table = cells.agg((F.sum(F.when(t == p, n).otherwise(0)) / F.sum("n")).alias("accuracy"), ((per[0] + per[1]) / F.sum("n")).alias("f1_weighted"))
    q = F.least(F.greatest(F.col(probability), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = df.agg(F.avg(-F.when(t == 1, F.ln(q)).otherwise(F.ln(1 - q))).alias("log_loss"), F.avg((t - p) ** 2).alias("mse"))
    steps = df.groupBy(probability).agg(F.count_if(t == 1).alias("pos"), F.count_if(t == 0).alias("neg"))
    steps = before(steps, [probability], F.col("neg"), "below")
    wins = steps.select((F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("u"), "pos", "neg")
    auc = wins.agg(F.when(F.sum("pos") * F.sum("neg") > 0, F.sum("u") / (F.sum("pos") * F.sum("neg"))).alias("auc"))
    return table.crossJoin(loss).crossJoin(auc)


def pairwise_preference(df: DataFrame, uid: str, position: tuple[str, ...], score: str, accuracy: str) -> DataFrame:
    """Mean over groups of how often two responses' order by score agrees with that by accuracy, each pair weighted by
    its difference in accuracy; 0.5 where all accuracies are equal.

    Pairs are made inside each group's arrays, so a row meets only its own group.
    """
    g = df.groupBy(uid).agg(F.sort_array(F.collect_list(F.struct(*position, F.col(score).alias("s"), F.col(accuracy).alias("a")))).alias("x"))

    def against(x: Column, i: Column) -> Column:
        rest = F.slice("x", i + 2, F.greatest(F.size("x") - i - 1, F.lit(0)))
        one = lambda acc, y: F.struct(
            (acc["hit"] + F.when((x["s"] - y["s"]) * (x["a"] - y["a"]) > 0, F.abs(x["a"] - y["a"])).otherwise(0.0)).alias("hit"), (acc["all"] + F.abs(x["a"] - y["a"])).alias("all")
        )
        return F.aggregate(rest, F.struct(F.lit(0.0).alias("hit"), F.lit(0.0).alias("all")), one)

    parts = g.where(F.size("x") > 1).select(uid, F.transform("x", against).alias("p"))
    total = lambda f: F.aggregate("p", F.lit(0.0), lambda acc, p: acc + p[f])
    return parts.select(uid, F.when(total("all") == 0, 0.5).otherwise(total("hit") / total("all")).alias("agreement"))


def contrastive(uid: str, score: str, accuracy: str) -> tuple[Column, Column]:
    """Mean score of the group's rows of lower and of higher accuracy than each row's; null where there are none."""
    w = Window.partitionBy(uid).orderBy(accuracy)
    low = w.rangeBetween(Window.unboundedPreceding, -1)
    high = w.rangeBetween(1, Window.unboundedFollowing)
    return F.avg(score).over(low), F.avg(score).over(high)
