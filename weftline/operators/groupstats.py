"""Group-relative statistics of scored rows: advantages, whitening, loss aggregation.

Rows hold a group (``uid``), a score and, for some, a length. Advantages are Columns over a window of the group, so
one shuffle by the group serves any number of them; Spark spills a group that does not fit in memory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6
#: Estimators by name: (uid, score, length) -> Column.
ESTIMATORS: dict[str, Callable[..., Column]] = {}


def estimator(name: str):
    def register(f):
        if name in ESTIMATORS:
            raise ValueError(f"estimator {name} is registered already")
        ESTIMATORS[name] = f
        return f

    return register


def get_estimator(name: str) -> Callable[..., Column]:
    if name not in ESTIMATORS:
        raise ValueError(f"unknown estimator {name}; known: {', '.join(sorted(ESTIMATORS))}")
    return ESTIMATORS[name]


def _group(uid: str) -> Window:
    return Window.partitionBy(uid)


def mean_std(uid: str, score: str) -> tuple[Column, Column, Column]:
    """Mean, sample deviation and size of a row's group; a single row has mean 0 and deviation 1."""
    w = _group(uid)
    n = F.count(score).over(w)
    return F.when(n == 1, 0.0).otherwise(F.avg(score).over(w)), F.when(n == 1, 1.0).otherwise(F.stddev_samp(score).over(w)), n


@estimator("grpo")
def grpo(uid: str, score: str, length: str | None = None, scale: bool = True) -> Column:
    mean, std, _ = mean_std(uid, score)
    centred = F.col(score) - mean
    return centred / (std + EPS) if scale else centred


@estimator("grpo_vectorized")
def grpo_floored(uid: str, score: str, length: str | None = None) -> Column:
    """As grpo, with the variance at least EPS instead of an addend."""
    w = _group(uid)
    n = F.count(score).over(w)
    std = F.sqrt(F.greatest(F.var_samp(score).over(w), F.lit(EPS)))
    return F.when(n == 1, F.col(score)).otherwise((F.col(score) - F.avg(score).over(w)) / (std + EPS))


@estimator("grpo_passk")
def passk(uid: str, score: str, length: str | None = None, order: tuple[str, ...] = ()) -> Column:
    """The best row gets its lead over the second best, in deviations; the others get 0. Groups of one get null."""
    w = _group(uid)
    ranked = w.orderBy(F.desc(score), *order)
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lead = F.first(score).over(whole) - F.nth_value(score, 2).over(whole)
    best = F.row_number().over(ranked) == 1
    return F.when(F.count(score).over(w) < 2, None).when(best, lead / (F.stddev_samp(score).over(w) + EPS)).otherwise(0.0)


@estimator("rloo")
def rloo(uid: str, score: str, length: str | None = None) -> Column:
    """Score less the mean of the group's other rows; a single row keeps its score."""
    w = _group(uid)
    n, total = F.count(score).over(w), F.sum(score).over(w)
    return F.when(n == 1, F.col(score)).otherwise(F.col(score) - (total - F.col(score)) / (n - 1))


@estimator("rloo_vectorized")
def rloo_zero(uid: str, score: str, length: str | None = None) -> Column:
    """As rloo, but a single row gets 0."""
    return F.when(F.count(score).over(_group(uid)) == 1, 0.0).otherwise(rloo(uid, score))


@estimator("opo")
def opo(uid: str, score: str, length: str) -> Column:
    """Score less the group's mean weighted by length; a single row keeps its score."""
    w = _group(uid)
    base = F.sum(F.col(length) * F.col(score)).over(w) / F.sum(length).over(w)
    return F.col(score) - F.when(F.count(score).over(w) == 1, 0.0).otherwise(base)


@estimator("baseline")
def minus_mean(uid: str, score: str, length: str | None = None) -> Column:
    mean, _, _ = mean_std(uid, score)
    return F.col(score) - mean


def scalars(df: DataFrame, **aggregates: Column) -> DataFrame:
    """``df`` with each aggregate of all its rows as a column: partial sums, then one row that is joined to all."""
    return df.crossJoin(F.broadcast(df.agg(*(c.alias(n) for n, c in aggregates.items()))))


def gpg(df: DataFrame, uid: str, score: str, f_norm: float = 1.0) -> DataFrame:
    """Adds ``advantage``: rows over rows of non-zero score, times the score less its group's mean."""
    mean, _, _ = mean_std(uid, score)
    out = scalars(df, _n=F.count("*"), _hit=F.greatest(F.count_if(F.col(score) != 0), F.lit(1)))
    return out.withColumn("advantage", F.col("_n") / F.col("_hit") * (F.col(score) - mean) / f_norm).drop("_n", "_hit")


def whiten(df: DataFrame, value: str, mask: str, shift_mean: bool = True) -> DataFrame:
    """Adds ``whitened``: values less the masked mean over the root of the masked variance (Bessel-corrected).

    Fails like a division by zero where fewer than two values are masked in: the result is null.
    """
    v, m = F.col(value), F.col(mask).cast("double")
    first = scalars(df, _s=F.sum(m), _mean=F.sum(v * m) / (F.sum(m) + 1e-8))
    second = scalars(first, _var=F.sum((v - F.col("_mean")) ** 2 * m) / (F.max("_s") + 1e-8))
    var = F.when(F.col("_s") > 1, F.col("_var") * F.col("_s") / (F.col("_s") - 1))
    out = (v - F.col("_mean")) / F.sqrt(var + 1e-8)
    return second.withColumn("whitened", out if shift_mean else out + F.col("_mean")).drop("_s", "_mean", "_var")


def group_stats(df: DataFrame, uid: str, score: str) -> DataFrame:
    """Per group mean, deviation (variance at least EPS) and size; a single row has mean 0 and deviation 1."""
    n = F.count(score)
    return df.groupBy(uid).agg(
        F.when(n == 1, 0.0).otherwise(F.avg(score)).alias("mean"),
        F.when(n == 1, 1.0).otherwise(F.sqrt(F.greatest(F.var_samp(score), F.lit(EPS)))).alias("std"),
        n.alias("n"),
    )


def varied_groups(uid: str, metric: str) -> Column:
    """Whether a row's group has metric values that differ, or is a single row."""
    w = _group(uid)
    return (F.stddev_pop(metric).over(w) > 0) | (F.count(metric).over(w) == 1)


def token_group(uid: str, row: tuple[str, ...], t: str, reward: str, mask: str) -> Column:
    """Token rewards normalised over all masked-in tokens of the group, summed from each token to the row's end."""
    w = _group(uid)
    r = F.when(F.col(mask), F.col(reward))
    n = F.count(r).over(w)
    mean = F.when(n <= 1, 0.0).otherwise(F.avg(r).over(w))
    std = F.when(n <= 1, 1.0).otherwise(F.stddev_samp(r).over(w))
    return F.when(F.col(mask), (F.col(reward) - mean) / (std + EPS)).otherwise(0.0)


def to_end(row: tuple[str, ...], t: str, value: Column) -> Column:
    """Sum of a value from each token to its row's end."""
    return F.sum(value).over(Window.partitionBy(*row).orderBy(t).rowsBetween(Window.currentRow, Window.unboundedFollowing))


def before_first(row: tuple[str, ...], t: str, event: Column) -> Column:
    """Whether a token stands before the row's first event or is that event: a mask of the response."""
    seen = F.sum(event.cast("int")).over(Window.partitionBy(*row).orderBy(t).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return seen - event.cast("int") == 0


def discounted(rewards: Column, masks: Column, gamma: float) -> Column:
    """Discounted returns from each place to the end; the running return is reset where the mask is 0.

    Arrays of one row: the recursion runs over a row's own tokens only.
    """
    pairs = F.reverse(F.arrays_zip(rewards.alias("r"), masks.alias("m")))
    start = F.struct(F.lit(0.0).alias("run"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        now = x["r"] + gamma * acc["run"]
        return F.struct((now * x["m"]).alias("run"), F.array_append(acc["out"], now).alias("out"))

    return F.reverse(F.aggregate(pairs, start, step, lambda acc: acc["out"]))


def gae(rewards: Column, values: Column, masks: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages of one row's tokens, before whitening; masked-out tokens hand the state on."""
    tokens = F.reverse(F.arrays_zip(rewards.alias("r"), values.alias("v"), masks.alias("m")))
    start = F.struct(F.lit(0.0).alias("next"), F.lit(0.0).alias("last"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        delta = x["r"] + gamma * acc["next"] - x["v"]
        last = delta + gamma * lam * acc["last"]
        keep = x["m"] == 1
        return F.struct(
            F.when(keep, x["v"]).otherwise(acc["next"]).alias("next"),
            F.when(keep, last).otherwise(acc["last"]).alias("last"),
            F.array_append(acc["out"], F.when(keep, last).otherwise(acc["last"])).alias("out"),
        )

    return F.reverse(F.aggregate(tokens, start, step, lambda acc: acc["out"]))


def token_direct(df: DataFrame, reward: str, mask: str) -> DataFrame:
    """Adds ``direct``: a token's own reward as its advantage, 0 outside the mask. A reward may be an array, one for each
    of a token's candidates; the mask then holds for all of them."""
    zero = lambda x: F.when(F.col(mask), x).otherwise(0.0)
    is_array = dict(df.dtypes)[reward].startswith("array")
    return df.withColumn("direct", F.transform(reward, zero) if is_array else zero(F.col(reward)))


def token_direct_plus_group(df: DataFrame, uid: str, row: tuple[str, ...], reward: str, mask: str, outcome: str | None = None, weight: float = 1.0, scale: bool = True) -> DataFrame:
    """Adds ``direct`` and ``advantage``: the direct advantage and ``weight`` times the group's, which is the sum of a
    row's outcomes (``outcome``, else the rewards) against those of the rows of its ``uid``; 0 outside the mask. Groups
    are counted over one line a row, so a long row or a large group is not one window of tokens."""
    rows = df.groupBy(uid, *(c for c in row if c != uid)).agg(F.sum(outcome or reward).alias("_score"))
    groups = rows.groupBy(uid).agg(F.count("_score").alias("_n"), F.avg("_score").alias("_mean"), F.stddev_samp("_score").alias("_std"))
    z = F.when(F.col("_n") == 1, F.col("_score")).otherwise(F.col("_score") - F.col("_mean"))
    z = z / (F.when(F.col("_n") == 1, 1.0).otherwise(F.col("_std")) + EPS) if scale else z
    scored = rows.join(groups, uid).select(uid, *(c for c in row if c != uid), z.alias("_z"))
    out = token_direct(df, reward, mask).join(scored, list(dict.fromkeys([uid, *row])))
    return out.withColumn("advantage", F.when(F.col(mask), F.col("direct") + weight * F.col("_z")).otherwise(0.0)).drop("_z")


def loss_modes(df: DataFrame, row: tuple[str, ...], loss: str, mask: str, norm: float) -> DataFrame:
    """One row: the four ways to bring token losses to one number."""
    m = F.col(mask).cast("double")
    rows = df.groupBy(*row).agg(F.sum(F.col(loss) * m).alias("s"), F.sum(m).alias("n"))
    return rows.agg(
        (F.sum("s") / F.sum("n")).alias("token_mean"),
        F.avg("s").alias("seq_mean_token_sum"),
        F.avg(F.col("s") / (F.col("n") + 1e-8)).alias("seq_mean_token_mean"),
        (F.sum("s") / norm).alias("seq_mean_token_sum_norm"),
    )
