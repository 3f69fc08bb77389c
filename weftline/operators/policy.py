"""Policy, value and preference losses, divergences, off-policy weights and diagnostics, as Columns and aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.binding import let
from weftline.operators.batch import before, with_position
from weftline.operators.groupstats import scalars


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def kl_penalty(log_prob: Column, reference: Column, kind: str) -> Column:
    """kl / k1: difference; abs; mse / k2: half its square; low_var_kl / k3: exp(-d) + d - 1, clamped."""
    d = log_prob - reference
    if kind in ("kl", "k1"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("mse", "k2"):
        return 0.5 * d * d
    if kind in ("low_var_kl", "k3"):
        back = clamp(-d, -20.0, 20.0)
        return clamp(F.exp(back) - back - 1.0, -10.0, 10.0)
    raise ValueError(f"unknown penalty {kind}")


def dual_clip_loss(new: Column, old: Column, advantage: Column, low: float = 0.2, high: float = 0.2, bound: float = 3.0) -> Column:
    """Clipped ratio loss; for negative advantages at most ``bound`` times the advantage."""
    ratio = F.exp(clamp(new - old, -20.0, 20.0))
    loss = F.greatest(-advantage * ratio, -advantage * clamp(ratio, 1 - low, 1 + high))
    return F.when(advantage < 0, F.least(-advantage * bound, loss)).otherwise(loss)


def clip_share(new: Column, old: Column, advantage: Column, low: float = 0.2, high: float = 0.2) -> Column:
    """Whether the clipped term is the larger one."""
    ratio = F.exp(clamp(new - old, -20.0, 20.0))
    return -advantage * clamp(ratio, 1 - low, 1 + high) > -advantage * ratio


def sequence_ratio_loss(df: DataFrame, row: tuple[str, ...], new: str, old: str, advantage: str, mask: str, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """Per row the clipped loss of the geometric mean ratio (exponent at most 10), averaged over its tokens."""
    m = F.col(mask).cast("double")
    rows = df.groupBy(*row).agg((F.sum((F.col(new) - F.col(old)) * m) / F.greatest(F.sum(m), F.lit(1.0))).alias("lr"), (F.sum(F.col(advantage) * m)).alias("a"), F.sum(m).alias("n"), F.collect_list(F.when(m == 1, F.col(advantage))).alias("each"))
    ratio = F.exp(F.least(F.col("lr"), F.lit(10.0)))
    loss = F.aggregate("each", F.lit(0.0), lambda s, a: s + F.greatest(-a * ratio, -a * clamp(ratio, 1 - low, 1 + high)))
    return rows.select(*row, (loss / (F.col("n") + 1e-8)).alias("loss"))


def geometric_loss(df: DataFrame, row: tuple[str, ...], new: str, old: str, advantage: str, mask: str, low: float = 0.4, high: float = 0.4) -> DataFrame:
    """Per row minus the mean advantage times the geometric mean of ratios that are clamped on the advantage's side."""
    m = F.col(mask).cast("double")
    sign = F.signum(advantage)
    moved = (F.col(new) - F.col(old)) * sign
    kept = F.least(moved, clamp(moved, -low, high)) * sign
    rows = df.groupBy(*row).agg(F.sum(kept * m).alias("s"), F.sum(m).alias("n"), F.sum(F.col(advantage) * m).alias("a"))
    ratio = F.exp(F.col("s") / (F.col("n") + 1e-8))
    return rows.select(*row, (-(F.col("a") / (F.col("n") + 1e-8)) * ratio).alias("loss"))


def covariance(df: DataFrame, log_prob: str, advantage: str, mask: str) -> DataFrame:
    """Adds ``cov``: the product of a token's advantage and log-probability, each less its mean over valid tokens."""
    valid = F.when(F.col(mask), F.lit(1))
    out = scalars(df, _a=F.avg(F.col(advantage) * valid), _l=F.avg(F.col(log_prob) * valid))
    return out.withColumn("cov", F.when(F.col(mask), (F.col(advantage) - F.col("_a")) * (F.col(log_prob) - F.col("_l")))).drop("_a", "_l")


def clip_cov(df: DataFrame, key: tuple[str, ...], new: str, old: str, advantage: str, mask: str, ratio: float = 0.0002, lower: float = 1.0, upper: float = 5.0, low: float = 0.2, high: float = 0.2, seed: int = 0) -> DataFrame:
    """Adds ``dropped`` and ``loss``: the clipped ratio loss of each token, 0 for those that are dropped.

    Dropped is a random subset, of ``ratio`` of the valid tokens (one at least), of the valid tokens that the ratio's
    clip leaves and whose covariance of advantage and log-probability lies between the bounds (neither included). The
    subset is those of the smallest MD5 of seed and key, so it is the same in every run; the ranks of the hashes are
    counted range by range, and only keys travel. Of a repeated key all rows are dropped, or none. Without valid tokens
    nothing is dropped; losses of tokens outside the mask are null.
    """
    valid = F.col(mask)
    c = covariance(df, new, advantage, mask).withColumn("cov", F.round("cov", 9))
    ratio_ = F.exp(F.col(new) - F.col(old))
    clipped, plain = -F.col(advantage) * clamp(ratio_, 1 - low, 1 + high), -F.col(advantage) * ratio_
    tokens = df.agg(F.count_if(valid)).first()[0]
    count = max(int(ratio * tokens), 1)
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in key))
    band = c.where(valid & (clipped <= plain) & (F.col("cov") > lower) & (F.col("cov") < upper)).select(*key, F.md5(text).alias("_hash")).distinct()
    chosen = with_position(band, ["_hash", *key], "_rank").where(F.col("_rank") < count).select(*key, F.lit(True).alias("dropped"))
    out = df.join(chosen, list(key), "left").withColumn("dropped", F.coalesce("dropped", F.lit(False)))
    return out.withColumn("loss", F.when(valid, F.when(F.col("dropped"), 0.0).otherwise(F.greatest(plain, clipped))))


#: Token losses by name: (new, old, advantage) log-probabilities and advantage -> Column. Further arguments have defaults.
LOSSES: dict[str, Callable[..., Column]] = {}


def loss(name: str):
    """Registers a token loss; a name is given once."""

    def register(f: Callable[..., Column]):
        if name in LOSSES:
            raise ValueError(f"loss {name} is registered already")
        LOSSES[name] = f
        return f

    return register


def get_loss(name: str) -> Callable[..., Column]:
    if name not in LOSSES:
        raise ValueError(f"unknown loss {name}; known: {', '.join(sorted(LOSSES))}")
    return LOSSES[name]


loss("vanilla")(dual_clip_loss)


@loss("gpg")
def gradient_loss(new: Column, old: Column, advantage: Column) -> Column:
    """The plain policy gradient; the old policy has no part in it."""
    return -advantage * new


@loss("direct")
def direct_ratio_loss(new: Column, old: Column, advantage: Column) -> Column:
    """The unclipped ratio; the log-ratio lies within 20 on both sides."""
    return -advantage * F.exp(clamp(new - old, -20.0, 20.0))


def value_loss(value: Column, old: Column, returns: Column, clip: float = 0.5) -> Column:
    near = F.greatest(F.least(value, old + clip), old - clip)
    return 0.5 * F.greatest((value - returns) ** 2, (near - returns) ** 2)


def overlong_penalty(length: Column, longest: int, buffer: int, factor: float) -> Column:
    return F.least(-(length - (longest - buffer)) / float(buffer) * factor, F.lit(0.0))


def rollout_weights(df: DataFrame, row: tuple[str, ...], old: str, rollout: str, mask: str, threshold: float, level: str) -> DataFrame:
    """Per token the importance weight of its token or its whole row, at most ``threshold``; 0 outside the mask."""
    from pyspark.sql import Window

    lr, m = F.col(old) - F.col(rollout), F.col(mask).cast("double")
    if level == "token":
        raw = lr
    elif level == "sequence":
        raw = F.sum(lr * m).over(Window.partitionBy(*row))
    else:
        raise ValueError(f"unknown level {level}")
    return df.withColumn("weight", F.least(F.exp(clamp(raw, -20.0, 20.0)), F.lit(threshold)) * m)


def rejection(df: DataFrame, row: tuple[str, ...], old: str, rollout: str, mask: str, upper: float, lower: float | None = None, level: str = "token", veto: float | None = None) -> DataFrame:
    """The mask without tokens (or rows) whose ratio leaves [lower, upper]; a token below ``veto`` drops its row."""
    from pyspark.sql import Window

    lower = 1.0 / upper if lower is None else lower
    w = Window.partitionBy(*row)
    lr, m = F.col(old) - F.col(rollout), F.col(mask).cast("double")
    total = F.sum(lr * m).over(w)
    raw = {"token": lr, "sequence": total, "geometric": total / F.greatest(F.sum(m).over(w), F.lit(1.0))}[level]
    ratio = F.exp(clamp(raw, -20.0, 20.0))
    keep = F.col(mask) & (ratio >= lower) & (ratio <= upper)
    if veto is not None:
        keep = keep & ~F.bool_or(F.col(mask) & (F.exp(lr) < veto)).over(w)
    return df.withColumn("kept", keep)


def corrected_loss(df: DataFrame, row: tuple[str, ...], new: str, rollout: str, advantage: str, mask: str, threshold: float | None = None, level: str = "token", upper: float | None = None, lower: float | None = None, rejected_by: str = "token", veto: float | None = None) -> DataFrame:
    """Adds ``weight``, ``kept`` and ``loss`` of the pure policy gradient on another policy's tokens: minus advantage
    times log-probability times the importance weight of the current policy over the rollout's (1 without a
    ``threshold``), of the tokens that the rejection keeps (all of the mask without ``upper``); null for others."""
    out = df.withColumn("weight", F.col(mask).cast("double")) if threshold is None else rollout_weights(df, row, new, rollout, mask, threshold, level)
    out = out.withColumn("kept", F.col(mask)) if upper is None else rejection(out, row, new, rollout, mask, upper, lower, rejected_by, veto)
    return out.withColumn("loss", F.when(F.col("kept"), -F.col(advantage) * F.col(new) * F.col("weight")))


def entropy(logits: Column) -> Column:
    """The entropy of the distribution that an array of logits gives: their log-sum-exp less their mean under it. The
    largest is taken off first. Null for a null or empty array, or one with nulls."""

    def of(c: Column) -> Column:
        total = F.aggregate(c, F.lit(0.0), lambda s, x: s + F.exp(x))
        mean = F.aggregate(c, F.lit(0.0), lambda s, x: s + F.exp(x) * x)
        return let(total, lambda t: F.log(t) - mean / t)

    known = F.when((F.size(logits) > 0) & F.forall(logits, lambda x: x.isNotNull()), logits)
    return let(known, lambda v: let(F.transform(v, lambda x: x.cast("double") - F.array_max(v)), of))


def off_policy_report(df: DataFrame, row: tuple[str, ...], old: str, rollout: str, mask: str) -> DataFrame:
    """One row of divergences between the training policy (``old``) and the policy that produced the tokens."""
    m = F.col(mask).cast("double")
    lr = F.col(old) - F.col(rollout)
    rows = df.groupBy(*row).agg(
        (F.sum(F.col(old) * m) / (F.sum(m) + 1e-8)).alias("o"),
        (F.sum(F.col(rollout) * m) / (F.sum(m) + 1e-8)).alias("r"),
        F.sum(lr * m).alias("s"),
        F.sum((F.exp(lr) - lr - 1.0) * m).alias("k3"),
        F.sum(F.exp(2.0 * clamp(lr, -20.0, 20.0)) * m).alias("c2"),
        F.sum(m).alias("n"),
    )
    d = F.col("r") - F.col("o")
    n = F.sum("n") + 1e-8
    return rows.agg(
        F.avg(F.exp(-F.col("o"))).alias("training_ppl"),
        F.avg(F.exp(-F.col("r"))).alias("rollout_ppl"),
        (-F.sum("s") / n).alias("kl"),
        (F.sum("k3") / n).alias("k3_kl"),
        F.avg(d).alias("log_ppl_diff"),
        F.avg(F.abs(d)).alias("log_ppl_abs_diff"),
        F.max(d).alias("log_ppl_diff_max"),
        F.min(d).alias("log_ppl_diff_min"),
        F.avg(F.exp(d)).alias("ppl_ratio"),
        (F.sum("c2") / n - 1.0).alias("chi2_token"),
        (F.avg(F.exp(2.0 * clamp(F.col("s"), -20.0, 20.0))) - 1.0).alias("chi2_seq"),
    )


def weight_report(df: DataFrame, weight: str, mask: str, threshold: float) -> DataFrame:
    """One row: mean, deviation, extremes, share over the threshold and effective sample share of masked weights."""
    m = F.col(mask).cast("double")
    w = clamp(F.col(weight), 1.0 / threshold, threshold)
    n = F.sum(m) + 1e-8
    s = df.agg(
        (F.sum(F.col(weight) * m) / n).alias("mean"),
        F.min(F.when(F.col(mask), F.col(weight))).alias("min"),
        F.max(F.when(F.col(mask), F.col(weight))).alias("max"),
        (F.sum(F.when(F.col(weight) > threshold, 1.0).otherwise(0.0) * m) / n).alias("share_high"),
        (F.sum(F.when(F.col(weight) < 1.0 / threshold, 1.0).otherwise(0.0) * m) / n).alias("share_low"),
        (F.sum(w * m) / n).alias("_m"),
        (F.sum(w * w * m) / n).alias("_q"),
    )
    m1, q = F.col("_m"), F.col("_q")
    return s.select("mean", "min", "max", "share_high", "share_low", F.sqrt(F.greatest(q - m1 * m1, F.lit(0.0))).alias("std"), (1.0 / (q / ((m1 + 1e-8) * (m1 + 1e-8)))).alias("effective_share"))


def log_sigmoid(x: Column) -> Column:
    return -F.log1p(F.exp(-x))


def orpo_loss(chosen: Column, rejected: Column, beta: float) -> Column:
    odds = (chosen - rejected) - (F.log1p(-F.exp(chosen)) - F.log1p(-F.exp(rejected)))
    return -chosen + beta * -log_sigmoid(odds)


def simpo_loss(chosen: Column, rejected: Column, beta: float, margin: float) -> Column:
    return -log_sigmoid(beta * (chosen - rejected - margin / beta))


def bco_loss(df: DataFrame, batch: str, chosen: str, rejected: str, reference_chosen: str, reference_rejected: str, beta: float = 0.1) -> DataFrame:
    """Adds ``baseline`` and ``loss``: each pair's rewards against the running mean of its batch's and all earlier
    batches' mean rewards. Batches are ordered by ``batch``; their running sums and numbers are counted range by range
    over one row a batch. Pairs with a null count for no mean and have no loss; a null batch is no batch."""
    good, bad = (beta * (F.col(a) - F.col(b)) for a, b in ((chosen, reference_chosen), (rejected, reference_rejected)))
    means = df.where(F.col(batch).isNotNull()).groupBy(batch).agg(F.avg((good + bad) / 2).alias("_mean")).where("_mean is not null")
    placed = with_position(before(means, [batch], F.col("_mean"), "_sum"), [batch], "_n")
    running = placed.select(batch, ((F.col("_sum") + F.col("_mean")) / (F.col("_n") + 1)).alias("baseline"))
    return df.join(running, batch, "left").withColumn("loss", -log_sigmoid(good - F.col("baseline")) - log_sigmoid(-(bad - F.col("baseline"))))


def squared_ratio_loss(df: DataFrame, row: tuple[str, ...], new: str, old: str, mask: str, reward: str, eta: float) -> DataFrame:
    """One row: mean over rows with tokens of (summed log-ratio - eta * reward) squared."""
    m = F.col(mask).cast("double")
    rows = df.groupBy(*row).agg(F.sum((F.col(new) - F.col(old)) * m).alias("s"), F.sum(m).alias("n"), F.max(reward).alias("r")).where("n > 0")
    return rows.agg(F.avg((F.col("s") - eta * F.col("r")) ** 2).alias("loss"))
