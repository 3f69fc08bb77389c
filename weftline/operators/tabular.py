"""Feature tables: target, imputation, scaling, encoding, gates for a new column, profile, and the search loop."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.batch import KNOWN_ROWS, before, with_position
from weftline.sources.shared import checkpointed, stored

TARGET_NAMES = ("target", "label", "class", "y")


def find_target(columns: list[str], asked: str | None = None) -> str:
    """The asked column, else one with a usual name, else one that holds such a name, else the last."""
    if asked:
        if asked not in columns:
            raise ValueError(f"no column {asked}")
        return asked
    low = {c.lower(): c for c in reversed(columns)}
    for name in TARGET_NAMES:
        if name in low:
            return low[name]
    return next((c for c in columns for name in TARGET_NAMES[:3] if name in c.lower()), columns[-1])


def task_type(df: DataFrame, target: str) -> str:
    """regression for a numeric target of more than max(20, root of the rows) values, else classification."""
    if dict(df.dtypes)[target] == "string":
        return "classification"
    n, distinct = df.agg(F.count("*"), F.count_distinct(target)).first()
    return "regression" if distinct > max(20, math.isqrt(n)) else "classification"


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """(name, n, q): for each column its number of values and its quantiles at ``shares``, between neighbours by linear
    interpolation, exact, of any number of rows.

    No task holds a column: different values are counted first, so that a value of many rows is one, and the counts
    before each are summed range by range; the values at the places asked for are then picked. Nulls don't count, NaN is
    larger than all; a column without values has none.
    """
    long_ = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("x.*")
    counts = checkpointed(long_.where("v is not null").groupBy("name", "v").agg(F.count("*").alias("c")))
    placed = before(counts, ["name", "v"], F.col("c"), "b")
    sizes = counts.groupBy("name").agg(F.sum("c").alias("n"))  # a row a column
    starts = sizes.withColumn("start", F.sum("n").over(Window.orderBy("name").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    own = F.col("b") - F.col("start")
    at = lambda place: F.max(F.when((own <= place) & (place < own + F.col("c")), F.col("v")))
    places = [(F.col("n") - 1) * F.lit(float(s)) for s in shares]
    picked = placed.join(F.broadcast(starts), "name").groupBy("name", "n").agg(*(at(f(p)).alias(f"{k}{i}") for i, p in enumerate(places) for k, f in (("l", F.floor), ("h", F.ceil))))
    between = [F.when(F.col(f"l{i}") == F.col(f"h{i}"), F.col(f"l{i}")).otherwise(F.col(f"l{i}") + (F.col(f"h{i}") - F.col(f"l{i}")) * (p - F.floor(p))) for i, p in enumerate(places)]
    return picked.select("name", "n", F.array(*between).alias("q"))


def scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns with nulls as the median (0 if all are null), then in [0, 1]; constant ones are 0.

    One aggregate finds all extremes; its row is joined to every row. Medians are found as in ``quantiles``.
    """
    middle = {r.name: r.q[0] for r in quantiles(df, columns, [0.5]).collect()}  # a row a column
    stats = df.agg(*(F.lit(middle.get(c, 0.0)).alias(f"_m{i}") for i, c in enumerate(columns)), *(F.min(c).alias(f"_l{i}") for i, c in enumerate(columns)), *(F.max(c).alias(f"_h{i}") for i, c in enumerate(columns)))
    out = df.crossJoin(F.broadcast(stats))
    for i, c in enumerate(columns):
        low, high = F.coalesce(f"_l{i}", F.lit(0.0)), F.coalesce(f"_h{i}", F.lit(0.0))
        v = F.coalesce(F.col(c).cast("double"), F.col(f"_m{i}"))
        out = out.withColumn(c, F.when(high == low, 0.0).otherwise((v - low) / (high - low)))
    return out.drop(*(f"_{k}{i}" for k in "mlh" for i in range(len(columns))))


def encoded(df: DataFrame, column: str) -> DataFrame:
    """The column as codes of its distinct strings in order; null is the string 'missing'. The distinct strings, as
    many as rows at worst, are found once and numbered range by range; up to KNOWN_ROWS are sent to all tasks."""
    v = F.coalesce(F.col(column).cast("string"), F.lit("missing"))
    codes = checkpointed(with_position(checkpointed(df.select(v.alias("_v")).distinct()), ["_v"], "_c").withColumn("_c", F.col("_c").cast("int")))
    if codes.count() <= KNOWN_ROWS:
        codes = F.broadcast(codes)
    return df.withColumn("_v", v).join(codes, "_v").withColumn(column, F.col("_c")).drop("_v", "_c")


def gates(df: DataFrame, candidate: Column, old: list[str]) -> DataFrame:
    """One row: counts of nulls, NaNs and infinities of a new column, whether it varies, the number of old columns
    that it equals, and whether it passes. All come from one aggregate."""
    c = candidate.cast("double")
    checks = df.select(c.alias("_new"), *old).agg(
        F.count_if(F.col("_new").isNull()).alias("n_null"), F.count_if(F.isnan("_new")).alias("n_nan"), F.count_if(F.abs("_new") == float("inf")).alias("n_infinite"),
        (F.min("_new") < F.max("_new")).alias("varies"), sum((F.bool_and(F.col("_new").eqNullSafe(F.col(o).cast("double"))).cast("int") for o in old), F.lit(0)).alias("n_equal"),
    )
    return checks.withColumn("passes", (F.col("n_null") + F.col("n_nan") + F.col("n_infinite") + F.col("n_equal") == 0) & F.col("varies"))


def proposal(round_: int, a: str, b: str) -> Column:
    """The mock's features by round: ratio, difference, product, square; a ratio by 0 is 0."""
    x, y = F.col(a), F.col(b)
    return (F.when(y != 0, x / y).otherwise(0.0), x - y, x * y, x * x)[round_ % 4]


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column count, mean, sample deviation, extremes and quartiles (linear)."""
    long_ = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("x.*")
    plain = long_.groupBy("name").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    q = F.broadcast(quantiles(df, columns, [0.25, 0.5, 0.75]).select("name", "q"))  # a row a column
    return plain.join(q, "name", "left").select("name", "n", "mean", "std", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max")


def improved(before: dict[str, float], after: dict[str, float], task: str, least: float = 1e-4) -> bool:
    """Whether a metric gained more than ``least``: accuracy, f1 and auc upwards, log-loss and mse downwards."""
    up = ("accuracy", "f1", "auc") if task == "classification" else ()
    down = ("log_loss", "mse") if task == "classification" else ("mse",)
    gains = [after[k] - before[k] for k in up if k in before and k in after] + [before[k] - after[k] for k in down if k in before and k in after]
    return any(g > least for g in gains)


def folded(df: DataFrame, target: str, key: str, folds: int = 3) -> DataFrame:
    """``df`` with its stratified fold (``_fold``), by the hash of a key; rows are written once to the shared folder."""
    from weftline.operators.batch import stratified_fold

    return stratified_fold(df, target, key, folds, "_fold")


def counted(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """The different rows of a table that ``folded`` made, each with its number (``_rows``), written to the shared folder.
    Trees of these rows with that weight are trees of all rows. Spark's trees draw the rows among which they look for
    thresholds by their places, so up to KNOWN_ROWS rows are put in order, for the same trees in every run."""
    columns = list(dict.fromkeys(["_fold", *features, target]))
    out = stored(df.groupBy(*columns).agg(F.count("*").alias("_rows")))
    return out if out.count() > KNOWN_ROWS else stored(out.coalesce(1).sortWithinPartitions(*columns))


def cross_validated(df: DataFrame, features: list[str], target: str, key: str, folds: int = 3, depth: int = 4) -> dict[str, float]:
    """Accuracy of decision trees over stratified folds; folds go by the hash of a key. A table that ``folded`` made
    keeps its folds, one that ``counted`` made stands for all rows that were counted."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    if "_fold" not in df.columns:
        df = folded(df, target, key, folds)
    if "_rows" not in df.columns:
        df = df.withColumn("_rows", F.lit(1))
    data = VectorAssembler(inputCols=features, outputCol="_x").transform(df)
    data = data.select("_fold", "_x", F.col(target).cast("double").alias("_y"), "_rows")
    hits = rows = 0
    for k in range(folds):
        model = DecisionTreeClassifier(featuresCol="_x", labelCol="_y", weightCol="_rows", maxDepth=depth, seed=42).fit(data.where(F.col("_fold") != k))
        h, n = model.transform(data.where(F.col("_fold") == k)).agg(F.sum(F.when(F.col("prediction") == F.col("_y"), F.col("_rows"))), F.sum("_rows")).first()
        hits, rows = hits + (h or 0), rows + (n or 0)
    return {"accuracy": hits / max(1, rows)}


def search(df: DataFrame, features: list[str], target: str, key: str, rounds: int = 4, texts: list[str] | None = None) -> list[dict]:
    """The rounds of the feature loop: each proposes a column, checks the gates, and keeps it if trees get better. With
    ``texts`` each round proposes the columns of a feature text (see ``expressions``) and keeps all or none of them. The
    folds are made once, for all rounds, of the columns that these can use; without ``texts``, which may use any column,
    equal rows are counted once, too, and all rounds work on the different ones."""
    df = folded(df, target, key) if texts is not None else counted(folded(df.select(*dict.fromkeys([*features, target, key])), target, key), features, target)
    best, trace = cross_validated(df, features, target, key), []
    if texts is not None:
        from weftline.operators.expressions import robust

        for r, text in enumerate(texts):
            more, reason = robust(df, text, features)
            new = [c for c in more.columns if c not in df.columns]
            after = cross_validated(more, features + new, target, key) if reason is None else None
            kept = bool(after and improved(best, after, "classification"))
            trace.append({"round": r, "feature": ", ".join(new) or text, "passes": reason is None, "accuracy": after["accuracy"] if after else None, "accepted": kept})
            if kept:
                df, features, best = more, features + new, after
        return trace
    for r in range(rounds):
        a, b = features[r % len(features)], features[(r + 1) % len(features)]
        name, column = f"f{r}", proposal(r, a, b)
        passes = gates(df, column, features).first().passes
        after = cross_validated(df.withColumn(name, column), [*features, name], target, key) if passes else None
        kept = bool(after and improved(best, after, "classification"))
        trace.append({"round": r, "feature": name, "passes": bool(passes), "accuracy": after["accuracy"] if after else None, "accepted": kept})
        if kept:
            df, features, best = df.withColumn(name, column), [*features, name], after
    return trace
