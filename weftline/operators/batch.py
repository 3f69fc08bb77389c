"""The algebra of row batches: positions, slices, repeats, parts, padding, unions of columns, mixing of datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.shared import checkpointed, stored


def with_position(df: DataFrame, order: list[str], name: str = "row_id", rows_per_range: int = 50_000) -> DataFrame:
    """``df`` with each row's place (from 0) in an order of its columns.

    No task orders all rows: rows are range-partitioned and counted first, and each range's offset is the sum of the
    ranges before it. The result is cut off from its plan, as ranges may differ between two runs of a plan.
    """
    return before(df, order, F.lit(1), name, rows_per_range).withColumn(name, F.col(name).cast("long"))


def before(df: DataFrame, order: list[str], value: Column, name: str, rows_per_range: int = 50_000) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows that stand before each in an order of its columns, as described at
    ``with_position``. The order must tell all rows apart."""
    n = max(1, -(-df.count() // rows_per_range))
    ranged = checkpointed(df.withColumn("__value", value).repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.sum("__value").alias("_n"))
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sizes.select("_p", (F.sum("_n").over(until(Window.orderBy("_p"))) - F.col("_n")).alias("_before"))  # a row a range
    own = F.sum("__value").over(until(Window.partitionBy("_p").orderBy(*order))) - F.col("__value")
    return ranged.withColumn("_i", own).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_before") + F.col("_i")).drop("_p", "_i", "_before", "__value")


def before_within(df: DataFrame, group: str, order: list[str], value: Column, name: str, total: str | None = None, rows_per_range: int = 50_000) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the same ``group`` that stand before each in an order of its
    columns; ``total`` names a further column for the group's whole sum. Null is a group of its own.

    A group of any size is spread over ranges of rows: each range counts its part of a group, and what is ordered in one
    task is a range's rows or a group's ranges, never a group's rows. The order must tell all rows of a group apart.
    """
    n = max(1, -(-df.count() // rows_per_range))
    keyed = df.withColumn("__g", F.struct(group)).withColumn("__value", value)
    ranged = checkpointed(keyed.repartitionByRange(n, "__g", *order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p", "__g").agg(F.sum("__value").alias("_n"))
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = Window.partitionBy("__g").orderBy("_p")  # a row a range in which the group lies
    offsets = sizes.select("_p", "__g", (F.sum("_n").over(until(parts)) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy("__g")).alias("_total"))
    own = F.sum("__value").over(until(Window.partitionBy("_p", "__g").orderBy(*order))) - F.col("__value")
    out = ranged.withColumn("_i", own).join(offsets, ["_p", "__g"]).withColumn(name, F.col("_before") + F.col("_i"))
    if total is not None:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_p", "__g", "_i", "_before", "_total", "__value")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over as many tasks as shuffles have, before a step that takes much time for few bytes: a small file
    is read in few tasks, and adaptive execution joins small partitions by their bytes alone."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


#: Rows of different inputs up to which they are sent to all tasks.
KNOWN_ROWS = 100_000


def for_distinct(df: DataFrame, inputs: list[str], **outputs: Column) -> DataFrame:
    """``df`` with columns that costly expressions make of ``inputs``, computed once for each different row of these.
    Nulls are values like others. Many different rows are joined, up to KNOWN_ROWS are sent to all tasks."""
    known = checkpointed(spread(df.select(*inputs).distinct()).select(*(F.col(c).alias(f"__{c}") for c in inputs), *(v.alias(k) for k, v in outputs.items())))
    if known.count() <= KNOWN_ROWS:
        known = F.broadcast(known)
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in inputs]
    return df.join(known, same).drop(*(f"__{c}" for c in inputs))


def take(df: DataFrame, position: str, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    p = F.col(position)
    out = df.where((p >= start) & ((p - start) % step == 0))
    return out if stop is None else out.where(p < stop)


def reorder(df: DataFrame, position: str, order: DataFrame) -> DataFrame:
    """Rows at the places that ``order`` (position, new) gives them; rows without a place are left out."""
    return df.join(order, position).drop(position).withColumnRenamed("new", position)


def repeat_each(df: DataFrame, position: str, times: int) -> DataFrame:
    """Every row ``times`` times, its copies next to one another."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("new_id", F.col(position) * times + F.col("copy"))


def tile(df: DataFrame, position: str, times: int, size: int) -> DataFrame:
    """The whole batch ``times`` times over."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("new_id", F.col(position) + F.col("copy") * size)


def chunk_of(position: Column, size: int, parts: int) -> Column:
    """The part of ``parts`` equal ones; the first ``size`` modulo ``parts`` of them have one row more."""
    small, extra = divmod(size, parts)
    edge = extra * (small + 1)
    late = F.lit(0) if small == 0 else F.floor((position - edge) / small)
    return F.when(position < edge, F.floor(position / (small + 1))).otherwise(extra + late).cast("int")


def pad_to_divisor(df: DataFrame, position: str, size: int, divisor: int) -> DataFrame:
    """``df`` and copies of its leading rows, over and over, until its size is a multiple; ``is_pad`` marks them."""
    pad = -size % divisor
    own = df.withColumn("is_pad", F.lit(False))
    if not pad or not size:
        return own
    rounds = -(-pad // size)
    more = df.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn(position, F.col(position) + F.col("_r") * size).where(F.col(position) < size + pad)
    return own.unionByName(more.drop("_r").withColumn("is_pad", F.lit(True)))


def union_columns(left: DataFrame, right: DataFrame, position: str) -> DataFrame:
    """Columns of both for each place. Columns that both have must agree, else the job fails."""
    shared = [c for c in left.columns if c in right.columns and c != position]
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in shared})
    out = left.join(renamed, position)
    for c in shared:
        same = F.assert_true(F.col(c).eqNullSafe(F.col(f"_r_{c}")), F.lit(f"column {c} differs"))
        out = out.withColumn(c, F.when(same.isNull(), F.col(c)))
    return out.drop(*(f"_r_{c}" for c in shared))


def fold(df: DataFrame, position: str, k: int, columns: list[str]) -> DataFrame:
    """k rows side by side as arrays, in order."""
    g = df.groupBy(F.floor(F.col(position) / k).alias(position)).agg(F.sort_array(F.collect_list(F.struct(position, *columns))).alias("x"))
    return g.select(position, *(F.col(f"x.{c}").alias(c) for c in columns))


def interleave(frames: list[DataFrame], order: list[str], strategy: str) -> DataFrame:
    """Rows of several sources in turn. ``under`` stops when the first source ends, ``over`` goes on until the last
    has ended and begins shorter ones again, ``once`` takes every row once. Adds ``source`` and ``turn``."""
    placed = [with_position(df, order, "turn") for df in frames]
    sizes = [p.count() for p in placed]
    out = None
    for i, (p, n) in enumerate(zip(placed, sizes, strict=True)):
        if strategy == "under":
            p = p.where(F.col("turn") < min(sizes))
        elif strategy == "over" and n:
            p = p.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit((max(sizes) - 1) // n)))).withColumn("turn", F.col("turn") + F.col("_r") * n).where(F.col("turn") < max(sizes)).drop("_r")
        elif strategy not in ("once", "over"):
            raise ValueError(f"unknown strategy {strategy}")
        p = p.withColumn("source", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def hash_share(key: Column, seed: str = "") -> Column:
    """A number from 0 to 1 that depends on the key alone: the same rows on every run and every cluster."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def split(df: DataFrame, key: Column, share: float, seed: str = "") -> tuple[DataFrame, DataFrame]:
    """(train, validation), about ``share`` of the rows in the second."""
    h = hash_share(key, seed)
    return df.where(h >= share), df.where(h < share)


def stratified_fold(df: DataFrame, label: str, key: str, folds: int, name: str = "fold", rows_per_range: int = 250_000) -> DataFrame:
    """``df`` with the fold of each row: rows of a label, in the order of their key's hash, go round the folds. Rows of
    one key stand in the order of a hash of all their columns.

    All rows are shuffled and sorted once, in ranges of the order, and written with their range and their place in it. A
    label may hold most of the rows, and a key many: either is spread over ranges. Then only the labels' parts of ranges
    are counted and summed.
    """
    n = max(1, -(-df.count() // rows_per_range))
    rest = F.xxhash64(*(c for c, t in df.dtypes if "map<" not in t))
    order = [label, "__h", key, "__r"]
    ranged = df.withColumn("__h", F.unhex(F.md5(F.col(key).cast("string")))).withColumn("__r", rest).repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = ranged.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()).drop("__h", "__r")
    placed = stored(placed.withColumn("__i", (F.col("__i").bitwiseAND((1 << 33) - 1) % folds).cast("int")))
    runs = placed.groupBy(F.col(label).alias("__g"), F.col("__p").alias("__q")).agg(F.count("*").alias("_n"))
    earlier = lambda part, by: F.coalesce(F.sum("_n").over(Window.partitionBy(part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = checkpointed(runs.select("__g", "__q", F.pmod(earlier("__g", "__q") - earlier("__q", "__g"), F.lit(folds)).alias("__s")))
    if shifts.count() <= KNOWN_ROWS:  # at most a row a range and a row a label
        shifts = F.broadcast(shifts)
    out = placed.join(shifts, F.col(label).eqNullSafe(F.col("__g")) & (F.col("__p") == F.col("__q")))
    return out.withColumn(name, ((F.col("__i") + F.col("__s")) % folds).cast("int")).drop("__p", "__i", "__g", "__q", "__s")


def replicate(sources: list[tuple[DataFrame, int]]) -> DataFrame:
    """The union of sources, each row of one as often as its weight says."""
    out = None
    for df, k in sources:
        part = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(k))))
        out = part if out is None else out.unionByName(part)
    return out


def newest(df: DataFrame, sequence: str, capacity: int) -> DataFrame:
    """What a bounded queue holds at the end: the latest ``capacity`` rows; older ones were dropped as it ran over."""
    return df.orderBy(F.desc(sequence)).limit(capacity)


def draws(df: DataFrame, weight: Column, key: Column, n: int, seed: str) -> DataFrame:
    """Importance resampling: about ``n`` draws with replacement, each row as often as its expected count, rounded up
    or down by its hash. Adds ``copies``; rows of none are left out."""
    total = df.agg(F.sum(weight).alias("_t"))
    expected = weight / F.col("_t") * n
    out = df.crossJoin(F.broadcast(total)).withColumn("copies", (F.floor(expected) + (hash_share(key, seed) < expected - F.floor(expected)).cast("int")).cast("int"))
    return out.drop("_t").where("copies > 0")
