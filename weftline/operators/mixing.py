"""Choosing by chance and in turn: mixed sources, mini-batches that can be resumed, attempts, sticky servers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.batch import hash_share, with_position


def interleave_by_chance(frames: list[DataFrame], shares: list[float], order: list[str], seed: str = "") -> DataFrame:
    """Rows of several sources, each slot's source drawn by its share, until a source that is drawn has no row left.

    A slot's draw is the hash of its number, so the same slots fall to the same source on every run. Adds ``slot`` and
    ``source``. Columns that a source lacks are null.
    """
    if len(shares) != len(frames) or min(shares) < 0 or abs(sum(shares) - 1) > 1e-9:
        raise ValueError("one share for each source, which add up to 1")
    placed = [with_position(df, order, "_n") for df in frames]
    sizes = [p.count() for p in placed]
    spark = frames[0].sparkSession
    u = hash_share(F.col("slot"), seed)
    limits = [sum(shares[: i + 1]) for i in range(len(shares))]
    source = reduce(lambda c, i: c.when(u < limits[i], i), range(1, len(shares) - 1), F.when(u < limits[0], 0)).otherwise(len(shares) - 1)
    slots = spark.range(sum(sizes) + 1).select(F.col("id").alias("slot")).withColumn("source", source.cast("int"))
    own = [with_position(slots.where(F.col("source") == i), ["slot"], "_n") for i in range(len(frames))]
    # the first slot whose source has run out ends it all
    ends = [o.where(F.col("_n") == n).agg(F.min("slot")).first()[0] for o, n in zip(own, sizes, strict=True)]
    stop = min((e for e in ends if e is not None), default=sum(sizes))
    out = None
    for o, p in zip(own, placed, strict=True):
        part = o.where(F.col("slot") < stop).join(p, "_n").drop("_n")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def mini_batches(df: DataFrame, key: str, size: int, epochs: int, seed: str = "", drop_last: bool = True) -> DataFrame:
    """Every row once an epoch, in an order of its own: adds ``epoch``, ``batch`` and ``place``. The last batch goes if
    it is not full. ``key`` must tell rows apart."""
    out = None
    n = df.count()
    for e in range(epochs):
        # the key follows its hash, so equal hashes have one order too
        hashed = df.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"{seed}:{e}"))))
        placed = with_position(hashed, ["_h", key], "_n").drop("_h")
        part = placed.select(*df.columns, F.lit(e).alias("epoch"), F.floor(F.col("_n") / size).alias("batch"), (F.col("_n") % size).alias("place"))
        part = part.where(F.col("batch") < n // size) if drop_last else part
        out = part if out is None else out.unionByName(part)
    return out


def resumed(batches: DataFrame, epoch: int, batch: int) -> DataFrame:
    """What is left of ``mini_batches`` after a state: batches of the epoch from ``batch`` on, and later epochs. As the
    order is a function of the seed, the state is these two numbers."""
    return batches.where((F.col("epoch") > epoch) | ((F.col("epoch") == epoch) & (F.col("batch") >= batch)))


def shuffle_buffer(df: DataFrame, position: str, size: int, seed: str = "") -> DataFrame:
    """``df`` with ``new_place``: rows change places only with those of their stretch of ``size`` rows, as rows that wait
    in a buffer of that size do."""
    w = Window.partitionBy("_s").orderBy(F.md5(F.concat(F.col(position).cast("string"), F.lit(seed))), position)
    staged = df.withColumn("_s", F.floor(F.col(position) / size))
    return staged.withColumn("new_place", (F.col("_s") * size + F.row_number().over(w) - 1).cast("long")).drop("_s")


def selected_attempt(attempts: DataFrame, record: str, policy: str, strategy: str, attempt: str, strategies: list[str], scores: list[Column], seed: str = "") -> DataFrame:
    """One attempt of each record. ``random``: that of the smallest hash; ``fixed``: that whose strategy is next in turn
    by the record's number, else the first; ``adaptive``: the largest by the scores, one after the other, else the first."""
    expected = F.element_at(F.array(*map(F.lit, strategies)), (F.col(record) % len(strategies) + 1).cast("int"))
    order = {
        "random": [F.md5(F.concat(F.col(record).cast("string"), F.lit("/"), F.col(attempt).cast("string"), F.lit(seed)))],
        "fixed": [F.when(F.col(strategy) == expected, 0).otherwise(1)],
        "adaptive": [s.desc_nulls_last() for s in scores],
    }
    if policy not in order:
        raise ValueError(f"unknown policy {policy}")
    w = Window.partitionBy(record).orderBy(*order[policy], attempt)
    return attempts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def policy_comparison(attempts: DataFrame, record: str, strategy: str, attempt: str, strategies: list[str], scores: list[Column], value: str) -> DataFrame:
    """Per experiment the records, and the mean value of the selected attempts: three policies with all strategies, and
    the adaptive one without each strategy in turn."""
    runs = [(p, p, strategies) for p in ("adaptive", "random", "fixed")] + [(f"without_{s}", "adaptive", [x for x in strategies if x != s]) for s in strategies]
    out = None
    for name, policy, kept in runs:
        chosen = selected_attempt(attempts.where(F.col(strategy).isin(*kept)), record, policy, strategy, attempt, kept, scores)
        row = chosen.agg(F.lit(name).alias("experiment"), F.count("*").alias("n_records"), F.avg(value).alias("mean_value"))
        out = row if out is None else out.unionByName(row)
    return out


def sticky_servers(requests: DataFrame, request: str, order: list[str], servers: int) -> DataFrame:
    """``requests`` with the server of each: a request id that was seen keeps its server, a new one goes to the server
    with the fewest ids, the smallest of equals. As every new id weighs the same, that is in turn by first appearance."""
    first = requests.groupBy(request).agg(F.min(F.struct(*order)).alias("_o")).select(request, *(F.col(f"_o.{c}").alias(f"_{c}") for c in order))
    placed = with_position(first, [f"_{c}" for c in order], "_n")
    return requests.join(placed.select(request, (F.col("_n") % servers).cast("int").alias("server")), request)


def one_kind(streaming: dict[str, bool]) -> bool:
    """Whether the datasets are streams; streams and tables are not mixed."""
    if any(streaming.values()) != all(streaming.values()):
        raise ValueError("all datasets must be streams, or none: " + ", ".join(f"{k} {'is' if v else 'is not'}" for k, v in sorted(streaming.items())))
    return any(streaming.values())


def merged_metrics(parts: DataFrame, worker: str, name: str, value: str, constants: list[str]) -> DataFrame:
    """Per metric the values of all workers in their order. ``constants`` are columns that all workers must agree in;
    the job fails where they do not."""
    checks = [F.assert_true(F.count_distinct(F.struct(c)) <= 1, F.lit(f"workers differ in {c}")) for c in constants]
    agreed = parts.agg(*(F.first(c, True).alias(c) for c in constants), *(c.alias(f"_ok{i}") for i, c in enumerate(checks)))
    lists = parts.groupBy(name).agg(F.sort_array(F.collect_list(F.struct(worker, value))).alias("x")).select(name, F.col(f"x.{value}").alias("values"))
    ok = reduce(lambda a, i: a & F.col(f"_ok{i}").isNull(), range(len(checks)), F.lit(True))
    return lists.crossJoin(F.broadcast(agreed)).where(ok).drop(*(f"_ok{i}" for i in range(len(checks))))
