"""Controllers whose state one batch changes and the next one reads: the adaptive coefficient of a KL penalty."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The largest share by which the divergence may miss its target and still count in full.
MOST_ERROR = 0.2
#: The state store that keeps named states.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def next_coefficient(value: float, divergence: float, steps: float, target: float, horizon: float) -> float:
    """The coefficient after a batch: larger if the divergence is above its target, smaller if it is below."""
    error = min(max(divergence / target - 1, -MOST_ERROR), MOST_ERROR)
    return value * (1 + error * steps / horizon)


class _Adaptive(StatefulProcessor):
    def __init__(self, start: float, target: float, horizon: float):
        self.start, self.target, self.horizon = start, target, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("coefficient", "value double, step long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        value, last = self.held.get() if self.held.exists() else (self.start, None)
        batch = pd.concat(list(rows)).dropna(subset=["step", "divergence"]).sort_values("step", kind="stable").drop_duplicates("step")
        if last is not None:
            batch = batch[batch["step"] > last]
        out = []
        for step, divergence, n in zip(batch["step"], batch["divergence"], batch["n"], strict=True):
            out.append((key[0], int(step), value))
            value, last = next_coefficient(value, float(divergence), float(n), self.target, self.horizon), int(step)
        if out:
            self.held.update((value, last))
        yield pd.DataFrame(out, columns=["run", "step", "coefficient"])


def adaptive_coefficients(steps: DataFrame, start: float, target: float, horizon: float) -> DataFrame:
    """(run, step, coefficient) of a stream of (run, step, divergence, n): the coefficient that holds for each step, by
    the divergences and batch sizes of the steps of its run before.

    A run is a key of the state, whose state is two numbers; steps arrive as one row each (their sequences are averaged
    before). A step of a run that is not after the run's last one, and a second row of a step, is left out, so rows that
    come again change nothing; rows without a step or a divergence are left out, too. The state is kept by Spark's
    checkpoint, so a query that starts again goes on with its coefficients.
    """
    session = steps.sparkSession
    if session.conf.get(STORE[0]) != STORE[1]:
        session.conf.set(*STORE)
    rows = steps.select(F.col("run"), F.col("step").cast("long").alias("step"), F.col("divergence").cast("double").alias("divergence"), F.col("n").cast("double").alias("n"))
    return rows.groupBy("run").transformWithStateInPandas(_Adaptive(start, target, horizon), f"run {dict(rows.dtypes)['run']}, step long, coefficient double", "append", "None")


def coefficients_of(steps: DataFrame, start: float, target: float, horizon: float) -> DataFrame:
    """The same of a table of all steps: a running product of each run's factors, by their logarithms. A horizon so
    short that a factor is not positive has no logarithm and is refused."""
    error = F.greatest(F.least(F.col("divergence") / target - 1, F.lit(MOST_ERROR)), F.lit(-MOST_ERROR))
    factor = 1 + error * F.col("n") / horizon
    log = F.when(factor > 0, F.log(factor)).otherwise(F.raise_error(F.lit("the horizon is too short")).cast("double"))
    before = Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return steps.select("run", "step", (start * F.exp(F.coalesce(F.sum(log).over(before), F.lit(0.0)))).alias("coefficient"))


def penalised(tokens: DataFrame, coefficients: DataFrame) -> DataFrame:
    """``tokens`` (run, step, score, kl, ...) with ``reward``: the score less the coefficient of the token's step times its divergence."""
    c = coefficients.select("run", "step", "coefficient")
    return tokens.join(c, ["run", "step"]).withColumn("reward", F.col("score") - F.col("coefficient") * F.col("kl")).drop("coefficient")
