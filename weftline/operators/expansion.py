"""The iterative pipelines: refilling masked reasoning steps, rewriting code, drawing until valid.

State belongs to one record, so records are rows and each row runs its own loop, with a model client that is given in.
The default client is deterministic; nothing here calls a network.
"""

from __future__ import annotations

import difflib
import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import codemetrics
from weftline.functions.steps import consistent
from weftline.operators.batch import spread

UNSURE = ("maybe", "perhaps", "not sure", "probably")


def mock_fill(before: list[str], masked: str, after: list[str], attempt: int) -> list[str]:
    """A deterministic refill: the masked step with its ground stated first, longer on each attempt."""
    ground = before[-1] if before else "the question"
    return [f"Because {ground.rstrip('.')}, we continue.", masked, *(["So the result follows from these steps."] if attempt else [])]


def score_fill(fill: list[str], masked: str, before: list[str], after: list[str]) -> dict[str, float]:
    """Five scores of a refill and their weighted sum."""
    text = " ".join(fill)
    matcher = lambda x: difflib.SequenceMatcher(None, text.lower(), x.lower())
    near = 0.55  # what is less alike doesn't count; the quick ratios are upper bounds of the ratio
    for m in map(matcher, before + after):
        if m.real_quick_ratio() > near and m.quick_ratio() > near:
            near = max(near, m.ratio())
    similarity = 0.0 if not text.strip() else (1.0 - near) / (1.0 - 0.55)  # exactly 0 for an equal step, 1 for none alike
    known = set(re.findall(r"[A-Za-z]\w*", " ".join(before + after + [masked])))
    new = {w for w in re.findall(r"\b[A-Za-z]\b", text)} - known
    logic = 0.0 if not text.strip() else 0.25 if any(u in text.lower() for u in UNSURE) else 0.45 if len(new) >= 3 else 0.86 if len(fill) <= 3 else 0.72
    verdicts = [consistent(e) for e in re.findall(r"[0-9.+\-*/^() ]+=[0-9.+\-*/^() =]+", text)]
    known_verdicts = [v for v in verdicts if v is not None]
    formula = (0.48 if "=" in masked else 0.75) if not verdicts else 0.68 if not known_verdicts else sum(known_verdicts) / len(known_verdicts)
    connected = bool(re.search(r"\b(so|thus|therefore|because|hence|then)\b", text.lower()))
    completeness = min(1.0, 0.45 + 0.2 * (len(fill) >= 1) + 0.2 * (("=" in masked) <= ("=" in text)) + 0.15 * connected)
    following = matcher(after[0]).ratio() if after else 0.0
    gain = min(1.0, 0.45 * (1 - following) + (0.2 if 8 <= len(text.split()) <= 80 else 0.05) + 0.15 * ("=" in text) + 0.2)
    parts = {"similarity": similarity, "logic_consistency": logic, "formula_correctness": formula, "completeness": completeness, "reasoning_gain": gain}
    return parts | {"aggregate": 0.18 * similarity + 0.24 * logic + 0.24 * formula + 0.17 * completeness + 0.17 * gain}


@lru_cache(maxsize=1 << 14)
def _scored(fill: tuple[str, ...], masked: str, before: tuple[str, ...], after: tuple[str, ...]) -> float:
    return score_fill(list(fill), masked, list(before), list(after))["aggregate"]


def expand_steps(df: DataFrame, key: str, steps: str, fill: Callable = mock_fill, masks: int = 10, refinements: int = 3, patience: int = 2, threshold: float = 0.8) -> DataFrame:
    """Per record: steps after expansion, attempts, retained refills, whether one was accepted, best score, errors.

    Masked steps are drawn by a hash of the record and round, so a record's result does not depend on its neighbours.
    A record that fails is a row with its error; records without steps have no attempts. A refill that a task has met
    among the same steps keeps its score.
    """

    def one(record: str, nodes: list[str]) -> tuple:
        attempts = kept = stale = 0
        accepted, best, seen = False, 0.0, set()
        for r in range(masks):
            open_ = [i for i in range(len(nodes)) if nodes[i] not in seen]
            if not open_ or stale >= patience:
                break
            at = open_[int(hashlib.md5(f"{record}:{r}".encode()).hexdigest(), 16) % len(open_)]
            masked, top = nodes[at], None
            for a in range(refinements):
                attempts += 1
                parts = fill(nodes[:at], masked, nodes[at + 1 :], a)
                s = _scored(tuple(parts), masked, tuple(nodes[:at]), tuple(nodes[at + 1 :]))
                if top is None or s > top[0] + 1e-6:
                    top = (s, parts)
            seen.add(masked)
            if top[0] > best + 1e-6:
                best, stale, kept = top[0], 0, kept + 1
                accepted |= top[0] >= threshold
                nodes = [*nodes[:at], *top[1], *nodes[at + 1 :]]
                seen.update(top[1])
            else:
                stale += 1
        return nodes, attempts, kept, accepted, best, None

    def run(batches):
        for pdf in batches:
            rows = []
            for record, nodes in zip(pdf[key], pdf[steps], strict=True):
                try:
                    rows.append((record, *one(str(record), list(nodes) if nodes is not None else [])))
                except Exception as e:  # a record's failure is its result
                    rows.append((record, [], 0, 0, False, 0.0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key, "nodes", "attempts", "kept", "accepted", "best", "error"])

    kind = dict(df.dtypes)[key]
    return spread(df.select(key, steps)).mapInPandas(run, f"{key} {kind}, nodes array<string>, attempts int, kept int, accepted boolean, best double, error string")


def mock_rewrite(code: str, strategy: str) -> str:
    """Deterministic rewrites: blanks at line ends and tabs go, or nothing changes."""
    return "\n".join(x.rstrip().replace("\t", "    ") for x in code.split("\n")) if strategy == "style" else code


def rewrite_code(df: DataFrame, key: str, code: str, rewrite: Callable = mock_rewrite, strategies: tuple[str, ...] = ("style", "readability"), rounds: int = 3) -> DataFrame:
    """One row per attempt of each record: round, strategy, metric before and after, passes, changed, retained.

    A retained rewrite is what the next round begins with; a record ends when a round retains nothing.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for record, source in zip(pdf[key], pdf[code], strict=True):
                now = source or ""
                for r in range(rounds):
                    kept = False
                    for s in strategies:
                        new = rewrite(now, s)
                        a, b = codemetrics.measure(now), codemetrics.measure(new)
                        passes = codemetrics.acceptable(now, new)
                        before, after = (a[2], b[2]) if s == "style" else (a[3], b[3])
                        ok = passes and new != now and after - before >= 0.01
                        rows.append((record, r, s, before, after, passes, new != now, ok))
                        if ok:
                            now, kept = new, True
                    if not kept:
                        break
            yield pd.DataFrame(rows, columns=[key, "round", "strategy", "before", "after", "passes", "changed", "retained"])

    kind = dict(df.dtypes)[key]
    return spread(df.select(key, code)).mapInPandas(run, f"{key} {kind}, round int, strategy string, before double, after double, passes boolean, changed boolean, retained boolean")


def first_valid(attempts: DataFrame, key: list[str], order: str, valid: str) -> DataFrame:
    """The first valid attempt of each slot, and whether there is one: the queue of draws as one aggregate."""
    g = attempts.groupBy(*key).agg(F.min(F.when(F.col(valid), F.col(order))).alias("attempt"), F.count("*").alias("n_attempts"))
    return g.withColumn("filled", F.col("attempt").isNotNull())


def retention_report(trace: DataFrame, strategies: list[str]) -> DataFrame:
    """Attempts, retained ones and their share per strategy, also of those never tried."""
    known = trace.sparkSession.createDataFrame([(s,) for s in strategies], "strategy string")
    g = trace.groupBy("strategy").agg(F.count("*").alias("attempted"), F.count_if("retained").alias("kept"))
    n, k = F.coalesce("attempted", F.lit(0)), F.coalesce("kept", F.lit(0))
    return known.join(g, "strategy", "left").select("strategy", n.alias("attempted"), k.alias("kept"), F.when(n > 0, k / n).otherwise(0.0).alias("rate"))


def batch_summary(records: DataFrame, group: str) -> DataFrame:
    """Per group and in all (ALL): records, failures, accepted, their share, mean score of the others, attempts."""
    ok = F.col("error").isNull()
    out = records.rollup(group).agg(
        F.grouping(group).alias("_g"), F.count("*").alias("n"), F.count_if(~ok).alias("failed"), F.count_if(ok & F.col("accepted")).alias("n_accepted"),
        F.coalesce(F.avg(F.when(ok, F.col("accepted").cast("double"))), F.lit(0.0)).alias("accepted_rate"), F.coalesce(F.avg(F.when(ok, F.col("best"))), F.lit(0.0)).alias("mean_best"), F.sum("attempts").alias("attempts"),
    )
    return out.withColumn(group, F.when(F.col("_g") == 1, "ALL").otherwise(F.col(group))).drop("_g")
