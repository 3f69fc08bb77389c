"""Likeness of a predicted text to its reference, and repetition inside a text."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def grams(items: list, n: int) -> Counter:
    return Counter(tuple(items[i : i + n]) for i in range(len(items) - n + 1))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def shared_grams(a: str, b: str, most: int) -> list[int]:
    """For 1 to ``most`` characters, how many runs two texts share, each as often as in the text that has it less often.
    A run is a number: that of its beginning and the place of its last character among the texts' characters."""
    seen, codes = np.unique(np.r_[_points(a), _points(b)], return_inverse=True)
    codes = codes.astype(np.int64)
    sides, ends, out = [codes[: len(a)], codes[len(a) :]], [codes[: len(a)], codes[len(a) :]], []
    kinds = len(seen)
    for n in range(1, most + 1):
        if n > 1:
            if kinds * len(seen) >= 1 << 62:  # numbers begin anew, by their order
                found, codes = np.unique(np.concatenate(sides), return_inverse=True)
                sides, kinds = [codes[: len(sides[0])], codes[len(sides[0]) :]], len(found)
            sides, kinds = [s[:-1] * len(seen) + e[n - 1 :] for s, e in zip(sides, ends, strict=True)], kinds * len(seen)
        (x, c), (y, d) = (np.unique(s, return_counts=True) for s in sides)
        if not len(x) or not len(y):
            out.append(0)
            continue
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        out.append(int(np.minimum(c, d[at])[y[at] == x].sum()))
    return out


def bleu(predicted: str, truth: str, most: int = 4) -> float:
    """BLEU of characters up to 4-grams; a length without a hit counts as 1 / (2^k * grams), k growing with each."""
    hits = shared_grams(predicted, truth, most)
    if not predicted or not hits[0]:
        return 0.0
    logs, missing = 0.0, 0
    for n, h in enumerate(hits, 1):
        total = max(1, len(predicted) - n + 1)
        missing += h == 0
        logs += math.log(h / total if h else 1 / (2**missing * total)) / most
    short = 1.0 if len(predicted) > len(truth) else math.exp(1 - len(truth) / len(predicted))
    return short * math.exp(logs)


def common_subsequence(a: list, b: list) -> int:
    """The length of the longest common subsequence: bits of an integer stand for places of ``b``."""
    at: dict = {}
    for i, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << i
    row = (1 << len(b)) - 1
    full = row
    for x in a:
        hit = row & at.get(x, 0)
        row = (row + hit) | (row - hit)
        row &= full
    return len(b) - row.bit_count()


def f_score(hits: int, predicted: int, truth: int) -> float:
    p, r = hits / predicted if predicted else 0.0, hits / truth if truth else 0.0
    return 2 * p * r / (p + r + 1e-8)


def rouge(predicted: str, truth: str) -> tuple[float, float, float]:
    """F scores of different words, of different word pairs, and of the longest common subsequence of words."""
    return rouge_of_words(predicted, truth, 1), rouge_of_words(predicted, truth, 2), rouge_l(predicted, truth)


def rouge_of_words(predicted: str, truth: str, n: int) -> float:
    a, b = predicted.split(), truth.split()
    if not a or not b:
        return 0.0
    x, y = (set(zip(*(w[i:] for i in range(n)), strict=False)) for w in (a, b))
    return f_score(len(x & y), len(x), len(y))


def rouge_l(predicted: str, truth: str) -> float:
    a, b = predicted.split(), truth.split()
    return f_score(common_subsequence(a, b), len(a), len(b)) if a and b else 0.0


SCORES = {"bleu_4": bleu, "rouge_1": lambda a, b: rouge_of_words(a, b, 1), "rouge_2": lambda a, b: rouge_of_words(a, b, 2), "rouge_l": rouge_l}


def overlap_scores(predicted: Column, truth: Column, names: tuple[str, ...] = tuple(SCORES)) -> Column:
    """Those of bleu_4, rouge_1, rouge_2 and rouge_l that are asked for, in percent, rounded to 4 digits, by Arrow
    batches. Nulls count as empty."""

    def run(p: pd.Series, t: pd.Series) -> pd.DataFrame:
        rows = [[round(100 * SCORES[s](a, b), 4) for s in names] for a, b in zip(p.fillna(""), t.fillna(""), strict=True)]
        return pd.DataFrame(rows, columns=list(names), dtype="float64")

    return F.pandas_udf(run, ", ".join(f"{s} double" for s in names))(predicted, truth)


def repetition(text: str) -> float:
    """The sum of common prefixes of neighbours in the order of suffixes, over half the square of the length.

    Ranks of suffixes double the number of characters that they compare. Common prefixes follow the text: the one of the
    next suffix is at most one shorter, so all are found in one walk with three arrays of the text's length.
    """
    n = len(text)
    if n <= 1:
        return 0.0
    rank, step = np.unique(_points(text), return_inverse=True)[1].astype(np.int64), 1
    while step < n and rank.max() < n - 1:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        rank = np.unique(key, return_inverse=True)[1]
        step *= 2
    order = np.argsort(rank, kind="stable")
    before = np.empty(n, dtype=np.int64)  # the suffix before each in the order; the first has none
    before[order[1:]], before[order[0]] = order[:-1], -1
    total = h = 0
    for i, j in enumerate(memoryview(before)):
        if j < 0:
            h = 0
            continue
        top = n - max(i, j)
        while h < top and text[i + h] == text[j + h]:
            h += 1
        total += h
        h = max(0, h - 1)
    return 2 * total / (n * (n + 1))


def may_repeat(text: str, limit: float) -> bool:
    """False only if the repetition is at most the limit: if no run of some length occurs twice, common prefixes are
    shorter than it, and so is their mean. Runs are told apart by hashes, which are equal for equal runs."""
    n = len(text)
    length = max(1, math.floor(limit * (n + 1) / 2))
    if n <= length:
        return True
    power = np.cumprod(np.r_[np.uint64(1), np.full(n, 0x9E3779B97F4A7C15, dtype=np.uint64)])
    total = np.r_[np.uint64(0), np.cumsum((_points(text).astype(np.uint64) + np.uint64(1)) * power[:n])]
    runs = np.sort((total[length:] - total[:-length]) * power[n - length :: -1][: n - length + 1])
    return bool((runs[1:] == runs[:-1]).any())


def repeats_itself(text: Column, limit: float = 0.2) -> Column:
    """Whether a text's repetition is above the limit. Null texts: false."""

    def run(t: pd.Series) -> pd.Series:
        return pd.Series([may_repeat(x, limit) and repetition(x) > limit if x else False for x in t])

    return F.pandas_udf(run, "boolean")(text)
