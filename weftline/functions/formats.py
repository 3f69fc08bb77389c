"""Small text and array functions of dataset preparation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(template: Column, values: dict[str, Column]) -> Column:
    """``{{name}}`` replaced by values, each name's first occurrence only."""
    out = template
    for name, v in values.items():
        mark = "{{" + name + "}}"
        at = F.instr(out, mark)
        out = F.when(at > 0, F.concat(F.substr(out, F.lit(1), at - 1), v, F.substr(out, at + len(mark)))).otherwise(out)
    return out


def media_segments(text: Column) -> Column:
    """The text cut at <image> and <video>, with the marks, without empty parts."""
    return F.filter(F.split(F.regexp_replace(text, r"(<image>|<video>)", "\x01$1\x01"), "\x01"), lambda x: x != "")


def letter_count_task(word: Column, letter: str) -> Column:
    """A spelled-out count: each letter compared, then the number of hits."""
    spelled = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.concat(c, F.when(c == letter, " = ").otherwise(" != "), F.lit(letter)))
    hits = F.length(word) - F.length(F.replace(word, F.lit(letter), F.lit("")))
    return F.concat(F.array_join(spelled, "\n"), F.lit("\nSo \\boxed{"), hits.cast("string"), F.lit("}"))


def identifier_words(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit(r"([A-Z]?[a-z]+|[A-Z]+|[0-9]+)"), F.lit(1))


def tidy_activity(text: Column) -> Column:
    """Titles become full stops, other brackets go, double spaces become one."""
    t = F.replace(F.trim(text), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(t, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def feedback(error: Column) -> Column:
    """Advice for each class of error."""
    return (
        F.when(error == "Timeout", "Reduce the work per call; the run did not end in time.").when(error == "SyntaxError", "Fix the syntax first.")
        .when(error == "AssertionError", "A test failed; check the edge cases.").when(error == "ImportError", "Use the standard library only.").when(error == "None", "").otherwise("Read the traceback and guard the failing line.")
    )


def well_formed(messages: Column) -> Column:
    """Whether every message has a known role and some content, and there is one."""
    ok = lambda m: m["role"].isin("user", "assistant", "system", "tool") & (F.trim(F.coalesce(m["content"], F.lit(""))) != "")
    return (F.size(messages) > 0) & F.forall(messages, ok)


def smoothed(values: Column, weight: float) -> Column:
    """Exponential smoothing in order: last = last * weight + (1 - weight) * value, from the first value on."""
    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        now = F.when(acc["last"].isNull(), v).otherwise(acc["last"] * weight + (1 - weight) * v)
        return F.struct(now.alias("last"), F.array_append(acc["out"], now).alias("out"))

    return F.aggregate(values, start, step, lambda acc: acc["out"])


def numerically_equal(prediction: Column, reference: Column, tolerance: float = 1e-4) -> Column:
    """Whether two numbers agree, the reference also as a percentage or a share of it; strings that are no numbers
    must be the same."""
    p, r = prediction.try_cast("double"), reference.try_cast("double")
    near = lambda x: F.abs(p - x) <= tolerance * F.abs(x)
    return F.when(p.isNotNull() & r.isNotNull(), near(r) | near(r / 100) | near(r * 100)).otherwise(F.coalesce(prediction == reference, F.lit(False)))


def point_reward(answer: Column, low: Column, high: Column) -> Column:
    """1 / place of the first of the points [[x, y], ...] that lies in a box of corners (x, y); 0 without one, -1 if
    the answer is no list of points."""
    points = F.from_json(answer, "array<array<double>>")
    inside = lambda p: (p[0] >= low[0]) & (p[0] <= high[0]) & (p[1] >= low[1]) & (p[1] <= high[1])
    at = F.array_position(F.transform(points, inside), F.lit(True))
    return F.when(points.isNull(), -1.0).when(at > 0, 1.0 / at).otherwise(0.0)


def shuffled_choices(options: Column, gold: Column, key: Column) -> tuple[Column, Column]:
    """The options in the order of their hash with a key, and the letter of the right one."""
    order = F.array_sort(F.transform(options, lambda o: F.struct(F.md5(F.concat(key.cast("string"), F.lit("|"), o)).alias("h"), o.alias("o"))))
    texts = F.transform(order, lambda x: x["o"])
    return texts, F.char(F.lit(64) + F.array_position(texts, gold))


def token_accuracy(predicted: Column, labels: Column, ignore: int = -100) -> Column:
    """Share of the labels that count that are predicted; null without any."""
    pairs = F.filter(F.zip_with(predicted, labels, lambda p, y: F.struct(p.alias("p"), y.alias("y"))), lambda x: x["y"] != ignore)
    hits = F.size(F.filter(pairs, lambda x: x["p"] == x["y"]))
    return F.when(F.size(pairs) > 0, hits / F.size(pairs))


#: Reward managers by name: Column builders of (score, length, longest, buffer).
MANAGERS: dict = {}


def manager(name: str):
    def register(f):
        if MANAGERS.setdefault(name, f) is not f:
            raise ValueError(f"manager {name} is registered already")
        return f

    return register


@manager("naive")
def naive(score: Column, length: Column, longest: int = 0, buffer: int = 0) -> Column:
    return score


@manager("overlong")
def overlong(score: Column, length: Column, longest: int = 0, buffer: int = 0) -> Column:
    from weftline.operators.policy import overlong_penalty

    return score + overlong_penalty(length, longest, buffer, 1.0)


def placed(score: Column, t: Column, length: Column) -> Column:
    """A row's score at its last token, 0 elsewhere."""
    return F.when(t == length - 1, score).otherwise(0.0)
