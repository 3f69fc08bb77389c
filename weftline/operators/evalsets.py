"""Evaluation sets: samples of several tasks in one form, shuffled choices, compressed test cases, an order of lessons."""

from __future__ import annotations

import base64
import io
import json
import pickle
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.binding import let

# The question of a multiple choice, and what a programming task says before its starter code or without one.
CHOICE = "Answer the following multiple choice question. The last line of your response should be of the following format: 'Answer: $LETTER' (without quotes) where LETTER is one of ABCD. Think step by step before answering.\n\n"
PROGRAM = "You will be given a question (problem specification) and will generate a correct Python program that matches the specification and passes all tests.\n\nQuestion: "
STARTER = "You will use the following starter code to write the solution to the problem and enclose your code within delimiters.\n```python\n"
NO_STARTER = "Read the inputs from stdin solve the problem and write the answer to stdout (do not directly test on the sample inputs). Enclose your code within delimiters as follows. Ensure that when the python program runs, it reads the inputs, runs the algorithm and writes output to STDOUT.```python\n# YOUR CODE HERE\n```"

#: Bytes that a row's compressed test cases may unfold to; more is an error of that row.
MOST_BYTES = 256 << 20


def sample(df: DataFrame, question: Column, truth: Column, data_source: str, ability: str, split: str, index: Column) -> DataFrame:
    """Rows in the form of an evaluation: data_source, prompt, ability, reward_model, extra_info."""
    return df.select(
        F.lit(data_source).alias("data_source"), F.array(F.struct(F.lit("user").alias("role"), question.alias("content"))).alias("prompt"), F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), truth.cast("string").alias("ground_truth")).alias("reward_model"), F.struct(F.lit(split).alias("split"), index.cast("long").alias("index")).alias("extra_info"),
    )


def shuffled_choice(question: Column, right: Column, wrong: Column, key: Column, seed: str) -> Column:
    """prompt and letter of a question with one right and three wrong answers (an array), whose order is that of hashes
    of the key and the answer's place: the same on every run, whichever rows stand beside. Null answers are empty."""
    answers = F.concat(F.array(right), wrong)
    hashed = F.transform(answers, lambda a, i: F.struct(F.md5(F.concat_ws("/", F.lit(seed), key.cast("string"), i.cast("string"))).alias("h"), (i == 0).alias("right"), F.coalesce(a, F.lit("")).alias("a")))

    def asked(x: Column) -> Column:
        lines = F.transform(x, lambda c, i: F.concat(F.substring(F.lit("ABCDEFGH"), i + 1, F.lit(1)), F.lit(") "), c["a"]))
        at = F.array_position(F.transform(x, lambda c: c["right"]), True).cast("int")
        return F.struct(F.concat(F.lit(CHOICE), F.coalesce(question, F.lit("")), F.lit("\n\n"), F.array_join(lines, "\n")).alias("prompt"), F.substring(F.lit("ABCDEFGH"), at, F.lit(1)).alias("letter"))

    return let(F.array_sort(hashed), asked)


def program_task(question: Column, starter: Column) -> Column:
    """The prompt of a programming task; null and empty starter code: the task reads and writes."""
    begun = F.when(F.coalesce(starter, F.lit("")) != "", F.concat(F.lit(STARTER), starter, F.lit("\n```"))).otherwise(F.lit(NO_STARTER))
    return F.concat(F.lit(PROGRAM), F.coalesce(question, F.lit("")), F.lit("\n\n"), begun)


class _TextOnly(pickle.Unpickler):
    """Reads a pickled text; anything that asks for a class is refused."""

    def find_class(self, module, name):
        raise ValueError(f"packed cases hold an object of {module}.{name}")


def _unfolded(data: bytes) -> bytes:
    d = zlib.decompressobj()
    out = d.decompress(data, MOST_BYTES)
    if d.unconsumed_tail or not d.eof:
        raise ValueError(f"packed cases are cut off or unfold to more than {MOST_BYTES} bytes")
    return out


def cases_of(text: str) -> object:
    """Test cases from JSON, or from the base64 of compressed JSON (also of a pickled text of JSON)."""
    try:
        return json.loads(text)
    except ValueError:
        raw = _unfolded(base64.b64decode(text, validate=True))
    return json.loads(_TextOnly(io.BytesIO(raw)).load() if raw[:1] == b"\x80" else raw)


def packed(public: str | None, private: str | None, metadata: str | None) -> tuple[str | None, str | None]:
    """(packed, error): the base64 of compressed JSON with ``inputs``, ``outputs`` and ``fn_name`` of all test cases,
    public ones first, or why there are none. Nulls and empty texts: no cases, no name."""
    try:
        cases = [c for text in (public, private) if text for c in cases_of(text)]
        form = {"inputs": [c["input"] for c in cases], "outputs": [c["output"] for c in cases], "fn_name": json.loads(metadata).get("func_name") if metadata else None}
        return base64.b64encode(zlib.compress(json.dumps(form).encode())).decode(), None
    except (ValueError, KeyError, TypeError, AttributeError, zlib.error, pickle.UnpicklingError, EOFError, IndexError) as e:  # a row's failure is its result
        return None, f"{type(e).__name__}: {e}"


def with_packed_cases(df: DataFrame, public: str, private: str, metadata: str) -> DataFrame:
    """``df`` with ``packed`` and ``error``, see ``packed``, by Arrow batches."""

    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.DataFrame:
        none = lambda x: None if pd.isna(x) else x
        return pd.DataFrame([packed(none(x), none(y), none(z)) for x, y, z in zip(a, b, c, strict=True)], columns=["packed", "error"], dtype=object)

    out = df.withColumn("_cases", F.pandas_udf(run, "packed string, error string")(public, private, metadata))
    return out.withColumns({"packed": F.col("_cases.packed"), "error": F.col("_cases.error")}).drop("_cases")


def unpacked(text: Column) -> Column:
    """inputs, outputs and fn_name of packed cases. Null: null; a text that is not packed cases fails the job."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            yield pd.Series([None if pd.isna(x) else json.dumps(cases_of(x)) for x in t], dtype=object)

    return F.from_json(F.pandas_udf(run, "string")(text), "inputs array<string>, outputs array<string>, fn_name string")


#: The builders of tasks by name: each takes a table and gives samples.
TASKS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def task(name: str) -> Callable:
    """Registers a builder; a name is given once."""

    def register(f: Callable[[DataFrame], DataFrame]):
        if TASKS.setdefault(name, f) is not f:
            raise ValueError(f"task {name} is known already")
        return f

    return register


def evaluation_set(tables: dict[str, DataFrame], tasks: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """The samples of all named tasks, each built from its table. A name that no builder has is refused."""
    known = TASKS if tasks is None else tasks
    missing = sorted(set(tables) - set(known))
    if missing or not tables:
        raise ValueError(f"no task {', '.join(missing)}; known are {', '.join(sorted(known))}")
    out = None
    for name, df in tables.items():
        part = known[name](df)
        out = part if out is None else out.unionByName(part)
    return out


@task("math")
def math_task(df: DataFrame) -> DataFrame:
    """From id, question, answer."""
    return sample(df, F.col("question"), F.col("answer"), "math", "Math", "test", F.col("id"))


@task("choice")
def choice_task(df: DataFrame) -> DataFrame:
    """From id, question, right, wrong (three texts)."""
    c = df.withColumn("_c", shuffled_choice(F.col("question"), F.col("right"), F.col("wrong"), F.col("id"), "choice"))
    return sample(c, F.col("_c.prompt"), F.col("_c.letter"), "choice", "Science", "test", F.col("id"))


@task("program")
def program_tasks(df: DataFrame) -> DataFrame:
    """From id, question, starter, public, private, metadata; tasks whose cases can't be read have a null truth."""
    return sample(with_packed_cases(df, "public", "private", "metadata"), program_task(F.col("question"), F.col("starter")), F.col("packed"), "program", "Code", "test", F.col("id"))


def within(df: DataFrame, date: str, first: str, end: str) -> DataFrame:
    """Rows dated from ``first`` on and before ``end``; dates are ISO texts. Those without a date go."""
    return df.where((F.col(date) >= first) & (F.col(date) < end))


def updated_lessons(state: DataFrame, batch: DataFrame, key: str, score: str, keep: float = 0.5) -> DataFrame:
    """key, score, seen: a batch's mean scores mixed into the state, ``keep`` of the old score and the rest of the new
    one. Keys that the batch lacks stay as they are; those that the state lacks begin with the batch's mean. Null
    scores in a batch are not counted, a key with such alone is not seen."""
    new = batch.where(F.col(score).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.avg(score).alias("_new"), F.count("*").alias("_n"))
    both = state.select(key, F.col("score").alias("_old"), "seen").join(new, key, "full")
    mixed = F.when(F.col("_new").isNull(), F.col("_old")).when(F.col("_old").isNull(), F.col("_new")).otherwise(keep * F.col("_old") + (1 - keep) * F.col("_new"))
    return both.select(key, mixed.alias("score"), (F.coalesce("seen", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("long").alias("seen"))


def lessons(df: DataFrame, state: DataFrame, key: str, target: float = 0.5) -> DataFrame:
    """``df`` with ``place``: rows that were never seen first, then those whose score is nearest to ``target``, equals by
    their key; the order in which a curriculum draws them. ``df`` has a row a key."""
    from weftline.operators.batch import with_position

    far = F.when(F.col("_s").isNull(), -1.0).otherwise(F.abs(F.col("_s") - target))
    joined = df.join(state.select(key, F.col("score").alias("_s")), key, "left").withColumn("_far", far)
    return with_position(joined, ["_far", key], "place").drop("_s", "_far")
