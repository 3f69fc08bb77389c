"""Running untrusted code against its tests, in a process of its own. Off unless a caller asks for it by name."""

from __future__ import annotations

import ast
import os
import signal
import subprocess
import sys
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.answers import error_class

#: Seconds and bytes of memory that a run gets.
SECONDS, MEMORY = 5, 512 << 20


def _limits() -> None:
    import resource

    resource.setrlimit(resource.RLIMIT_CPU, (SECONDS, SECONDS))
    resource.setrlimit(resource.RLIMIT_AS, (MEMORY, MEMORY))
    resource.setrlimit(resource.RLIMIT_FSIZE, (1 << 20, 1 << 20))


def _ended(p: subprocess.Popen) -> None:
    """Ends a process and all that it began and left in its session."""
    try:
        os.killpg(p.pid, signal.SIGKILL)
    except ProcessLookupError:
        pass
    p.wait()


def run_python(script: str, given: str = "", seconds: float = SECONDS) -> tuple[bool, str, str, bool]:
    """(ended well, stdout, stderr, timed out) of a script: isolated from the site and the environment, in an empty folder
    and a session that go with it, under limits of time, memory and file size (1 MB, output as well).

    This is no sandbox: the script runs as the worker's user, may read that user's files and use the network. Run code
    that nobody vouches for in workers without either. Children of the script are ended with it unless they begin a
    session of their own; each has the limits, their number has none.
    """
    with tempfile.TemporaryDirectory() as home, tempfile.TemporaryFile() as asked, tempfile.TemporaryFile() as out, tempfile.TemporaryFile() as err:
        asked.write(given.encode("utf-8", "surrogatepass"))
        asked.seek(0)
        p = subprocess.Popen([sys.executable, "-I", "-c", script], stdin=asked, stdout=out, stderr=err, cwd=home, env={"PATH": os.defpath, "PYTHONIOENCODING": "utf-8"}, start_new_session=True, preexec_fn=_limits)
        try:
            p.wait(seconds)
        except subprocess.TimeoutExpired:
            return False, "", "", True
        finally:
            _ended(p)
        out.seek(0)
        err.seek(0)
        return p.returncode == 0, out.read().decode("utf-8", "replace"), err.read().decode("utf-8", "replace"), False


def with_tests(code: str, tests: list[str]) -> str:
    """The code with its test lines in one function that is called at the end."""
    body = [line for t in tests for line in t.split("\n")] + ["return True"]
    return code.rstrip() + "\n\n\ndef __run_tests__():\n" + "\n".join(f"    {line}" for line in body) + "\n\n__run_tests__()\n"


def _each_once(df: DataFrame, columns: list[str], run: Callable, schema: str, enabled: bool) -> DataFrame:
    """``df`` with what ``run`` makes of each different combination of the columns; nulls are equal."""
    if not enabled:
        raise ValueError("running code is off; enabled=True allows it")
    asked = [F.col(c).alias(f"_k{i}") for i, c in enumerate(columns)]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [run(*r) for r in f.itertuples(index=False)]
            yield pd.concat([f.reset_index(drop=True), pd.DataFrame(made, columns=names)], axis=1)

    names = [x.strip().split()[0] for x in schema.split(",")]
    kinds = ", ".join(f"_k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))
    done = df.select(*asked).distinct().mapInPandas(rows, f"{kinds}, {schema}")
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(columns)]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return df.join(done, condition, "left").drop(*(f"_k{i}" for i in range(len(columns))))


def tested(df: DataFrame, code: str, tests: str, enabled: bool = False) -> DataFrame:
    """``df`` with ``passed``, ``stdout``, ``stderr`` and ``error`` of its code against its tests (an array of lines of
    code; none: the code has to run). Equal code with equal tests runs once."""

    def run(source: str | None, own) -> tuple:
        return run_python(with_tests(source or "", list(own) if own is not None else []))

    out = _each_once(df, [code, tests], run, "passed boolean, stdout string, stderr string, timed_out boolean", enabled)
    return out.withColumn("error", F.when(F.col("passed"), "None").otherwise(error_class(F.col("stderr"), F.col("stdout"), F.col("timed_out")))).drop("timed_out")


def rewrite_gate(df: DataFrame, before: str, after: str, tests: str, enabled: bool = False) -> DataFrame:
    """``df`` with ``gate``: 1 if there are no tests, or if both codes pass them, else 0."""
    one = tested(df, before, tests, enabled).withColumnRenamed("passed", "_before").drop("stdout", "stderr", "error")
    both = tested(one, after, tests, enabled).withColumnRenamed("passed", "_after").drop("stdout", "stderr", "error")
    none = F.coalesce(F.size(tests), F.lit(0)) <= 0
    return both.withColumn("gate", F.when(none | (F.col("_before") & F.col("_after")), 1.0).otherwise(0.0)).drop("_before", "_after")


def solution_code(reply: Column) -> Column:
    """What follows the last Python fence of a reply, up to its end; a reply without one is code as it stands."""
    return F.substring_index(F.substring_index(reply, "```python", -1), "```", 1)


def share_of_cases(df: DataFrame, code: str, inputs: str, outputs: str, enabled: bool = False) -> DataFrame:
    """``df`` with ``share``: of its test cases (arrays of what is read and what must be written) those that pass."""

    def run(source: str | None, given, wanted) -> tuple:
        cases = list(zip(given if given is not None else [], wanted if wanted is not None else [], strict=False))
        right = 0
        for x, y in cases:
            ok, out, _, _ = run_python(source or "", x)
            right += ok and [line.rstrip() for line in out.strip().split("\n")] == [line.rstrip() for line in y.strip().split("\n")]
        return (right / len(cases) if cases else 0.0,)

    return _each_once(df, [code, inputs, outputs], run, "share double", enabled)


def first_passing(generate: Callable[[str, str, int], str], prompt: str, tests: list[str], attempts: int) -> tuple:
    """(attempts made, code, passed, error) of generating, testing and repairing: ``generate(prompt, feedback, attempt)``
    is asked again with the error until the code passes or the attempts are used up."""
    feedback, code, error, n = "", "", "None", 0
    for n in range(1, attempts + 1):
        code = generate(prompt, feedback, n)
        try:
            ast.parse(code)
        except (SyntaxError, ValueError) as e:
            error = feedback = f"SyntaxError: {e}"
            continue
        ok, out, err, late = run_python(with_tests(code, tests))
        if ok:
            return n, code, True, "None"
        error = feedback = "Timeout" if late else (err.strip() or out.strip()).split("\n")[-1]
    return n, code, False, error


def repaired(df: DataFrame, prompt: str, tests: str, generate: Callable[[str, str, int], str], attempts: int = 3, enabled: bool = False) -> DataFrame:
    """``df`` with ``attempts``, ``code``, ``passed`` and ``last_error`` of each prompt's repair loop."""

    def run(p: str | None, own) -> tuple:
        return first_passing(generate, p or "", list(own) if own is not None else [], attempts)

    return _each_once(df, [prompt, tests], run, "attempts int, code string, passed boolean, last_error string", enabled)
