"""Answer extraction, normalisation and rule-based scores, as Columns."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.binding import let

# What a final answer is rid of, in this order, before it is compared.
SUBSTITUTIONS = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals",
    "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
]
#: ASCII punctuation, as a class for both regex dialects.
PUNCTUATION = r"[!-/:-@\[-`{-~]"
# How a number in an answer is written.
NUMBER = r"(\-?[0-9\.\,]+)"


def tail(text: Column, n: int) -> Column:
    """The last ``n`` characters."""
    return F.when(F.length(text) > n, F.substr(text, F.length(text) - (n - 1))).otherwise(text)


def marked_number(text: Column) -> Column:
    """The number after the last '#### ' in the last 300 characters, without thousands commas and dollar signs; null
    without one."""
    found = F.regexp_extract_all(tail(text, 300), F.lit("#### " + NUMBER), F.lit(1))
    return F.regexp_replace(F.try_element_at(found, F.lit(-1)), "[,$]", "")


def last_number(text: Column) -> Column:
    """The last number in the last 300 characters that is more than a full stop; null without one."""
    found = F.regexp_extract_all(tail(text, 300), F.lit(NUMBER), F.lit(1))
    return F.try_element_at(F.filter(found, lambda x: ~x.isin("", ".")), F.lit(-1))


def number_score(text: Column, truth: Column, flexible: bool = False, format_score: float = 0.0) -> Column:
    answer = last_number(text) if flexible else marked_number(text)
    return F.when(answer.isNull(), 0.0).when(answer == truth, 1.0).otherwise(format_score)


def last_boxed(text: Column) -> Column:
    """The last ``\\boxed{...}`` with its braces balanced, null if there is none or it is never closed.

    The depth runs over the characters from the last opening on, inside the row.
    """
    at = F.length(text) - F.length(F.substring_index(text, "\\boxed{", -1)) + 1
    rest = F.when(F.contains(text, F.lit("\\boxed{")), F.substr(text, at))

    def close(r: Column) -> Column:
        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("i"), F.lit(0).alias("end"))
        step = lambda a, c: let(
            a["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0),
            lambda d: F.struct(F.when(a["end"] > 0, a["depth"]).otherwise(d).alias("depth"), (a["i"] + 1).alias("i"), F.when(a["end"] > 0, a["end"]).when(d == 0, a["i"] + 1).otherwise(F.lit(0)).alias("end")),
        )
        end = F.aggregate(F.split(r, ""), start, step, lambda a: a["end"])
        return let(end, lambda e: F.when(e > 0, F.concat(F.lit("\\boxed{"), F.substr(r, F.lit(1), e))))

    return F.when(rest.isNotNull(), let(rest, close))


def unboxed(boxed: Column) -> Column:
    return F.substr(boxed, F.lit(len("\\boxed{") + 1), F.length(boxed) - len("\\boxed{}"))


def normalise_final(answer: Column) -> Column:
    """A final answer in the form in which answers are compared."""
    a = F.substring_index(answer, "=", -1)
    for before, after in SUBSTITUTIONS:
        a = F.replace(a, F.lit(before), F.lit(after))
    for gone in REMOVED:
        a = F.replace(a, F.lit(gone), F.lit(""))
    for pattern, by in ((r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"), (r"(\\text\{)(.*?)(\})", "$2"), (r"(\\textbf\{)(.*?)(\})", "$2"), (r"(\\overline\{)(.*?)(\})", "$2"), (r"(\\boxed\{)(.*)(\})", "$2"), (r"(frac)([^{])(.)", "frac{$2}{$3}"), (r"(sqrt)([^{])", "sqrt{$2}")):
        a = F.regexp_replace(a, pattern, by)
    a = F.replace(a, F.lit("$"), F.lit(""))
    plain = F.replace(a, F.lit(","), F.lit(""))
    return F.trim(F.when(plain.rlike("^[0-9]+$"), plain).otherwise(a))


def stated_answer(text: Column) -> Column:
    """What follows the last 'Answer:' on its line, in the last 300 characters; '[INVALID]' without one."""
    found = F.regexp_extract_all(tail(text, 300), F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("[INVALID]"))


def normalise_words(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    a = F.regexp_replace(F.lower(text), PUNCTUATION, "")
    a = F.regexp_replace(a, r"\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(a, r"\s+", " "))


def tagged_answer(text: Column) -> Column:
    """The content of the last <answer> of two at least; the first one is the instruction's. Null otherwise."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1))
    return F.when(F.size(found) > 1, F.trim(F.try_element_at(found, F.lit(-1))))


def count_of(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def exact_match(text: Column, truth: Column, inside: bool = False, format_score: float = 0.0) -> Column:
    """1 if the tagged answer equals the truth (or holds it), a quarter where tags are spammed, else format_score."""
    answer = tagged_answer(text)
    a, t = normalise_words(answer), normalise_words(truth)
    hit = F.contains(a, t) if inside else a == t
    spam = (count_of(text, "<answer>") > 10) | (count_of(text, "</answer>") > 10)
    full = F.lit(1.0) if inside else F.when(spam, 0.25).otherwise(1.0)
    return F.when(answer.isNull(), 0.0).when(hit, full).otherwise(format_score)


def thinks_and_boxes(text: Column) -> Column:
    return text.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$")


def letter_choice(text: Column) -> Column:
    """The letter after 'Answer:', with or without a dollar sign; null without one."""
    found = F.regexp_extract(text, r"(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?", 1)
    return F.when(found != "", F.upper(found))


def error_class(stderr: Column, stdout: Column, timed_out: Column) -> Column:
    both = F.concat(F.coalesce(stderr, F.lit("")), F.lit("\n"), F.coalesce(stdout, F.lit("")))
    has = lambda *parts: F.contains(both, F.lit(parts[0])) if len(parts) == 1 else F.contains(both, F.lit(parts[0])) | F.contains(both, F.lit(parts[1]))
    return (
        F.when(timed_out, "Timeout").when(has("SyntaxError"), "SyntaxError").when(has("AssertionError"), "AssertionError").when(has("ImportError", "ModuleNotFoundError"), "ImportError")
        .when(has("Traceback"), "RuntimeError").when(F.regexp_replace(both, r"\s", "") != "", "UnknownError").otherwise("None")
    )


#: Score by data source: (text, truth) -> Column.
SCORERS = {
    "grade_school": lambda text, truth: number_score(text, truth),
    "competition": lambda text, truth: F.when(normalise_final(stated_answer(text)) == truth, 1.0).otherwise(-1.0),
    "search_qa": lambda text, truth: exact_match(text, truth),
    "geometry": lambda text, truth: 0.9 * (unboxed(last_boxed(text)).eqNullSafe(truth)).cast("double") + 0.1 * thinks_and_boxes(text).cast("double"),
    "multiple_choice": lambda text, truth: letter_choice(text).eqNullSafe(truth).cast("double"),
}


def register_scorer(name: str, rule: Callable[[Column, Column], Column]) -> None:
    """Adds a source's rule (text, truth) -> Column; names are taken once."""
    if name in SCORERS:
        raise ValueError(f"{name} has a scorer")
    SCORERS[name] = rule


def load_scorer(path: str, function: str, **options) -> Callable[[Column, Column], Column]:
    """A rule from a Python file, with its options bound: ``function(text, truth, **options)`` has to give a Column."""
    spec = importlib.util.spec_from_file_location("custom_scorer", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, function):
        raise AttributeError(f"{path} has no {function}")
    return partial(getattr(module, function), **options)


def dispatch(source: Column, text: Column, truth: Column) -> Column:
    """The score of each row by its source's rule; an unknown source fails the job."""
    out = None
    for name, rule in SCORERS.items():
        out = F.when(source == name, rule(text, truth)) if out is None else out.when(source == name, rule(text, truth))
    return out.otherwise(F.raise_error(F.concat(F.lit("no scorer for "), source)).cast("double"))
