"""LaTeX answers: their normal form, equality, tuples and short numeric forms, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.answers import count_of, last_boxed, unboxed
from weftline.functions.binding import let

# Literal replacements before and after units on the right are cut off, in this order.
BEFORE_UNITS = [("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")]
AFTER_UNITS = [("\\\\%", ""), ("\\%", ""), (" .", " 0."), ("{.", "{0.")]
# Units that an answer may carry, each with an optional plural and power.
UNITS = ["degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard"]
# Signs and words that stand for others in short answers, in this order.
SHORT_FORMS = [("\\%", "%"), ("\\$", "$"), ("$", ""), ("%", ""), (" or ", " , "), (" and ", " , "), ("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12")]
_INTEGER = "(?:0|-?[1-9][0-9]*)"


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def _first(text: Column, n: int = 1) -> Column:
    return F.substr(text, F.lit(1), F.lit(n))


def _after(text: Column, n: int) -> Column:
    return F.substr(text, F.lit(n + 1))


def _parts(text: Column, command: str) -> Column:
    return F.split(text, "\\Q" + command + "\\E", -1)


def braced_roots(text: Column) -> Column:
    """``\\sqrt3`` as ``\\sqrt{3}``; null where a root is of nothing."""

    def fixed(parts: Column) -> Column:
        later = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
        each = F.transform(later, lambda p: F.when(_first(p) == "{", F.concat(F.lit("\\sqrt"), p)).otherwise(F.concat(F.lit("\\sqrt{"), _first(p), F.lit("}"), _after(p, 1))))
        return F.when(~F.exists(later, lambda p: p == ""), F.concat(parts[0], F.array_join(each, "")))

    return let(_parts(text, "\\sqrt"), fixed)


def braced_fractions(text: Column) -> Column:
    """``\\frac12`` as ``\\frac{1}{2}``; a text with a fraction of one sign stays as it is; null where one has nothing."""

    def each(p: Column) -> Column:
        top = F.concat(F.lit("\\frac{"), _first(p), F.lit("}"))
        below = F.when(F.substr(p, F.lit(2), F.lit(1)) == "{", _after(p, 1)).otherwise(F.concat(F.lit("{"), F.substr(p, F.lit(2), F.lit(1)), F.lit("}"), _after(p, 2)))
        return F.when(_first(p) == "{", F.concat(F.lit("\\frac"), p)).otherwise(F.concat(top, below))

    def fixed(parts: Column) -> Column:
        later = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
        # what stands first decides: a missing fraction fails, a short one ends the attempt
        odd = F.filter(later, lambda p: (p == "") | ((F.length(p) < 2) & (p != "{")))
        whole = F.concat(parts[0], F.array_join(F.transform(later, each), ""))
        return F.when(F.size(odd) == 0, whole).when(odd[0] != "", text)

    return let(_parts(text, "\\frac"), fixed)


def normal_form(answer: Column) -> Column:
    """An answer in the form in which LaTeX answers are compared; null where it has none (two units on the right, a root
    or fraction of nothing)."""

    def start(t: Column) -> Column:
        t = F.when(_first(t) == ".", F.concat(F.lit("0"), t)).otherwise(t)
        # 'k = ' at the beginning
        named = (count_of(t, "=") == 1) & (F.length(F.substring_index(t, "=", 1)) <= 2)
        return let(F.when(named, F.substring_index(t, "=", -1)).otherwise(t), finish)

    def finish(t: Column) -> Column:
        t = braced_fractions(F.replace(braced_roots(t), F.lit(" "), F.lit("")))
        return let(F.when(t == "0.5", "\\frac{1}{2}").otherwise(t), lambda x: F.regexp_replace(x, f"^({_INTEGER})/({_INTEGER})$", r"\\frac{$1}{$2}"))

    def cut(t: Column) -> Column:
        t = F.when(count_of(t, "\\text{ ") <= 1, F.substring_index(t, "\\text{ ", 1))
        return let(_replaced(t, AFTER_UNITS), lambda x: F.when(x == "", x).otherwise(start(x)))

    return let(_replaced(answer, BEFORE_UNITS), cut)


def equivalent(a: Column, b: Column) -> Column:
    """Whether two answers have one normal form, or are equal as they stand if one of them has none; two nulls are."""
    same = let(F.struct(normal_form(a).alias("x"), normal_form(b).alias("y")), lambda s: F.when(s["x"].isNull() | s["y"].isNull(), a == b).otherwise(s["x"] == s["y"]))
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(same)


def boxed_score(text: Column, truth: Column) -> Column:
    """1 if the last boxed answer is equivalent to the truth, else 0."""
    answer = unboxed(last_boxed(text))
    return F.when(answer.isNotNull() & equivalent(answer, truth), 1.0).otherwise(0.0)


def plain(answer: Column) -> Column:
    """An answer without units, signs of money and percentage and outer braces; whole numbers without a fraction of zero, mixed numbers as sums."""
    t = F.regexp_replace(answer, r"^\\text\{(.+?)\}$", "$1")
    t = _replaced(t, SHORT_FORMS)
    for unit in UNITS:
        t = F.regexp_replace(t, unit + r"(es)?(s)? *(\^[0-9]+)?", "")
    t = F.regexp_replace(t, r"\^ *\\circ", "")
    t = F.regexp_replace(t, r"(?s)^\{(.*)\}$", "$1")
    t = F.regexp_replace(t, r",\\! *", "")
    t = F.regexp_replace(t, r"^\s*(-?[0-9]+)\.0*\s*$", "$1")
    t = F.regexp_replace(t, "- *", "-")
    return F.regexp_replace(t, r"([0-9]) +([0-9])", "$1+$2")


def short_form(answer: Column) -> Column:
    """A short answer without units, signs of money and percentage, braces and spaces, in lower case; whole numbers
    without a fraction of zero and without thousands commas, mixed numbers as sums. Commands stay as they stand."""
    t = F.lower(F.regexp_replace(plain(answer), "[ {}]", ""))
    return let(F.replace(t, F.lit(","), F.lit("")), lambda plain: F.when(plain.rlike("^-?[0-9]+(\\.0*)?$"), F.regexp_replace(plain, "\\.0*$", "")).otherwise(t))


def number_of(answer: Column) -> Column:
    """The value of a short form that is a number, a fraction of two, or a mixed number; null otherwise."""

    def value(t: Column) -> Column:
        of = lambda i: F.regexp_extract(t, r"^(-?[0-9.]+)(?:/([0-9.]+))?$", i).try_cast("double")
        latex_fraction = lambda i: F.regexp_extract(t, r"^(-?)\\frac([0-9]+)/([0-9]+)$", i)
        mixed = lambda i: F.regexp_extract(t, r"^([0-9]+)\+([0-9]+)/([0-9]+)$", i).try_cast("double")
        plain = F.when(of(2).isNull(), of(1)).when(of(2) != 0, of(1) / of(2))
        whole = F.when(mixed(3) != 0, mixed(1) + mixed(2) / mixed(3))
        signed = F.when(latex_fraction(3).try_cast("double") != 0, F.when(latex_fraction(1) == "-", -1.0).otherwise(1.0) * latex_fraction(2).try_cast("double") / latex_fraction(3).try_cast("double"))
        return F.coalesce(plain, whole, signed)

    # a fraction keeps a mark between its parts when its braces go
    return let(short_form(F.regexp_replace(answer, r"\\[dt]?frac\{([0-9]+)\}\{([0-9]+)\}", r"\\frac$1/$2")), value)


def agrees(answer: Column, truth: Column, tolerance: float = 1e-9) -> Column:
    """Whether an answer agrees with the truth by one of several ways, the strictest first: as normal forms, as short
    forms, as numbers (a percentage may stand for its hundredth or the other way round), element by element as tuples
    with the same brackets. Expressions with unknowns are compared as text only."""

    def same(a: Column, b: Column) -> Column:
        near = lambda x, y: F.abs(x - y) <= tolerance * F.greatest(F.abs(y), F.lit(1.0))
        numbers = let(F.struct(number_of(a).alias("x"), number_of(b).alias("y")), lambda s: F.coalesce(near(s["x"], s["y"]) | near(s["x"], s["y"] * 100) | near(s["x"] * 100, s["y"]), F.lit(False)))
        return equivalent(a, b) | F.coalesce(short_form(a) == short_form(b), F.lit(False)) | numbers

    def tuples(s: Column) -> Column:
        alike = (F.size(s["x"]) == F.size(s["y"])) & (F.size(s["x"]) > 1) & (_first(answer) == _first(truth)) & (F.substr(answer, F.length(answer)) == F.substr(truth, F.length(truth)))
        return alike & F.forall(F.arrays_zip(s["x"], s["y"]), lambda p: same(p["x"], p["y"]))

    elements = F.struct(tuple_elements(answer).alias("x"), tuple_elements(truth).alias("y"))
    return F.when(answer.isNull() | truth.isNull(), False).otherwise(same(answer, truth) | F.coalesce(let(elements, tuples), F.lit(False)))


def without_thousands(text: Column) -> Column:
    """Numbers without the commas that part well-formed groups of three digits."""
    comma = r"([0-9]),([0-9]{3})(?=$|[^0-9])"
    return reduce(lambda t, _: F.regexp_replace(t, comma, "$1$2"), range(8), text)


def tuple_elements(answer: Column) -> Column:
    """The elements of a tuple or interval, else the answer as the only one; an empty answer has none."""

    def split(t: Column) -> Column:
        inner = F.substr(t, F.lit(2), F.length(t) - 2)
        is_tuple = (F.length(t) > 2) & t.rlike(r"^[()\[\]]") & t.rlike(r"[()\[\]]$") & ~inner.rlike(r"[()\[\]]")
        return F.when(t == "", F.array().cast("array<string>")).when(is_tuple, F.transform(F.split(inner, ",", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))).otherwise(F.array(t))

    return let(without_thousands(answer), split)
