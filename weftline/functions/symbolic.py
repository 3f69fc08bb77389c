"""Answers with unknowns: LaTeX read as quotients of polynomials, compared exactly.

A polynomial is a dict of monomials to fractions; a monomial is a sorted tuple of (atom, exponent). Atoms are unknowns,
pi, roots of primes, powers of primes with an unknown in the exponent, roots of polynomials and functions of polynomials.
The square of a root is taken out at once, so that numbers with square roots have one form.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from fractions import Fraction
from functools import lru_cache
from math import gcd, lcm

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import latex

#: Bounds of an answer's characters, of a polynomial's terms, of exponents, of bits of a number and of nesting. An answer beyond one has no value.
CHARS, TERMS, EXPONENT, BITS, NESTING = 400, 300, 40, 2000, 30
#: Different letters in two answers beyond which they count as words and are not read.
UNKNOWNS = 2

# Commands that are read as functions of what follows, and those that say nothing.
FUNCTIONS = ["sin", "cos", "tan", "cot", "sec", "csc", "log", "ln", "arcsin", "arccos", "arctan"]
SILENT = [r"\left", r"\right", r"\,", r"\;", r"\:", r"\!", r"\ ", r"\quad", r"\displaystyle", r"\big", r"\bigl", r"\bigr", "~"]
# Signs and commands that stand for another.
SAME = {r"\cdot": "*", r"\times": "*", "·": "*", "×": "*", r"\div": "/", "÷": "/", r"\dfrac": r"\frac", r"\tfrac": r"\frac", r"\cfrac": r"\frac", r"\{": "(", r"\}": ")", "[": "(", "]": ")", "−": "-", "√": r"\sqrt", "π": r"\pi", "**": "^"}
_TOKEN = re.compile(r"\\[a-z]+|\\[,;:! {}]|sqrt|pi|\d+(?:\.\d+)?|\.\d+|\*\*|\S")

Poly = dict[tuple, Fraction]


class NoValue(ValueError):
    """The text is no expression of this kind, or beyond the bounds."""


def _constant(value: Fraction | int) -> Poly:
    return {(): Fraction(value)} if value else {}


def _atom(atom: tuple, exponent: int = 1) -> Poly:
    return {((atom, exponent),): Fraction(1)}


def _checked(p: Poly) -> Poly:
    if len(p) > TERMS or any(c.numerator.bit_length() > BITS or c.denominator.bit_length() > BITS for c in p.values()):
        raise NoValue("too large")
    return p


def add(a: Poly, b: Poly, sign: int = 1) -> Poly:
    out = dict(a)
    for m, c in b.items():
        out[m] = out.get(m, Fraction(0)) + sign * c
    return _checked({m: c for m, c in out.items() if c})


def multiply(a: Poly, b: Poly) -> Poly:
    if len(a) * len(b) > 4 * TERMS:
        raise NoValue("too large")
    out: Poly = {}
    for m, c in a.items():
        for n, d in b.items():
            for k, e in _product(m, n).items():
                out[k] = out.get(k, Fraction(0)) + c * d * e
    return _checked({m: c for m, c in out.items() if c})


def _product(m: tuple, n: tuple) -> Poly:
    """Two monomials' product; pairs of a root leave it."""
    powers = dict(m)
    for atom, e in n:
        powers[atom] = powers.get(atom, 0) + e
    if any(abs(e) > EXPONENT for e in powers.values()):
        raise NoValue("too large")
    out = {tuple(sorted(((a, e % 2 if a[0] == "root" else e) for a, e in powers.items() if (e % 2 if a[0] == "root" else e)), key=repr)): Fraction(1)}
    for atom, e in powers.items():
        for _ in range(e // 2 if atom[0] == "root" else 0):
            out = multiply(out, dict(atom[1]) if isinstance(atom[1], tuple) else _constant(atom[1]))
    return out


class Quotient:
    """A polynomial over a polynomial other than zero."""

    def __init__(self, top: Poly, below: Poly | None = None):
        self.top, self.below = top, _constant(1) if below is None else below
        if not self.below:
            raise NoValue("division by zero")

    def __add__(self, other: Quotient) -> Quotient:
        if self.below == other.below:
            return Quotient(add(self.top, other.top), self.below)
        return Quotient(add(multiply(self.top, other.below), multiply(other.top, self.below)), multiply(self.below, other.below))

    def __neg__(self) -> Quotient:
        return Quotient({m: -c for m, c in self.top.items()}, self.below)

    def __mul__(self, other: Quotient) -> Quotient:
        return Quotient(multiply(self.top, other.top), multiply(self.below, other.below))

    def __truediv__(self, other: Quotient) -> Quotient:
        return Quotient(multiply(self.top, other.below), multiply(self.below, other.top))

    def equals(self, other: Quotient) -> bool:
        return not add(multiply(self.top, other.below), multiply(other.top, self.below), -1)

    def polynomial(self) -> Poly:
        """Itself, if it is over a number."""
        if set(self.below) != {()}:
            raise NoValue("not a polynomial")
        return {m: c / self.below[()] for m, c in self.top.items()}

    def number(self) -> Fraction | None:
        """Its value, if it is a fraction of whole numbers."""
        if set(self.below) != {()} or set(self.top) - {()}:
            return None
        return self.top.get((), Fraction(0)) / self.below[()]


def _key(p: Poly) -> tuple:
    return tuple(sorted(p.items(), key=repr))


def _primes(n: int) -> dict[int, int]:
    if n.bit_length() > 40:
        raise NoValue("too large")
    out, p = {}, 2
    while p * p <= n:
        while n % p == 0:
            out[p], n = out.get(p, 0) + 1, n // p
        p += 1
    return out | ({n: out.get(n, 0) + 1} if n > 1 else {})


def root(q: Quotient) -> Quotient:
    """The square root: of a number by its primes, of a polynomial as an atom; that of a quotient has roots above and below."""
    value = q.number()
    if value is None:
        if set(q.below) != {()}:
            return root(Quotient(q.top)) / root(Quotient(q.below))
        p = q.polynomial()
        content = Fraction(gcd(*(c.numerator for c in p.values())), lcm(*(c.denominator for c in p.values())))
        return root(Quotient(_constant(content))) * Quotient(_atom(("root", _key({m: c / content for m, c in p.items()}))))
    if value < 0:
        raise NoValue("root of a negative number")
    out = _constant(Fraction(1, value.denominator)) if value else {}
    for p, e in _primes(value.numerator * value.denominator).items() if value else ():
        out = multiply(out, _constant(p ** (e // 2)))
        if e % 2:
            out = multiply(out, _atom(("root", p)))
    return Quotient(out)


def power(base: Quotient, exponent: Quotient) -> Quotient:
    value = exponent.number()
    if value is not None:
        if value.denominator == 2:
            base, value = root(base), value * 2
        if value.denominator != 1 or abs(value) > EXPONENT:
            raise NoValue("exponent")
        out = Quotient(_constant(1))
        for _ in range(abs(int(value))):
            out = out * base
        return Quotient(_constant(1)) / out if value < 0 else out
    of = base.number()
    if of is None or of <= 0:
        raise NoValue("unknown exponent of an unknown")
    out = Quotient(_constant(1))
    for sign, number in ((1, of.numerator), (-1, of.denominator)):
        for p, times in _primes(number).items():
            for m, c in exponent.polynomial().items():
                c = c * times * sign
                if c.denominator != 1 or abs(c) > EXPONENT:
                    raise NoValue("exponent")
                part = Quotient(_constant(Fraction(p) ** int(c))) if m == () else Quotient(_atom(("power", p, m), abs(int(c))))
                out = out / part if m != () and c < 0 else out * part
    return out


class _Reader:
    """Reads an expression from its tokens: sums of products of powers, with products that no sign marks."""

    def __init__(self, text: str):
        if len(text) > CHARS:
            raise NoValue("too long")
        found = (SAME.get(t, t) for t in _TOKEN.findall(text.lower()))
        self.tokens = [r"\sqrt" if t == "sqrt" else r"\pi" if t == "pi" else t for t in found if t not in SILENT]
        self.at = self.depth = 0

    def whole(self) -> Quotient:
        out = self.sum()
        if self.at < len(self.tokens):
            raise NoValue(self.tokens[self.at])
        return out

    def next(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, token: str | None = None) -> str:
        found = self.next()
        if not found or token is not None and found != token:
            raise NoValue(f"no {token}")
        self.at += 1
        return found

    def sum(self) -> Quotient:
        self.depth += 1
        if self.depth > NESTING:
            raise NoValue("too deep")
        out = self.product()
        while self.next() in ("+", "-"):
            out = out + self.product() if self.take() == "+" else out + -self.product()
        self.depth -= 1
        return out

    def product(self) -> Quotient:
        if self.next() in ("+", "-"):
            return self.product() if self.take() == "+" else -self.product()
        out = self.factor()
        while True:
            if self.next() in ("*", "/"):
                sign = self.take()
                negative = self.next() == "-" and bool(self.take())
                more = -self.factor() if negative else self.factor()
                out = out * more if sign == "*" else out / more
            elif self.next() and self.next() not in "+-)}|=,":
                out = out * self.factor()
            else:
                return out

    def factor(self) -> Quotient:
        out = self.base()
        if self.next() == "^":
            self.take()
            negative = self.next() == "-" and bool(self.take())
            exponent = self.factor()  # powers of powers belong to the upper one
            out = power(out, -exponent if negative else exponent)
        return out

    def group(self) -> Quotient:
        """What stands in braces, or one sign."""
        if self.next() == "{":
            return self.base()
        token = self.next()
        if len(token) > 1 and token.isdigit():  # \frac12 is of single digits
            self.tokens[self.at : self.at + 1] = [token[0], token[1:]]
        return self.base()

    def base(self) -> Quotient:
        token = self.take()
        if token in ("(", "{"):
            out = self.sum()
            self.take(")" if token == "(" else "}")
            return out
        if token[0].isdigit() or token[0] == ".":
            out = Quotient(_constant(Fraction(token)))
            # a whole number before a fraction of whole numbers is a mixed number
            rest = self.tokens[self.at : self.at + 7]
            if token.isdigit() and len(rest) == 7 and rest[0] == r"\frac" and rest[1] == rest[4] == "{" and rest[3] == rest[6] == "}" and rest[2].isdigit() and rest[5].isdigit():
                return out + self.base()
            return out
        if token == r"\frac":
            return self.group() / self.group()
        if token == r"\sqrt":
            if self.tokens[self.at : self.at + 1] + self.tokens[self.at + 2 : self.at + 4] == ["(", ")", "{"]:  # an index
                if self.tokens[self.at + 1] != "2":
                    raise NoValue("a root other than the square root")
                self.at += 3
            return root(self.group())
        if token == r"\pi":
            return Quotient(_atom(("pi",)))
        if token[0] == "\\" and token[1:] in FUNCTIONS:
            return Quotient(_atom(("function", token[1:], _key(self.factor().polynomial()))))
        if len(token) == 1 and token.isalpha():
            return Quotient(_atom(("unknown", token)))
        raise NoValue(token)


@lru_cache(maxsize=20_000)
def value_of(text: str) -> Quotient | None:
    """The value of an answer; null if it is no expression that is read here, or beyond the bounds."""
    try:
        return _Reader(text).whole()
    except (NoValue, RecursionError):
        return None


def letters(text: str) -> set[str]:
    """The letters of an answer, without those of roots and fractions; a name of a function counts with its letters."""
    return {c for c in re.sub(r"\\?[dtc]?frac|\\?sqrt|\\(?:left|right|cdot|times|div)(?![a-z])", "", text.lower()) if c.isalpha()}


@lru_cache(maxsize=20_000)
def same_value(a: str, b: str, unknowns: int = UNKNOWNS) -> bool:
    """Whether two answers are the same expression, whatever its form. Answers of more different letters are words."""
    if len(letters(a) | letters(b)) > unknowns:
        return False
    x, y = value_of(a), value_of(b)
    if x is None or y is None:
        return False
    try:
        return x.equals(y)
    except NoValue:
        return False


_FRACTION, _WHOLE = re.compile(r"-?[0-9]+.?/0*[1-9][0-9]*.?"), re.compile(r"-?[0-9]+(\.0*)?")


def element_agrees(given: str, truth: str, unknowns: int = UNKNOWNS) -> bool:
    """As ``same_value``, but two fractions written with a slash must be equal as they stand, as reduced ones are asked
    for, and a whole number agrees with whole numbers only."""
    given, truth = ("".join(t.split()) for t in (given, truth))
    if _FRACTION.fullmatch(given) and _FRACTION.fullmatch(truth):
        return given == truth
    if bool(_WHOLE.fullmatch(given)) != bool(_WHOLE.fullmatch(truth)):
        return False
    return same_value(given, truth, unknowns)


def elements(text: str) -> list[str]:
    """What stands between the outer brackets of a tuple or interval, by commas other than those of thousands; else the text."""
    text = re.sub(r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", "", text)
    inner = text[1:-1]
    return inner.split(",") if len(text) > 2 and text[0] in "([" and text[-1] in ")]" and not re.search(r"[()\[\]]", inner) else [text]


def elements_agree(given: str, truth: str, unknowns: int = UNKNOWNS) -> bool:
    x, y = elements(given), elements(truth)
    if len(x) != len(y) or len(y) > 1 and (given[0], given[-1]) != (truth[0], truth[-1]):
        return False
    return bool(given) and all(element_agrees(p, q, unknowns) for p, q in zip(x, y, strict=True))


def _over_pairs(check: Callable, a: Column, b: Column) -> Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([p is not None and q is not None and check(p, q) for p, q in zip(x, y, strict=True)], dtype=bool)

    return F.pandas_udf(run, "boolean")(a, b)


def symbolically_equal(answer: Column, truth: Column, unknowns: int = UNKNOWNS) -> Column:
    """Whether two answers are the same expression, by exact arithmetic: ``2(x+1)`` and ``2x+2``, ``\\frac{x^2-1}{x-1}``
    and ``x+1``, ``\\sqrt{12}`` and ``2\\sqrt3``, ``4^n`` and ``2^{2n}``. Nulls, texts that are no expression, and those
    beyond the bounds of length, terms, exponents and nesting are equal to nothing; so time and memory of a row are bounded."""
    return _over_pairs(lambda p, q: same_value(p, q, unknowns), answer, truth)


def grade(answer: Column, truth: Column, unknowns: int = UNKNOWNS) -> Column:
    """Whether an answer is right: by its normal or short form, or else element by element (of tuples and intervals with
    the same brackets) by ``element_agrees``. Null answers and truths are wrong."""
    text = latex.equivalent(answer, truth) | F.coalesce(latex.short_form(answer) == latex.short_form(truth), F.lit(False))
    by_element = _over_pairs(lambda p, q: elements_agree(p, q, unknowns), F.trim(latex.plain(answer)), F.trim(latex.plain(truth)))
    return F.when(answer.isNull() | truth.isNull(), False).otherwise(text | by_element)
