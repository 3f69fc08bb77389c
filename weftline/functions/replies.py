"""What a model's reply holds: steps, formulas, rewrites, feedback, and scores without an evaluator. As Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.binding import let

# Lines that are only a delimiter of displayed mathematics.
DELIMITERS = ["$$", "\\[", "\\]", "\\(", "\\)"]
# Words that part the formulas of a sentence.
CONNECTIVES = ["so", "thus", "therefore", "then", "hence", "and", "which implies", "this gives", "we have"]
# The lists that feedback must have.
FEEDBACK = ["preserve", "fix", "avoid", "evidence"]
# The weights of a step's scores.
WEIGHTS = {"similarity": 0.18, "logic_consistency": 0.24, "formula_correctness": 0.24, "completeness": 0.17, "reasoning_gain": 0.17}

# How formulas and fenced blocks are found, and what a reply without JSON gets as its rationale.
FORMULA = r"[A-Za-z0-9().\s+\-*/^=<>]{3,}"
FENCE = r"(?s)```(?:json)?\s*(.*?)```"
NO_JSON = "Parsed from non-JSON model response."


def _trimmed(t: Column) -> Column:
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def _filled(items: Column) -> Column:
    return F.filter(F.transform(items, _trimmed), lambda x: x != "")


def adapter_steps(text: Column) -> Column:
    """Lines without bullets, numbering, delimiters and environments if there are two or more, else sentences, else the
    text. Lines of one or two signs count only with a letter or digit. Null and blank texts: none."""

    def body(t: Column) -> Column:
        bare = F.transform(F.split(t, "\n", -1), lambda x: _trimmed(F.regexp_replace(x, r"^\s*(?:[-*]|\d+[.)：:])\s*", "")))
        keep = lambda x: (x != "") & ~x.isin(*DELIMITERS) & ~x.startswith("\\begin{") & ~x.startswith("\\end{") & ((F.length(x) > 2) | x.rlike("[A-Za-z0-9一-龥]"))
        sentences = F.filter(_filled(F.split(t, r"(?<=[.!?。！？])\s+", -1)), lambda x: ~x.isin(*DELIMITERS))
        whole = let(sentences, lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(t)))
        return let(F.filter(bare, keep), lambda lines: F.when(F.size(lines) >= 2, lines).otherwise(whole))

    none = F.array().cast("array<string>")
    return let(_trimmed(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))), lambda t: F.when(t == "", none).otherwise(body(t)))


def clause_formulas(text: Column) -> Column:
    """Formulas between connectives and punctuation: runs of formula signs with an operator, without the words before."""
    chunks = F.split(text, r"(?i)\b(?:" + "|".join(CONNECTIVES) + r")\b|[,;.]", -1)
    runs = F.flatten(F.transform(chunks, lambda c: F.regexp_extract_all(c, F.lit(FORMULA), F.lit(0))))

    def bare(f: Column) -> Column:
        f = F.regexp_replace(F.regexp_replace(f, r"^[ .,:;]+|[ .,:;]+$", ""), r"\s+", " ")
        return _trimmed(F.regexp_replace(f, r"^(?:[A-Za-z]+\s+){1,4}(?=[A-Za-z0-9(])", ""))

    return F.filter(F.transform(runs, bare), lambda f: f.rlike(r"[=+\-*/^]"))


def _fenced(text: Column) -> Column:
    return F.when(text.rlike(FENCE), F.regexp_extract(text, FENCE, 1))


def _is_json(text: Column) -> Column:
    """Whether a text is a JSON object or list. Other scalars count as text."""
    return F.try_parse_json(text).isNotNull() & text.rlike(r"^\s*[\[{]")


def reply_steps(reply: Column) -> Column:
    """The steps of a reply: the list ``steps`` of a JSON object, or of one between fences, else its lines without
    bullets and numbering, else the reply itself. An object without ``steps`` has none."""

    def of(t: Column, further: Column | None) -> Column:
        lines = F.filter(F.transform(F.split(t, r"\r\n|\n|\r", -1), lambda x: _trimmed(F.regexp_replace(x, r"^\s*(?:[-*]|\d+[.)])\s*", ""))), lambda x: x != "")
        plain = let(lines, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(t)))
        listed = F.from_json(t, "steps array<string>")["steps"]
        missing = F.get_json_object(t, "$.steps").isNull()
        found = F.when(_is_json(t) & missing, F.array().cast("array<string>")).when(_is_json(t) & listed.isNotNull(), _filled(F.filter(listed, lambda x: x.isNotNull())))
        return F.coalesce(found, plain) if further is None else F.coalesce(found, further, plain)

    def body(t: Column) -> Column:
        inside = F.when(_fenced(t).isNotNull(), let(_trimmed(F.coalesce(_fenced(t), F.lit(""))), lambda x: of(x, None)))
        return of(t, inside)

    return let(_trimmed(reply), body)


def reply_rewrite(reply: Column) -> Column:
    """code, reasoning and rationale of a rewrite: from a JSON object, or from one between fences, else the code is what
    stands between the fences, or the whole reply."""
    empty = F.array().cast("array<string>")

    def of(t: Column) -> Column:
        o = F.from_json(t, "code string, reasoning array<string>, rationale string")
        is_object = _is_json(t) & t.rlike(r"^\s*\{")
        got = F.struct(_trimmed(F.coalesce(o["code"], F.lit(""))).alias("code"), F.coalesce(o["reasoning"], empty).alias("reasoning"), _trimmed(F.coalesce(o["rationale"], F.lit(""))).alias("rationale"))
        plain = F.struct(t.alias("code"), empty.alias("reasoning"), F.lit(NO_JSON).alias("rationale"))
        return F.when(is_object, got).otherwise(plain)

    return let(_trimmed(reply), lambda t: F.when(~_is_json(t) & _fenced(t).isNotNull(), let(_trimmed(F.coalesce(_fenced(t), F.lit(""))), of)).otherwise(of(t)))


def feedback(reply: Column, fallback: dict[str, Column]) -> Column:
    """The four lists of a reply that is a JSON object with all of them, else those of ``fallback``. A single text counts
    as a list of one; empty entries go."""
    empty = F.array().cast("array<string>")

    def listed(raw: Column) -> Column:
        """``raw`` is the JSON of a value."""
        items = F.from_json(raw, "array<string>")
        text = F.regexp_replace(raw, r'^"|"$', "")
        return F.when(raw.rlike(r"^\s*\["), F.filter(items, lambda x: x.isNotNull() & (_trimmed(x) != ""))).when(_trimmed(raw).rlike(r"^[\[{]") | (_trimmed(text) == ""), empty).otherwise(F.array(_trimmed(text)))

    value = lambda k: F.get_json_object(reply, f"$.{k}")
    complete = reduce(lambda a, b: a & b, [value(k).isNotNull() for k in FEEDBACK]) & _is_json(reply)
    own = F.struct(*(F.coalesce(listed(value(k)), empty).alias(k) for k in FEEDBACK))
    other = F.struct(*(F.coalesce(F.filter(fallback.get(k, empty), lambda x: _trimmed(x) != ""), empty).alias(k) for k in FEEDBACK))
    return F.when(complete, own).otherwise(other)


def fallback_scores(step: Column) -> Column:
    """Scores of a recovered step without an evaluator, from its number of words and whether it holds a formula."""

    def scores(t: Column) -> Column:
        words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
        long, formula = words >= 5, F.size(clause_formulas(t)) > 0
        own = {
            "similarity": F.lit(0.82),
            "logic_consistency": F.when(words > 0, 0.78).otherwise(0.0),
            "formula_correctness": F.when(formula, 0.85).otherwise(0.65),
            "completeness": F.when(long, 0.8).otherwise(0.55),
            "reasoning_gain": F.when(long, 0.68).otherwise(0.45),
        }
        total = reduce(lambda a, b: a + b, [F.lit(w) * own[k] for k, w in WEIGHTS.items()])
        return F.struct(*(c.alias(k) for k, c in own.items()), total.alias("aggregate_score"), (total >= 0.62).alias("accepted"))

    return let(step, scores)
