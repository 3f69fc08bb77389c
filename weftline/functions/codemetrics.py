"""Static metrics of Python sources. A source is parsed once per row; nothing of it is ever run."""

from __future__ import annotations

import ast
import builtins
import io
import keyword
import math
import re
import tokenize
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Calls and modules that a safe source does without.
UNSAFE_CALLS = frozenset({"eval", "exec", "compile", "open", "input", "__import__", "globals", "locals", "vars"})
UNSAFE_MODULES = frozenset({"os", "sys", "subprocess", "socket", "shutil", "pathlib", "requests", "urllib"})
NAMES = frozenset(dir(builtins)) | frozenset(keyword.kwlist)
_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.Assert)
_BLOCK = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith)


def parse(source: str | None) -> ast.Module | None:
    try:
        return ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def style(source: str, parses: bool) -> tuple[int, float]:
    """Violations (trailing blanks, tabs, over 88 columns, no syntax) and 1 / (1 + violations a logical line)."""
    lines = source.split("\n")
    bad = sum((x != x.rstrip()) + ("\t" in x) + (len(x) > 88) for x in lines) + (not parses)
    return bad, 1.0 / (1.0 + bad / max(1, sum(bool(x.strip()) for x in lines)))


def readability(source: str) -> float:
    lines = [x for x in source.split("\n") if x.strip()]
    if not lines:
        return 0.0
    mean = sum(map(len, lines)) / len(lines)
    long_, comments = sum(len(x) > 88 for x in lines) / len(lines), sum(x.lstrip().startswith("#") for x in lines) / len(lines)
    return max(0.0, min(1.0, 1.0 - min(0.4, max(0.0, (mean - 72) / 100)) - 0.35 * long_ + min(0.12, 0.5 * comments)))


def halstead(tree: ast.AST) -> tuple[float, float, float]:
    """Volume, difficulty and effort by operator and operand nodes."""
    operators, operands = Counter(), Counter()
    for n in ast.walk(tree):
        if isinstance(n, (ast.BinOp, ast.UnaryOp, ast.BoolOp)):
            operators[type(n.op).__name__] += 1
        elif isinstance(n, ast.Compare):
            operators.update(type(o).__name__ for o in n.ops)
        elif isinstance(n, (ast.Call, ast.Assign, ast.AugAssign, ast.Return, ast.If, ast.For, ast.While, ast.Subscript, ast.Attribute)):
            operators[type(n).__name__] += 1
        elif isinstance(n, ast.Name):
            operands[n.id] += 1
        elif isinstance(n, ast.Constant):
            operands[repr(n.value)] += 1
        elif isinstance(n, ast.arg):
            operands[n.arg] += 1
    kinds = len(operators) + len(operands)
    total = operators.total() + operands.total()
    volume = total * math.log2(kinds) if kinds > 1 else 0.0
    difficulty = len(operators) / 2 * operands.total() / len(operands) if operands else 0.0
    return volume, difficulty, volume * difficulty


def cyclomatic(tree: ast.AST) -> int:
    return 1 + sum(isinstance(n, _BRANCH) + (len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0) for n in ast.walk(tree))


def cognitive(node: ast.AST, depth: int = 0) -> int:
    """Each branch costs one more than the branches around it."""
    total = 0
    for child in ast.iter_child_nodes(node):
        branch = isinstance(child, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp))
        total += (1 + depth if branch else len(child.values) - 1 if isinstance(child, ast.BoolOp) else 0) + cognitive(child, depth + branch)
    return total


def paths(body: list[ast.stmt]) -> int:
    """Ways through a block: statements multiply, alternatives add."""
    n = 1
    for s in body:
        if isinstance(s, ast.If):
            n *= paths(s.body) + (paths(s.orelse) if s.orelse else 1)
        elif isinstance(s, (ast.For, ast.AsyncFor, ast.While)):
            n *= paths(s.body) + 1
        elif isinstance(s, ast.Try):
            n *= paths(s.body) + sum(paths(h.body) for h in s.handlers)
        elif isinstance(s, (ast.With, ast.AsyncWith, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            n *= paths(s.body)
        n = min(n, 10**9)
    return n


def nesting(node: ast.AST, depth: int = 0) -> int:
    return max([depth, *(nesting(c, depth + isinstance(c, _BLOCK)) for c in ast.iter_child_nodes(node))])


def maintainability(volume: float, complexity: int, lines: int) -> float:
    return max(0.0, min(1.0, (171 - 5.2 * math.log(max(1.0, volume)) - 0.23 * complexity - 16.2 * math.log(max(1, lines))) / 171))


def limited(value: float, good: float, step: float) -> float:
    """1 up to a good value, then falling by ``step``, not below 0."""
    return 1.0 if value <= good else max(0.0, 1.0 - (value - good) * step)


def identifiers(tree: ast.AST) -> list[str]:
    found = [n.id for n in ast.walk(tree) if isinstance(n, ast.Name)] + [n.arg for n in ast.walk(tree) if isinstance(n, ast.arg)]
    found += [n.name for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    return [x for x in dict.fromkeys(found) if x not in NAMES]


def naming(tree: ast.AST) -> float:
    """Share of names in snake case, of classes in capitals."""
    classes = {n.name for n in ast.walk(tree) if isinstance(n, ast.ClassDef)}
    names = identifiers(tree)
    fits = [bool(re.fullmatch(r"_*[A-Z][A-Za-z0-9]*" if x in classes else r"_*[a-z][a-z0-9_]*|[A-Z][A-Z0-9_]*|_+", x)) for x in names]
    return sum(fits) / len(fits) if fits else 1.0


def words_of(name: str) -> list[str]:
    return re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", name)


def unabbreviated(tree: ast.AST) -> float:
    """Share of names whose words have three letters or more, or are usual short ones."""
    usual = {"i", "j", "k", "n", "x", "y", "id", "is", "to", "in", "on", "of", "by"}
    names = identifiers(tree)
    fits = [all(len(w) >= 3 or w.lower() in usual for w in words_of(x)) for x in names]
    return sum(fits) / len(fits) if fits else 1.0


def resolved(tree: ast.AST) -> float:
    """Share of the names read that the source defines or the language has."""
    made = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and not isinstance(n.ctx, ast.Load)} | {n.arg for n in ast.walk(tree) if isinstance(n, ast.arg)}
    made |= {n.name for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))}
    made |= {(a.asname or a.name).split(".")[0] for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names}
    read = [n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)]
    return sum(x in made or x in NAMES for x in read) / len(read) if read else 1.0


def safe(tree: ast.AST) -> bool:
    for n in ast.walk(tree):
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in UNSAFE_CALLS:
            return False
        if isinstance(n, ast.Import) and any(a.name.split(".")[0] in UNSAFE_MODULES for a in n.names):
            return False
        if isinstance(n, ast.ImportFrom) and (n.module or "").split(".")[0] in UNSAFE_MODULES:
            return False
    return True


METRICS = (
    "parses boolean, violations int, style double, readability double, volume double, difficulty double, effort double, cyclomatic int, cognitive int, npath long, nesting int, "
    "maintainability double, complexity_score double, naming double, unabbreviated double, resolved double, safe boolean"
)


@lru_cache(maxsize=4096)
def measure(source: str | None) -> tuple:
    """All metrics of one source; one that has no syntax gets a complexity of 999 and zeros."""
    text = source or ""
    tree = parse(source)
    bad, style_score = style(text, tree is not None)
    if tree is None:
        return (False, bad, style_score, readability(text), 0.0, 0.0, 0.0, 999, 999, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, False)
    volume, difficulty, effort = halstead(tree)
    cc = cyclomatic(tree)
    lines = sum(bool(x.strip()) for x in text.split("\n"))
    return (True, bad, style_score, readability(text), volume, difficulty, effort, cc, cognitive(tree), paths(tree.body), nesting(tree), maintainability(volume, cc, lines), limited(cc, 6, 0.08), naming(tree), unabbreviated(tree), resolved(tree), safe(tree))


def metrics(source: Column) -> Column:
    """A struct of METRICS, by Arrow batches."""
    names = [x.strip().split()[0] for x in METRICS.split(",")]

    def run(sources: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(s) for s in sources], columns=names)

    return F.pandas_udf(run, METRICS)(source)


def node_kinds(tree: ast.AST) -> list[str]:
    return [type(n).__name__ for n in ast.walk(tree) if not isinstance(n, (ast.Load, ast.Store, ast.Del))]


def distance(a: list, b: list) -> float:
    """Edit distance of two sequences over the length of the longer one."""
    if not a and not b:
        return 0.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1] / max(len(a), len(b))


def multiset_jaccard(a: Counter, b: Counter) -> float:
    either = (a | b).total()
    return (a & b).total() / either if either else 1.0


def subtrees(tree: ast.AST) -> Counter:
    """Shapes of all subtrees with children, without names and values."""
    found: Counter = Counter()

    def shape(n: ast.AST) -> str:
        parts = [shape(c) for c in ast.iter_child_nodes(n) if not isinstance(c, (ast.Load, ast.Store, ast.Del))]
        s = f"{type(n).__name__}({','.join(parts)})"
        if parts:
            found[s] += 1
        return s

    shape(tree)
    return found


def flows(tree: ast.AST) -> Counter:
    """Assignments as (target, name read) pairs."""
    found: Counter = Counter()
    for n in ast.walk(tree):
        if isinstance(n, (ast.Assign, ast.AugAssign, ast.AnnAssign)) and n.value is not None:
            targets = n.targets if isinstance(n, ast.Assign) else [n.target]
            for t in (x.id for y in targets for x in ast.walk(y) if isinstance(x, ast.Name)):
                found.update((t, r.id) for r in ast.walk(n.value) if isinstance(r, ast.Name))
    return found


def signatures(tree: ast.AST) -> dict[str, tuple]:
    return {n.name: tuple(a.arg for a in n.args.args) for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))}


COMPARISON = "edit_distance double, syntax_match double, syntax_overlap double, flow_overlap double, same_signatures boolean, passes boolean"


@lru_cache(maxsize=4096)
def _outline(source: str) -> tuple[dict[str, tuple], bool] | None:
    """The functions of a source and whether it is safe; null without syntax."""
    tree = parse(source)
    return None if tree is None else (signatures(tree), safe(tree))


def acceptable(before: str, after: str) -> bool:
    """Whether a rewrite has syntax, is safe and keeps the functions of its source."""
    a = _outline(before)
    b = a and _outline(after)
    return bool(a and b) and a[0].items() <= b[0].items() and b[1]


@lru_cache(maxsize=4096)
def compare(before: str | None, after: str | None) -> tuple:
    """How alike two sources are; passes: the second has syntax, is safe and keeps the functions of the first."""
    a, b = parse(before), parse(after)
    if a is None or b is None:
        return (1.0, 0.0, 0.0, 0.0, False, False)
    ka, kb = node_kinds(a), node_kinds(b)
    sa, sb = subtrees(a), subtrees(b)
    kept = signatures(a).items() <= signatures(b).items()
    match = (sa & sb).total() / sa.total() if sa else 1.0
    return (distance(ka, kb), match, multiset_jaccard(Counter(ka), Counter(kb)), multiset_jaccard(flows(a), flows(b)), kept, kept and safe(b))


def comparison(before: Column, after: Column) -> Column:
    names = [x.strip().split()[0] for x in COMPARISON.split(",")]

    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([compare(p, q) for p, q in zip(x, y, strict=True)], columns=names)

    return F.pandas_udf(run, COMPARISON)(before, after)


def token_weights(source: str) -> list[tuple[str, dict[str, float]]]:
    """Each token with what aspects of a rewrite it bears on, shares that sum to 1."""
    out = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            if t.type in (tokenize.COMMENT,):
                w = {"cot": 0.55, "style": 0.45}
            elif t.type in (tokenize.INDENT, tokenize.DEDENT, tokenize.NEWLINE, tokenize.NL):
                w = {"style": 0.65}
            elif t.type == tokenize.NAME and t.string in ("if", "for", "while", "try", "except", "return", "else", "elif", "break", "continue"):
                w = {"complexity": 0.8}
            elif t.type == tokenize.NAME and t.string not in NAMES:
                w = {"variable": 0.55}
            elif t.type == tokenize.OP:
                w = {"ast": 0.7}
            elif t.type == tokenize.ENDMARKER:
                continue
            else:
                w = {"style": 0.35, "ast": 0.65}
            total = sum(w.values())
            out.append((t.string, {k: v / total for k, v in w.items()}))
    except (tokenize.TokenError, IndentationError, SyntaxError):
        pass
    return out


def retained(df: DataFrame, primary: str, strategy: str, gain: dict[str, float], loss: dict[str, float], metric_names: list[str]) -> DataFrame:
    """Adds ``retained``: a rewrite that passes, differs, gains in its strategy's metric and loses little in others.

    Columns are before_<m> and after_<m> of each metric, ``passes`` and ``changed``. A strategy of syntax needs a match
    of 0.5 instead of a gain, and such a match excuses a loss in it.
    """
    delta = {m: F.col(f"after_{m}") - F.col(f"before_{m}") for m in metric_names}
    enough = F.lit(False)
    for m in metric_names:
        ok = F.col(f"after_{m}") >= 0.5 if m == "syntax_match" else delta[m] >= gain.get(m, 0.01)
        enough = enough | ((F.col(primary) == m) & ok)
    hurt = F.lit(False)
    for m in metric_names:
        worse = delta[m] < -loss.get(m, 0.02)
        hurt = hurt | (worse & (F.col("after_syntax_match") < 0.5) if m == "syntax_match" else worse)
    return df.withColumn("retained", F.col("passes") & F.col("changed") & enough & ~hurt)


def signature_line(code: Column) -> Column:
    return F.regexp_extract(code, r"(?m)^\s*(def\s+\w+\s*\(.*?\)\s*(?:->\s*[^:\n]+)?:)", 1)


def assembled(signature: Column, body: Column) -> Column:
    """A body under its signature, indented if it isn't."""
    lines = F.transform(F.split(body, "\n"), lambda x: F.when(F.startswith(x, F.lit("    ")) | (x == ""), x).otherwise(F.concat(F.lit("    "), x)))
    return F.concat(signature, F.lit("\n"), F.array_join(lines, "\n"))
