"""Generated features: a small grammar of assignments is turned into Columns; nothing of the text is ever run.

A feature text is a few lines like ``df['ratio'] = df['a'] / (df['b'] + 1)`` or ``df['z'] = np.log1p(df.a - df.a.min())``.
Only what is listed below is admitted; values are computed by Spark, with the results that floating-point arithmetic
gives (a quotient by 0 is infinite or not a number, so that gates can refuse the feature).
"""

from __future__ import annotations

import ast
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.tabular import gates

#: Bounds of a text's characters, and of its tree's nodes and depth.
CHARS, NODES, DEPTH = 2000, 300, 40
_INF = float("inf")


class Refused(ValueError):
    """The text isn't of the grammar."""


def _lit(x: float) -> Column:
    return F.lit(float(x))


def divide(x: Column, y: Column) -> Column:
    by_zero = F.when(x > 0, _lit(_INF)).when(x < 0, _lit(-_INF)).otherwise(_lit(math.nan))
    return F.when(y != 0, F.try_divide(x, y)).when(y.isNotNull() & x.isNotNull(), F.when(F.isnan(x), x).otherwise(by_zero))


def _log(x: Column) -> Column:
    return F.when(x > 0, F.log(x)).when(x == 0, _lit(-_INF)).when(x < 0, _lit(math.nan))


def _whole(x: Column) -> Column:
    """Rounded down; infinite values and NaN stay."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def _rest(x: Column, y: Column) -> Column:
    """The remainder with the divisor's sign."""
    return F.when(y != 0, x - _whole(F.try_divide(x, y)) * y).when(y.isNotNull() & x.isNotNull(), _lit(math.nan))


def _clip(x: Column, low: Column, high: Column) -> Column:
    return F.when(F.isnan(x), x).otherwise(F.greatest(F.least(x, high), low))


def _round(x: Column, digits: float) -> Column:
    return F.when(F.abs(x) < _INF, F.bround(x, int(digits))).otherwise(x)


#: Functions of np by name, with the number of their arguments.
FUNCTIONS: dict[str, tuple[int, Callable[..., Column]]] = {
    "abs": (1, F.abs), "sqrt": (1, F.sqrt), "exp": (1, F.exp), "log": (1, _log), "log1p": (1, lambda x: _log(x + 1.0)), "log2": (1, lambda x: _log(x) / math.log(2)), "log10": (1, lambda x: _log(x) / math.log(10)),
    "sin": (1, F.sin), "cos": (1, F.cos), "tanh": (1, F.tanh), "sign": (1, F.signum), "square": (1, lambda x: x * x), "floor": (1, _whole), "ceil": (1, lambda x: -_whole(-x)), "maximum": (2, F.greatest), "minimum": (2, F.least),
    "power": (2, F.pow), "clip": (3, _clip), "isnan": (1, lambda x: F.isnan(x)),
}
#: Methods of a column without arguments.
METHODS: dict[str, Callable[[Column], Column]] = {"abs": F.abs}
#: Methods that give one number of the whole column.
AGGREGATES: dict[str, Callable[[Column], Column]] = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum, "count": lambda c: F.count(c).cast("double")}
CONSTANTS = {("math", "pi"): math.pi, ("math", "e"): math.e, ("np", "pi"): math.pi, ("np", "e"): math.e}
_BINARY: dict[type, Callable[[Column, Column], Column]] = {ast.Add: lambda x, y: x + y, ast.Sub: lambda x, y: x - y, ast.Mult: lambda x, y: x * y, ast.Div: divide, ast.FloorDiv: lambda x, y: _whole(divide(x, y)), ast.Mod: _rest, ast.Pow: F.pow}
_COMPARED: dict[type, Callable[[Column, Column], Column]] = {ast.Lt: lambda x, y: x < y, ast.LtE: lambda x, y: x <= y, ast.Gt: lambda x, y: x > y, ast.GtE: lambda x, y: x >= y, ast.Eq: lambda x, y: x == y, ast.NotEq: lambda x, y: x != y}


class _Compiler:
    """Turns nodes into Columns of doubles."""

    def __init__(self, columns: list[str], totals: dict[str, float] | None):
        self.made: dict[str, Column] = {}
        self.columns, self.totals, self.asked = columns, totals, {}
        self.inside = False  # an aggregate

    def column(self, name: str) -> Column:
        if name in self.made:
            return self.made[name]
        if name not in self.columns:
            raise Refused(f"no column {name}")
        return F.col("`" + name.replace("`", "``") + "`").cast("double")

    def name_of(self, node: ast.AST) -> str | None:
        """The column that ``df['a']`` or ``df.a`` names."""
        if isinstance(node, ast.Subscript) and isinstance(node.value, ast.Name) and node.value.id == "df" and isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str):
            return node.slice.value
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id == "df":
            return node.attr
        return None

    def value(self, node: ast.AST) -> Column:
        if (name := self.name_of(node)) is not None:
            return self.column(name)
        match node:
            case ast.Constant(value=bool()):
                return _lit(node.value)
            case ast.Constant(value=int() | float()) if math.isfinite(node.value):
                return _lit(node.value)
            case ast.Attribute(value=ast.Name(id=module), attr=constant) if (module, constant) in CONSTANTS:
                return _lit(CONSTANTS[module, constant])
            case ast.UnaryOp(op=ast.USub()):
                return -self.value(node.operand)
            case ast.UnaryOp(op=ast.UAdd()):
                return self.value(node.operand)
            case ast.BinOp() if type(node.op) in _BINARY:
                return _BINARY[type(node.op)](self.value(node.left), self.value(node.right))
            case ast.Compare() | ast.BinOp() | ast.UnaryOp():
                return self.condition(node).cast("double")
            case ast.Call():
                return self.call(node)
        raise Refused(f"{type(node).__name__} is not admitted")

    def condition(self, node: ast.AST) -> Column:
        match node:
            case ast.Compare(ops=[op], comparators=[right]) if type(op) in _COMPARED:
                return _COMPARED[type(op)](self.value(node.left), self.value(right))
            case ast.BinOp(op=ast.BitAnd()):
                return self.condition(node.left) & self.condition(node.right)
            case ast.BinOp(op=ast.BitOr()):
                return self.condition(node.left) | self.condition(node.right)
            case ast.UnaryOp(op=ast.Invert()):
                return ~self.condition(node.operand)
        raise Refused(f"{type(node).__name__} is not a condition")

    def number(self, node: ast.AST) -> float:
        match node:
            case ast.UnaryOp(op=ast.USub()):
                return -self.number(node.operand)
            case ast.Constant(value=int() | float()) if math.isfinite(node.value):
                return node.value
        raise Refused("a number is asked for")

    def call(self, node: ast.Call) -> Column:
        if node.keywords or any(isinstance(a, ast.Starred) for a in node.args):
            raise Refused("named arguments are not admitted")
        if not isinstance(node.func, ast.Attribute):
            raise Refused("functions have to be those of np, or methods of columns")
        name, owner, args = node.func.attr, node.func.value, node.args
        if isinstance(owner, ast.Name) and owner.id in ("np", "math"):
            if name == "where" and len(args) == 3:
                return F.when(self.condition(args[0]), self.value(args[1])).otherwise(self.value(args[2]))
            if name not in FUNCTIONS or FUNCTIONS[name][0] != len(args):
                raise Refused(f"{owner.id}.{name} of {len(args)} is not admitted")
            out = FUNCTIONS[name][1](*map(self.value, args))
            return out.cast("double") if name == "isnan" else out
        if name in AGGREGATES and not args:
            return self.total(name, owner, ast.unparse(node))
        value = self.value(owner)
        if name in METHODS and not args:
            return METHODS[name](value)
        if name == "fillna" and len(args) == 1:
            v = self.value(args[0])
            return F.when(value.isNull() | F.isnan(value), v).otherwise(value)
        if name == "clip" and len(args) == 2:
            return _clip(value, self.value(args[0]), self.value(args[1]))
        if name == "round" and len(args) <= 1:
            return _round(value, self.number(args[0]) if args else 0)
        raise Refused(f"the method {name} of {len(args)} is not admitted")

    def total(self, name: str, owner: ast.AST, text: str) -> Column:
        if self.inside:
            raise Refused("an aggregate of an aggregate is not admitted")
        self.inside = True
        value = self.value(owner)
        self.inside = False
        key = f"{text}@{len(self.made)}"  # the columns made so far may have changed what it is of
        self.asked[key] = AGGREGATES[name](F.when(~F.isnan(value), value))
        if self.totals is None:
            return _lit(0.0)
        found = self.totals[key]
        return F.lit(found).cast("double")


def _statements(code: str) -> list[ast.stmt]:
    if len(code) > CHARS:
        raise Refused("the text is too long")
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, MemoryError, RecursionError) as e:
        raise Refused(f"no syntax: {e}") from None
    level, depth, count = [tree], 0, 0
    while level:
        level = [c for n in level for c in ast.iter_child_nodes(n) if not isinstance(c, (ast.expr_context, ast.operator))]
        depth, count = depth + 1, count + len(level)
        if depth > DEPTH or count > NODES:
            raise Refused("the text is too large")
    return tree.body


def _compiled(code: str, columns: list[str], totals: dict[str, float] | None) -> _Compiler:
    c = _Compiler(columns, totals)
    for s in _statements(code):
        match s:
            case ast.Assign(targets=[target]):
                value = s.value
            case ast.AugAssign(target=target):
                value = ast.BinOp(left=target, op=s.op, right=s.value)
            case _:
                raise Refused(f"{type(s).__name__} is not admitted; features are assigned to columns of df")
        name = c.name_of(target)
        if name is None:
            raise Refused("only columns of df can be assigned")
        if name in columns:
            raise Refused(f"the column {name} is there already")
        c.made[name] = c.value(value)
    if not c.made:
        raise Refused("the text makes no column")
    return c


def features(df: DataFrame, code: str) -> dict[str, Column]:
    """The new columns of a feature text by name, as Columns of ``df``. Aggregates of columns are computed first, all in
    one row; columns made before may be used, and made again. Anything that isn't of the grammar raises ``Refused``, as
    do a column that isn't there, one that is there already as a target, and a text beyond the bounds. Nulls stay null."""
    first = _compiled(code, df.columns, None)
    if not first.asked:
        return first.made
    row = df.agg(*(c.cast("double").alias(f"t{i}") for i, c in enumerate(first.asked.values()))).first()
    totals = dict(zip(first.asked, row, strict=True))
    # an aggregate of a column that was made with another aggregate needs its value first: as often as they depend on one another
    for _ in range(len(totals)):
        again = _compiled(code, df.columns, totals)
        row = df.agg(*(c.cast("double").alias(f"t{i}") for i, c in enumerate(again.asked.values()))).first()
        if (found := dict(zip(again.asked, row, strict=True))) == totals:
            break
        totals = found
    return _compiled(code, df.columns, totals).made


def robust(df: DataFrame, code: str, old: list[str]) -> tuple[DataFrame, str | None]:
    """``df`` with the columns of a feature text, and no reason; or ``df`` as it is, and why the text is refused: it is
    not of the grammar, or a column of it has nulls, NaN or infinite values, is constant, or equals one of ``old``."""
    try:
        made = features(df, code)
    except Refused as e:
        return df, str(e)
    for name, column in made.items():
        g = gates(df, column, old).first()
        if not g.passes:
            why = [w for w, bad in (("nulls", g.n_null), ("values that are no number", g.n_nan), ("infinite values", g.n_infinite), ("an old column's values", g.n_equal)) if bad]
            return df, f"{name} has {', '.join(why) or 'one value only'}"
    return df.withColumns(made), None
