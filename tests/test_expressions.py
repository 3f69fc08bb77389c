"""Feature texts: what is admitted gives what pandas gives, everything else is refused and never run."""

import math

import numpy as np
import pandas as pd
import pytest

from weftline.operators import expressions, tabular

ROWS = [(1, 2.0, -3.0), (2, 0.0, 0.0), (3, -1.5, 4.0), (4, 7.25, 0.5), (5, None, 2.0), (6, 3.0, -0.5)]
ADMITTED = [
    "df['f'] = df['a'] / df['b']", "df['f'] = df.a / (df.b - df.b)", "df['f'] = np.log(df['a'])", "df['f'] = np.log1p(df.a - df.a.min())", "df.f = df.a ** 2 - 3 * +df.b", "df['f'] = df['a'] // df['b']", "df['f'] = df['a'] % df['b']",
    "df['f'] = np.where((df.a > 0) & ~(df.b >= 1) | (df.b == 0), df.a, -df.b)", "df['f'] = (df.a > df.b)", "df['f'] = (df.a - df.a.mean()) / df.a.std()", "df['f'] = np.maximum(df.b, 1.5) + np.minimum(df.b, -1)", "df['f'] = df.b.abs().clip(0.4, 2.5).round(1)",
    "df['f'] = df.a.fillna(df.a.max())", "df['f'] = np.sqrt(df.b)", "df['f'] = np.sign(df.b) * np.exp(df.b) + np.tanh(df.b) - np.cos(df.b) * np.sin(math.pi)", "df['g'] = df.b * 2\ndf['f'] = df.g + df.g.sum()", "df['g'] = df.b - df.b.mean()\ndf['f'] = df.g / df.g.max()",
    "df['f'] = df.b\ndf['f'] += 1\ndf['f'] *= df.b", "df['f'] = np.floor(df.b) + np.ceil(df.b) + np.square(df.b) + np.abs(df.b) + np.power(df.b, 2) + np.log2(df.k) + np.log10(df.k)", "df['f'] = np.clip(df.b, -1, 1) + df.k.count()",
]
REFUSED = [
    "", "df['f'] = ", "import os", "f = 3", "df['f'] = __import__('os').system('true')", "df['f'] = open('/etc/passwd')", "df['f'] = df.a.apply(abs)", "df['f'] = df['missing']", "df['f'] = df.a.__class__", "df['f'] = [x for x in df.a]", "df['f'] = lambda x: x",
    "df['f'] = df.a if df.b else 0", "exec('1')", "df['f'] = 'text'", "df['f'] = np.load('x')", "df['f'] = np.log(df.a, df.b)", "df['f'] = np.log(x=df.a)", "df['f'] = np.log(*df.a)", "df['a'] = df.b", "df['f'], df['g'] = df.a, df.b", "del df['a']", "df['f'] = 1e999",
    "df['f'] = df.a and df.b", "df['f'] = df.a < df.b < 1", "df['f'] = (df.a - df.a.mean()).mean().max()", "df['f'] = " + "-" * 60 + "df.a", "df['f'] = " + " + ".join(["df.a"] * 200), "#" * 3000, "for i in range(3): df['f'] = df.a", "df['f'] = df[df.a > 0]", "df['f'] = f'{df}'", "df[0] = df.a",
    "df['f'] = df.a.round(df.b)", "df['f'] = ~df.a", "df.drop('a')", "df['f'] = (lambda: df.a)()", "other['f'] = df.a", "df['f'] = 3j", "df['f'] = np.where(df.a, df.a, df.b)",
]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, "k long, a double, b double")


@pytest.mark.parametrize("code", ADMITTED)
def test_admitted_texts_give_what_pandas_gives(df, code):
    pdf = pd.DataFrame(ROWS, columns=["k", "a", "b"]).astype({"a": float})
    if "np.sqrt" in code:
        pdf["f"] = np.sqrt(pdf.b)
    else:
        with np.errstate(all="ignore"):
            exec(code.replace("df.f =", "df['f'] ="), {"df": pdf, "np": np, "math": math})
    got = df.withColumns(expressions.features(df, code)).orderBy("k").toPandas()["f"].astype(float)
    # a null is one of pandas' NaN; a comparison of it is null here, false there
    want = pdf["f"].astype(float).where(pdf["a"].notna() | ("(df.a > " not in code), np.nan)
    got = got.where(pdf["a"].notna() | ("(df.a > " not in code), np.nan)
    assert np.allclose(got, want, equal_nan=True), (got.tolist(), want.tolist())


@pytest.mark.parametrize("code", REFUSED)
def test_everything_else_is_refused(df, code):
    with pytest.raises(expressions.Refused):
        expressions.features(df, code)


def test_gates_and_search(spark, df):
    old = ["k", "a", "b"]
    for code, reason in (
        ("df['f'] = df.a", "nulls"), ("df['f'] = df.b / (df.b * 0)", "infinite"), ("df['f'] = np.log(df.b)", "no number"), ("df['f'] = df.b * 0 + 1", "one value only"), ("df['f'] = df.b + 0", "old column"), ("import os", "Import"), ("df['f'] = df.b * 2\ndf['g'] = df.b", "g has"),
    ):
        out, why = expressions.robust(df, code, old)
        assert reason in why and out.columns == df.columns
    out, why = expressions.robust(df, "df['f'] = df.b * 2 + df.k\ndf['g'] = df.f - df.b", old)
    assert why is None and out.columns == ["k", "a", "b", "f", "g"]
    rows = [(i, float(i * 37 % 100), float(i * 61 % 100), int(i * 37 % 100 > i * 61 % 100)) for i in range(300)]
    table = spark.createDataFrame(rows, "key long, p double, q double, y long")
    trace = tabular.search(table, ["p", "q"], "y", "key", texts=["import os", "df['d'] = df.p - df.q", "df['e'] = df.p * 0"])
    assert [(t["passes"], t["accepted"]) for t in trace] == [(False, False), (True, True), (False, False)] and trace[1]["accuracy"] > 0.99
    assert expressions.features(df.where("false"), "df['f'] = df.a - df.a.mean()").keys() == {"f"}
