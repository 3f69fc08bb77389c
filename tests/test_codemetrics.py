"""Code metrics: values counted by hand for small sources."""

import math

import pytest

from weftline.functions import codemetrics as m

NAMES = [x.strip().split()[0] for x in m.METRICS.split(",")]
NESTED = "def f(a, b):\n    if a and b:\n        for i in a:\n            print(i)\n    return b\n"
CHOICES = "def g(x):\n    try:\n        y = 1 if x else 2\n    except ValueError:\n        y = 3\n    while y:\n        with open(x) as h:\n            y = h\n    else:\n        pass\n    return y\n"
CLASSES = "import os\nclass my_thing:\n    def Go(self, badName):\n        return badName + missing\nTOTAL = 1\n"
STYLE = "# note\nx = 1 \n\ty = 2\n" + "z" * 90 + " = 3\n"


def of(source: str) -> dict:
    return dict(zip(NAMES, m.measure(source), strict=True))


@pytest.mark.parametrize(
    ("source", "want"),
    [
        # branches: if, and, for; paths: (for 1 + 1) and the way past the if
        (NESTED, {"parses": True, "violations": 0, "style": 1.0, "cyclomatic": 4, "cognitive": 4, "npath": 3, "nesting": 2, "complexity_score": 1.0, "naming": 1.0, "unabbreviated": 0.25, "resolved": 1.0, "safe": True}),
        # branches: conditional, handler, while; paths: (1 + 1) * (1 + 1)
        (CHOICES, {"cyclomatic": 4, "cognitive": 3, "npath": 4, "nesting": 2, "resolved": 1.0, "safe": False}),
        # names: badName, missing, TOTAL, self, Go, my_thing; read: badName and missing
        (CLASSES, {"cyclomatic": 1, "cognitive": 0, "npath": 1, "nesting": 0, "naming": pytest.approx(3 / 6), "resolved": 0.5, "safe": False}),
        ("", {"parses": True, "violations": 0, "style": 1.0, "readability": 0.0, "cyclomatic": 1, "npath": 1, "volume": 0.0, "difficulty": 0.0, "naming": 1.0, "resolved": 1.0}),
        ("def f(:", {"parses": False, "violations": 1, "style": 0.5, "cyclomatic": 999, "cognitive": 999, "nesting": 0, "maintainability": 0.0, "safe": False}),
        ("if a:\n    pass\nelif b:\n    pass\nelse:\n    pass\n", {"cyclomatic": 3, "cognitive": 3, "npath": 3, "nesting": 2, "resolved": 0.0}),
        ("a or b or c", {"cyclomatic": 3, "cognitive": 2, "npath": 1}),
        ("[x for x in y if x]", {"cyclomatic": 2, "cognitive": 0}),
        ("assert a\neval('1')", {"cyclomatic": 2, "safe": False}),
        ("from urllib.parse import quote", {"safe": False}),
    ],
)
def test_counts(source, want):
    got = of(source)
    assert {k: got[k] for k in want} == want


def test_halstead_of_nested():
    # operators: and, if, for, call, return; operands: a 3, b 3, i 2, print 1
    got = of(NESTED)
    volume, difficulty = 14 * math.log2(9), 5 / 2 * 9 / 4
    assert (got["volume"], got["difficulty"], got["effort"]) == pytest.approx((volume, difficulty, volume * difficulty))
    assert got["maintainability"] == pytest.approx((171 - 5.2 * math.log(volume) - 0.23 * 4 - 16.2 * math.log(5)) / 171)


def test_style_and_readability():
    bad, score = m.style(STYLE, False)
    assert (bad, score) == (4, 1 / (1 + 4 / 4))  # a blank at the end, a tab, a long line, no syntax
    lines = ["# note", "x = 1 ", "\ty = 2", "z" * 90 + " = 3"]
    mean = sum(map(len, lines)) / 4
    assert m.readability(STYLE) == pytest.approx(min(1.0, 1 - min(0.4, max(0.0, (mean - 72) / 100)) - 0.35 / 4 + min(0.12, 0.5 / 4)))


def test_limited_and_words():
    assert [m.limited(v, 6, 0.08) for v in (3, 6, 7, 40)] == [1.0, 1.0, pytest.approx(0.92), 0.0]
    assert m.words_of("getHTTPValue2") == ["get", "HTTP", "Value", "2"]


RENAMED = NESTED.replace("b", "c")


@pytest.mark.parametrize(
    ("before", "after", "want"),
    [
        (NESTED, NESTED, (0.0, 1.0, 1.0, 1.0, True, True)),
        (NESTED, RENAMED, (0.0, 1.0, 1.0, 1.0, False, False)),  # shapes have no names, signatures do; no assignments
        ("x = a", "x = b", (0.0, 1.0, 1.0, 0.0, True, True)),
        ("x = a\ny = a", "x = a", None),
        ("x = 1", "def f(:", (1.0, 0.0, 0.0, 0.0, False, False)),
        ("", "", (0.0, 1.0, 1.0, 1.0, True, True)),
    ],
)
def test_comparison(before, after, want):
    got = m.compare(before, after)
    if want is not None:
        assert got == want
    else:
        # kinds: module, 2 assign, 4 name against module, assign, 2 name, level by level
        assert got[2] == pytest.approx(4 / 7) and got[3] == pytest.approx(1 / 2) and got[0] == pytest.approx(3 / 7)
        assert got[1] == pytest.approx(1 / 3)  # of three shapes with parts, one assignment is there


def test_token_weights():
    got = dict(m.token_weights("# c\nif name:\n    x = 1\n"))
    assert got["# c"] == {"cot": 0.55, "style": 0.45} and got["if"] == {"complexity": 1.0} and got["name"] == {"variable": 1.0} and got["="] == {"ast": 1.0}
    assert got["1"] == {"style": 0.35, "ast": 0.65}
    assert m.token_weights("'''") == []


def test_sources_are_read_once_for_all_their_rewrites(monkeypatch):
    read = []
    parse = m.parse
    monkeypatch.setattr(m, "parse", lambda s: read.append(s) or parse(s))
    source = "def only_here(a):\n    return a\n"
    assert all(m.acceptable(source, source) for _ in range(3)) and len(read) == 1
    assert not m.acceptable("def (", source) and not m.acceptable(source, "def (") and not m.acceptable(source, "eval('1')")
