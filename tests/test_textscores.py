"""Likeness, repetition and tested code: against plain versions and small cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import answers, execution, textscores
from weftline.operators import mixing, samples
from weftline.sources import files, reports


def test_common_subsequence_against_a_table():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
        assert textscores.common_subsequence(a, b) == row[-1]


def test_bleu_and_rouge():
    assert textscores.bleu("abcdef", "abcdef") == pytest.approx(1.0)
    assert textscores.bleu("", "abc") == textscores.bleu("xyz", "abc") == 0.0
    # three of four letters, two of three pairs, one of two triples, no four: 1 / (2 * 1)
    assert textscores.bleu("abcx", "abcd") == pytest.approx((3 / 4 * 2 / 3 * 1 / 2 * 1 / 2) ** 0.25)
    assert textscores.bleu("ab", "abcd") == pytest.approx(math.exp(1 - 4 / 2) * (1 * 1 * 1 / 2 * 1 / 4) ** 0.25)
    one, two, longest = textscores.rouge("the cat sat", "the cat ran off")
    assert (one, two, longest) == (pytest.approx(4 / 7, abs=1e-6), pytest.approx(2 / 5, abs=1e-6), pytest.approx(4 / 7, abs=1e-6))
    assert textscores.rouge("", "x") == (0.0, 0.0, 0.0)


def test_repetition_against_sorted_suffixes():
    rng = random.Random(2)
    agree = lambda x, y: next((k for k, (c, d) in enumerate(zip(x, y, strict=False)) if c != d), min(len(x), len(y)))
    for _ in range(150):
        t = "".join(rng.choice("abé") for _ in range(rng.randint(0, 40))) * rng.choice([1, 1, 3])
        order = sorted(t[i:] for i in range(len(t)))
        want = 2 * sum(map(agree, order, order[1:])) / (len(t) * (len(t) + 1)) if len(t) > 1 else 0.0
        assert textscores.repetition(t) == pytest.approx(want)
    assert textscores.repetition("a" * 1000) > 0.9


def test_code_runs_only_if_asked(spark):
    df = spark.createDataFrame([(1, "x = 1", []), (2, "while True: pass", []), (3, "import nothing_here", []), (4, "x = 1", ["assert x == 2"]), (5, None, None)], "id int, code string, tests array<string>")
    with pytest.raises(ValueError):
        execution.tested(df, "code", "tests")
    got = {r.id: (r.passed, r.error) for r in execution.tested(df, "code", "tests", enabled=True).collect()}
    assert got == {1: (True, "None"), 2: (False, got[2][1]), 3: (False, "ImportError"), 4: (False, "AssertionError"), 5: (True, "None")}
    gates = spark.createDataFrame([(1, "x = 1", "x = 2", ["assert x"]), (2, "x = 1", "x = 0", ["assert x"]), (3, "broken(", "x", [])], "id int, a string, b string, tests array<string>")
    assert {r.id: r.gate for r in execution.rewrite_gate(gates, "a", "b", "tests", enabled=True).collect()} == {1: 1.0, 2: 0.0, 3: 1.0}


def test_kinds_shares_and_ids(spark):
    assert mixing.one_kind({"a": True, "b": True}) and not mixing.one_kind({"a": False})
    with pytest.raises(ValueError):
        mixing.one_kind({"a": True, "b": False})
    df = spark.createDataFrame([([1, 2, 3, 4],)], "x array<int>")
    assert [tuple(r) for r in df.select(samples.prompt_ids(F.col("x"), 3), samples.prompt_ids(F.col("x"), 3, 9)).collect()] == [([1, 2, 3], [1, 2, 9])]
    pairs = samples.flattened_pairs(spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "k int, x string, y string"), "k", "x", "y").orderBy("part", "k").collect()
    assert [r.answer for r in pairs] == ["a", "c", "b", "d"]
    clash = spark.createDataFrame([(0, "m", 1, "v1"), (1, "m", 2, "v2")], "w int, name string, value int, version string")
    with pytest.raises(Exception, match="workers differ"):
        mixing.merged_metrics(clash, "w", "name", "value", ["version"]).collect()


def test_batches_folders_and_names(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string")
    files.save_batch(df, str(tmp_path / "b"), {"step": 3, "keys": ["k"]})
    rows, meta = files.load_batch(spark, str(tmp_path / "b"))
    assert sorted(map(tuple, rows.collect())) == [(1, "a"), (2, "b")] and meta == {"step": 3, "keys": ["k"]}
    files.append_rows(spark, str(tmp_path / "t"), df)
    assert files.append_rows(spark, str(tmp_path / "t"), df.where("k = 1")).count() == 3
    (tmp_path / "f").mkdir()
    for name, line in (("x.json", '{"k": 1}'), ("y.jsonl", '{"k": 2}\n{"k": 3}'), ("z.txt", '{"k": 4}')):
        (tmp_path / "f" / name).write_text(line)
    assert sorted(r.k for r in files.read_folder(spark, str(tmp_path / "f"), "k int").collect()) == [1, 2, 3]
    paths = spark.createDataFrame([("run/t0.7_n16/a.parquet",), ("other",)], "p string").select(files.hyper_parameters(F.col("p"), r"t(?<temperature>[0-9.]+)_n(?<samples>[0-9]+)").alias("h"))
    assert [r.h for r in paths.collect()] == [{"temperature": "0.7", "samples": "16"}, None]


def test_likeness_of_texts_of_no_one_and_two_words(spark):
    cases = [("", "a b", 0.0, 0.0), ("a", "a", 100.0, 0.0), ("a", "b", 0.0, 0.0), ("a b", "a", 66.6667, 0.0), ("a b", "a b", 100.0, 100.0), ("a b", "b a", 100.0, 0.0), (None, "a", 0.0, 0.0)]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, a string, b string")
    got = {r.i: (r.s.rouge_1, r.s.rouge_2) for r in df.select("i", textscores.overlap_scores(F.col("a"), F.col("b")).alias("s")).collect()}
    for i, (_, _, one, two) in enumerate(cases):
        assert got[i] == pytest.approx((one, two), abs=1e-3)


def test_reports(spark, monkeypatch):
    df = spark.createDataFrame([("a|b", 2.0), ("<c>", None), ("d", 1.0)], "name string, v double")
    assert reports.markdown(df, "T") == "## T\n\n| name | v |\n| --- | --- |\n| a\\|b | 2.0000 |\n| <c> |  |\n| d | 1.0000 |\n"
    svg = reports.bars(df, "name", "v", "x & y")
    assert svg.count("<rect") == 3 and "&lt;c&gt;" in svg and "x &amp; y" in svg and 'width="340.0"' in svg and 'width="170.0"' in svg
    monkeypatch.setattr(reports, "MOST_ROWS", 2)
    with pytest.raises(ValueError):
        reports.markdown(df)


def test_scorers_from_files(spark, tmp_path):
    (tmp_path / "own.py").write_text("def rule(text, truth, bonus):\n    return (text == truth).cast('double') + bonus\n")
    rule = answers.load_scorer(str(tmp_path / "own.py"), "rule", bonus=0.5)
    answers.register_scorer("own", rule)
    try:
        df = spark.createDataFrame([("own", "a", "a"), ("own", "a", "b")], "s string, x string, y string").select(answers.dispatch(F.col("s"), F.col("x"), F.col("y")).alias("v"))
        assert sorted(r.v for r in df.collect()) == [0.5, 1.5]
        with pytest.raises(ValueError):
            answers.register_scorer("own", rule)
    finally:
        del answers.SCORERS["own"]
    with pytest.raises(AttributeError):
        answers.load_scorer(str(tmp_path / "own.py"), "missing")


def test_shared_runs_of_characters_against_counters():
    rng = random.Random(5)
    wide = [chr(c) for c in range(0x4E00, 0x4E00 + 20_000)]
    cases = [("".join(rng.choice(k) for _ in range(rng.randrange(40))), "".join(rng.choice(k) for _ in range(rng.randrange(40)))) for k in ("ab", "abcdé𝄞", wide) for _ in range(60)]
    cases.append(("".join(wide) + "".join(wide[::3]), "".join(wide[5:]) * 2))  # 20,000 ^ 4 is no 62-bit number left for five
    for a, b in cases:
        assert textscores.shared_grams(a, b, 5) == [(textscores.grams(list(a), n) & textscores.grams(list(b), n)).total() for n in range(1, 6)]


def test_only_scores_that_are_asked_for(spark, monkeypatch):
    df = spark.createDataFrame([("a b", "a c")], "a string, b string")
    s = df.select(textscores.overlap_scores(F.col("a"), F.col("b"), ("rouge_1",)).alias("s"))
    assert s.select("s.*").columns == ["rouge_1"] and s.first().s.rouge_1 == 50.0
    monkeypatch.setattr(textscores, "grams", None)
    assert textscores.bleu("abcdefg", "abcdefg") == 1.0


def test_texts_without_a_long_run_twice_are_not_sorted(spark):
    rng = random.Random(6)
    plain = "".join(rng.choice("abcdefgh") for _ in range(3000))
    assert not textscores.may_repeat(plain, 0.2)
    seen = set()
    for _ in range(300):
        part = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 30)))
        text = part * rng.randrange(1, 4) + "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(40)))
        want = textscores.repetition(text) > 0.2
        seen.add((want, textscores.may_repeat(text, 0.2)))
        assert textscores.may_repeat(text, 0.2) or not want
    assert {(True, True), (False, False)} <= seen
