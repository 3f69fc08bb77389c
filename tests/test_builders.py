"""Report parts, evaluation sets, packed test cases and lessons: tables of cases and plain loops."""

import base64
import json
import pickle
import zlib

import pytest
from pyspark.sql import functions as F

from weftline.operators import evalsets, reporting

SCORES = "array<struct<name:string,score:double>>"


def test_metric_changes(spark):
    rows = [([("a", 1.0), ("b", 2.0), (None, 5.0)], [("a", 3.0), ("c", 4.0)]), ([("a", None)], None), (None, [("a", 5.0)]), ([], [("d", None)])]
    df = spark.createDataFrame(rows, f"x {SCORES}, y {SCORES}")
    got = {r.name: (r.before, r.after, r.delta) for r in reporting.metric_changes(df, F.col("x"), F.col("y")).collect()}
    assert got == {"a": (1.0, 4.0, 3.0), "b": (2.0, 0.0, -2.0), "c": (0.0, 4.0, 4.0)}
    assert reporting.metric_changes(df.where("false"), F.col("x"), F.col("y")).count() == 0


def test_execution_rates(spark):
    kind = "p boolean, r double, c array<struct<passed:boolean,pass_rate:double>>"
    df = spark.createDataFrame([(True, 1.0, [(True, 1.0), (False, None)]), (None, None, None), (False, 0.5, []), (True, 0.0, [(None, 0.5)])], kind)
    rates = lambda d: tuple(reporting.execution_rates(d, F.col("p"), F.col("r"), F.col("c")).first())
    assert rates(df) == (0.5, 0.5, 1 / 3, 0.5, 3)
    assert rates(df.where("false")) == (0.0, 0.0, 0.0, 0.0, 0)
    trace = spark.createDataFrame([("a", True), ("a", False), ("z", True), (None, True)], "s string, kept boolean")
    assert reporting.retained_share(trace, F.col("s") == "a", F.col("kept")).first().rate == 0.5
    assert reporting.retained_share(trace.where("false"), F.col("s") == "a", F.col("kept")).first().rate == 0.0


def test_totals(spark):
    df = spark.createDataFrame([("a", 3, 5), ("a", None, 1), ("b", 9, 2), (None, 1, 1)], "g string, x int, y int")
    got = {r.g: (r.before, r.after, r.added) for r in reporting.totals(df, "g", F.col("x"), F.col("y")).collect()}
    assert got == {"a": (3, 6, 3), "b": (9, 2, 0), None: (1, 1, 0), "ALL": (13, 9, 0)}


def test_packed_cases(spark):
    cases = lambda *x: json.dumps([{"input": a, "output": b} for a, b in x])
    private = cases(("3", "4"))
    old = base64.b64encode(zlib.compress(pickle.dumps(private))).decode()
    unsafe = base64.b64encode(zlib.compress(pickle.dumps(Exception("x")))).decode()
    rows = [
        (0, cases(("1", "2")), private, '{"func_name": "f"}'), (1, cases(("1", "2")), old, "{}"), (2, cases(), base64.b64encode(zlib.compress(private.encode())).decode(), None), (3, None, "", None),
        (4, "[]", "not cases", "{}"), (5, "[]", unsafe, "{}"), (6, '[{"input": "1"}]', "[]", "{}"), (7, "3", "[]", "[]"), (8, "[]", old[:-8], "{}"),
    ]
    out = evalsets.with_packed_cases(spark.createDataFrame(rows, "id int, public string, private string, metadata string"), "public", "private", "metadata")
    got = {r.id: r for r in out.select("id", "error", evalsets.unpacked(F.col("packed")).alias("c")).collect()}
    assert [tuple(got[i].c) for i in range(4)] == [(["1", "3"], ["2", "4"], "f"), (["1", "3"], ["2", "4"], None), (["3"], ["4"], None), ([], [], None)]
    assert all(got[i].c is None and got[i].error for i in range(4, 9))
    assert "Exception" in got[5].error


def test_unfolded_is_bounded(monkeypatch):
    monkeypatch.setattr(evalsets, "MOST_BYTES", 1000)
    big = base64.b64encode(zlib.compress(b'["' + b"x" * 2000 + b'"]')).decode()
    assert evalsets.packed("[]", big, None)[0] is None
    assert evalsets.packed("[]", base64.b64encode(zlib.compress(b"[]")).decode(), None)[1] is None


def test_evaluation_set(spark):
    df = spark.createDataFrame([(i, f"q{i}", "yes", ["no", None, "maybe"]) for i in range(40)], "id long, question string, right string, wrong array<string>")
    rows = evalsets.evaluation_set({"choice": df}).collect()
    for r in rows:
        text, letter = r.prompt[0].content, r.reward_model.ground_truth
        assert text.startswith(evalsets.CHOICE + f"q{r.extra_info["index"]}\n\nA) ")
        assert f"\n{letter}) yes" in text
        assert sorted(line[3:] for line in text.split("\n")[-4:]) == ["", "maybe", "no", "yes"]
    assert {r.reward_model.ground_truth for r in rows} == set("ABCD")
    both = evalsets.evaluation_set({"choice": df, "math": df.withColumn("answer", F.lit(3))})
    assert both.groupBy("data_source").count().count() == 2
    with pytest.raises(ValueError, match="no task"):
        evalsets.evaluation_set({"poems": df})
    with pytest.raises(ValueError, match="known already"):
        evalsets.task("math")(lambda d: d)
    assert evalsets.within(spark.createDataFrame([("2024-08-01",), ("2025-01-00",), (None,)], "d string"), "d", "2024-08-00", "2025-01-00").count() == 1


def test_lessons(spark):
    state = spark.createDataFrame([(1, 0.5, 4), (2, 1.0, 1)], "k int, score double, seen long")
    batch = spark.createDataFrame([(2, 0.0), (2, 0.5), (3, 0.75), (4, None), (None, 1.0)], "k int, r double")
    new = evalsets.updated_lessons(state, batch, "k", "r")
    assert {tuple(r) for r in new.collect()} == {(1, 0.5, 4), (2, 0.625, 3), (3, 0.75, 1)}
    rows = spark.createDataFrame([(i, "x") for i in range(5)], "k int, t string")
    assert [r.k for r in evalsets.lessons(rows, new, "k").orderBy("place").collect()] == [0, 4, 1, 2, 3]
    assert evalsets.lessons(rows.where("false"), new, "k").count() == 0


def test_converters(spark):
    from weftline.operators import converters

    chat = spark.createDataFrame([(1, [("system", "s"), ("human", "a"), ("gpt", "b")]), (2, [("human", "a"), ("other", None)]), (3, []), (4, None)], "id int, m array<struct<from:string,value:string>>")
    got = {r.id: (r["_system"], r["_prompt"], r["_response"]) for r in converters.converted(chat, "sharegpt", {"messages": "m"}).collect()}
    assert got[1][0] == "s"
    assert [tuple(m) for m in got[1][1]] == [("user", "a")]
    assert [tuple(m) for m in got[1][2]] == [("assistant", "b")]
    assert [tuple(m) for m in got[2][2]] == [("other", None)]
    assert got[3][1] == got[3][2] == []
    pairs = spark.createDataFrame([("p", "good", "bad", True)], "p string, c string, r string, t boolean")
    two = converters.converted(pairs, "alpaca", {"prompt": "p", "chosen": "c", "rejected": "r"}).first()
    assert [m.content for m in two["_response"]] == ["good", "bad"]
    tagged = converters.converted(pairs, "alpaca", {"prompt": "p", "response": "c", "tag": "t"}).first()
    assert [m.content for m in tagged["_response"]] == ["good", ""]
    with pytest.raises(ValueError, match="no converter"):
        converters.converted(pairs, "unknown", {})
    with pytest.raises(ValueError, match="no column"):
        converters.converted(pairs, "alpaca", {"prompt": "missing"})
    with pytest.raises(ValueError, match="registered already"):
        converters.converter("alpaca")(lambda of: None)


def test_losses_by_name():
    from weftline.operators import policy

    assert policy.get_loss("vanilla") is policy.dual_clip_loss
    with pytest.raises(ValueError, match="unknown loss"):
        policy.get_loss("none")
    with pytest.raises(ValueError, match="registered already"):
        policy.loss("gpg")(policy.gradient_loss)


def test_malformed_lines(spark, tmp_path):
    from weftline.sources import files

    for name, lines in {"a": ['﻿{"id": 1}', "", "not json", '{"id": 2}', '{"id": "x"', ""], "b": ["[", '{"id": 3}'], "c": ['{"id": 4}'] * 500 + ["{"] + ['{"id": 5}'] * 500}.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        bad = files.malformed_lines(spark, str(tmp_path), "id long").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r.file[-7:], r.line_number, r.value) for r in bad} == {("a.jsonl", 3, "not json"), ("a.jsonl", 5, '{"id": "x"'), ("b.jsonl", 1, "["), ("c.jsonl", 501, "{")}


def test_runs_leave_no_children(tmp_path):
    import time

    from weftline.functions.execution import run_python

    mark = tmp_path / "late"
    late = f"import time; time.sleep(2); open({str(mark)!r}, 'w')"
    child = f"import subprocess, sys\nsubprocess.Popen([sys.executable, '-c', {late!r}])\n"
    assert run_python(child + "print('done')")[:2] == (True, "done\n")
    assert run_python(child + "import time\ntime.sleep(9)", seconds=0.5)[3]
    time.sleep(2.5)
    assert not mark.exists()
    assert run_python("print(input()[::-1])", "äb")[:2] == (True, "bä\n")
    ok, out, _, _ = run_python("while True: print('x' * 1000)")
    assert not ok
    assert len(out) <= 1 << 20


def test_knapsacks_keep_every_row(spark):
    from weftline.operators import finetune

    df = spark.createDataFrame([(0, i, n) for i, n in enumerate([5, 8, 3, 11, None, 10])], "b int, k int, n int")
    got = {r.k: r.knapsack for r in finetune.pack_greedily(df, "b", "k", "n", 10).collect()}
    assert len(got) == 6
    assert {k for k, s in got.items() if s is None} == {3, 4}
    assert got[0] is not None


def test_repetition_of_random_texts():
    import random

    from weftline.functions.textscores import repetition

    def plain(t):
        order = sorted(range(len(t)), key=lambda i: t[i:])
        common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        return 2 * sum(common(t[x:], t[y:]) for x, y in zip(order, order[1:], strict=False)) / (len(t) * (len(t) + 1))

    r = random.Random(3)
    for n in range(2, 60):
        t = "".join(r.choice("ab" if n % 2 else "aé𝄞") for _ in range(n))
        assert repetition(t) == pytest.approx(plain(t))
    assert repetition("ab" * 200_000) > 0.9
