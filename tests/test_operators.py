"""Small cases with results worked out by hand or by plain loops."""

import difflib
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from weftline.functions import answers, codemetrics, steps
from weftline.operators import batch, dedup, evaluation, expansion, finetune, groupstats, policy, tabular, textquality
from weftline.sources import files
from weftline.streaming import streams


@pytest.mark.parametrize(("source", "target", "want"), [(3000, 2000, (600, 400)), (2000, 3000, (400, 600)), (1000, 100, (900, 100)), (100, 1000, (100, 900)), (100, 500, (100, 500)), (500, 100, (500, 100)), (10, 10, (10, 10))])
def test_budgets(spark, source, target, want):
    s, t = finetune.budgets(F.lit(source), F.lit(target), 1000)
    assert tuple(spark.range(1).select(s, t).first()) == want


def test_group_stats(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (0, 3.0)], "uid int, score double")
    got = {r.uid: (r.mean, round(r.std, 6), r.n) for r in groupstats.group_stats(df, "uid", "score").collect()}
    assert got == {0: (2.0, round(2**0.5, 6), 2), 1: (0.0, 1.0, 1)}


def test_estimators_against_loops(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(12), float(rng.randrange(4)), float(rng.randrange(1, 9))) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, uid int, score double, length double")
    got = {r.id: r for r in df.select("id", *(groupstats.get_estimator(n)("uid", "score", "length").alias(n) for n in ("grpo", "rloo", "rloo_vectorized", "opo", "baseline", "grpo_passk"))).collect()}
    for i, uid, s, _ in rows:
        g = [(x[2], x[3]) for x in rows if x[1] == uid]
        scores = [x[0] for x in g]
        if len(g) == 1:
            assert (got[i].grpo, got[i].rloo, got[i].rloo_vectorized, got[i].opo, got[i].baseline, got[i].grpo_passk) == (pytest.approx(s, abs=1e-5), s, 0.0, s, s, None)
            continue
        mean, std = statistics.fmean(scores), statistics.stdev(scores)
        assert got[i].grpo == pytest.approx((s - mean) / (std + 1e-6))
        assert got[i].rloo == pytest.approx(s - (sum(scores) - s) / (len(g) - 1))
        assert got[i].opo == pytest.approx(s - sum(a * b for a, b in g) / sum(b for _, b in g))
        assert got[i].baseline == pytest.approx(s - mean)
    with pytest.raises(ValueError):
        groupstats.get_estimator("none")


def test_gae_carries_state_over_masked_tokens(spark):
    row = spark.range(1).select(groupstats.gae(F.array(*map(F.lit, (1.0, 5.0, 2.0))), F.array(*map(F.lit, (0.5, 9.0, 1.0))), F.array(*map(F.lit, (1.0, 0.0, 1.0))), 0.9, 0.8).alias("a")).first().a
    last = 2.0 - 1.0
    first = 1.0 + 0.9 * 1.0 - 0.5 + 0.72 * last
    assert row == pytest.approx([first, last, last])


def test_response_mask(spark):
    ids = [20, 10, 34, 1, 0, 0, 0]
    df = spark.createDataFrame([(0, t, x) for t, x in enumerate(ids)], "row int, t int, x int")
    got = df.withColumn("m", groupstats.before_first(("row",), "t", F.col("x") == 1)).orderBy("t").collect()
    assert [int(r.m) for r in got] == [1, 1, 1, 1, 0, 0, 0]


def test_majority_and_ties(spark):
    df = spark.createDataFrame([(0, 0, "A", 0.9), (0, 1, "B", 0.8), (0, 2, "A", 0.7), (1, 0, "B", 0.8), (1, 1, "A", 0.9)], "uid int, i int, pred string, v double")
    got = {r.uid: (r.majority, r.value) for r in evaluation.majority(df, "uid", "pred", "v", ("i",)).collect()}
    assert got == {0: ("A", 0.9), 1: ("B", 0.8)}


def test_metric_names(spark):
    df = spark.createDataFrame([("loss", 1.0), ("loss", 2.0), ("loss", 3.0), ("max_reward", 5.0), ("max_reward", 8.0), ("max_reward", 6.0), ("min_error", 0.1), ("min_error", 0.05)], "n string, v double")
    assert {r.n: r.x for r in df.groupBy("n").agg(evaluation.by_name(F.col("n"), F.col("v")).alias("x")).collect()} == {"loss": 2.0, "max_reward": 8.0, "min_error": 0.05}


def test_expected_best_matches_bootstrap(spark):
    df = spark.createDataFrame([(0, 0, float(x)) for x in (1, 4, 6, 9, 2)], "k int, uid int, v double")
    exact = evaluation.best_worst_expected(df, ["k"], "uid", "v", 3).first()
    drawn = evaluation.bootstrap(df, "uid", "v", 3, draws=20000).first()
    assert exact.best == pytest.approx(drawn.best_mean, abs=0.1)
    assert exact.worst == pytest.approx(drawn.worst_mean, abs=0.1)


@pytest.mark.parametrize("text", ["", "x" * 149, "ab" * 400, "The same line of text is here\n" * 5, "The same line of text is here\n" * 4, "".join(chr(97 + (i * i) % 23) for i in range(700)), None])
def test_repetition_flags(spark, text):
    def lines(t):
        ls = [x.strip() for x in t.split("\n") if len(x.strip()) >= 20]
        return any(ls.count(x) >= 5 for x in ls)

    def windows(t):
        ws = [t[i : i + 100] for i in range(0, len(t) - 99, 10)] if len(t) >= 300 else []
        return any(ws.count(w) >= 3 for w in ws)

    def blocks(t):
        return any(t[i : i + 50] == t[i + 50 : i + 100] == t[i + 100 : i + 150] for i in range(len(t) - 149))

    c = F.col("t")
    row = spark.createDataFrame([(text,)], "t string").select(textquality.repeated_lines(c), textquality.repeated_windows(c), textquality.consecutive_blocks(c), textquality.reject_reason(c, marker="\\boxed").alias("r")).first()
    if text is None:
        assert not any(row[:3])
        assert row.r == "empty"
    else:
        assert tuple(row[:3]) == (lines(text), windows(text), blocks(text))
        assert row.r == "no_marker"


@pytest.mark.parametrize(("text", "want"), [("so \\boxed{a{b}c} end", "a{b}c"), ("\\boxed{1} and \\boxed{2}", "2"), ("\\boxed{open", None), ("none", None), ("\\boxed{}", "")])
def test_boxed(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(answers.unboxed(answers.last_boxed(F.col("t")))).first()[0] == want


def test_answer_rules(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(answers.marked_number(F.lit("a #### 1,234"))) == "1234"
    assert one(answers.marked_number(F.lit("a"))) is None
    assert one(answers.normalise_final(F.lit("x = \\frac12 units"))) == "\\frac{1}{2}"
    assert one(answers.normalise_words(F.lit("The  Cat, an Apple!"))) == "cat apple"
    assert one(answers.tagged_answer(F.lit("<answer>only one</answer>"))) is None
    with pytest.raises(Exception, match="no scorer"):
        one(answers.dispatch(F.lit("unknown"), F.lit("a"), F.lit("b")))


@pytest.mark.parametrize(("text", "want"), [("1) a = 1\n- b\n\nstep 3. c", ["a = 1", "b", "c"]), ("One field. Two, e.g. this. Three!", ["One field.", "Two, e.g. this.", "Three!"]), ("  ", []), (None, []), ("word", ["word"])])
def test_split_steps(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(steps.split_steps(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(("equation", "want"), [("2+3=5", True), ("2+3 = 6", False), ("2^3=8=4+4", True), ("x=1", None), ("1/0=2", None), ("9**9**9=1", None), (None, None), ("__import__('os')=1", None)])
def test_equations(equation, want):
    assert steps.consistent(equation) is want


def test_knapsacks_and_balance():
    sacks = finetune.knapsacks([5, 9, 4, 1, 6, 12], 10)
    assert sorted(i for s in sacks for i in s) == [0, 1, 2, 3, 4]
    assert all(sum([5, 9, 4, 1, 6, 12][i] for i in s) <= 10 for s in sacks)
    costs = [random.Random(i).randrange(1, 1000) for i in range(64)]
    for equal in (False, True):
        sets = finetune.balanced(costs, 8, equal)
        assert sorted(i for s in sets for i in s) == list(range(64))
        sums = [sum(costs[i] for i in s) for s in sets]
        assert max(sums) - min(sums) < max(costs)
        assert not equal or {len(s) for s in sets} == {8}
    assert finetune.balanced([], 3) == [[], [], []]
    assert finetune.greedy_sets([3, 1, 1], 2) == [[0], [1, 2]]


def test_chat_alignment(spark):
    df = spark.createDataFrame([([("system", "S"), ("user", "u"), ("assistant", "a")],), ([("user", "u"), ("user", "v")],), ([],)], "t array<struct<role:string,content:string>>")
    system, prompt, response = finetune.align_chat(F.col("t"))
    rows = df.select(system.alias("s"), prompt.alias("p"), response.alias("r"), finetune.valid_turns(F.transform("t", lambda m: m["role"])).alias("ok")).collect()
    assert [(r.s, [tuple(x) for x in r.p], [tuple(x) for x in r.r], r.ok) for r in rows] == [("S", [("user", "u")], [("assistant", "a")], False), ("", [("user", "u")], [("user", "v")], False), ("", [], [], False)]


def test_batch_algebra(spark):
    df = spark.createDataFrame([(x,) for x in "dbace"], "k string")
    rows = batch.with_position(df, ["k"], rows_per_range=2)
    assert [r.k for r in rows.orderBy("row_id").collect()] == list("abcde")
    padded = batch.pad_to_divisor(rows, "row_id", 5, 4).orderBy("row_id").collect()
    assert [r.k for r in padded] == list("abcdeabc")
    assert batch.pad_to_divisor(rows, "row_id", 5, 13).count() == 13
    with pytest.raises(Exception, match="differs"):
        batch.union_columns(rows, rows.withColumn("k", F.upper("k")), "row_id").collect()
    assert batch.with_position(df.where("false"), ["k"]).count() == 0


def test_tabular(spark):
    df = spark.createDataFrame([(1.0, "b", None), (None, None, None), (3.0, "a", None)], "x double, c string, z double")
    out = tabular.scaled(df, ["x", "z"]).collect()
    assert sorted(r.x for r in out) == [0.0, 0.5, 1.0]
    assert {r.z for r in out} == {0.0}
    assert {r.c for r in tabular.encoded(df, "c").collect()} == {0, 1, 2}
    assert tabular.find_target(["a", "Label", "b"]) == "Label"
    assert tabular.find_target(["a", "my_target_x", "b"]) == "my_target_x"
    assert tabular.find_target(["a", "b"]) == "b"
    assert not tabular.gates(df, F.col("x") * 1, ["x"]).first().passes


def test_code_metrics():
    code = "def f(a, b):\n    if a and b:\n        for i in a:\n            print(i)\n    return b\n"
    m = dict(zip([x.split()[0] for x in codemetrics.METRICS.split(", ")], codemetrics.measure(code), strict=True))
    assert (m["parses"], m["cyclomatic"], m["cognitive"], m["nesting"], m["npath"], m["safe"], m["violations"]) == (True, 4, 4, 2, 3, True, 0)
    assert codemetrics.measure("def f(:")[7] == 999
    assert codemetrics.compare(code, code) == (0.0, 1.0, 1.0, 1.0, True, True)
    assert not codemetrics.compare(code, "import os\n" + code)[5]
    assert all(abs(sum(w.values()) - 1) < 1e-9 for _, w in codemetrics.token_weights(code))


def test_expansion_rows(spark):
    df = spark.createDataFrame([(1, ["a = 1", "so 2 + 3 = 5"]), (2, []), (3, None)], "id int, steps array<string>")
    got = {r.id: r for r in expansion.expand_steps(df, "id", "steps").collect()}
    assert got[1].attempts > 0
    assert got[1].error is None
    assert got[2].attempts == got[3].attempts == 0

    def broken(*_):
        raise RuntimeError("no model")

    assert "no model" in expansion.expand_steps(df, "id", "steps", fill=broken).where("id = 1").first().error
    trace = expansion.rewrite_code(spark.createDataFrame([(1, "x = 1  \n"), (2, "x = 1\n")], "id int, code string"), "id", "code")
    assert {r.id for r in trace.where("retained").collect()} == {1}


def test_files(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('﻿{"id": 1, "t": "x"}\n\n{"id": 2, "t": "y"}\nnot json\n{"id": 3, "t": "z"}\n', encoding="utf-8")
    assert [r.id for r in files.read_jsonl(spark, str(p), "id long, t string", strict=False).collect()] == [1, 2, 3]
    assert files.read_jsonl(spark, str(p), "id long, t string", strict=False, limit=2).count() == 2
    with pytest.raises(Exception, match="malformed line"):
        files.read_jsonl(spark, str(p), "id long, t string").collect()
    with pytest.raises(ValueError):
        files.read(spark, ["a.csv", "b.json"])
    with pytest.raises(ValueError):
        files.write_parquet(spark.range(0), str(tmp_path / "none"))
    files.write_parquet(spark.range(3), str(tmp_path / "t.parquet"))
    r = files.Registry(json.dumps({"t": {"file_name": "t.parquet", "columns": {"row": "id"}}}), str(tmp_path))
    assert r.load(spark, "t").columns == ["row"]
    with pytest.raises(ValueError):
        r.get("u")
    with pytest.raises(ValueError):
        r.load(spark, "t", ranking=True)


def test_bounded_queue_stream(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(k, i * 10 + j) for k in ("a", "b") for j in range(4)], "k string, seq long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.file_stream(spark, str(tmp_path / "in"), "k string, seq long")
    q = streams.bounded_queue(stream, "k", "seq", 5).writeStream.format("memory").queryName("queue").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.sql("SELECT k, max(dropped) AS dropped, max(held) AS held FROM queue GROUP BY k").collect()
    assert {(r.k, r.dropped, r.held) for r in last} == {("a", 7, 5), ("b", 7, 5)}


def test_penalties(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(policy.kl_penalty(F.lit(0.0), F.lit(100.0), "k3")) == 10.0
    assert one(policy.overlong_penalty(F.lit(45), 50, 10, 1.0)) == -0.5
    assert one(policy.overlong_penalty(F.lit(10), 50, 10, 1.0)) == 0.0
    with pytest.raises(ValueError):
        policy.kl_penalty(F.lit(0.0), F.lit(1.0), "k9")


def test_scores_of_refills_compare_only_what_may_count(monkeypatch):
    made = []
    ratio = difflib.SequenceMatcher.ratio
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda m: made.append(1) or ratio(m))
    s = expansion.score_fill(["abcdef ghi"], "abcdef", ["1234 5678 90"] * 5, ["qrstuvw"])
    assert len(made) == 1  # the following step's; seven before
    assert s["similarity"] == 1.0
    same = expansion.score_fill(["abc def"], "abcdef", ["abc def"], [])
    assert same["similarity"] == 0.0


def test_scores_of_refills_are_kept_and_records_are_dealt_over_tasks(spark):
    before = expansion._scored.cache_info().hits
    assert expansion._scored(("So a",), "a", ("b",), ()) == expansion._scored(("So a",), "a", ("b",), ()) == expansion.score_fill(["So a"], "a", ["b"], [])["aggregate"]
    assert expansion._scored.cache_info().hits > before
    one = spark.createDataFrame([(i, ["Let x = 1", "So 2 + 3 = 5"], "x = 1") for i in range(50)], "id int, steps array<string>, code string").coalesce(1)
    assert expansion.expand_steps(one, "id", "steps").rdd.getNumPartitions() > 1
    assert expansion.rewrite_code(one, "id", "code").rdd.getNumPartitions() > 1


def test_folds_of_a_feature_search_are_made_once(spark, monkeypatch):
    made = []
    fold = batch.stratified_fold
    monkeypatch.setattr(batch, "stratified_fold", lambda *a: made.append(a[0].columns) or fold(*a))
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5), i % 2, "unused") for i in range(60)], "k int, a double, b double, y int, other string")
    trace = tabular.search(df, ["a", "b"], "y", "k", rounds=2)
    assert made == [["a", "b", "y", "k"]] and len(trace) == 2  # once a round and once more before, with all columns


def test_trees_of_a_feature_search_take_equal_rows_once(spark, monkeypatch):
    from pyspark.ml.classification import DecisionTreeClassifier

    taken = []
    fit = DecisionTreeClassifier.fit
    monkeypatch.setattr(DecisionTreeClassifier, "fit", lambda self, data, *a: taken.append(data.count()) or fit(self, data, *a))
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5), int(i % 7 > 3)) for i in range(600)], "k int, a double, b double, y int")
    trace = tabular.search(df, ["a", "b"], "y", "k", rounds=2)
    assert len(trace) == 2 and len(taken) >= 6
    assert max(taken) <= 35 * 2  # different rows of two folds; 400 rows before


def test_trees_of_counted_rows_are_those_of_all_rows(spark):
    rng = random.Random(3)
    rows = [(i, float(x), float(z), int(x + z + rng.randrange(4) > 9)) for i in range(3000) for x, z in [(rng.randrange(9), rng.randrange(6))]]
    rows = tabular.folded(spark.createDataFrame(rows, "k int, a double, b double, y int"), "y", "k")
    few = tabular.counted(rows, ["a", "b"], "y")
    assert few.count() < 400 and few.agg({"_rows": "sum"}).first()[0] == 3000
    want = tabular.cross_validated(rows, ["a", "b"], "y", "k")
    assert tabular.cross_validated(few, ["a", "b"], "y", "k") == want and want["accuracy"] > 0.7


def test_stratified_folds_are_the_same_in_every_run_and_spread_hot_keys(spark):
    import hashlib

    rows = [(i, i // 2 if i % 3 else None, [None, "x", "y"][i % 50 % 3 if i % 2 else 1]) for i in range(400)]  # one key of a third of the rows, one label of half of them
    df = spark.createDataFrame(rows, "i int, key int, label string")
    found = [{r.i: r.f for r in batch.stratified_fold(d, "label", "key", 3, "f", 20).collect()} for d in (df, df.orderBy("i", ascending=False), df.repartition(7))]
    assert found[0] == found[1] == found[2] and len(found[0]) == 400
    out = batch.stratified_fold(df, "label", "key", 3, "f", 20)
    assert out.columns == ["i", "key", "label", "f"]
    for label in (None, "x", "y"):
        own = [(k is not None, hashlib.md5(str(k).encode()).hexdigest() if k is not None else "", found[0][i]) for i, k, g in rows if g == label]
        keys = sorted({r[:2] for r in own})
        at = 0
        for key in keys:  # the folds of a key's rows are those of its places
            n = sum(r[:2] == key for r in own)
            assert sorted(f for *r, f in own if tuple(r) == key) == sorted((at + j) % 3 for j in range(n))
            at += n


def test_codes_of_few_strings_are_sent_to_all_tasks(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(60)], "i int, c string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tabular.encoded(df, "c")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_costly_columns_are_made_once_for_equal_inputs(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, "b"), (4, "c", "b"), (5, None, "b")], "id int, x string, y string")
    got = {r.id: (r.z, r.u) for r in batch.for_distinct(df, ["x", "y"], z=F.concat_ws("-", "x", "y"), u=F.expr("uuid()")).collect()}
    assert {i: z for i, (z, _) in got.items()} == {1: "a", 2: "a", 3: "b", 4: "c-b", 5: "b"}
    assert got[1] == got[2] and got[3] == got[5] and len(set(got.values())) == 3


def test_resampled_extremes_of_prompts_of_many_sizes(spark):
    import numpy as np

    rng = random.Random(8)
    rows = [(i, float(rng.randrange(5)) if i % 9 else rng.choice([float("nan"), float("inf"), 1.0, None])) for i in range(40) for _ in range(1 + i % 6)]
    got = {r.p: r[1:] for r in evaluation.bootstrap(spark.createDataFrame(rows, "p int, v double"), "p", "v", 3, draws=50).collect()}
    assert len(got) == 40
    for p, found in got.items():
        values = np.sort([float("nan") if v is None else v for q, v in rows if q == p])
        pick = values[np.random.default_rng(42).integers(0, len(values), size=(50, 3))]
        hi, lo = pick.max(axis=1), pick.min(axis=1)
        with np.errstate(invalid="ignore"):
            assert found == pytest.approx((hi.mean(), hi.std(), lo.mean(), lo.std()), nan_ok=True)


def test_nearest_vectors_in_blocks_send_vectors_as_they_are(spark):
    import numpy as np

    x = np.random.default_rng(4).normal(size=(30, 4)).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>")
    q, c = df.where("id < 12"), df.where("id >= 12")
    near = dedup.nearest_vectors(q, c, block=5, rows=2)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    assert {r.query_id: (r.match_id, round(r.cosine, 9)) for r in near.collect()} == {i: (12 + int((u[i] @ u[12:].T).argmax()), round(float((u[i] @ u[12:].T).max()), 9)) for i in range(12)}
    with pytest.raises(Exception, match="length 0"):
        dedup.nearest_vectors(spark.createDataFrame([(1, [0.0, 0.0])], "id long, vec array<float>"), c).collect()


def test_runs_of_words_are_grouped_by_plain_numbers(spark):
    df = spark.createDataFrame([("s", "a b c d a b c d"), ("t", "a b")], "k string, t string")
    out = evaluation.distinct_ngrams(df, "k", "t")
    assert {r.k: round(r.distinct_share, 6) for r in out.collect()} == {"s": 0.8, "t": 0.0}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_zip" in plan and "sequence" not in plan  # no lambda for each run
