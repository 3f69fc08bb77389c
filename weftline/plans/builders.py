"""Report parts, evaluation sets and lessons, bound to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import converters, evalsets, policy, reporting
from weftline.plans.base import query, table
from weftline.plans.measures import rounded

_LINES = "string_split(coalesce(text, ''), chr(10))"


def _score(name: str, value: F.Column) -> F.Column:
    return F.struct(F.lit(name).alias("name"), value.cast("double").alias("score"))


@query(
    f"""WITH l AS (SELECT len({_LINES}) AS n, len(list_distinct({_LINES})) AS k, length(coalesce(text, '')) AS c FROM documents),
m AS (SELECT 'lines' AS name, 0 AS late, n::DOUBLE AS v FROM l UNION ALL SELECT 'lines', 1, k FROM l UNION ALL SELECT 'distinct_share', 0, k / n::DOUBLE FROM l UNION ALL SELECT 'distinct_share', 1, 1 FROM l
 UNION ALL SELECT 'characters', 0, c FROM l UNION ALL SELECT 'kept_share', 1, k / n::DOUBLE FROM l WHERE n > 1),
g AS (SELECT name, coalesce(avg(v) FILTER (late = 0), 0) AS before, coalesce(avg(v) FILTER (late = 1), 0) AS after FROM m GROUP BY 1)
SELECT name, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS delta FROM g"""
)
def metric_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents before and after each line of theirs is kept once. One metric is known before only, one after only."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    d = table(spark, sf_dir, "documents").select(F.size(lines).alias("n"), F.size(F.array_distinct(lines)).alias("k"), F.length(F.coalesce("text", F.lit(""))).alias("c"))
    share = F.col("k") / F.col("n")
    before = F.array(_score("lines", F.col("n")), _score("distinct_share", share), _score("characters", F.col("c")))
    after = F.array(_score("lines", F.col("k")), _score("distinct_share", F.lit(1)), _score("kept_share", F.when(F.col("n") > 1, share)))
    return rounded(reporting.metric_changes(d, before, after))


@query(
    """WITH r AS (SELECT o_orderkey, count(l_orderkey) AS n, count(*) FILTER (l_returnflag <> 'R') AS p, coalesce(sum(l_discount * 10), 0) AS s, max(l_tax) AS t FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT round(avg((n > 0 AND p = n)::INT), 6) AS final_pass_rate, round(avg(t), 6) AS final_test_rate, round(sum(p) / sum(n)::DOUBLE, 6) AS candidate_pass_rate, round(sum(s) / sum(n)::DOUBLE, 6) AS candidate_test_rate, sum(n)::BIGINT AS candidates FROM r"""
)
def execution_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for records, their lines for candidates; a record passes if all of its candidates do."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct((F.col("l_returnflag") != "R").alias("passed"), (F.col("l_discount") * 10).alias("pass_rate"))).alias("c"), F.max("l_tax").alias("t"))
    records = table(spark, sf_dir, "orders").select("o_orderkey").join(c, "o_orderkey", "left")
    return rounded(reporting.execution_rates(records, F.forall("c", lambda x: x["passed"]), F.col("t"), F.col("c")))


@query(
    f"""WITH d AS (SELECT coalesce(source, 'none') AS source, len({_LINES}) AS b, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]'), lambda x: x <> '')) AS a FROM documents)
SELECT coalesce(source, 'ALL') AS source, sum(b)::BIGINT AS before, sum(a)::BIGINT AS after, greatest(sum(a) - sum(b), 0)::BIGINT AS added FROM d GROUP BY ROLLUP (source)"""
)
def node_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stand for the steps before an expansion, sentences for those after it."""
    d = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("text", F.lit("")).alias("t"))
    return reporting.totals(d, "source", F.size(F.split("t", "\n", -1)), F.size(F.filter(F.split("t", "[.!?]", -1), lambda x: x != "")))


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A programming task a user: events of a value are public cases, others private ones."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    case = F.struct(F.col("event_id").cast("string").alias("input"), F.col("event_type").alias("output"))
    g = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", (F.coalesce("value", F.lit(0.0)) < 20).alias("public"), case.alias("case")))).alias("x"), F.min("event_type").alias("first"))
    of = lambda public: F.to_json(F.transform(F.filter("x", lambda r: r["public"] == F.lit(public)), lambda r: r["case"]))
    starter = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("def f"), F.col("user_id").cast("string"), F.lit("(x):")))
    meta = F.when(F.col("user_id") % 2 == 0, F.to_json(F.struct(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("func_name"))))
    return g.select(F.col("user_id").alias("id"), F.concat(F.lit("What follows "), F.col("first"), F.lit("?")).alias("question"), starter.alias("starter"), of(True).alias("public"), of(False).alias("private"), meta.alias("metadata"))


@query(
    """WITH e AS (SELECT user_id, event_id, event_type, coalesce(value, 0) < 20 AS public FROM events)
SELECT user_id AS id, count(*)::INT AS n_cases, md5(string_agg(event_id || '>' || event_type, ',' ORDER BY public DESC, event_id)) AS cases, CASE WHEN user_id % 2 = 0 THEN 'f' || user_id END AS fn_name FROM e GROUP BY 1"""
)
def packed_test_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test cases packed, read back from what was packed."""
    p = evalsets.with_packed_cases(_cases(spark, sf_dir), "public", "private", "metadata").where("error is null").select("id", evalsets.unpacked(F.col("packed")).alias("c"))
    pairs = F.zip_with("c.inputs", "c.outputs", lambda a, b: F.concat(a, F.lit(">"), b))
    return p.select("id", F.size("c.inputs").alias("n_cases"), F.md5(F.array_join(pairs, ",")).alias("cases"), F.col("c.fn_name").alias("fn_name"))


def _text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(
    f"""WITH b AS (SELECT item_id AS id, text AS q, unnest([0, 1, 2, 3]) AS i FROM benchmark),
c AS (SELECT id, q, i, CASE i WHEN 0 THEN left(q, 12) ELSE id || ' ' || i END AS a, row_number() OVER (PARTITION BY id ORDER BY md5('choice/' || id || '/' || i), i) AS n FROM b),
choice AS (SELECT id, {_text(evalsets.CHOICE)} || q || chr(10) || chr(10) || string_agg(substr('ABCD', n, 1) || ') ' || a, chr(10) ORDER BY n) AS prompt, max(substr('ABCD', n, 1)) FILTER (i = 0) AS truth FROM c GROUP BY id, q),
u AS (SELECT user_id AS id, {_text(evalsets.PROGRAM)} || 'What follows ' || min(event_type) || '?' || chr(10) || chr(10) || CASE WHEN user_id % 2 = 0 THEN {_text(evalsets.STARTER)} || 'def f' || user_id || '(x):' || chr(10) || '```' ELSE {_text(evalsets.NO_STARTER)} END AS prompt FROM events GROUP BY user_id)
SELECT 'math' AS data_source, 'Math' AS ability, item_id AS id, md5(text) AS prompt, length(text)::VARCHAR AS truth FROM benchmark
UNION ALL SELECT 'choice', 'Science', id, md5(prompt), truth FROM choice
UNION ALL SELECT 'program', 'Code', id, md5(prompt), 'packed' FROM u"""
)
def evaluation_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tasks in one table: passages as questions, passages with four choices, programs."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    wrong = F.array(*(F.concat(F.col("id").cast("string"), F.lit(f" {i}")) for i in (1, 2, 3)))
    tables = {
        "math": b.withColumn("answer", F.length("question")),
        "choice": b.select("id", "question", F.substring("question", 1, 12).alias("right"), wrong.alias("wrong")),
        "program": _cases(spark, sf_dir),
    }
    out = evalsets.evaluation_set(tables)
    truth = F.when(F.col("data_source") == "program", F.when(F.col("reward_model.ground_truth").isNotNull(), "packed")).otherwise(F.col("reward_model.ground_truth"))
    return out.select("data_source", "ability", F.col("extra_info.index").alias("id"), F.md5(F.col("prompt")[0]["content"]).alias("prompt"), truth.alias("truth"))


@query(
    """WITH a AS (SELECT user_id, avg(value) FILTER (event_id % 2 = 0) AS o, avg(value) FILTER (event_id % 2 = 1) AS n, count(value) AS seen FROM events WHERE user_id IS NOT NULL GROUP BY 1),
s AS (SELECT user_id, CASE WHEN n IS NULL THEN o WHEN o IS NULL THEN n ELSE 0.5::DOUBLE * o + 0.5::DOUBLE * n END AS score, seen FROM a WHERE o IS NOT NULL OR n IS NOT NULL),
c AS (SELECT c_custkey AS user_id, round(score, 6) AS score, coalesce(seen, 0) AS seen FROM customer LEFT JOIN s ON user_id = c_custkey)
SELECT user_id, seen::BIGINT AS seen, row_number() OVER (ORDER BY coalesce(abs(score - 25), -1), user_id) - 1 AS place FROM c"""
)
def curriculum_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as lessons, events as two batches of results with values as scores: never seen first, then by how near
    the score is to 25."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").cast("double").alias("value"))
    state = spark.createDataFrame([], "user_id long, score double, seen long")
    for half in (0, 1):
        state = evalsets.updated_lessons(state, e.where(F.col("event_id") % 2 == half), "user_id", "value")
    state = state.withColumn("score", F.round("score", 6))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return evalsets.lessons(c, state, "user_id", 25.0).join(state.select("user_id", "seen"), "user_id", "left").select("user_id", F.coalesce("seen", F.lit(0)).alias("seen"), "place")


@query(
    """WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS r, list(text ORDER BY turn) AS x FROM conversations GROUP BY 1), o AS (SELECT conv_id, r[1] = 'system' AS led, len(r) AS n, r, x FROM c),
f AS (SELECT unnest(['openai', 'sharegpt']) AS format)
SELECT format, conv_id AS id, CASE WHEN led AND coalesce(x[1], '') <> '' THEN x[1] ELSE 'be brief' END AS system, greatest(n - CASE WHEN led THEN 1 ELSE 0 END - 1, 0)::INT AS n_prompt, CASE WHEN n > CASE WHEN led THEN 1 ELSE 0 END THEN r[-1] || ':' || coalesce(x[-1], '') END AS answer FROM o, f
UNION ALL SELECT 'alpaca', item_id, '', 1, 'assistant:' || text FROM benchmark"""
)
def converted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in two forms and passages in a third, each converted by its format's name."""
    turn = F.struct("turn", F.col("role").alias("role"), F.col("text").alias("content"))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("x")).withColumn("sys", F.lit("be brief"))
    tags = F.create_map(*(F.lit(t) for t in ("user", "human", "assistant", "gpt", "system", "system")))
    tagged = F.transform("x", lambda m: F.struct(F.coalesce(F.element_at(tags, m["role"]), m["role"]).alias("from"), m["content"].alias("value")))
    plain = F.transform("x", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("conv_id"), F.lit("Repeat.").alias("p"), "text")
    parts = {"openai": (c.withColumn("m", plain), {"messages": "m", "system": "sys"}), "sharegpt": (c.withColumn("m", tagged), {"messages": "m", "system": "sys"}), "alpaca": (b, {"prompt": "p", "query": "text", "response": "text"})}
    out = None
    for name, (df, columns) in parts.items():
        last = F.get("_response", F.lit(0))
        part = converters.converted(df, name, columns).select(F.lit(name).alias("format"), F.col("conv_id").alias("id"), F.col("_system").alias("system"), F.size("_prompt").alias("n_prompt"), F.concat(last["role"], F.lit(":"), F.coalesce(last["content"], F.lit(""))).alias("answer"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    """WITH t AS (SELECT ln(l_quantity / 60.0::DOUBLE) AS n, ln((l_linenumber + 50) / 60.0::DOUBLE) AS o, l_discount::DOUBLE * 10 - 0.5 AS a FROM lineitem),
l AS (SELECT -a * exp(least(greatest(n - o, -20), 20)) AS direct, -a * n AS gpg, greatest(-a * exp(least(greatest(n - o, -20), 20)), -a * least(greatest(exp(least(greatest(n - o, -20), 20)), 0.8), 1.2)) AS c, a FROM t)
SELECT 'direct' AS loss, round(avg(direct), 6) AS mean FROM l UNION ALL SELECT 'gpg', round(avg(gpg), 6) FROM l UNION ALL SELECT 'vanilla', round(avg(CASE WHEN a < 0 THEN least(-a * 3, c) ELSE c END), 6) FROM l"""
)
def losses_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of every registered token loss; quantities and line numbers stand for probabilities."""
    new, old, a = F.log(F.col("l_quantity") / 60.0), F.log((F.col("l_linenumber") + 50) / 60.0), F.col("l_discount").cast("double") * 10 - 0.5
    names = sorted(policy.LOSSES)
    row = table(spark, sf_dir, "lineitem").agg(*(F.avg(policy.get_loss(n)(new, old, a)).alias(n) for n in names))
    return rounded(row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("loss"), F.col(n).alias("mean")) for n in names))).alias("x")).select("x.*"))
