"""Mixing, sample forms, replies, LaTeX answers, likeness and tested code, bound to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import execution, latex, replies, textscores
from weftline.operators import batch, mixing, samples
from weftline.plans.base import query, table
from weftline.plans.measures import rounded

_SHARE = "(('0x' || substr(md5({}), 1, 8))::BIGINT::DOUBLE / 4294967296)"
_CHANCE = f"""s AS (SELECT CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS source, doc_id, row_number() OVER (PARTITION BY CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END ORDER BY doc_id) - 1 AS n FROM documents),
u AS (SELECT slot, {_SHARE.format("slot::VARCHAR || 'mix'")} AS u FROM (SELECT unnest(range((SELECT count(*) + 1 FROM documents))) AS slot)),
p AS (SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS n FROM (SELECT slot, CASE WHEN u < 0.5 THEN 0 WHEN u < 0.75 THEN 1 ELSE 2 END AS source FROM u))"""


@query(f"WITH {_CHANCE} SELECT slot, source, doc_id FROM p JOIN s USING (source, n) WHERE slot < (SELECT min(slot) FROM p LEFT JOIN s USING (source, n) WHERE doc_id IS NULL)")
def interleave_by_chance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    parts = [d.where("lang = 'en'"), d.where("lang = 'de'"), d.where("lang not in ('en', 'de')")]
    return mixing.interleave_by_chance(parts, [0.5, 0.25, 0.25], ["doc_id"], "mix").select("slot", "source", "doc_id")


_BATCHES = """b AS (SELECT event_id, e AS epoch, n // 64 AS batch, n % 64 AS place FROM (SELECT event_id, e, row_number() OVER (PARTITION BY e ORDER BY md5(event_id::VARCHAR || 's:' || e), event_id) - 1 AS n FROM events, (SELECT unnest([0, 1]) AS e))
WHERE n < (SELECT count(*) FROM events) // 64 * 64)"""


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mini_batches(table(spark, sf_dir, "events").select("event_id"), "event_id", 64, 2, "s")


@query(f"WITH {_BATCHES} SELECT * FROM b")
def mini_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir)


@query(f"WITH {_BATCHES} SELECT * FROM b WHERE epoch > 0 OR batch >= 3")
def resumed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.resumed(_batches(spark, sf_dir), 0, 3)


@query("SELECT doc_id, s * 256 + row_number() OVER (PARTITION BY s ORDER BY md5(n::VARCHAR || 'buf'), n) - 1 AS new_place FROM (SELECT doc_id, n, n // 256 AS s FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents))")
def shuffle_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = batch.with_position(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])
    return mixing.shuffle_buffer(placed, "row_id", 256, "buf").select("doc_id", "new_place")


STRATEGIES = ["click", "error", "purchase", "signup", "view"]


def _experiment_sql(name: str, policy: str, kept: list[str]) -> str:
    turn = "CASE user_id % {} {} END".format(len(kept), " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(kept)))
    order = {"random": "md5(user_id::VARCHAR || '/' || event_id::VARCHAR)", "fixed": f"CASE WHEN event_type = {turn} THEN 0 ELSE 1 END", "adaptive": "value DESC NULLS LAST, ts DESC NULLS LAST"}[policy]
    kinds = ", ".join(f"'{s}'" for s in kept)
    return f"SELECT '{name}' AS experiment, count(*) AS n_records, round(avg(value), 6) AS mean_value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}, event_id) AS r FROM events WHERE event_type IN ({kinds})) WHERE r = 1"


@query(" UNION ALL ".join([*(_experiment_sql(p, p, STRATEGIES) for p in ("adaptive", "random", "fixed")), *(_experiment_sql(f"without_{s}", "adaptive", [x for x in STRATEGIES if x != s]) for s in STRATEGIES)]))
def policy_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stand for attempts: the user is the record, the kind the strategy, value and time the scores."""
    e = table(spark, sf_dir, "events")
    return rounded(mixing.policy_comparison(e, "user_id", "event_type", "event_id", STRATEGIES, [F.col("value"), F.col("ts")], "value"))


@query("SELECT event_id, user_id, ((n - 1) % 7)::INT AS server FROM events JOIN (SELECT user_id, row_number() OVER (ORDER BY min(event_id)) AS n FROM events GROUP BY 1) USING (user_id)")
def sticky_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sticky_servers(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", ["event_id"], 7)


@query("SELECT left(n_name, 1) AS name, array_to_string(list(n_nationkey ORDER BY n_regionkey, n_nationkey), ',') AS all_values, 'v1' AS version FROM nation GROUP BY 1")
def merged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "nation").select("n_regionkey", F.substring("n_name", 1, 1).alias("name"), "n_nationkey", F.lit("v1").alias("version"))
    merged = mixing.merged_metrics(parts, "n_regionkey", "name", "n_nationkey", ["version"])
    return merged.select("name", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("all_values"), "version")


@query("SELECT item_id, 'system: be brief|user: ' || text AS prompt, item_id::VARCHAR AS ground_truth, text AS single_turn_prompt, 'general ask-for-assistance task' AS task_desc, length(text)::BIGINT AS size FROM benchmark")
def collapsed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    rows = b.select(F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("prompt"), F.col("text").alias("single_turn_prompt"), F.lit("").alias("ground_truth"), F.col("item_id").cast("string").alias("completion"), F.length("text").cast("long").alias("size"), "item_id")
    out = samples.collapsed(rows, "be brief", "dialogues", "agent", F.col("item_id"))
    return out.select(F.col("index").alias("item_id"), F.array_join(F.transform("prompt", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "|").alias("prompt"), "reward_model.ground_truth", "extra_info.interaction_kwargs.single_turn_prompt", "extra_info.interaction_kwargs.task_desc", "extra_info.size")


@query(r"SELECT doc_id AS example_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS prompt, coalesce(lang, '') AS answer, layout FROM documents, (SELECT unnest(['flat', 'nested']) AS layout)")
def evaluation_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.lit(" "), F.coalesce("lang", F.lit("")), F.lit("\n")).alias("answer"))
    flat = samples.evaluation_samples(d.select("doc_id", F.col("text").alias("problem"), "answer"), F.col("doc_id")).withColumn("layout", F.lit("flat"))
    nested = d.select("doc_id", F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("prompt"), F.struct(F.col("answer").alias("ground_truth")).alias("reward_model"))
    return flat.unionByName(samples.evaluation_samples(nested, F.col("doc_id")).withColumn("layout", F.lit("nested")))


@query("SELECT item_id, 'searchR1_set' || item_id % 3 AS data_source, 'Search first.' || text AS content, text AS question, item_id::VARCHAR AS truth FROM benchmark")
def search_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    source = F.concat(F.lit("set"), (F.col("item_id") % 3).cast("string"))
    out = b.select(*samples.search_sample(F.col("text"), F.col("item_id").cast("string"), source, "train", F.col("item_id"), "You may search.", "Search first.\n"))
    return out.select(F.col("extra_info.index").alias("item_id"), "data_source", F.col("prompt")[1]["content"].alias("content"), "extra_info.tools_kwargs.search.create_kwargs.question", F.col("extra_info.tools_kwargs.search.create_kwargs.ground_truth").alias("truth"))


@query("SELECT n_nationkey, n_name AS id, CASE WHEN n_regionkey > 2 THEN 'own' ELSE n_regionkey::VARCHAR END AS type FROM nation")
def node_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.create_map(F.lit("node_id"), F.col("n_name"), F.lit("node_type"), F.col("n_regionkey").cast("string"))
    node = F.when(F.col("n_regionkey") > 2, F.map_concat(named, F.create_map(F.lit("type"), F.lit("own")))).otherwise(named)
    out = table(spark, sf_dir, "nation").select("n_nationkey", samples.with_aliases(F.array(node))[0].alias("n"))
    return out.select("n_nationkey", F.element_at("n", "id").alias("id"), F.element_at("n", "type").alias("type"))


@query(
    """WITH s AS (SELECT l_orderkey, list(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_linenumber % 3 + 1 END ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS g FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(flatten(list_transform(range(len(g)), lambda i: list_transform(range(len(g)), lambda j: (j <= i AND g[i + 1] = g[j + 1] AND g[i + 1] <> 0)::INT))), '') AS mask FROM s"""
)
def segment_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.when(F.col("l_returnflag") == "R", 0).otherwise((F.col("l_linenumber") % 3 + 1).cast("int")).alias("g"))
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["g"]).alias("g"))
    return s.select("l_orderkey", F.array_join(F.transform(F.flatten(samples.segment_mask(F.col("g"))), lambda x: x.cast("string")), "").alias("mask"))


_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"


@query(
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS up, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_partkey, l_suppkey) AS down FROM (SELECT DISTINCT {_LINE} FROM lineitem))
SELECT c.l_orderkey, c.l_partkey AS chosen_part, x.l_partkey AS rejected_part, round(ln(1 + exp(-abs(0.01 * z))) + greatest(-0.01 * z, 0), 6) AS loss FROM (SELECT * FROM r WHERE up = 1) c JOIN (SELECT * FROM r WHERE down = 1) x USING (l_orderkey),
LATERAL (SELECT ((c.l_quantity - x.l_quantity) - (c.l_linenumber - x.l_linenumber))::DOUBLE AS z) WHERE c.l_quantity > x.l_quantity"""
)
def best_worst_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities stand for the policy's log-probabilities, line numbers for the reference's."""
    rows = table(spark, sf_dir, "lineitem").select(*_LINE.split(", ")).distinct()
    pairs = samples.best_and_worst(rows, "l_orderkey", "l_quantity", ["l_linenumber", "l_partkey", "l_suppkey"])
    of = lambda side, c: F.col(f"{side}.{c}").cast("double")
    loss = samples.preference_loss(of("chosen", "l_quantity"), of("rejected", "l_quantity"), of("chosen", "l_linenumber"), of("rejected", "l_linenumber"), 0.01)
    return pairs.select("l_orderkey", F.col("chosen.l_partkey").alias("chosen_part"), F.col("rejected.l_partkey").alias("rejected_part"), F.round(loss, 6).alias("loss"))


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(t, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: " + _STRIP.format("x") + r"), lambda x: x <> '' AND x NOT IN ('$$', '\[', '\]', '\(', '\)'))"
_BARE = r"list_filter(list_transform(string_split(t, chr(10)), lambda x: " + _STRIP.format(r"regexp_replace(x, '^\s*([-*]|\d+[.)：:])\s*', '')") + r"), lambda x: x <> '' AND x NOT IN ('$$', '\[', '\]', '\(', '\)') AND NOT starts_with(x, '\begin{') AND NOT starts_with(x, '\end{') AND (length(x) > 2 OR regexp_matches(x, '[A-Za-z0-9一-龥]')))"


@query(
    f"""WITH d AS (SELECT doc_id, {_STRIP.format("replace(coalesce(text, ''), chr(13) || chr(10), chr(10))")} AS t FROM documents), s AS (SELECT doc_id, t, {_BARE} AS a, {_SENTENCES} AS b FROM d),
p AS (SELECT doc_id, CASE WHEN t = '' THEN [] WHEN len(a) >= 2 THEN a WHEN len(b) > 0 THEN b ELSE [t] END AS x FROM s)
SELECT doc_id, len(x)::INT AS n_steps, md5(array_to_string(x, '|')) AS steps FROM p"""
)
def adapter_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "documents").select("doc_id", replies.adapter_steps(F.col("text")).alias("x"))
    return steps.select("doc_id", F.size("x").alias("n_steps"), F.md5(F.array_join("x", "|")).alias("steps"))


@query(
    rf"""WITH d AS (SELECT doc_id, {_STRIP.format("coalesce(text, '')")} AS t FROM documents),
l AS (SELECT doc_id, t, list_filter(list_transform(string_split(t, chr(10)), lambda x: {_STRIP.format("x")}), lambda x: x <> '') AS a, list_filter(list_transform(string_split(t, chr(10)), lambda x: {_STRIP.format(r"regexp_replace(x, '^\s*([-*]|\d+[.)])\s*', '')")}), lambda x: x <> '') AS b FROM d),
p AS (SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN a WHEN len(b) > 0 THEN b ELSE [t] END AS x FROM l)
SELECT doc_id, len(x)::INT AS n_steps, md5(array_to_string(x, '|')) AS steps FROM p"""
)
def reply_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the replies are JSON objects, a third hold one between fences, a third are plain lines."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    d = table(spark, sf_dir, "documents").select("doc_id", strip(F.coalesce("text", F.lit(""))).alias("t"))
    as_json = F.to_json(F.struct(F.split("t", "\n").alias("steps")))
    reply = F.when(F.col("doc_id") % 3 == 0, as_json).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Here it is:\n```json\n"), as_json, F.lit("\n```\n"))).otherwise(F.col("t"))
    steps = d.select("doc_id", replies.reply_steps(reply).alias("x"))
    return steps.select("doc_id", F.size("x").alias("n_steps"), F.md5(F.array_join("x", "|")).alias("steps"))


def _formulas_sql(source: str, key: str) -> str:
    """SQL for ``key`` and ``f``, the formulas of a table's texts; what follows a name's words is written back, as the
    engine of these patterns has no look-ahead."""
    chunks = rf"regexp_split_to_array(text, '(?i)\b(?:{'|'.join(replies.CONNECTIVES)})\b|[,;.]')"
    runs = rf"flatten(list_transform({chunks}, lambda c: regexp_extract_all(c, '{replies.FORMULA}')))"
    tidy = r"regexp_replace(regexp_replace(r, '^[ .,:;]+|[ .,:;]+$', '', 'g'), '\s+', ' ', 'g')"
    bare = _STRIP.format(rf"regexp_replace({tidy}, '^(?:[A-Za-z]+\s+){{1,4}}([A-Za-z0-9(])', '\1')")
    return rf"SELECT {key}, text, list_filter(list_transform({runs}, lambda r: {bare}), lambda r: regexp_matches(r, '[=+\-*/^]')) AS f FROM {source}"


@query(f"SELECT doc_id, len(f)::INT AS n_formulas, array_to_string(f, '|') AS formulas FROM ({_formulas_sql('documents', 'doc_id')})")
def clause_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "documents").select("doc_id", replies.clause_formulas(F.col("text")).alias("f"))
    return f.select("doc_id", F.size("f").alias("n_formulas"), F.array_join("f", "|").alias("formulas"))


@query(
    f"""WITH x AS (SELECT item_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n, len(f) > 0 AS has FROM ({_formulas_sql("benchmark", "item_id")})),
s AS (SELECT item_id, 0.82::DOUBLE AS similarity, CASE WHEN n > 0 THEN 0.78::DOUBLE ELSE 0 END AS logic_consistency, CASE WHEN has THEN 0.85::DOUBLE ELSE 0.65 END AS formula_correctness, CASE WHEN n >= 5 THEN 0.8::DOUBLE ELSE 0.55 END AS completeness, CASE WHEN n >= 5 THEN 0.68::DOUBLE ELSE 0.45 END AS reasoning_gain FROM x),
t AS (SELECT *, {" + ".join(f"{w}::DOUBLE * {k}" for k, w in replies.WEIGHTS.items())} AS total FROM s)
SELECT * EXCLUDE (total), round(total, 6) AS aggregate_score, total >= 0.62 AS accepted FROM t"""
)
def fallback_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "benchmark").select("item_id", replies.fallback_scores(F.col("text")).alias("s"))
    return rounded(s.select("item_id", "s.*"))


_A, _B = "l_linenumber", "(l_partkey % 9 + 1)"


@query(
    f"""WITH t AS (SELECT {_LINE}, {_A}::VARCHAR AS a, {_B}::VARCHAR AS b, l_suppkey % 6 AS style FROM (SELECT DISTINCT {_LINE} FROM lineitem)),
x AS (SELECT *, CASE style WHEN 0 THEN '\\frac' || a || b WHEN 1 THEN '\\dfrac{{' || a || '}}{{' || b || '}}' WHEN 2 THEN a || '/' || b WHEN 3 THEN 'x = ' || a || '/' || b WHEN 4 THEN '\\left\\frac{{' || a || '}}' || b || '\\text{{ km}}' ELSE '.5' END AS answer FROM t),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(answer, 'dfrac', 'frac'), '\\left', ''), '\\\\text\\{{ .*$', ''), '^x = ', ''), '^([0-9]+)/([0-9]+)$', '\\\\frac{{\\1}}{{\\2}}'), '\\\\frac([0-9])([0-9])', '\\\\frac{{\\1}}{{\\2}}') AS k FROM x)
SELECT {_LINE}, CASE WHEN style = 5 THEN '\\frac{{1}}{{2}}' ELSE k END AS form, CASE WHEN (CASE WHEN style = 5 THEN '\\frac{{1}}{{2}}' ELSE k END) = '\\frac{{' || a || '}}{{' || b || '}}' THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM c"""
)
def latex_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_linenumber").cast("string"), (F.col("l_partkey") % 9 + 1).cast("string")
    style, lit = F.col("l_suppkey") % 6, F.lit
    answer = (
        F.when(style == 0, F.concat(lit("\\frac"), a, b)).when(style == 1, F.concat(lit("\\dfrac{"), a, lit("}{"), b, lit("}"))).when(style == 2, F.concat(a, lit("/"), b))
        .when(style == 3, F.concat(lit("x = "), a, lit("/"), b)).when(style == 4, F.concat(lit("\\left\\frac{"), a, lit("}"), b, lit("\\text{ km}"))).otherwise(".5")
    )
    truth = F.concat(lit("\\frac{"), a, lit("}{"), b, lit("}"))
    reply = F.concat(lit("We get \\boxed{"), F.col("answer"), lit("}."))
    lines = table(spark, sf_dir, "lineitem").select(*_LINE.split(", "), answer.alias("answer"), truth.alias("truth"))
    graded = batch.for_distinct(lines, ["answer", "truth"], form=latex.normal_form(F.col("answer")), score=latex.boxed_score(reply, F.col("truth")))
    return graded.select(*_LINE.split(", "), "form", "score").distinct()


@query("SELECT event_id, user_id % 50 || ',' || event_id % 1000 + 1000 AS inside, 2::INT AS n FROM events")
def tuple_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = F.col("event_id") % 1000 + 1000
    comma = F.concat(F.lit("1,"), F.substring(big.cast("string"), 2, 3))
    e = table(spark, sf_dir, "events").select("event_id", latex.tuple_elements(F.concat(F.lit("("), (F.col("user_id") % 50).cast("string"), F.lit(", "), comma, F.lit("]"))).alias("x"))
    return e.select("event_id", F.array_join("x", ",").alias("inside"), F.size("x").alias("n"))


_ROUGE = """p AS (SELECT a.doc_id, list_filter(regexp_split_to_array(coalesce(a.text, ''), '\\s+'), lambda w: w <> '') AS x, list_filter(regexp_split_to_array(coalesce(b.text, ''), '\\s+'), lambda w: w <> '') AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
g AS (SELECT doc_id, len(x) > 0 AND len(y) > 0 AS ok, list_distinct(x) AS x1, list_distinct(y) AS y1, list_distinct(list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1])) AS x2, list_distinct(list_transform(range(1, len(y)), lambda i: y[i] || ' ' || y[i + 1])) AS y2 FROM p)"""
_F = "CASE WHEN ok AND h > 0 THEN round(100 * (2 * (h / len({0})) * (h / len({1})) / (h / len({0}) + h / len({1}) + 1e-8)), 4) ELSE 0.0 END"


def _successive(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("truth")), "doc_id")


@query(
    f"""WITH {_ROUGE}, a AS (SELECT doc_id, {_F.format("x1", "y1")} AS rouge_1 FROM (SELECT *, len(list_intersect(x1, y1))::DOUBLE AS h FROM g)), b AS (SELECT doc_id, {_F.format("x2", "y2")} AS rouge_2 FROM (SELECT *, len(list_intersect(x2, y2))::DOUBLE AS h FROM g))
SELECT doc_id, rouge_1, rouge_2 FROM a JOIN b USING (doc_id)"""
)
def rouge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _successive(spark, sf_dir).select("doc_id", textscores.overlap_scores(F.col("text"), F.col("truth"), ("rouge_1", "rouge_2")).alias("s"))
    return s.select("doc_id", "s.rouge_1", "s.rouge_2")


@query()
def corpus_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus means of all likeness scores of documents with their successors."""
    s = _successive(spark, sf_dir).select(textscores.overlap_scores(F.col("text"), F.col("truth")).alias("s")).select("s.*")
    return rounded(s.agg(*(F.avg(c).alias(c) for c in s.columns)), 4)


@query()
def repeating_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", textscores.repeats_itself(F.col("text")).alias("repeats"))


@query("SELECT event_id, user_id % 4 + 1 = event_id % 5 AS passed, CASE WHEN user_id % 4 + 1 = event_id % 5 THEN 'None' ELSE 'AssertionError' END AS error FROM events")
def unit_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few different codes with few different tests, each run once."""
    code = F.concat(F.lit("def f(x):\n    return x + "), (F.col("user_id") % 4).cast("string"))
    test = F.array(F.concat(F.lit("assert f(1) == "), (F.col("event_id") % 5).cast("string")))
    e = table(spark, sf_dir, "events").select("event_id", code.alias("code"), test.alias("tests"))
    return execution.tested(e, "code", "tests", enabled=True).select("event_id", "passed", "error")


@query("SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 1.0::DOUBLE WHEN user_id % 4 = 2 THEN 0.5 ELSE 0.0 END AS share FROM events")
def cases_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of two numbers, with a part of the codes wrong: the second case adds 0, so half of it may be right."""
    reply = F.concat(F.lit("Like so:\n```python\na, b = map(int, input().split())\nprint(a + b * "), F.when(F.col("user_id") % 4 == 0, "1").when(F.col("user_id") % 4 == 2, "2").otherwise("1 + 7"), F.lit(")\n```"))
    e = table(spark, sf_dir, "events").select("event_id", execution.solution_code(reply).alias("code"), F.array(F.lit("1 2"), F.lit("4 0")).alias("inputs"), F.array(F.lit("3"), F.lit("4\n")).alias("outputs"))
    return execution.share_of_cases(e, "code", "inputs", "outputs", enabled=True).select("event_id", "share")


def mock_generate(prompt: str, feedback: str, attempt: int) -> str:
    """Right at the attempt that the prompt names; a missing colon at the first one otherwise."""
    right = attempt >= int(prompt.rsplit(" ", 1)[1])
    return f"def f(x){':' if right or attempt > 1 else ''}\n    return x + {1 if right else 2}"


@query("SELECT event_id, least(user_id % 5 + 1, 3)::INT AS attempts, user_id % 5 + 1 <= 3 AS passed FROM events")
def repaired_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = F.concat(F.lit("right at attempt "), (F.col("user_id") % 5 + 1).cast("string"))
    e = table(spark, sf_dir, "events").select("event_id", prompt.alias("prompt"), F.array(F.lit("assert f(1) == 2")).alias("tests"))
    return execution.repaired(e, "prompt", "tests", mock_generate, 3, enabled=True).select("event_id", "attempts", "passed")
