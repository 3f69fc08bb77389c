"""Dataset preparation and small recipe operators, bound to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import formats
from weftline.operators import batch
from weftline.plans.base import query, table
from weftline.plans.prepared import _MARKED, _RESP, chats, responses
from weftline.plans.rollouts import _KEY, KEY, TOKENS, tokens


@query(f"WITH {_RESP} SELECT event_id, text || ' Think step by step.' AS prompt, 'math' AS ability, 'rule' AS style, {_MARKED} AS ground_truth FROM resp WHERE {_MARKED} IS NOT NULL")
def prep_marked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a word-problem set in the form that training reads, flattened."""
    from weftline.functions import answers

    row = responses(spark, sf_dir).select("event_id", F.array(F.struct(F.lit("user").alias("role"), F.concat("text", F.lit(" Think step by step.")).alias("content"))).alias("prompt"), F.lit("math").alias("ability"), F.struct(F.lit("rule").alias("style"), answers.marked_number(F.col("text")).alias("ground_truth")).alias("reward_model"))
    row = row.where("reward_model.ground_truth is not null")
    return row.select("event_id", F.col("prompt")[0]["content"].alias("prompt"), "ability", "reward_model.style", "reward_model.ground_truth")


@query("SELECT item_id, kind, CASE WHEN (row_number() OVER (PARTITION BY kind ORDER BY item_id) - 1) < 0.75 * count(*) OVER (PARTITION BY kind) THEN 'train' ELSE 'test' END AS part FROM benchmark, (SELECT unnest(['chosen', 'rejected']) AS kind)")
def prep_preference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batch.with_position(table(spark, sf_dir, "benchmark").select("item_id"), ["item_id"])
    n = rows.count()
    part = F.when(F.col("row_id") < 0.75 * n, "train").otherwise("test")
    return rows.select("item_id", F.explode(F.array(F.lit("chosen"), F.lit("rejected"))).alias("kind"), part.alias("part"))


@query(
    """WITH s AS (SELECT string_agg('Q: ' || text || chr(10) || 'A: ' || item_id, chr(10) || chr(10) ORDER BY item_id) AS shots FROM (SELECT * FROM benchmark ORDER BY item_id LIMIT 3))
SELECT item_id, shots || chr(10) || chr(10) || 'Q: ' || text || chr(10) || 'A:' AS prompt FROM benchmark, s WHERE item_id > (SELECT max(item_id) FROM (SELECT item_id FROM benchmark ORDER BY item_id LIMIT 3))"""
)
def fewshot_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    q = F.concat(F.lit("Q: "), F.col("text"), F.lit("\nA:"))
    first = b.orderBy("item_id").limit(3)
    shots = first.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_id", F.concat(q, F.lit(" "), F.col("item_id").cast("string")).alias("x")))), lambda s: s["x"]), "\n\n").alias("shots"), F.max("item_id").alias("last"))
    return b.crossJoin(F.broadcast(shots)).where("item_id > last").select("item_id", F.concat("shots", F.lit("\n\n"), q).alias("prompt"))


@query("SELECT event_id, 'User ' || user_id || ' did ' || event_type || ' and {{user}}' AS text FROM events")
def fill_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = formats.filled(F.lit("User {{user}} did {{kind}} and {{user}}"), {"user": F.col("user_id").cast("string"), "kind": F.col("event_type")})
    return table(spark, sf_dir, "events").select("event_id", t.alias("text"))


_MEDIA = "replace(replace(coalesce(text, ''), ', ', '<image>'), '. ', '<video>')"


@query(
    f"""WITH s AS (SELECT doc_id, list_filter(string_split(replace(replace({_MEDIA}, '<image>', chr(1) || '<image>' || chr(1)), '<video>', chr(1) || '<video>' || chr(1)), chr(1)), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, len(s)::INT AS n, len(list_filter(s, lambda x: x = '<image>'))::INT AS images, md5(array_to_string(s, '|')) AS segments FROM s"""
)
def media_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose commas stand for images and whose stops stand for videos."""
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(", "), F.lit("<image>")), F.lit(". "), F.lit("<video>"))
    s = table(spark, sf_dir, "documents").select("doc_id", formats.media_segments(text).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.size(F.filter("s", lambda x: x == "<image>")).alias("images"), F.md5(F.array_join("s", "|")).alias("segments"))


@query("SELECT event_id, array_to_string(list_transform(string_split(event_type, ''), lambda c: c || CASE WHEN c = 'r' THEN ' = ' ELSE ' != ' END || 'r'), chr(10)) || chr(10) || 'So \\boxed{' || (length(event_type) - length(replace(event_type, 'r', ''))) || '}' AS answer FROM events")
def character_count_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", formats.letter_count_task(F.col("event_type"), "r").alias("answer"))


@query("SELECT p_partkey, array_to_string(regexp_extract_all(p_name || '_oneTwo3HTTP', '([A-Z]?[a-z]+|[A-Z]+|[0-9]+)', 1), ' ') AS words FROM part")
def split_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(formats.identifier_words(F.concat("p_name", F.lit("_oneTwo3HTTP"))), " ").alias("words"))


@query(r"SELECT item_id, replace(regexp_replace(replace(trim(text || ' [title] end [x]  go'), ' [title]', '. '), '\[.*?\]', '', 'g'), '  ', ' ') AS text FROM benchmark")
def tidy_activity_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", formats.tidy_activity(F.concat("text", F.lit(" [title] end [x]  go"))).alias("text"))


@query("SELECT conv_id, bool_and(role IN ('user', 'assistant', 'system', 'tool') AND trim(text) <> '') AS ok FROM conversations GROUP BY 1")
def message_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(spark, sf_dir).select("conv_id", formats.well_formed(F.col("turns")).alias("ok"))


@query(
    """WITH p AS (SELECT user_id, event_id % 50 AS y, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT user_id, round(CASE WHEN user_id % 9 = 0 THEN -1 ELSE coalesce(1.0::DOUBLE / min(n) FILTER (value BETWEEN 5 AND 30 AND y BETWEEN 10 AND 40), 0) END, 6) AS reward FROM p GROUP BY 1"""
)
def point_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as the points of an answer, in their order; every ninth answer is no list."""
    point = F.struct("event_id", F.array(F.col("value").cast("double"), (F.col("event_id") % 50).cast("double")).alias("p"))
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(point)).alias("x"))
    answer = F.when(F.col("user_id") % 9 == 0, "none").otherwise(F.to_json(F.transform("x", lambda r: r["p"])))
    box = lambda x, y: F.array(F.lit(float(x)), F.lit(float(y)))
    return g.select("user_id", F.round(formats.point_reward(answer, box(5, 10), box(30, 40)), 6).alias("reward"))


@query(
    """WITH o AS (SELECT event_id, event_type AS gold, unnest([event_type, 'red', 'green', 'blue']) AS o FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY md5(event_id || '|' || o)) AS n FROM o)
SELECT event_id, string_agg(o, ',' ORDER BY n) AS options, chr((64 + max(n) FILTER (o = gold))::INT) AS answer FROM r GROUP BY 1"""
)
def multiple_choice_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_type")
    options, answer = formats.shuffled_choices(F.array(k, F.lit("red"), F.lit("green"), F.lit("blue")), k, F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(options, ",").alias("options"), answer.alias("answer"))


@query(
    r"""WITH w AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \n]'), lambda x: x <> ''), lambda x: length(x)) AS n FROM documents),
t AS (SELECT doc_id, unnest(n) AS n, unnest(range(len(n))) AS i FROM w), l AS (SELECT doc_id, n AS p, lead(n) OVER (PARTITION BY doc_id ORDER BY i) AS x FROM t)
SELECT doc_id, round(avg((p = x)::INT) FILTER (x >= 3), 6) AS accuracy FROM documents LEFT JOIN l USING (doc_id) GROUP BY 1"""
)
def token_label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word's length is the guess of the next word's; words of fewer than three characters are no labels."""
    n = F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \n]", -1), lambda x: x != ""), F.length)
    d = table(spark, sf_dir, "documents").select("doc_id", n.alias("n"))
    short = F.greatest(F.size("n") - 1, F.lit(0))
    labels = F.transform(F.slice("n", F.lit(2), short), lambda x: F.when(x < 3, -100).otherwise(x))
    return d.select("doc_id", F.round(formats.token_accuracy(F.slice("n", F.lit(1), short), labels), 6).alias("accuracy"))


@query("SELECT event_type IN ('click', 'view') AS wanted, round(sum(value) FILTER (event_id % 7 <> 0), 4) AS total, count(*) FILTER (event_id % 7 <> 0) AS n FROM events GROUP BY 1")
def kto_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and counts by flag, NaNs left out."""
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    df = table(spark, sf_dir, "events").select(F.col("event_type").isin("click", "view").alias("wanted"), v.alias("v"))
    return df.groupBy("wanted").agg(F.round(F.sum(F.when(~F.isnan("v"), F.col("v"))), 4).alias("total"), F.count_if(~F.isnan("v")).alias("n"))


@query(
    f"""WITH RECURSIVE {TOKENS}, s AS (SELECT user_id, event_id, t, r AS last FROM tok WHERE t = 0 UNION ALL SELECT k.user_id, k.event_id, k.t, s.last * 0.8 + (1 - 0.8) * k.r FROM s JOIN tok k ON k.user_id = s.user_id AND k.t = s.t + 1)
SELECT event_id, round(last, 6) AS smooth FROM s"""
)
def ema_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens(spark, sf_dir).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("t", "r", "event_id"))).alias("x"))
    s = rows.select(F.transform("x", lambda x: x["event_id"]).alias("ids"), formats.smoothed(F.transform("x", lambda x: x["r"]), 0.8).alias("s"))
    return s.select(F.explode(F.arrays_zip("ids", "s")).alias("z")).select(F.col("z.ids").alias("event_id"), F.round("z.s", 6).alias("smooth"))


@query(f"WITH {TOKENS} SELECT event_id, max(r) OVER (PARTITION BY user_id ORDER BY t) AS best, coalesce(r > max(r) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-6, true) AS improved FROM tok")
def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("t")
    before = F.max("r").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return tokens(spark, sf_dir).select("event_id", F.max("r").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("best"), F.coalesce(F.col("r") > before + 1e-6, F.lit(True)).alias("improved"))


@query(
    f"""WITH x AS (SELECT {_KEY}, CASE l_linenumber % 4 WHEN 0 THEN l_quantity::VARCHAR WHEN 1 THEN (l_quantity / 100)::VARCHAR WHEN 2 THEN l_returnflag ELSE (l_partkey % 60)::VARCHAR END AS p, CASE WHEN l_linestatus = 'O' THEN l_quantity::VARCHAR ELSE 'R' END AS r FROM lineitem),
n AS (SELECT *, try_cast(p AS DOUBLE) AS a, try_cast(r AS DOUBLE) AS b FROM x)
SELECT {_KEY}, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN abs(a - b) <= 1e-4 * abs(b) OR abs(a - b / 100) <= 1e-4 * abs(b / 100) OR abs(a - b * 100) <= 1e-4 * abs(b * 100) ELSE p = r END AS equal FROM n"""
)
def numeric_answer_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities, their hundredths, flags and remainders against quantities or a flag."""
    q, k = F.col("l_quantity"), F.col("l_linenumber") % 4
    p = F.when(k == 0, q.cast("string")).when(k == 1, (q / 100).cast("string")).when(k == 2, F.col("l_returnflag")).otherwise((F.col("l_partkey") % 60).cast("string"))
    r = F.when(F.col("l_linestatus") == "O", q.cast("string")).otherwise("R")
    return table(spark, sf_dir, "lineitem").select(*KEY, formats.numerically_equal(p, r).alias("equal"))


@query(f"WITH {TOKENS} SELECT event_id, CASE WHEN t = count(*) OVER (PARTITION BY user_id) - 1 THEN (user_id % 3)::DOUBLE ELSE 0 END AS reward FROM tok")
def reward_at_last_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("user_id"))
    return tokens(spark, sf_dir).select("event_id", formats.placed((F.col("user_id") % 3).cast("double"), F.col("t"), n).alias("reward"))


@query(f"SELECT {_KEY}, round(l_tax, 6) AS naive, round(l_tax + least(-(l_quantity - 40) / 10.0::DOUBLE, 0), 6) AS overlong FROM lineitem")
def reward_managers(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda name: F.round(formats.MANAGERS[name](F.col("l_tax"), F.col("l_quantity"), 50, 10), 6).alias(name)
    return table(spark, sf_dir, "lineitem").select(*KEY, of("naive"), of("overlong"))


@query("SELECT doc_id FROM documents WHERE len(list_filter(string_split(text, ' '), lambda w: w <> '')) <= 200")
def overlong_prompt_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of at most 200 words; the length is any expression."""
    return table(spark, sf_dir, "documents").where(F.size(F.filter(F.split("text", " "), lambda w: w != "")) <= 200).select("doc_id")


@query(f"WITH {TOKENS} SELECT round(avg(p), 6) AS perplexity FROM (SELECT exp(avg(-old) FILTER (mask)) AS p FROM tok GROUP BY user_id)")
def corpus_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = tokens(spark, sf_dir).groupBy("user_id").agg(F.exp(F.avg(F.when(F.col("mask"), -F.col("old")))).alias("p"))
    return per.agg(F.round(F.avg("p"), 6).alias("perplexity"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'A test failed; check the edge cases.' WHEN 'click' THEN 'Fix the syntax first.' ELSE '' END AS advice FROM events")
def error_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_type")
    return table(spark, sf_dir, "events").select("event_id", formats.feedback(F.when(k == "error", "AssertionError").when(k == "click", "SyntaxError").otherwise("None")).alias("advice"))


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \n]'), lambda x: x <> '') AS w FROM documents), h AS (SELECT doc_id, w[1:len(w) // 2] AS p, w[len(w) // 2 + 1:] AS c FROM w),
s AS (SELECT doc_id, side, list_concat(p, CASE side WHEN 'chosen' THEN c ELSE list_reverse(c) END) AS x, len(p) AS np, len(c) AS n FROM h, (SELECT unnest(['chosen', 'rejected']) AS side))
SELECT doc_id, side, md5(array_to_string(x, ' ')) AS parts, np::INT AS prompt_length, n > 0 AS wanted FROM s"""
)
def pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt (the first half of a text's words) and one side's part, as one array each: the other half for the
    chosen side, the same in reverse for the rejected one."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \n]", -1), lambda x: x != "").alias("w"))
    half = F.floor(F.size("w") / 2).cast("int")
    p, c = F.slice("w", F.lit(1), half), F.slice("w", half + 1, F.size("w") - half)
    sides = F.explode(F.array(F.struct(F.lit("chosen").alias("side"), c.alias("c")), F.struct(F.lit("rejected").alias("side"), F.reverse(c).alias("c"))))
    rows = d.select("doc_id", p.alias("p"), sides.alias("s"))
    return rows.select("doc_id", "s.side", F.md5(F.array_join(F.concat("p", "s.c"), " ")).alias("parts"), F.size("p").alias("prompt_length"), (F.size("s.c") > 0).alias("wanted"))


@query("SELECT event_id FROM events ORDER BY md5(event_id || 'shuffle') LIMIT 200")
def seeded_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample without replacement: the rows of the smallest hashes."""
    return table(spark, sf_dir, "events").orderBy(F.md5(F.concat(F.col("event_id").cast("string"), F.lit("shuffle")))).limit(200).select("event_id")
