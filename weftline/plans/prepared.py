"""Answer scoring, reasoning steps, fine-tuning data, tabular features and code metrics, bound to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import answers, steps
from weftline.operators import finetune, tabular
from weftline.plans.base import query, table
from weftline.plans.measures import rounded

# ---- responses made of events: text, truth

_RESP = """resp AS (SELECT event_id, user_id, CASE event_id % 4
 WHEN 0 THEN 'Let x = ' || (event_id % 9) || chr(10) || 'So 2 + 3 = 5' || chr(10) || '#### ' || (event_id % 5) || ',' || (100 + event_id % 3)
 WHEN 1 THEN 'It costs $' || (event_id % 50) || '. In all ' || (event_id % 5) || '.5 units.'
 WHEN 2 THEN 'First. Then (i.e. next) we see. Answer: $\\text{an} ' || (event_id % 6) || ' km$'
 ELSE '<answer>x</answer> so <answer>The ' || event_type || ', Event!</answer>' END AS text,
 CASE event_id % 4 WHEN 0 THEN '1' || (100 + event_id % 3) WHEN 2 THEN '3' WHEN 3 THEN 'click event' ELSE '2.5' END AS truth FROM events)"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    s = lambda c: c.cast("string")
    text = (
        F.when(e % 4 == 0, F.concat(F.lit("Let x = "), s(e % 9), F.lit("\nSo 2 + 3 = 5\n#### "), s(e % 5), F.lit(","), s(100 + e % 3)))
        .when(e % 4 == 1, F.concat(F.lit("It costs $"), s(e % 50), F.lit(". In all "), s(e % 5), F.lit(".5 units.")))
        .when(e % 4 == 2, F.concat(F.lit("First. Then (i.e. next) we see. Answer: $\\text{an} "), s(e % 6), F.lit(" km$")))
        .otherwise(F.concat(F.lit("<answer>x</answer> so <answer>The "), F.col("event_type"), F.lit(", Event!</answer>")))
    )
    truth = F.when(e % 4 == 0, F.concat(F.lit("1"), s(100 + e % 3))).when(e % 4 == 2, "3").when(e % 4 == 3, "click event").otherwise("2.5")
    return table(spark, sf_dir, "events").select("event_id", "user_id", text.alias("text"), truth.alias("truth"))


_RESP = _RESP.replace("\\\\", "\\")
_NUM = r"(\-?[0-9\.\,]+)"
_MARKED = rf"regexp_replace(regexp_extract_all(right(text, 300), '#### {_NUM}', 1)[-1], '[,$]', '', 'g')"
_LAST = rf"list_filter(regexp_extract_all(right(text, 300), '{_NUM}', 1), lambda x: x NOT IN ('', '.'))[-1]"


@query(f"WITH {_RESP}, x AS (SELECT event_id, truth, {_MARKED} AS strict, {_LAST} AS flexible FROM resp) SELECT event_id, strict, flexible, CASE WHEN strict IS NULL THEN 0.0::DOUBLE WHEN strict = truth THEN 1.0 ELSE 0.1 END AS score FROM x")
def gsm8k_extract_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return responses(spark, sf_dir).select("event_id", answers.marked_number(t).alias("strict"), answers.last_number(t).alias("flexible"), answers.number_score(t, F.col("truth"), format_score=0.1).alias("score"))


_WORDS = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))"
_TAGS = r"CASE WHEN len(regexp_extract_all(text, '(?s)<answer>(.*?)</answer>', 1)) > 1 THEN trim(regexp_extract_all(text, '(?s)<answer>(.*?)</answer>', 1)[-1]) END"


@query(f"WITH {_RESP}, x AS (SELECT event_id, truth, {_TAGS} AS a FROM resp) SELECT event_id, CASE WHEN a IS NULL THEN 0.0::DOUBLE WHEN {_WORDS.format('a')} = {_WORDS.format('truth')} THEN 1.0 ELSE 0.1 END AS em, CASE WHEN a IS NULL THEN 0.0::DOUBLE WHEN contains({_WORDS.format('a')}, {_WORDS.format('truth')}) THEN 1.0 ELSE 0.0 END AS sub_em FROM x")
def qa_em_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, y = F.col("text"), F.col("truth")
    return responses(spark, sf_dir).select("event_id", answers.exact_match(t, y, format_score=0.1).alias("em"), answers.exact_match(t, y, inside=True).alias("sub_em"))


def _fold_sql(column: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    a = f"string_split({column}, '=')[-1]"
    for x, y in [*answers.SUBSTITUTIONS, *((r, "") for r in answers.REMOVED)]:
        a = f"replace({a}, {quote(x)}, {quote(y)})"
    for p, r, g in ((r"(.*?)(\$)(.*?)(\$)(.*)", r"$\3$", ""), (r"(\\text\{)(.*?)(\})", r"\2", ""), (r"(\\textbf\{)(.*?)(\})", r"\2", ""), (r"(\\overline\{)(.*?)(\})", r"\2", ""), (r"(\\boxed\{)(.*)(\})", r"\2", ""), (r"(frac)([^{])(.)", r"frac{\2}{\3}", ""), (r"(sqrt)([^{])", r"sqrt{\2}", "")):
        a = f"regexp_replace({a}, {quote(p)}, {quote(r)}, 'g{g}')"
    return f"replace({a}, '$', '')"


@query(
    f"""WITH {_RESP}, x AS (SELECT event_id, truth, coalesce(regexp_extract_all(right(text, 300), '(?i)Answer\\s*:\\s*([^\\n]+)', 1)[-1], '[INVALID]') AS a FROM resp),
n AS (SELECT event_id, truth, {_fold_sql('a')} AS n FROM x), p AS (SELECT event_id, truth, trim(CASE WHEN regexp_full_match(replace(n, ',', ''), '[0-9]+') THEN replace(n, ',', '') ELSE n END) AS pred FROM n)
SELECT event_id, pred, CASE WHEN pred = truth THEN 1.0::DOUBLE ELSE -1.0 END AS score FROM p"""
)
def dapo_answer_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = answers.normalise_final(answers.stated_answer(F.col("text")))
    return responses(spark, sf_dir).select("event_id", pred.alias("pred"), "truth").select("event_id", "pred", F.when(F.col("pred") == F.col("truth"), 1.0).otherwise(-1.0).alias("score"))


_BOXED = r"""WITH p AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), q AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '<think>' || replace(t, chr(10), '</think>') ELSE t END AS t, string_split(string_split(t, ', ')[-1], '. ')[1] AS truth FROM p),
x AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN truth ELSE 'other' END AS truth, replace(replace(t, ', ', ' \boxed{'), '. ', '} ') AS t FROM q),
a AS (SELECT *, CASE WHEN contains(t, '\boxed{') THEN string_split(t, '\boxed{')[-1] END AS tail FROM x),
b AS (SELECT *, CASE WHEN regexp_matches(tail, '^(?:[^{}]|\{[^{}]*\})*\}') THEN regexp_extract(tail, '^((?:[^{}]|\{[^{}]*\})*)\}', 1) END AS answer FROM a)"""


@query(rf"{_BOXED} SELECT doc_id, md5(answer) AS answer, contains(t, '\boxed') AS in_format, round(0.9::DOUBLE * coalesce((answer = truth)::INT, 0) + 0.1::DOUBLE * regexp_matches(t, '(?s)^<think>.*</think>.*\\boxed\{{.*\}}')::INT, 6) AS geometry_score FROM b")
def format_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose commas open a box and whose stops close one; a third begin with a thought. Half of them have what
    stands after the last comma as the truth."""
    t = F.coalesce("text", F.lit(""))
    truth = F.when(F.col("doc_id") % 2 == 0, F.substring_index(F.substring_index(t, ", ", -1), ". ", 1)).otherwise("other")
    thought = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<think>"), F.replace(t, F.lit("\n"), F.lit("</think>")))).otherwise(t)
    boxed = F.replace(F.replace(thought, F.lit(", "), F.lit(" \\boxed{")), F.lit(". "), F.lit("} "))
    d = table(spark, sf_dir, "documents").select("doc_id", boxed.alias("t"), truth.alias("truth"))
    x = d.select("*", answers.unboxed(answers.last_boxed(F.col("t"))).alias("a"))
    score = 0.9 * F.col("a").eqNullSafe(F.col("truth")).cast("double") + 0.1 * answers.thinks_and_boxes(F.col("t")).cast("double")
    return x.select("doc_id", F.md5("a").alias("answer"), F.contains("t", F.lit("\\boxed")).alias("in_format"), F.round(score, 6).alias("geometry_score"))


_SOURCE = "CASE event_id % 4 WHEN 0 THEN 'grade_school' WHEN 1 THEN 'multiple_choice' WHEN 2 THEN 'competition' ELSE 'search_qa' END"


@query(
    f"""WITH {_RESP}, x AS (SELECT event_id, truth, {_SOURCE} AS source, {_MARKED} AS m, {_TAGS} AS a, coalesce(regexp_extract_all(right(text, 300), '(?i)Answer\\s*:\\s*([^\\n]+)', 1)[-1], '[INVALID]') AS s FROM resp),
y AS (SELECT source, CASE source WHEN 'grade_school' THEN coalesce((m = truth)::INT, 0) WHEN 'search_qa' THEN coalesce(({_WORDS.format('a')} = {_WORDS.format('truth')})::INT, 0) WHEN 'competition' THEN CASE WHEN {_fold_sql('s')} = truth THEN 1 ELSE -1 END ELSE 0 END AS score FROM x)
SELECT source, count(*) AS n, round(avg(score), 6) AS mean_score FROM y GROUP BY 1"""
)
def score_dispatch_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id") % 4
    source = F.when(e == 0, "grade_school").when(e == 1, "multiple_choice").when(e == 2, "competition").otherwise("search_qa")
    scored = responses(spark, sf_dir).withColumn("source", source)
    return scored.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(answers.dispatch(F.col("source"), F.col("text"), F.col("truth"))), 6).alias("mean_score"))


_ERROR = "replace(replace(replace(replace(coalesce(text, ''), 'sch', 'SyntaxError'), 'que', 'AssertionError'), 'ent', 'ModuleNotFoundError'), 'ti', 'Traceback')"


@query(
    f"""WITH e AS (SELECT doc_id, n_chars % 5 = 0 AS late, {_ERROR} AS e FROM documents)
SELECT doc_id, CASE WHEN late THEN 'Timeout' WHEN contains(e, 'SyntaxError') THEN 'SyntaxError' WHEN contains(e, 'AssertionError') THEN 'AssertionError' WHEN contains(e, 'ImportError') OR contains(e, 'ModuleNotFoundError') THEN 'ImportError'
 WHEN contains(e, 'Traceback') THEN 'RuntimeError' WHEN regexp_matches(e, '[^ \n\t\r]') THEN 'UnknownError' ELSE 'None' END AS error FROM e"""
)
def error_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as logs: some syllables stand for the names of errors."""
    err = F.coalesce("text", F.lit(""))
    for part, kind in {"sch": "SyntaxError", "que": "AssertionError", "ent": "ModuleNotFoundError", "ti": "Traceback"}.items():
        err = F.replace(err, F.lit(part), F.lit(kind))
    return table(spark, sf_dir, "documents").select("doc_id", answers.error_class(err, F.lit(None), F.col("n_chars") % 5 == 0).alias("error"))


# ---- reasoning steps

_LINES = r"list_filter(list_transform(list_filter(list_transform(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), lambda x: regexp_replace(regexp_replace(x, '(?i)^\s*(?:step\s*)?\d+[).:-]\s*', ''), '^\s*[-*]\s*', '')), lambda x: x <> '')"
_SENT = r"list_transform(list_filter(list_transform(string_split(regexp_replace(replace(replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), 'e.g.', 'e' || chr(1) || 'g' || chr(1)), 'i.e.', 'i' || chr(1) || 'e' || chr(1)), '([.!?])\s+', '\1' || chr(2), 'g'), chr(2)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), lambda x: replace(x, chr(1), '.'))"
_STEPS = f"st AS (SELECT event_id, CASE WHEN len({_LINES}) >= 2 THEN {_LINES} ELSE {_SENT} END AS s FROM resp)"
_KIND = r"CASE WHEN i = n OR regexp_matches(lower(step), 'answer|therefore|boxed') THEN 'conclusion' WHEN regexp_matches(lower(step), 'let |define|suppose|assume') THEN 'definition' WHEN contains(step, '=') AND regexp_matches(step, '[+\-*/^]') THEN 'equation_transform' WHEN regexp_matches(lower(step), 'so|thus|hence|because') THEN 'inference' ELSE 'explanation' END"


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = responses(spark, sf_dir).select("event_id", steps.split_steps(F.col("text")).alias("s"))
    return s.select("event_id", F.size("s").cast("long").alias("n"), F.posexplode("s").alias("i", "step")).withColumn("i", (F.col("i") + 1).cast("long"))


@query(f"WITH {_RESP}, {_STEPS} SELECT event_id, len(s) AS n_steps, array_to_string(s, '|') AS steps FROM st")
def split_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = responses(spark, sf_dir).select("event_id", steps.split_steps(F.col("text")).alias("s"))
    return s.select("event_id", F.size("s").cast("long").alias("n_steps"), F.array_join("s", "|").alias("steps"))


@query(f"WITH {_RESP}, {_STEPS}, e AS (SELECT event_id, len(s) AS n, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS step FROM st) SELECT event_id, i, {_KIND} AS kind FROM e")
def classify_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir).select("event_id", "i", steps.step_kind(F.col("step"), F.col("i"), F.col("n")).alias("kind"))


@query(f"WITH {_RESP}, {_STEPS}, e AS (SELECT event_id, unnest(range(1, len(s) + 1)) AS i FROM st) SELECT event_id, 's' || i AS node, CASE WHEN i > 1 THEN 's' || (i - 1) END AS depends_on FROM e")
def step_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = F.concat(F.lit("s"), F.col("i").cast("string"))
    return _steps(spark, sf_dir).select("event_id", node.alias("node"), F.lag(node).over(Window.partitionBy("event_id").orderBy("i")).alias("depends_on"))


@query(rf"WITH {_RESP} SELECT event_id, array_to_string(list_filter(list_transform(regexp_extract_all(text, '([A-Za-z0-9().\s+\-*/^=<>]+)', 1), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: regexp_matches(x, '[=+\-*/^]')), '|') AS formulas FROM resp")
def extract_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses(spark, sf_dir).select("event_id", F.array_join(steps.formulas(F.col("text")), "|").alias("formulas"))


@query("SELECT doc_id, ((length(t) - length(replace(t, '\\[', ''))) // 2 <> (length(t) - length(replace(t, '\\]', ''))) // 2)::INT + (((length(t) - length(replace(t, '$$', ''))) // 2) % 2)::INT AS issues FROM (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN '\\[ x' WHEN 1 THEN '$$ y \\[ z \\]' ELSE '' END AS t FROM documents)")
def latex_structure_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id") % 3
    t = F.concat("text", F.when(d == 0, "\\[ x").when(d == 1, "$$ y \\[ z \\]").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", steps.structure_issues(t).alias("issues"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'unknown' WHEN event_id % 5 + 2 = 4 THEN 'true' ELSE 'false' END AS holds FROM events")
def equation_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    eq = F.when(e % 3 == 2, "x = y").otherwise(F.concat((e % 5).cast("string"), F.lit(" + 2 = 2^2")))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(steps.equation_holds(eq).cast("string"), F.lit("unknown")).alias("holds"))


@query("SELECT event_id, round(CASE WHEN event_id % 2 = 0 THEN 1.0::DOUBLE ELSE 2.0 * 3 / 8 END, 6) AS ratio FROM events")
def sequence_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.when(F.col("event_id") % 2 == 0, "abcd").otherwise("bcde")
    return table(spark, sf_dir, "events").select("event_id", F.round(steps.similarity(F.lit("abcd"), other), 6).alias("ratio"))


# ---- fine-tuning data from conversations

_TURNS = "string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)"


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("t"))
    return c.select("conv_id", F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("turns"))


@query(f"SELECT conv_id, {_TURNS} AS rendered FROM conversations GROUP BY 1")
def chatml_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(spark, sf_dir).select("conv_id", finetune.render(F.col("turns")).alias("rendered"))


@query("SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '### Instruction:' || chr(10) || text || chr(10) || chr(10) || '### Response:' || chr(10) ELSE text || chr(10) || chr(10) END, '' ORDER BY turn) AS rendered FROM conversations GROUP BY 1")
def template_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(spark, sf_dir).select("conv_id", finetune.render_template(F.col("turns"), "alpaca").alias("rendered"))


@query(
    """WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS r, list(text ORDER BY turn) AS x FROM conversations GROUP BY 1), l AS (SELECT conv_id, CASE WHEN r[1] = 'system' THEN x[1] ELSE '' END AS system, CASE WHEN r[1] = 'system' THEN x[2:] ELSE x END AS x, CASE WHEN r[1] = 'system' THEN r[2:] ELSE r END AS r FROM c)
SELECT conv_id, system, (len(x) - 1)::INT AS n_prompt, coalesce(r[-1], '') AS response_role, coalesce(x[-1], '') AS response FROM l"""
)
def sharegpt_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    system, prompt, response = finetune.align_chat(F.col("turns"))
    out = chats(spark, sf_dir).select("conv_id", system.alias("system"), F.size(prompt).alias("n_prompt"), response.alias("r"))
    return out.select("conv_id", "system", "n_prompt", F.coalesce(F.get("r", F.lit(0))["role"], F.lit("")).alias("response_role"), F.coalesce(F.get("r", F.lit(0))["content"], F.lit("")).alias("response"))


@query(
    """WITH c AS (SELECT conv_id, list(role ORDER BY turn) FILTER (role <> 'system') AS r FROM conversations GROUP BY 1)
SELECT conv_id FROM c WHERE len(r) > 0 AND len(r) % 2 = 0 AND len(list_filter(range(1, len(r) + 1), lambda i: r[i] <> CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) = 0"""
)
def turn_parity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.filter(F.transform("turns", lambda m: m["role"]), lambda r: r != "system")
    return chats(spark, sf_dir).where(finetune.valid_turns(roles)).select("conv_id")


@query("SELECT item_id, 'user' AS role, 'Repeat this.' || CASE WHEN item_id % 3 = 0 THEN '' ELSE chr(10) || text END AS asked, text AS response, '' AS system FROM benchmark")
def alpaca_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    prompt, response, system = finetune.align_alpaca(F.lit("Repeat this."), F.when(F.col("item_id") % 3 == 0, "").otherwise(F.col("text")), F.col("text"))
    p = F.element_at(prompt, 1)
    return b.select("item_id", p["role"].alias("role"), p["content"].alias("asked"), F.element_at(response, 1)["content"].alias("response"), system.alias("system"))


@query("SELECT doc_id, md5(CASE WHEN quality = 1 THEN coalesce(text, '') ELSE '' END) AS first, md5(CASE WHEN quality = 1 THEN '' ELSE coalesce(text, '') END) AS second FROM labels JOIN documents USING (doc_id)")
def kto_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = table(spark, sf_dir, "labels").select("doc_id", "quality").join(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    r = finetune.align_tagged(F.col("text"), F.col("quality") == 1)
    return rated.select("doc_id", F.md5(r[0]["content"]).alias("first"), F.md5(r[1]["content"]).alias("second"))


@query("SELECT conv_id, turn, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), last_value(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS other FROM conversations")
def kto_shift_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finetune.shifted_pairs(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "other")


_CUT = "CASE WHEN t * 2 < 1000 THEN 1000 WHEN s * 2 < 1000 THEN 1000 - s ELSE floor(1000 * t / (s + t)::DOUBLE) END"


@query(f"WITH x AS (SELECT doc_id, n_chars % 3000 + 1 AS s, (n_chars * 7) % 2000 + 1 AS t FROM documents) SELECT doc_id, least(greatest(1000 - least({_CUT}, t), 0), s)::INT AS source_length, least({_CUT}, t)::INT AS target_length FROM x")
def truncate_infer_seqlen(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    s, t = finetune.budgets(n % 3000 + 1, (n * 7) % 2000 + 1, 1000)
    return table(spark, sf_dir, "documents").select("doc_id", s.alias("source_length"), t.alias("target_length"))


@query("SELECT doc_id, array_to_string(list_transform(range(8), lambda i: CASE WHEN i < k THEN doc_id * 10 + i ELSE 0 END), ',') AS ids, array_to_string(list_transform(range(k + 2), lambda i: CASE WHEN i < k THEN -100 ELSE i - k END), ',') AS labels FROM (SELECT doc_id, doc_id % 6 AS k FROM documents)")
def labels_and_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    k = d % 6
    source = F.transform(F.filter(F.sequence(F.lit(0), F.lit(5)), lambda i: i < k), lambda i: d * 10 + i)
    ids = finetune.padded(source, 8, 0)
    _, labels = finetune.labelled(source, F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))
    text = lambda a: F.array_join(a.cast("array<string>"), ",")
    return table(spark, sf_dir, "documents").select("doc_id", text(ids).alias("ids"), text(labels).alias("labels"))


@query(
    """WITH c AS (SELECT doc_id, lang, n_chars, sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id) AS e, floor(sum(n_chars) OVER (PARTITION BY lang) / 4096) * 4096 AS total FROM documents)
SELECT doc_id, ((e - n_chars) // 4096)::BIGINT AS first_block, ((e - n_chars) % 4096)::BIGINT AS "offset", greatest(least(e, total) - (e - n_chars), 0)::BIGINT AS kept FROM c"""
)
def concat_chunk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = finetune.blocks(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "lang", "doc_id", "n_chars", 4096)
    return b.select("doc_id", "first_block", "offset", "kept")


@query()
def knapsack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select((F.col("doc_id") / 1000).cast("long").alias("batch"), "doc_id", "n_chars")
    return finetune.pack_greedily(df, "batch", "doc_id", "n_chars", 8192)


@query("SELECT doc_id, 24576 * n_chars + n_chars * n_chars AS cost FROM documents")
def workload_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", finetune.workload(F.col("n_chars")).alias("cost"))


@query()
def balanced_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select((F.col("doc_id") / 1000).cast("long").alias("batch"), "doc_id", finetune.workload(F.col("n_chars")).alias("cost"))
    return finetune.partition_batches(df, "batch", "doc_id", "cost", 8)


@query()
def micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select((F.col("doc_id") / 1000).cast("long").alias("batch"), "doc_id", "n_chars")
    return finetune.micro_batches(df, "batch", "doc_id", "n_chars", 65536)


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 'search,' || event_type ELSE '' END AS calls FROM events")
def tool_call_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id") % 3
    text = F.when(e == 0, "<tool_call>{bad</tool_call>").when(e == 1, F.concat(F.lit('go <tool_call>\n{"name": "search", "arguments": "'), F.col("event_type"), F.lit('"}\n</tool_call>'))).otherwise("no call")
    calls = F.transform(finetune.tool_calls(text), lambda c: F.concat_ws(",", c["name"], c["arguments"]))
    return table(spark, sf_dir, "events").select("event_id", F.when(calls.isNotNull(), F.array_join(calls, ";")).alias("calls"))


@query(r"SELECT doc_id, length(t)::BIGINT AS n_before, md5(regexp_replace(t, '(?s)<think>.*?</think>[ \n]*', '', 'g')) AS text FROM (SELECT doc_id, replace(replace(coalesce(text, ''), ', ', ' <think>'), '. ', '</think>' || chr(10) || ' ') AS t FROM documents)")
def remove_thoughts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose commas open a thought and whose stops close one, so that some are opened twice or never closed."""
    t = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(", "), F.lit(" <think>")), F.lit(". "), F.lit("</think>\n "))
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", F.length("t").cast("long").alias("n_before"), F.md5(finetune.without_thoughts(F.col("t"))).alias("text"))


@query("SELECT conv_id, turn, role, text AS completion FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, length(text) DESC) AS n FROM conversations) WHERE n = 1")
def latest_best_turn_per_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = finetune.latest_best(table(spark, sf_dir, "conversations"), "conv_id", [F.desc("turn"), F.desc(F.length("text"))])
    return best.select("conv_id", "turn", "role", F.col("text").alias("completion"))


@query(r"SELECT conv_id, sum(CASE WHEN turn > 0 THEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) ELSE 0 END)::BIGINT AS words FROM conversations GROUP BY 1")
def future_turn_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.when(F.col("turn") > 0, words).otherwise(0)).cast("long").alias("words"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN source ELSE 'none' END AS question FROM documents")
def alias_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id") % 3
    q = finetune.first_of(F.when(d == 0, F.col("lang")).otherwise("  "), F.when(d == 1, F.col("source")), F.lit(" none "))
    return table(spark, sf_dir, "documents").select("doc_id", q.alias("question"))


@query("SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS responses FROM lineitem GROUP BY 1")
def attach_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"))).alias("x"))
    return g.select("l_orderkey", F.array_join(F.transform("x", lambda s: s["l_returnflag"]), ",").alias("responses"))


# ---- tabular

_NUMERIC = ["l_quantity", "l_discount", "l_tax"]
_K = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(
    """WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS q, l_tax AS t, 3.0::DOUBLE AS c FROM lineitem),
s AS (SELECT quantile_cont(q, 0.5) AS m, min(q) AS lo, max(q) AS hi, min(t) AS tl, max(t) AS th FROM v)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round((coalesce(q, m) - lo) / (hi - lo), 6) AS q, round((t - tl) / (th - tl), 6) AS t, 0.0::DOUBLE AS c FROM v, s"""
)
def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(*_K, F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("q"), F.col("l_tax").alias("t"), F.lit(3.0).alias("c"))
    return tabular.scaled(df, ["q", "t", "c"]).withColumns({c: F.round(c, 6) for c in ("q", "t", "c")})


@query("SELECT c_custkey, (dense_rank() OVER (ORDER BY CASE WHEN c_custkey % 10 = 0 THEN 'missing' ELSE c_mktsegment END) - 1)::INT AS code FROM customer")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")).alias("code"))
    return tabular.encoded(df, "code")


def _gate(name: str, column, expression: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tabular.gates(table(spark, sf_dir, "lineitem"), column(), _NUMERIC)

    run.__name__ = name
    query(
        f"""WITH g AS (SELECT {expression} AS x, l_quantity, l_discount, l_tax FROM lineitem), a AS (SELECT count(*) FILTER (x IS NULL) AS n_null, count(*) FILTER (isnan(x)) AS n_nan, count(*) FILTER (isinf(x)) AS n_infinite, min(x) < max(x) AS varies,
 bool_and(x IS NOT DISTINCT FROM l_quantity)::INT + bool_and(x IS NOT DISTINCT FROM l_discount)::INT + bool_and(x IS NOT DISTINCT FROM l_tax)::INT AS n_equal FROM g)
SELECT *, n_null + n_nan + n_infinite + n_equal = 0 AND varies AS passes FROM a"""
    )(run)


_gate("feature_gates", lambda: tabular.proposal(0, "l_quantity", "l_discount"), "CASE WHEN l_discount <> 0 THEN l_quantity / l_discount ELSE 0 END")
_gate("feature_gates_duplicate", lambda: F.col("l_tax") + 0.0, "l_tax + 0.0::DOUBLE")
_gate("feature_gates_null", lambda: F.when(F.col("l_linenumber") > 1, F.lit(2.0)), "CASE WHEN l_linenumber > 1 THEN 2.0::DOUBLE END")


@query(
    """WITH u AS (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS name, unnest([l_quantity, l_discount, l_tax]) AS v FROM lineitem)
SELECT name, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3, max(v) AS max FROM u GROUP BY 1"""
)
def describe_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tabular.profile(table(spark, sf_dir, "lineitem"), _NUMERIC))


@query()
def feature_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", *_NUMERIC, "l_returnflag")
    df = tabular.encoded(df, "l_returnflag")
    trace = tabular.search(df, _NUMERIC, "l_returnflag", "l_partkey")
    return spark.createDataFrame(trace, "round long, feature string, passes boolean, accuracy double, accepted boolean")


@query("SELECT CASE WHEN GROUPING(event_type) = 1 THEN 'ALL' ELSE event_type END AS category, count(*) AS n, round(avg((event_id % 3 = 0)::INT), 6) AS accuracy FROM events GROUP BY ROLLUP (event_type)")
def category_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "events").rollup("event_type").agg(F.grouping("event_type").alias("g"), F.count("*").alias("n"), F.round(F.avg((F.col("event_id") % 3 == 0).cast("double")), 6).alias("accuracy"))
    return out.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("event_type")).alias("category"), "n", "accuracy")



